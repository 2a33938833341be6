"""Similar titles against all pairs, chains of styles, and layers of settings against a plain merge."""

import difflib
import random

import pyarrow as pa
import pytest

from vellum.functions.text import fold
from vellum.operators import formats, settings, similarity, styles


def changed(rng, s):
    s = list(s)
    for _ in range(rng.randint(0, max(1, len(s) // 5))):
        at = rng.randrange(len(s))
        s[at : at + rng.randint(0, 2)] = rng.choice(["", "x", "yz", s[at].upper()])
    return "".join(s)


@pytest.fixture(scope="module")
def titles():
    rng = random.Random(9)
    words = ["".join(rng.choice("aeiostrnlmé") for _ in range(rng.randint(2, 9))) for _ in range(120)]
    known = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(250)] + ["", None, "a", "ab"]
    asked = [changed(rng, rng.choice(known[:250])) for _ in range(200)] + known[:20] + ["", None, "a", "zzzz", "ba"]
    return asked, known


def best_of(asked, known, least, fits=lambda x, y: True):
    out = {}
    for y in {a for a in asked if a}:
        found = [(-difflib.SequenceMatcher(None, x, y).ratio(), x) for x in {k for k in known if k} if fits(x, y)]
        if found and -min(found)[0] >= least:
            out[y] = (min(found)[1], -min(found)[0])
    return out


def test_strings_that_share_a_run(spark, titles):
    asked, known = titles
    runs = lambda s, q: {s[i : i + q] for i in range(max(1, len(s) - q + 1))}
    for least, q in ((0.75, 8), (0.6, 4)):
        got = similarity.share_a_run(spark.createDataFrame([(a,) for a in asked], "s string"), spark.createDataFrame([(k,) for k in known], "s string"), least, q)
        want = best_of(asked, known, least, lambda x, y: runs(x, q) & runs(y, q))  # noqa: B023
        assert {r["s"]: (r["best"], r["similarity"]) for r in got.collect()} == want


def test_frequent_runs_send_few_pairs(spark, monkeypatch):
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    known = ["proceedings of " + letters(rng.randint(20, 90)) for _ in range(900)]
    asked = [("on " if i % 2 else "") + "proceedings of " + letters(rng.randint(20, 90)) for i in range(600)] + [k[:-4] + "x" for k in known[:30]] + ["x" + k[3:] for k in known[30:60]]
    lists = [pa.table({"t": [t for t, n in rows for _ in range(n)], "at": [i for _, n in rows for i in range(n)]}) for rows in ([(t, len(t) - 7) for t in side] for side in (asked, known))]
    near = [t for t in similarity.near_of_runs(lists[0].append_column("least", pa.array([0.75] * lists[0].num_rows)), lists[1], 8)]
    pairs = {(x, y) for t in near for x, y in zip(t["x"].to_pylist(), t["y"].to_pylist())}
    assert len(pairs) < 2_000  # of 594,000 that have the run in common
    want = best_of(asked[-60:], known, 0.75)
    assert {y: x for x, y in pairs if want.get(y, ("",))[0] == x} == {y: x for y, (x, _) in want.items()}
    monkeypatch.setattr(similarity, "OFTEN", 100)
    monkeypatch.setattr(similarity, "STRINGS", 200)
    got = similarity.share_a_run(*[spark.createDataFrame([(t,) for t in side], "s string") for side in (asked[-60:] + known[:5], known)], 0.75)
    assert {r["s"]: (r["best"], r["similarity"]) for r in got.collect()} == want | {k: (k, 1.0) for k in known[:5]}


@pytest.mark.parametrize("block", [40, 2048])
def test_nearest_of_all(spark, titles, block, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", block)
    asked, known = titles
    got = similarity.nearest(spark.createDataFrame([(a,) for a in asked], "s string"), spark.createDataFrame([(k,) for k in known], "s string"), 0.6)
    assert {r["s"]: (r["best"], r["similarity"]) for r in got.collect()} == best_of(asked, known, 0.6)
    none = spark.createDataFrame([], "s string")
    assert similarity.nearest(none, none, 0.6).count() == 0
    assert similarity.nearest(spark.createDataFrame([("a",)], "s string"), none, 0.6).count() == 0


def test_titles_without_doi(spark):
    work = "doi string, title string, container string, volume string, year string"
    known = spark.createDataFrame([("10.1/b", "A robust approach to déjà vu", "J", "3", "2001"), ("10.1/a", "A Robust Approach to Deja Vu", "K", "", "2002"), ("10.1/c", None, "", "", "")], work)
    refs = spark.createDataFrame([(1, 0, "", "a robust aproach to Deja vu.", "?", "9", ""), (1, 1, "10.9/x", "A robust approach to déjà vu", "", "", ""), (2, 0, None, "to déjà vu", "", "", ""), (3, 0, "", None, "", "", "")], f"doc_id int, k int, {work}")
    got = {(r["doc_id"], r["k"]): (r["doi"], r["container"], r["volume"], r["year"], r["verified"]) for r in similarity.enrich_by_title(refs, known).collect()}
    assert got == {(1, 0): ("10.1/a", "K", "9", "2002", True), (1, 1): ("10.9/x", "", "", "", False), (2, 0): (None, "", "", "", False), (3, 0): ("", "", "", "", False)}
    assert spark.range(1).select(fold(similarity.F.lit("DÉJÀ"))).first()[0] == "deja"


def test_journals(spark):
    known = spark.createDataFrame([("Journal of Energy", "MDPI", "1"), ("journal of energy", "Acme", "2"), ("Journal of Energies", "Wiley", "3")], "title string, publisher string, issn string")
    asked = spark.createDataFrame([("Jornal of Energy ",), ("IEEE Access",), ("Cooking",), ("",), (None,)], "name string")
    got = {r["name"]: (r["title"], r["publisher"], r["preset"], r["source"]) for r in similarity.lookup_journals(asked, known).collect()}
    assert got == {"Jornal of Energy": ("Journal of Energy", "MDPI", "mdpi", "publisher"), "IEEE Access": ("IEEE Access", "", "ieee_journal", "name"), "Cooking": ("Cooking", "", None, "")}


def test_chains_of_styles(spark):
    chain = [("d", f"s{i}", f"s{i + 1}", True if i == 9 else None, True if i == 10 else None, True if i == 9 else None) for i in range(12)]
    loop = [("e", "a", "b", None, None, None), ("e", "b", "c", None, None, None), ("e", "c", "a", None, True, None), ("e", "self", "self", None, None, None), ("e", "odd", None, False, None, None), ("e", "lost", "nowhere", None, None, True)]
    table = spark.createDataFrame(chain + loop + [("e", "self", "self", None, None, None), ("e", None, "a", True, True, True)], "doc_id string, style string, based_on string, numbered boolean, caps boolean, hidden boolean")
    got = {(r["doc_id"], r["style"]): (r["numbered"], r["caps"], r["hidden"]) for r in styles.resolve(table).collect()}
    assert got["d", "s0"] == (True, None, None)  # the tenth style counts for numbering, for hiding the ninth is the last
    assert got["d", "s1"] == (True, True, True)
    assert got["e", "a"] == (None, True, None) and got["e", "b"] == (None, True, None)
    assert got["e", "self"] == (None, None, None) and got["e", "odd"] == (False, None, None) and got["e", "lost"] == (None, None, True)
    assert len(got) == 18
    own = spark.createDataFrame([("e", 0, "odd", None), ("e", 1, "odd", True), ("e", 2, None, None), ("x", 3, "a", None)], "doc_id string, pos int, style string, numbered boolean")
    p = styles.inherited(own, table, {"numbered": 10}).collect()
    assert {r["pos"]: r["numbered"] for r in p} == {0: False, 1: True, 2: False, 3: False}


def test_layers_equal_a_nested_merge(spark):
    over = [
        {"font": {"size": 9, "family": None}, "headings": {"levels": [{}, {"bold": False}, {"case": "upper"}]}},
        {"headings": {"levels": [{"size": 20}] * 6}, "page": {"margins_cm": [1, 2]}, "title": {"size": 3}},
        {"font": {"family": "X"}, "new": {"deep": {"er": 1}}, "limits": {"abstract_words": 5}},
    ]
    for preset in ("mdpi", "apa7", "ieee_conference"):
        docs = spark.createDataFrame([(1, preset), (2, "plos")], "doc_id int, preset string")
        layers = [spark.createDataFrame([(1, *row) for row in settings.flat(o)], "doc_id int, path string, value string") for o in over]
        got = {r["path"]: r["value"] for r in settings.for_documents(docs, layers).where("doc_id = 1").collect()}
        assert got == {p: v for p, v in settings.flat(formats.build(preset, *over)) if v is not None}


def test_values_and_groups_replace_each_other(spark):
    rows = [(0, "a.b", "1"), (0, "a.c[0].d", "2"), (1, "a", "3"), (2, "e.f.g", "4"), (0, "e", "5"), (0, "h.i", "6"), (1, "h", None), (0, "k", "7"), (0, "k.l", "8"), (1, None, "9")]
    got = settings.merge(spark.createDataFrame([(1, *r) for r in rows], "d int, layer int, path string, value string"), ["d"])
    assert {(r["path"], r["value"], r["layer"]) for r in got.collect()} == {("a", "3", 1), ("e.f.g", "4", 2), ("h.i", "6", 0), ("k.l", "8", 0)}
