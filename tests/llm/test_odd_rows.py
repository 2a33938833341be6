"""Rows of equal or null id, clashing column names and texts built against hashes, for the operators on documents."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import hashing, line_dedup, linking, ngram_join, spaced_seeds, suffix_sort, topk


def thue_morse(n, a="a", b="b"):
    word = [a if bin(i).count("1") % 2 else b for i in range(n)]
    return word, [b if x == a else a for x in word]


def long_text(seed, n=120):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 9))) for _ in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_built_texts_do_not_collide(spark, n):
    x, y = ("".join(w) for w in thue_morse(n))
    a, b = (" ".join(w) for w in thue_morse(n, "one", "two"))
    body = np.frombuffer((x + " " + y).encode(), np.uint8)
    assert len(set(hashing.words(body, np.array([0, len(body)]))[0])) == 2
    docs = spark.createDataFrame([(1, x), (2, y), (3, a), (4, b)], "doc_id bigint, text string")
    for words in (False, True):
        assert {r["n_removed"] for r in line_dedup.dedup_lines(docs, words=words).collect()} == {0}
    one_word = docs.where("doc_id < 3")
    assert {r["component_id"] for r in ngram_join.near_duplicates(one_word).collect()} == {1, 2}


def test_rows_of_one_id(spark):
    t, u = long_text(1), long_text(2)
    docs = spark.createDataFrame([(1, t), (1, u), (2, t), (None, u), (None, None)], "doc_id bigint, text string")
    clean = sorted((r["doc_id"] or 0, r["text"] or "", r["n_removed"]) for r in line_dedup.dedup_lines(docs).collect())
    assert clean == sorted([(0, "", 0), (0, u, 0), (1, "", 1), (1, t, 0), (2, "", 1)])
    near = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs.where("text IS NOT NULL")).collect())
    assert near == [(0, 116, 1), (1, 116, 1), (1, 116, 1), (2, 116, 1)]
    cut = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in suffix_sort.remove_repeats(docs).collect())
    assert cut == sorted((i or 0, len(x or ""), len(x or "")) for i, x in [(1, t), (1, u), (2, t), (None, u), (None, None)])
    alone = suffix_sort.remove_repeats(docs.where("doc_id = 2").unionByName(docs.where(F.col("doc_id") == 1)).where(F.col("text") != u).unionByName(spark.createDataFrame([(1, u)], "doc_id bigint, text string")))
    assert sorted((r["doc_id"], r["n_removed"]) for r in alone.collect()) == [(1, 0), (1, len(t)), (2, len(t))]
    kept = ngram_join.one_of_each(docs.withColumn("row", F.lit(7)))
    assert kept.columns == ["doc_id", "text", "row"]
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted([(0, ""), (1, t), (1, u)])
    bench = spark.createDataFrame([(None, " ".join(u.split()[:20])), (-1, "something else that nobody says in here at all ever again")], "item_id bigint, text string")
    held = sorted((r["doc_id"] or 0, r["n_items"], r["item_ids"]) for r in spaced_seeds.decontaminate(docs, bench).collect())
    assert held == [(0, 0, ""), (0, 1, "null"), (1, 0, ""), (1, 1, "null"), (2, 0, "")]
    left = spaced_seeds.clean_documents(docs, bench).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == sorted([(0, ""), (1, t), (2, t)])


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "same line\nown"), (2, "same line\nother")], "doc_id bigint, text string")
    for names in (["lines", "_key", "n_lines", "__row", "row"], ["N_REMOVED", "__maybe", "__LINES", "gone"]):
        more = docs.withColumns({name: F.lit(5) for name in names})
        got = line_dedup.dedup_lines(more)
        assert got.columns[: len(more.columns)] == more.columns
        assert {tuple(r) for r in got.select(*names).collect()} == {(5,) * len(names)}
        assert {r["text"] for r in got.collect()} == {"same line\nown", "other"}
        assert ngram_join.one_of_each(more).columns == more.columns
        assert spaced_seeds.clean_documents(more, docs.select(F.col("doc_id").alias("item_id"), "text").limit(0)).count() == 2


def test_live_postings_in_portions():
    rng = np.random.default_rng(0)
    key, ident, kind = (rng.integers(0, n, 5000).astype(np.uint64) for n in (900, 40, 2))
    for k in (2, 3):
        columns = [key, ident, kind][:k]
        portions = [[c[i : i + 300] for c in columns] for i in range(0, 5000, 300)]
        got = {tuple(int(x) for x in row) for made in linking.live_postings(iter(portions)) for row in zip(*made)}
        rows = {tuple(int(x) for x in row) for row in zip(*columns)}
        by_key: dict[int, set] = {}
        for row in rows:
            by_key.setdefault(row[0], set()).add(row)
        assert got == {r for group in by_key.values() if len({r[1] for r in group}) > 1 and (k == 2 or any(r[2] == 0 for r in group)) for r in group}


def test_vectors_that_cannot_be_compared(spark):
    df = spark.createDataFrame([(0, [0.5, 0.25]), (1, [0.5]), (50, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(ValueError, match="length"):
        topk.top_k(df)
    with pytest.raises(ValueError, match="too large"):
        topk.top_k(spark.createDataFrame([(0, [1e17, 0.0]), (1, [1e17, 1.0])], "vec_id bigint, embedding array<double>"))
    twice = spark.createDataFrame([(0, [0.5, 0.25]), (1, [0.5, 0.5]), (1, [0.5, 0.5])], "vec_id bigint, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in topk.top_k(twice).orderBy("rank").collect()] == [(1, 128 * 128 + 64 * 128)] * 2


def test_pipeline_on_odd_tables(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, lines int"
    t, u = long_text(5), long_text(6)
    tables = {"rows": [(1, t, "en", "s", 1, 2), (1, t, "en", "s", 1, 2), (None, u, "en", "s", 1, 2), (None, None, None, None, None, None), (2, "", "", "", 0, 0)], "none": []}
    for name, rows in tables.items():
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = sorted(r["doc_id"] or 0 for r in corpus_pipeline.run(spark, folder).collect())
        assert got == ([0, 0, 1, 2] if rows else [])


def test_counts_of_one_bucket():
    rng = np.random.default_rng(1)
    parts = [np.unique(rng.integers(0, 3000, 500).astype(np.uint64), return_counts=True) for _ in range(60)]
    for v, n in parts[:5]:
        got = ngram_join.unsqueeze(ngram_join.squeeze(v, n))
        assert (got[0] == v).all() and (got[1] == n).all()
    values, counts = ngram_join.tally(iter(parts), at_least=700)
    want = Counter()
    for v, n in parts:
        want.update(dict(zip(v.tolist(), n.tolist())))
    assert dict(zip(values.tolist(), counts.tolist())) == want and (np.diff(values.astype(np.int64)) > 0).all()
