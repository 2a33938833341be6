"""The most similar string of an authority table: works by title, journals by name.

Similarity is twice the letters of the matching blocks over the letters of both strings, where the longest common run is
the first block and the parts before and after it are treated alike; difflib measures it, for candidates that Spark
brings together. Strings are compared once each, however many rows have them. Two ways to candidates:

- `share_a_run`: strings that have a run of `q` letters in common meet in groups of such runs, and pairs whose length, letters and
  longest common subsequence let them reach the threshold are measured. Frequent runs make many pairs; these are bounded in
  arrays inside the groups and no row is sent for them. For authorities of any size; two strings without a common run of q
  letters are no candidates.
- `nearest`: each string against the whole authority, in blocks of both, probed from the highest bound on; the bound by the
  bag of letters ends the search as soon as nothing better can follow. Exact, for authorities such as lists of journals:
  the work is the product of both numbers of different strings, without a row for any pair.

Ties go to the smallest string of the authority. Null and empty strings match nothing, nor do they serve as authority.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import fold
from vellum.operators.specs import preset_for

#: Cells of a bag of letters, by code point; a bound needs no cell of its own for each letter.
CELLS = 64
#: Strings of a block, on both sides.
BLOCK = 2048
#: Authority strings for each group of runs; of one run in one group; pairs that are bounded at once; letters from which on a pair goes
#: to difflib without its longest common subsequence. They change no result.
STRINGS, OFTEN, PAIRS, LONG = 512, 4096, 1 << 18, 512


def judged(pairs: DataFrame, least: float) -> DataFrame:
    """similarity of the pairs (x, y, ...) that reach `least`; the bounds by length and by bag come before the whole measure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                m = difflib.SequenceMatcher(None, x, y)
                ok = m.real_quick_ratio() >= least and m.quick_ratio() >= least
                found.append(m.ratio() if ok else 0.0)
            out = pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], names=[*b.schema.names, "similarity"])
            yield out.filter(pa.array([s >= least for s in found], pa.bool_()))

    schema = ", ".join(f"`{n}` {t}" for n, t in pairs.dtypes)
    return pairs.mapInArrow(run, f"{schema}, similarity double")


def cells_of(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of each string as cells of a bag, filled up with a cell of no letter, and the lengths."""
    size = np.array([len(s) for s in strings], np.int64)
    out = np.full((len(strings), int(size.max(initial=1))), CELLS, np.int16)
    for i, s in enumerate(strings):
        out[i, : len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) % CELLS
    return out, size


def bag_of(cells: np.ndarray) -> np.ndarray:
    """How many letters of each string fall into each cell."""
    out = np.zeros((len(cells), CELLS + 1), np.uint8 if cells.shape[1] < 256 else np.int32)
    each = np.arange(len(cells))
    for at in range(cells.shape[1]):
        out[each, cells[:, at]] += 1
    return np.ascontiguousarray(out[:, :CELLS])


def places_of(cells: np.ndarray) -> np.ndarray:
    """Where each cell stands in each string, a bit a place, 64 places a word."""
    words = -(-cells.shape[1] // 64)
    out = np.zeros((len(cells), CELLS + 1, words), np.uint64)
    each = np.arange(len(cells))
    for at in range(cells.shape[1]):
        out[each, cells[:, at], at // 64] |= np.uint64(1 << at % 64)
    out[:, CELLS] = 0
    return out


def common_letters(places: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Letters of a longest common subsequence of the pairs, by bits: places[k] of the one string, cells[k] of the other."""
    v = np.full((places.shape[2], len(places)), ~np.uint64(0))
    each = np.arange(len(places))
    for at in range(cells.shape[1]):
        hit = places[each, cells[:, at]]
        carry = np.zeros(len(places), np.uint64)
        for w in range(len(v)):
            u = v[w] & hit[:, w]
            part = v[w] + u
            total = part + carry
            v[w] = total | (v[w] & ~u)
            carry = ((part < u) | (total < part)).astype(np.uint64)
    return (64 - np.bitwise_count(v).astype(np.int64)).sum(0)


def near_of_runs(ours: pa.Table, theirs: pa.Table, q: int) -> Iterator[pa.Table]:
    """x of theirs, y of ours, bound: the different pairs that have a run in common at the given places (t, at) and whose length,
    bag and longest common subsequence let them reach what ours ask for (least): common runs in order have no more letters than either
    tells. Where the letters before the run are equal too, the pair is met at the run that begins there."""
    text, at, least = (ours.column(c).to_pylist() for c in ("t", "at", "least"))
    other, there = (theirs.column(c).to_pylist() for c in ("t", "at"))
    codes: dict[str, int] = {}
    of_run = np.array([codes.setdefault(t[k : k + q], len(codes)) for t, k in zip(other, there)], np.int64)
    asked = np.array([codes.get(s[k : k + q], -1) for s, k in zip(text, at)], np.int64)
    own, known = {s: i for i, s in enumerate(dict.fromkeys(text))}, {t: i for i, t in enumerate(dict.fromkeys(other))}
    i_of, j_of = np.array([own[s] for s in text], np.int64), np.array([known[t] for t in other], np.int64)
    need = np.zeros(len(own))
    need[i_of] = least
    order = np.argsort(of_run, kind="stable")
    j_of, ends = j_of[order], np.searchsorted(of_run[order], np.arange(len(codes) + 1))
    rows = np.flatnonzero(asked >= 0)
    begin, many = ends[asked[rows]], ends[asked[rows] + 1] - ends[asked[rows]]
    before = np.array([ord(s[k - 1]) if k else -1 for s, k in zip(text, at)], np.int64)
    prior = np.array([ord(t[k - 1]) if k else -2 for t, k in zip(other, there)], np.int64)[order]
    mine, known = pa.array(own, pa.string()), pa.array(known, pa.string())
    (a, n), (b, m) = cells_of(list(own)), cells_of(known.to_pylist())
    bag_a, bag_b = bag_of(a), bag_of(b)
    parts = np.searchsorted(np.cumsum(many), np.arange(PAIRS, int(many.sum()) + PAIRS, PAIRS)) + 1
    last = 0
    for end in np.minimum(parts, len(rows)):
        k, here = many[last:end], slice(last, end)
        within = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        row, place = np.repeat(rows[here], k), np.repeat(begin[here], k) + within
        begins = before[row] != prior[place]
        both = np.unique(i_of[row[begins]] * len(known) + j_of[place[begins]])
        last = end
        for i, j in ((both[f : f + PAIRS // 8] // len(known), both[f : f + PAIRS // 8] % len(known)) for f in range(0, len(both), PAIRS // 8)):
            bound = 2.0 * np.minimum(n[i], m[j]) / (n[i] + m[j])
            i, j = i[bound >= need[i]], j[bound >= need[i]]
            bound = 2.0 * np.minimum(bag_a[i], bag_b[j]).sum(1, dtype=np.int64) / (n[i] + m[j])
            i, j, bound = (c[bound >= need[i]] for c in (i, j, bound))
            short = np.flatnonzero(np.maximum(n[i], m[j]) <= LONG)
            if len(short):
                si, sj = i[short], j[short]
                different, back = np.unique(si, return_inverse=True)
                places = places_of(a[different, : int(n[si].max())])
                bound[short] = 2.0 * common_letters(places[back], b[sj, : int(m[sj].max())]) / (n[si] + m[sj])
            i, j, bound = (c[bound >= need[i]] for c in (i, j, bound))
            yield pa.table({"x": known.take(pa.array(j)), "y": mine.take(pa.array(i)), "bound": pa.array(bound, pa.float64())})


def at_runs(strings: DataFrame, name: str, q: int) -> DataFrame:
    """Each string with the places (from 0) of its different runs of q letters."""
    each = strings.select(F.col(name).alias("t"), F.explode(F.sequence(F.lit(0), F.greatest(F.char_length(name) - q, F.lit(0)))).alias("at"))
    return each.withColumn("run", F.xxhash64(F.substring("t", F.col("at") + 1, q)))


def share_a_run(strings: DataFrame, authority: DataFrame, least: float, q: int = 8) -> DataFrame:
    """s, best, similarity of the different strings (s) for which an authority string (best) reaches `least`. Strings that the
    authority has are their own best; the others meet it in groups of runs, where bounds come before any row is made."""
    theirs = authority.select(F.col("s").alias("best")).where("best <> ''").distinct()
    asked = strings.select("s").where("s <> ''").distinct().join(theirs.withColumn("has", F.lit(True)), F.col("s") == F.col("best"), "left").select("s", "has")
    ours = asked.where("has IS NULL")
    x, y = at_runs(ours, "s", q), at_runs(theirs, "best", q)
    # a run of very many authority strings is parted among groups
    often = y.groupBy("run").count().where(F.col("count") > OFTEN).select("run", F.ceil(F.col("count") / OFTEN).cast("int").alias("parts"))
    x, y = (side.join(F.broadcast(often), "run", "left").withColumn("parts", F.coalesce("parts", F.lit(1))) for side in (x, y))
    x = x.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    y = y.withColumn("part", F.pmod(F.xxhash64("t"), F.col("parts")).cast("int"))
    groups = max(1, math.ceil(theirs.count() / STRINGS))
    x, y = (side.select(F.pmod("run", F.lit(groups)).alias("g"), "part", "t", "at") for side in (x, y))
    none = pa.table({"x": pa.array([], pa.string()), "y": pa.array([], pa.string()), "bound": pa.array([], pa.float64())})

    def met(asks: DataFrame, top: bool) -> DataFrame:
        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            found = pa.concat_tables([none, *near_of_runs(left, right, q)]) if left.num_rows and right.num_rows else none
            if not top:
                return found
            first = found.sort_by([("bound", "descending")]).group_by("y", use_threads=False).aggregate([("x", "first"), ("bound", "first")])
            return first.select(["x_first", "y", "bound_first"]).rename_columns(["x", "y", "bound"])

        return asks.groupBy("g", "part").cogroup(y.groupBy("g", "part")).applyInArrow(meet, "x string, y string, bound double")

    # what a likely string reaches is the least that others have to
    likely = met(x.withColumn("least", F.lit(float(least))), True).groupBy("y").agg(F.max_by("x", F.struct("bound", "x")).alias("x"))
    reached = judged(likely.select("x", "y"), least).select(F.col("y").alias("t"), F.col("similarity").alias("least"))
    asks = x.join(reached, "t", "left").withColumn("least", F.coalesce("least", F.lit(float(least))))
    pairs = met(asks, False).select("x", "y").distinct()
    found = judged(pairs, least).select(F.col("y").alias("s"), F.col("x").alias("best"), "similarity")
    return closest(found).unionByName(asked.where("has").select("s", F.col("s").alias("best"), F.lit(1.0).alias("similarity")).where(F.lit(least <= 1.0)))


def closest(found: DataFrame) -> DataFrame:
    """For each s the most similar string, the smallest of equally similar ones."""
    top = found.groupBy("s").agg(F.min_by(F.struct("best", "similarity"), F.struct(-F.col("similarity"), F.col("best"))).alias("top"))
    return top.select("s", "top.best", "top.similarity")


def bags(strings: list[str]) -> np.ndarray:
    """How many letters of each string fall into each cell."""
    out = np.zeros((len(strings), CELLS), np.int32)
    for i, s in enumerate(strings):
        out[i] = np.bincount(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) % CELLS, minlength=CELLS)
    return out


def nearest_of_block(ours: list[str], theirs: list[str], least: float) -> list[tuple[str, str, float]]:
    """Of each of our strings the nearest of theirs, if it reaches `least`, probed from the highest bound on."""
    if not theirs:
        return []
    theirs = sorted(theirs)
    bag, size, out = bags(theirs), np.array([len(t) for t in theirs]), []
    for s, own in zip(ours, bags(ours)):
        bound = 2 * np.minimum(own, bag).sum(1) / (size + len(s))
        best, at = least, -1
        m = difflib.SequenceMatcher(None, "", s)
        for j in np.argsort(-bound, kind="stable"):
            if bound[j] < best:
                break
            m.set_seq1(theirs[j])
            got = m.ratio()
            if got > best or (got == best and (at < 0 or j < at)):
                best, at = got, int(j)
        if at >= 0:
            out.append((s, theirs[at], best))
    return out


def nearest(strings: DataFrame, authority: DataFrame, least: float) -> DataFrame:
    """As share_a_run, over the whole authority."""
    ours = strings.select("s").where("s <> ''").distinct()
    theirs = authority.select("s").where("s <> ''").distinct()
    blocks = [max(1, math.ceil(t.count() / BLOCK)) for t in (ours, theirs)]
    dealt = [t.withColumn(c, F.pmod(F.xxhash64("s"), F.lit(n)).cast("int")) for t, c, n in zip((ours, theirs), "gh", blocks)]
    every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in blocks]
    left, right = dealt[0].withColumn("h", every[1]), dealt[1].withColumn("g", every[0])

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        rows = nearest_of_block(x.column("s").to_pylist(), y.column("s").to_pylist(), least)
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["s", "best", "similarity"])

    found = left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(meet, "s string, best string, similarity double")
    return closest(found)


def enrich_by_title(refs: DataFrame, authority: DataFrame, least: float = 0.75, q: int = 8) -> DataFrame:
    """refs (doc_id, k, doi, title, container, volume, year) without a DOI take what an authority table (doi, title, container,
    volume, year) has under the most similar title, if that reaches `least` and has 20 letters or more; of equal titles, the
    entry of the smallest DOI. Letters are compared without case or marks. `verified` tells which rows did."""
    fields = ["title", "container", "volume", "year"]
    known = authority.withColumn("_s", fold(F.col("title"))).groupBy("_s").agg(F.min_by(F.struct("doi", *fields), "doi").alias("_of"))
    asked = F.when((F.coalesce("doi", F.lit("")) == "") & (F.char_length("title") >= 20), fold(F.col("title")))
    named = refs.withColumn("_s", asked)
    found = share_a_run(named.select(F.col("_s").alias("s")), known.select(F.col("_s").alias("s")), least, q)
    best = found.join(known, found["best"] == known["_s"]).select(F.col("s").alias("_s"), "_of", "similarity")
    j = named.join(best, "_s", "left")
    filled = [F.coalesce(F.nullif(F.col(f"_of.{c}"), F.lit("")), F.col(c)).alias(c) for c in fields]
    return j.select("doc_id", "k", F.coalesce(F.col("_of.doi"), F.col("doi")).alias("doi"), *filled, "similarity", F.col("_of").isNotNull().alias("verified"))


def lookup_journals(names: DataFrame, journals: DataFrame, least: float = 0.6) -> DataFrame:
    """For each different name: the journal (title, publisher, issn) of the most similar title, if it is more similar than
    `least`, and the preset that the name itself or else publisher and title point to; where none is similar the name is
    its own title. Of journals of one title (case aside), the one of the smallest publisher and issn."""
    name = names.select(F.trim("name").alias("name")).where("name <> ''").distinct().withColumn("_s", F.lower("name"))
    known = journals.withColumn("_t", F.lower("title")).groupBy("_t").agg(F.min(F.struct("title", "publisher", "issn")).alias("_of"))
    found = nearest(name.select(F.col("_s").alias("s")), known.select(F.col("_t").alias("s")), least).where(F.col("similarity") > least)
    best = found.join(known, found["best"] == known["_t"]).select(F.col("s").alias("_s"), "_of", "similarity")
    j = name.join(best, "_s", "left")
    text = lambda c: F.coalesce(F.col(f"_of.{c}"), F.lit(""))
    own, by_publisher = preset_for(F.col("name")), preset_for(F.concat_ws(" ", text("publisher"), text("title")))
    source = F.when(own.isNotNull(), "name").when(F.col("_of").isNotNull() & by_publisher.isNotNull(), "publisher").otherwise("")
    return j.select("name", F.coalesce("_of.title", "name").alias("title"), text("publisher").alias("publisher"), text("issn").alias("issn"), "similarity", F.coalesce(own, F.when(F.col("_of").isNotNull(), by_publisher)).alias("preset"), source.alias("source"))
