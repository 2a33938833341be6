"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over a few neighbouring words: the words at its places are hashed, those between are ignored,
so a substituted word there changes nothing. Every mask is applied at every place of the test items and of the
documents; equal hashes propose an alignment (item, document, distance), which is then verified over the whole item:
a document holds an item if some WINDOW aligned words (the whole item, if it is shorter) differ in at most ALLOWED
words; a word that the document lacks counts as different. The three masks together hit every window of 13 words with any 3 of them substituted (tested exhaustively), so
no such overlap is missed. Items of 9 to 12 words allow one substitution, shorter ones none (a mask of all their words
finds those).

Words: A-Z lower-cased, split at ASCII white space. The items are taken in parts of at most `part_bytes` bytes of text,
each part sent with the code and matched in one pass over the documents, so what is sent stays bounded however
large the benchmark is. Within a task only hits become rows; there is no shuffle of documents.

Nulls: null or empty texts and items without words hold nothing and match nothing; an item without an id is reported as
null. Repeated items are reported under each of their ids; rows of equal or null id are documents of their own. Texts of
any length are taken whole. An empty benchmark leaves every document clean. Only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import hashing, linking
from vellum.llm.common import flat_bytes, fresh, row_slices, text_column, with_row_key

WINDOW, ALLOWED = 13, 3
#: The places of each mask.
MASKS = ((0, 1, 2, 4, 5), (0, 2, 5, 6, 7), (0, 1, 5, 7, 8))
SPAN = 1 + max(m[-1] for m in MASKS)


def allowed(n_words: int) -> int:
    return ALLOWED if n_words >= WINDOW else int(n_words >= SPAN)


class Seeds:
    """The seeds of some test items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        body, offsets = flat_bytes(pa.array([t for _, t in items], pa.string()))
        h, rows, _, _ = hashing.words(body, offsets)
        begin = np.searchsorted(rows, np.arange(len(items) + 1))
        self.words = [h[a:b] for a, b in zip(begin, begin[1:])]
        self.masks: list[tuple[tuple[int, ...], np.ndarray, np.ndarray, np.ndarray]] = []
        for mask in (*MASKS, *(tuple(range(n)) for n in range(1, SPAN))):
            whole = mask == tuple(range(len(mask))) and mask not in MASKS
            seeds, owner, place = [], [], []
            for i, w in enumerate(self.words):
                if whole and len(w) == len(mask):
                    at = np.zeros(1, np.int64)
                elif not whole and len(w) >= SPAN:
                    at = np.arange(len(w) - mask[-1])
                else:
                    continue
                seeds.append(hashing.combine([w[at + p] for p in mask], len(mask)))
                owner.append(np.full(len(at), i))
                place.append(at)
            if seeds:
                s, o, p = np.concatenate(seeds), np.concatenate(owner), np.concatenate(place)
                order = np.argsort(s, kind="stable")
                self.masks.append((mask, s[order], o[order], p[order]))
        # one bit a hash prefix: most places of the documents go no further
        self.filters = []
        for _, s, _, _ in self.masks:
            bits = np.zeros(1 << 22, bool)
            bits[(s >> np.uint64(42)).astype(np.int64)] = True
            self.filters.append(bits)

    def holds(self, h: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item, first word, end) of the verified overlaps; words counted over all rows."""
        found = []
        for (mask, seeds, owner, place), bits in zip(self.masks, self.filters):
            n = len(h) - mask[-1]
            if n <= 0:
                continue
            own = hashing.combine([h[p : p + n] for p in mask], len(mask))
            at = np.flatnonzero(bits[(own >> np.uint64(42)).astype(np.int64)])
            at = at[rows[at] == rows[at + mask[-1]]]
            lo, hi = np.searchsorted(seeds, own[at], "left"), np.searchsorted(seeds, own[at], "right")
            many = hi - lo
            if many.any():
                who = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                here = np.repeat(at, many)
                found.append(np.stack([rows[here], owner[who], here - place[who]], 1))
        if not found:
            return []
        out = []
        for row, item, start in np.unique(np.concatenate(found), axis=0):
            w = self.words[item]
            a, b = max(0, -start), min(len(w), len(h) - start)
            same = (h[start + a : start + b] == w[a:b]) & (rows[start + a : start + b] == row)
            full = np.zeros(len(w), np.int64)
            full[a:b] = same
            size = min(WINDOW, len(w))
            sums = np.concatenate([[0], np.cumsum(full)])
            good = np.flatnonzero(sums[size:] - sums[:-size] >= size - allowed(len(w)))
            if len(good):
                out.append((int(row), int(item), int(start + good[0]), int(start + good[-1] + size)))
        return out


def overlaps(docs: DataFrame, benchmark: DataFrame, part_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, item_id, first_word, end_word: each document and item that overlap (the stretch of the first alignment found)."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), text_column().alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / part_bytes))
    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_column().alias("text"))
    out = None
    for part in range(parts):
        some = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        rows = sorted(((r["item_id"], r["text"]) for r in some.collect()), key=lambda r: (r[0] is not None, *r) if r[0] is not None else (False, 0, r[1]))
        found = picked.mapInArrow(matcher(rows), "doc_id bigint, item_id bigint, first_word bigint, end_word bigint")
        out = found if out is None else out.unionByName(found)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, each judged by itself."""
    key = fresh(docs, "row")
    keyed, _ = with_row_key(docs, key)
    found = overlaps(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark)
    return linking.without(keyed, key, found.select(F.col("doc_id").alias(key))).drop(key)


def matcher(items: list[tuple[int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Seeds(items)
        for b in batches:
            body, offsets = flat_bytes(b.column(1))
            for first, last in row_slices(offsets, hashing.SLICE):
                own = offsets[first : last + 1] - offsets[first]
                h, rows, _, _ = hashing.words(body[offsets[first] : offsets[last]], own)
                got = seeds.holds(h, rows) if seeds.masks else []
                if got:
                    begin = np.searchsorted(rows, np.arange(last - first + 1))
                    row, item, start, end = (np.array(x, np.int64) for x in zip(*got))
                    ids = b.column(0).take(pa.array(row + first))
                    columns = [ids, pa.array([seeds.ids[i] for i in item], pa.int64()), pa.array(start - begin[row]), pa.array(end - begin[row])]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "first_word", "end_word"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_items that it holds, item_ids (ascending, joined by commas, "null" for an item without an
    id), contaminated."""
    docs, _ = with_row_key(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "row")
    found = overlaps(docs.select(F.col("row").alias("doc_id"), "text"), benchmark)
    hits = found.groupBy(F.col("doc_id").alias("row")).agg(F.array_sort(F.collect_set(F.struct("item_id"))).alias("items"))
    joined = docs.select("row", "doc_id").join(hits, "row", "left")
    names = F.transform("items", lambda x: F.coalesce(x["item_id"].cast("string"), F.lit("null")))
    return joined.select(
        "doc_id",
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce(F.array_join(names, ","), F.lit("")).alias("item_ids"),
        F.col("items").isNotNull().alias("contaminated"),
    )
