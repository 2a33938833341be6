"""Exact top-k by inner product over a bit-sliced index.

Vectors are quantised: component x becomes floor(256 * x), a small integer v. The index keeps the upper bits of each
attribute, u = (v >> SHIFT) - low >= 0, as one bitmap a bit (slice) over a block of rows. For a query q the sum over
attributes of q_d * u_d is added up with bitmap arithmetic alone: every set bit j of |q_d| puts the slices of u_d (or
their complements where q_d is negative) with weight 2^(j+b) on the heap of that weight, and carry-save adders reduce
each heap to one slice of the score, three bitmaps to a sum and a carry. Rows are then selected from the most
significant slice downward: first the k-th best approximate score, then all rows within twice the error bound of it.
What the lower bits can add is bounded by |q| * |rest| (Cauchy-Schwarz), so these boundary rows hold every true answer;
their scores are taken exactly from the stored integers. Nothing is approximate in the result.

Equal vectors of a block are kept once with their k + 1 smallest ids, enough for any query with itself left out, so
ties of thousands of copies cost one row.

Queries and candidates meet in blocks: the rows are dealt into groups by a hash of their id and the queries into
blocks, and each (group, query block) is one bounded task. Nulls: a vector that is null, holds a null or a non-finite
component takes no part. A null id takes no part. Ties go to the smaller id. Repeated ids are candidates as often as
they occur. Empty tables give an empty result. Vectors of different length, and components so large that a score could
leave 64 bits, raise an error before the search. Only the id and the vector are read, so other columns may have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SHIFT = 3
BLOCK = 4096
#: Rows of a group and of a query block: what one task holds at once.
GROUP_ROWS, QUERY_ROWS = 16_384, 1_024


def quantise(vectors: np.ndarray) -> np.ndarray:
    return np.floor(256.0 * vectors.astype(np.float64)).astype(np.int64)


class Block:
    """The index of up to BLOCK distinct integer vectors."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.n = rows, len(rows)
        upper = rows >> SHIFT
        self.low = int(upper.min())
        u = upper - self.low
        self.bits = max(1, int(u.max()).bit_length())
        self.top = (1 << self.bits) - 1
        rest = (rows - (upper << SHIFT)) - ((1 << SHIFT) - 1) / 2
        self.rest = float(np.sqrt((rest * rest).sum(1).max()))
        words = (self.n + 63) // 64
        padded = np.zeros((words * 64, rows.shape[1]), np.int64)
        padded[: self.n] = u
        self.slices = np.stack([pack(((padded >> b) & 1).astype(bool).T) for b in range(self.bits)], 1)  # attribute, bit, word
        self.present = pack((np.arange(words * 64) < self.n)[None])[0]

    def scores(self, q: np.ndarray) -> np.ndarray:
        """Slices, least significant first, of sum |q_d| * (u_d or its complement): the score of the upper bits but for a constant."""
        size = np.abs(q)
        heaps: dict[int, list[np.ndarray]] = {}
        for sign, flip in ((q > 0, False), (q < 0, True)):
            for j in range(int(size.max()).bit_length()):
                at = np.flatnonzero(sign & ((size >> j) & 1).astype(bool))
                if len(at):
                    for b in range(self.bits):
                        part = self.slices[at, b]
                        heaps.setdefault(j + b, []).append(~part if flip else part)
        out, weight = [], 0
        while weight in heaps or any(w > weight for w in heaps):
            heap = np.concatenate(heaps.pop(weight)) if weight in heaps else self.present[None] & np.uint64(0)
            while len(heap) > 1:
                if len(heap) == 2:
                    total, carry, left = heap[:1] ^ heap[1:], heap[:1] & heap[1:], heap[:0]
                else:
                    m = len(heap) // 3
                    a, b, c = heap[:m], heap[m : 2 * m], heap[2 * m : 3 * m]
                    ab = a ^ b
                    total, carry, left = ab ^ c, (a & b) | (ab & c), heap[3 * m :]
                heaps.setdefault(weight + 1, []).append(carry)
                heap = np.concatenate([total, left])
            out.append(heap[0])
            weight += 1
        return np.array(out)

    def select(self, slices: np.ndarray, k: int, error: float) -> np.ndarray:
        """Rows whose approximate score is within twice the error of the k-th best one."""
        if self.n <= k:
            return np.arange(self.n)
        sure, equal, best = np.zeros_like(self.present), self.present.copy(), 0
        for weight in range(len(slices) - 1, -1, -1):
            above = sure | (equal & slices[weight])
            if int(np.bitwise_count(above).sum()) >= k:
                equal &= slices[weight]
                best |= 1 << weight
            else:
                sure = above
                equal &= ~slices[weight]
        bound = best - math.ceil(2 * error)
        if bound <= 0:
            return np.arange(self.n)
        more, equal = np.zeros_like(self.present), self.present.copy()
        for weight in range(len(slices) - 1, -1, -1):
            if bound >> weight & 1:
                equal &= slices[weight]
            else:
                more |= equal & slices[weight]
                equal &= ~slices[weight]
        if bound >> len(slices):
            return np.zeros(0, np.int64)
        return np.flatnonzero(np.unpackbits((more | equal).view(np.uint8), bitorder="little")[: self.n])

    def best(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k distinct best rows and, at the last place, all rows that tie with it: indices and exact scores."""
        if not q.any():
            return np.arange(self.n), np.zeros(self.n, np.int64)
        slices = self.scores(q)
        error = float(np.sqrt((q * q).sum())) * self.rest / (1 << SHIFT)
        at = self.select(slices, k, error + 1)
        exact = self.rows[at] @ q
        if len(at) > k:
            last = np.partition(exact, len(exact) - k)[len(exact) - k]
            keep = exact >= last
            at, exact = at[keep], exact[keep]
        return at, exact


def pack(bits: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.uint64)


def search_group(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """Of each query, the k best candidates of this group."""
    best: list[list[tuple[int, int]]] = [[] for _ in query_ids]
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    distinct, copy_of = np.unique(rows, axis=0, return_inverse=True)
    copy_of = copy_of.reshape(-1)
    by = np.argsort(copy_of, kind="stable")  # by vector, then by id
    first = np.searchsorted(copy_of[by], np.arange(len(distinct) + 1))
    for start in range(0, len(distinct), BLOCK):
        block = Block(distinct[start : start + BLOCK])
        for i, q in enumerate(queries):
            at, exact = block.best(q, k + 1)
            found = best[i]
            if len(at) > 4 * k:  # of rows that tie, those with the smallest ids
                smallest = ids[by[first[at + start]]]
                keep = np.lexsort((smallest, -exact))[: k + 1]
                at, exact = at[keep], exact[keep]
            for row, score in zip(at + start, exact):
                for e in by[first[row] : min(first[row] + k + 1, first[row + 1])]:
                    if ids[e] != query_ids[i]:
                        found.append((-int(score), int(ids[e])))
            found.sort()
            del found[k:]
    out = [(int(q), i, -s) for q, found in zip(query_ids, best) for s, i in found]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", group_rows: int = GROUP_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Of each row whose id is divisible by `every`, the k rows of highest inner product: query_id, rank from 1, vec_id, score."""
    x = F.col("v")
    usable = (
        vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        .where(F.col("id").isNotNull() & x.isNotNull() & (F.size(x) > 0))
        .where(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))))
    )
    length, largest = F.size(x), F.array_max(F.transform(x, F.abs))
    sizes = usable.agg(
        F.count("*").alias("n"), F.sum((F.pmod("id", F.lit(every)) == 0).cast("bigint")).alias("q"),
        F.min(length).alias("shortest"), F.max(length).alias("longest"), F.max(largest).alias("largest"),
    ).first()
    if sizes["n"] and sizes["shortest"] != sizes["longest"]:
        raise ValueError(f"vectors of different length: {sizes['shortest']} to {sizes['longest']}")
    if sizes["n"] and (256 * sizes["largest"] + 1) ** 2 * sizes["longest"] >= 2**62:
        raise ValueError(f"components too large for exact integer scores: {sizes['largest']}")
    groups, blocks = max(1, math.ceil((sizes["n"] or 0) / group_rows)), max(1, math.ceil((sizes["q"] or 0) / query_rows))
    asked = usable.where(F.pmod("id", F.lit(every)) == 0).withColumn("h", F.pmod(F.xxhash64("id", F.lit("q")), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = usable.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return search_group(left["id"].to_numpy(), quantise(np.stack(left["v"])), right["id"].to_numpy(), quantise(np.stack(right["v"])), k)

    found = dealt.groupBy("g", "h").cogroup(asked.groupBy("g", "h")).applyInPandas(meet, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
