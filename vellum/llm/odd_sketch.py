"""MinHash near-duplicates with odd sketches: components of documents whose sets of word 2-shingles have Jaccard similarity of 0.80 or more.

1. Words and sets are those of ngram_join with shingles of 2 words. Documents with equal sets collapse to one representative.
2. A set has SAMPLES min-hashes, each the smallest of its shingles' 64-bit hashes times an odd number. They make
   SAMPLES / ROWS band keys; representatives that share one are candidates. At the threshold a pair shares no key once in
   (1 - 0.8^4)^-32, some 2 * 10^7 pairs, and less often above it.
3. The samples also make an odd sketch: each (place, sample) toggles one of BITS bits, so equal samples cancel out in the
   XOR of two sketches and its ones count the places that differ. Differing samples toggle two bits each, and collisions
   only remove ones, so a pair of more ones than `most_ones` has fewer equal samples than a pair at the threshold
   does but once in 10^9. Such candidates go without a look at their texts; `estimate` gives the similarity meant by a count.
4. A parity bitmap of the set itself bounds the number of shingles in which two sets differ from below, exactly; a pair that
   differs in more than the threshold allows goes as well. Small and middling sets are told apart by this, large ones by
   the samples.
5. What remains is confirmed on the whole sets, and components are made without all pairs of a key (linking.resolve: each id
   of a key against its smallest, then only pairs across components, in blocks where a key holds many).

A set of fewer than 4 shingles reaches the threshold with an equal set only, so it has no keys.

Nulls: a null or empty text, or one of white space only, has an empty set and is linked with nothing. Rows of equal or null
id are documents of their own, each with its own row in the result; a component's id is the smallest that is not null,
and null if there is none. Ties and repeated texts share a set. Long texts are taken whole, a slice of rows at a time; the
set of one document, 8 bytes a word, must fit in a worker. Empty tables give no rows. Only the id and text are read, so other
columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import hashing, linking
from vellum.llm.common import cut, text_column, with_row_key
from vellum.llm.ngram_join import sets, similar

NUM, DEN, SHINGLE = 80, 100, 2
SAMPLES, ROWS, BITS = 128, 4, 1024
#: Smallest size of a set that can reach the threshold with a different one.
LEAST = -(-NUM // (DEN - NUM))
#: Ids of a key that are paired by a join; more are paired in blocks.
FEW = 64
#: Odd multipliers of the samples.
ODD = hashing.mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)


def min_hashes(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """SAMPLES rows of one smallest hash for each set; no set is empty."""
    return np.stack([np.minimum.reduceat(values * odd, begin) for odd in ODD])


def sketches(samples: np.ndarray) -> np.ndarray:
    """The odd sketches of the sets, BITS / 8 bytes each."""
    n = samples.shape[1]
    place = np.arange(1, SAMPLES + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    spot = (hashing.mix(samples + place) & np.uint64(BITS - 1)).astype(np.int64) + np.arange(n) * BITS
    return np.packbits(np.bincount(spot.ravel(), minlength=n * BITS).astype(np.uint8).reshape(n, BITS) & 1, axis=1)


def parities(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """For each of n sets the parity of its shingles by their BITS cells, BITS / 8 bytes."""
    spot = (values >> np.uint64(20) & np.uint64(BITS - 1)).astype(np.int64) + rows * BITS
    return np.packbits(np.bincount(spot, minlength=n * BITS).astype(np.uint8).reshape(n, BITS) & 1, axis=1)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """A row for each set, a key for each band."""
    return np.stack([hashing.combine(list(samples[at : at + ROWS]), 1 + at) for at in range(0, SAMPLES, ROWS)], axis=1)


def estimate(ones: float) -> float:
    """The similarity that a count of ones in the XOR of two sketches stands for."""
    return 1 + BITS / (4 * SAMPLES) * math.log(max(1 - 2 * ones / BITS, 1 / BITS))


def most_ones(miss: float = 1e-9) -> int:
    """More ones than a pair at the threshold has, but with probability `miss`: twice the samples that differ, from the tail
    of their binomial distribution."""
    p, tail = 1 - NUM / DEN, 0.0
    for differing in range(SAMPLES, -1, -1):
        tail += math.comb(SAMPLES, differing) * p**differing * (1 - p) ** (SAMPLES - differing)
        if tail > miss:
            return 2 * differing
    return 0


MOST_ONES = most_ones()


def described(docs: DataFrame) -> DataFrame:
    """row, n (size of the set), set_a and set_b (its 128-bit name), sketch (that of the samples, then the set's own parities)
    and bands; both null where no different set can be near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, values, begin in sets(b.column(1), SHINGLE):
                count = np.diff(begin)
                names = np.zeros((2, len(count)), np.uint64)
                some = np.flatnonzero(count)
                if len(some):
                    for i in range(2):
                        names[i][some] = np.add.reduceat(hashing.mix(values + np.uint64(i + 1)), begin[some])
                sketch, bands = np.full(len(count), None, object), np.full(len(count), None, object)
                able = np.flatnonzero(count >= LEAST)
                if len(able):
                    keep = np.repeat(count >= LEAST, count)
                    samples = min_hashes(values[keep], np.cumsum(count[able]) - count[able])
                    both = np.concatenate([sketches(samples), parities(values[keep], np.repeat(np.arange(len(able)), count[able]), len(able))], axis=1)
                    for i, s, k in zip(able, both, band_keys(samples).view(np.int64)):
                        sketch[i], bands[i] = s.tobytes(), k
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(count)), pa.array(count), pa.array(names[0].view(np.int64)), pa.array(names[1].view(np.int64)), pa.array(sketch, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["row", "n", "set_a", "set_b", "sketch", "bands"],
                )

    return docs.mapInArrow(run, "row bigint, n bigint, set_a bigint, set_b bigint, sketch binary, bands array<bigint>")


def bits(column: pa.Array) -> np.ndarray:
    """The two bitmaps of each row as 64-bit words: (rows, 2, words)."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 2, BITS // 64)


def may_be_near(x: np.ndarray, y: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether bitmaps x and y of sets of together `total` shingles allow the threshold: sets that differ in d of them have a
    similarity of (total - d) / (total + d)."""
    ones = np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)
    return (ones[..., 0] <= MOST_ONES) & (ones[..., 1] * (DEN + NUM) <= total * (DEN - NUM))


def near_by_bits(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of sizes na and nb with sketches xa and xb that may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                total = b.column(4).to_numpy() + b.column(5).to_numpy()
                yield b.select(["a", "b"]).filter(pa.array(may_be_near(bits(b.column(2)), bits(b.column(3)), total)))

    return pairs.select("a", "b", "xa", "xb", "na", "nb").mapInArrow(run, "a bigint, b bigint")


def near_sketches(left: pa.Table, right: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For linking.in_blocks: pairs of different labels whose sizes and bitmaps allow the threshold."""
    x, y = bits(left.column("sketch")), bits(right.column("sketch"))
    (m, n), (label, labels) = ([t.column(c).to_numpy() for t in (left, right)] for c in ("n", "label"))
    for i in range(len(x)):
        j = np.flatnonzero((np.minimum(m[i], n) * DEN >= np.maximum(m[i], n) * NUM) & (label[i] != labels))
        if len(j):
            j = j[may_be_near(x[i], y[j], m[i] + n[j])]
            yield np.full(len(j), i), j


def rows_with_components(docs: DataFrame) -> DataFrame:
    """row, n, label (the smallest row key of the component) of rows (row, text), whose keys are unique and not null."""
    made = cut(described(docs))
    reps = cut(made.where("n > 0").groupBy("set_a", "set_b", "n").agg(F.min("row").alias("rep")))
    own = cut(made.where("bands IS NOT NULL").join(reps.select(F.col("rep").alias("row")), "row", "left_semi").select(F.col("row").alias("rep"), "n", "sketch", "bands"))
    keyed = own.select(F.explode("bands").alias("key"), F.col("rep").alias("id"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("ids")).where(F.col("ids") > 1).select("key")
    postings = cut(keyed.join(shared, "key").distinct())
    sizes, marks = own.select("rep", "n"), own.select("rep", "sketch")

    def verify(pairs: DataFrame) -> DataFrame:
        x, y = (own.select(F.col("rep").alias(i), F.col("n").alias(f"n{i}"), F.col("sketch").alias(f"x{i}")) for i in "ab")
        near = pairs.join(x, "a").join(y, "b").where(F.least("na", "nb") * DEN >= F.greatest("na", "nb") * NUM)
        return similar(near_by_bits(near), docs, SHINGLE, NUM, DEN)

    def sized(x: str, y: str):
        m, n = F.col(f"{x}.n"), F.col(f"{y}.n")
        return F.least(m, n) * DEN >= F.greatest(m, n) * NUM

    def candidates(rest: DataFrame) -> DataFrame:
        many = cut(rest.groupBy("key").agg(F.count("*").alias("ids")).where(F.col("ids") > FEW).select("key"))
        few = linking.joined(rest.join(many, "key", "left_anti"), sized)
        return few.unionByName(linking.in_blocks(rest.join(many, "key"), marks.withColumnRenamed("rep", "id"), near_sketches)).distinct()

    labels = linking.components(linking.resolve(postings, verify, sizes.withColumnRenamed("rep", "id"), candidates))
    of_set = reps.join(labels, F.col("rep") == F.col("id"), "left").select("set_a", "set_b", "n", F.coalesce("label", "rep").alias("label"))
    return made.select("row", "n", "set_a", "set_b").join(of_set, ["set_a", "set_b", "n"], "left").select("row", "n", F.coalesce("label", "row").alias("label"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept: whether that is the row's own id."""
    docs, unique = with_row_key(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_column().alias("text")), "row")
    found = rows_with_components(docs.select("row", "text"))
    if unique:
        named = found.select(F.col("row").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("label").alias("component_id"))
    else:
        with_ids = found.join(docs.select("row", "doc_id"), "row")
        least = with_ids.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        named = with_ids.join(least, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return named.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
