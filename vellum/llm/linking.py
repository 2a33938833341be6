"""Connected components of candidate links without listing all pairs of a group.

Candidates come as postings (key, id): ids that share a key may be linked, and a verification decides. Listing all
pairs of a key is quadratic, so links are found in two steps that together lose none:

1. Star: each id is verified against the smallest id of each of its keys. In a group of copies nearly all attach there.
2. Rest: keys whose ids are by now all in one component need nothing more, since every pair in them is connected
   already. In the others, pairs of ids in different components are verified.

Components are made by large-star and small-star contraction, each round one written table, all by joins and partial
aggregates; nothing is gathered on the driver but counts.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import cut, fresh

#: Bits of a filter: 16 an id, within these bounds (128 KB and 8 MB).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 26


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every id in edges (a, b), label the smallest id of its component. Loops and repeats are allowed."""
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct())
    while True:
        before = signature(now)
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct()
        now = cut(small)
        if signature(now) == before:
            break
    roots = now.select(F.col("b").alias("id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(roots.select("id", F.col("id").alias("label")))


def signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def pack(columns: list[np.ndarray]) -> bytes:
    """Equal-length columns of 8 bytes, one after another."""
    return b"".join(np.ascontiguousarray(c).view(np.uint64).tobytes() for c in columns)


def unpack(blob: bytes, n: int) -> list[np.ndarray]:
    return list(np.frombuffer(blob, np.uint64).reshape(n, -1))


def deal(columns: list[np.ndarray], buckets: int, key: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed columns) of rows dealt by the upper bits of their key."""
    bucket = ((key >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), pack([c[part] for c in columns])


def blob_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])


def one_bucket_each(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[bytes]]:
    """The blobs of each bucket of a task whose rows (bucket, blob) are sorted, bucket after bucket."""
    rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    for _, own in itertools.groupby(rows, key=lambda row: row[0]):
        yield (blob for _, blob in own)


def dealt(blobs: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, blob) so that a task has whole buckets, one after another: it never holds more than one."""
    return blobs.repartition(buckets, "bucket").sortWithinPartitions("bucket")


def by_bucket(blobs: DataFrame, buckets: int, work: Callable[[Iterator[list[np.ndarray]]], Iterator[list[np.ndarray]]], n_in: int, out: list[str], at_once: int = 1_000_000) -> DataFrame:
    """work on the rows of each bucket, in portions of about at_once rows; its output columns become bigint rows. The number of
    buckets follows the input; what work keeps between portions of a bucket is its own affair."""

    def portions(own: Iterator[bytes]) -> Iterator[list[np.ndarray]]:
        held: list[list[np.ndarray]] = []
        size = 0
        for blob in own:
            held.append(unpack(blob, n_in))
            size += len(held[-1][0])
            if size >= at_once:
                yield [np.concatenate([p[i] for p in held]) for i in range(n_in)]
                held, size = [], 0
        if held:
            yield [np.concatenate([p[i] for p in held]) for i in range(n_in)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in one_bucket_each(batches):
            for made in work(portions(own)):
                for at in range(0, len(made[0]), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000].view(np.int64)) for c in made], names=out)

    return dealt(blobs, buckets).mapInArrow(run, ", ".join(f"{c} bigint" for c in out))


def whole(work: Callable[[list[np.ndarray]], list[np.ndarray]]) -> Callable[[Iterator[list[np.ndarray]]], Iterator[list[np.ndarray]]]:
    """For by_bucket: work on all rows of a bucket at once."""

    def run(portions: Iterator[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
        parts = list(portions)
        if parts:
            yield work([np.concatenate([p[i] for p in parts]) for i in range(len(parts[0]))])

    return run


def live_postings(portions: Iterator[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """For by_bucket: of (key, id) or (key, id, kind) rows, those whose key has two ids or more; with kinds, also a row of
    kind 0. Some may come twice. A key that qualified once is only remembered by itself, so a key of any number of
    rows takes no more room than another; rows of keys that don't qualify yet wait."""
    alive = np.zeros(0, np.uint64)
    wait: list[np.ndarray] | None = None
    for new in portions:
        rows = new if wait is None else [np.concatenate([w, n]) for w, n in zip(wait, new)]
        order = np.lexsort(rows[::-1])
        rows = [r[order] for r in rows]
        keep = np.ones(len(order), bool)
        keep[1:] = np.logical_or.reduce([r[1:] != r[:-1] for r in rows])
        rows = [r[keep] for r in rows]
        key, ident = rows[0], rows[1]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        group = np.cumsum(first) - 1
        other = first.copy()
        other[1:] |= ident[1:] != ident[:-1]
        good = np.bincount(group[other], minlength=group[-1] + 1) > 1
        if len(rows) > 2:
            good &= np.bincount(group, rows[2] == 0, len(good)) > 0
        known = key[first]
        if len(alive):
            good |= alive[np.minimum(np.searchsorted(alive, known), len(alive) - 1)] == known
        yield [r[good[group]] for r in rows]
        alive = np.union1d(alive, known[good])
        wait = [r[~good[group]] for r in rows]


def resolve(postings: DataFrame, verify: Callable[[DataFrame], DataFrame], traits: DataFrame, candidates: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) that connect what the postings (key, id) and the verification of pairs (a < b) allow: every component of
    the full link graph is connected by them. The postings are read several times; pass written ones, which may have a
    column `kind` beside. traits: columns beside id; candidates: from written rows (key, id, label, kind, traits) to the
    pairs (a, b) of one key and two labels that can be links."""
    pivot = postings.groupBy("key").agg(F.min("id").alias("a"))
    star = cut(postings.join(pivot, "key").where(F.col("a") < F.col("id")).select("a", F.col("id").alias("b")).distinct())
    links = cut(verify(star))
    labels = components(links)
    named = postings.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    open_keys = named.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where(F.col("l") != F.col("h")).select("key")
    rest = cut(named.join(open_keys, "key"))
    own = traits.join(rest.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    rest = cut(rest.join(own, "id"))
    pairs = candidates(rest).join(star, ["a", "b"], "left_anti")
    return links.unionByName(cut(verify(pairs)))


def joined(rest: DataFrame, near: Callable[[str, str], Column]) -> DataFrame:
    """Candidates by a join: the pairs of a key and two labels for which near("x", "y"), over the rows as x.* and y.*, holds."""
    pairs = rest.alias("x").join(rest.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.label") < F.col("y.label")) & near("x", "y"))
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def in_blocks(rest: DataFrame, traits: DataFrame, near: Callable[[pa.Table, pa.Table], Iterator[tuple[np.ndarray, np.ndarray]]], rows: int = 512) -> DataFrame:
    """Candidates of keys that hold many ids, without a row for each pair: a key's rows are dealt into blocks, two blocks meet
    in one group of up to 2 * rows rows (with the traits of their ids), and only what near(left, right) finds there (places
    in both) comes out. So a key of n ids sends n * n / rows rows, not n * n."""
    sizes = rest.groupBy("key").agg(F.ceil(F.count("*") / rows).cast("int").alias("blocks"))
    dealt = rest.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.join(traits, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))

    def run(group: pa.Table) -> pa.Table:
        low, own = group.column("low")[0].as_py(), group.column("own").to_numpy()
        left = group.filter(pa.array(own == low))
        right = left if low == group.column("high")[0].as_py() else group.filter(pa.array(own != low))
        found = [pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)}) for i, j in near(left, right) for x, y in [(left.column("id").to_numpy()[i], right.column("id").to_numpy()[j])] if len(x)]
        return pa.concat_tables(found) if found else pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    return dealt.groupBy("key", "low", "high").applyInArrow(run, "a bigint, b bigint").distinct()


def bloom_bits(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n).bit_length()))


def bloom(ids: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter over a bigint column, made by OR over words on the executors; its size follows the number of ids up
    to a bound. What it lets through by chance a later join removes, so it only saves shuffling, at any size of the data."""
    bits = bloom_bits(ids.count())
    spots = F.explode(F.array(*[F.pmod(F.xxhash64(column, F.lit(i)), F.lit(bits)) for i in range(3)]))
    words = ids.select(spots.alias("spot")).groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot % 64 as int))")).alias("bits"))
    got = words.toArrow()
    out = np.zeros(bits // 64, np.int64)
    if got.num_rows:
        out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out


def spots(column: str, table: np.ndarray) -> list[Column]:
    """The three places of a bigint column in a filter, as columns for a function that takes Arrow batches anyway."""
    bits = len(table) * 64
    return [F.pmod(F.xxhash64(column, F.lit(i)), F.lit(bits)).alias(f"_spot{i}") for i in range(3)]


def hits(table: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    """Which rows of a batch with such places the filter lets through."""
    ok = np.ones(batch.num_rows, bool)
    for i in range(3):
        spot = batch.column(f"_spot{i}").to_numpy()
        ok &= (table[spot >> 6] >> (spot & 63)) & 1 == 1
    return ok


def passes(spark_filter: np.ndarray, column: str | Column) -> Column:
    """Whether the filter lets a bigint column through."""
    bits = len(spark_filter) * 64
    packed = spark_filter.tobytes()

    @F.pandas_udf("boolean")
    def hit(a, b, c):
        table = np.frombuffer(packed, np.int64)
        ok = np.ones(len(a), bool)
        for s in (a, b, c):
            spot = s.to_numpy()
            ok &= (table[spot >> 6] >> (spot & 63)) & 1 == 1
        return pd.Series(ok)

    return hit(*[F.pmod(F.xxhash64(column, F.lit(i)), F.lit(bits)) for i in range(3)])


def bucket_count(total_bytes: int, bytes_each: int = 8 << 20, least: int = 12) -> int:
    return max(least, -(-int(total_bytes or 0) // bytes_each))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def bloom_of_hashes(ids: DataFrame, column: str) -> np.ndarray:
    """As bloom(), over a column that holds hashes already: their own bits are the places."""
    bits = bloom_bits(ids.count())
    spots = F.explode(F.array(*[F.shiftrightunsigned(column, s).bitwiseAND(F.lit(bits - 1).cast("bigint")) for s in (8, 33)]))
    words = ids.select(spots.alias("spot")).groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot % 64 as int))")).alias("bits"))
    got = words.toArrow()
    out = np.zeros(bits // 64, np.int64)
    if got.num_rows:
        out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out


def in_bloom_of_hashes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    ok, bits, words = np.ones(len(hashes), bool), len(table) * 64, table.view(np.uint64)
    for s in (8, 33):
        spot = (hashes >> np.uint64(s)) & np.uint64(bits - 1)
        ok &= (words[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
    return ok


def without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows whose `key` (a bigint, never null) isn't in the column of that name of `gone`. Only rows that the filter
    lets through are shuffled."""
    gone = cut(gone.select(key).distinct())
    maybe = fresh(docs, "maybe")
    marked = docs.withColumn(maybe, passes(bloom(gone, key), key))
    kept = marked.where(F.col(maybe)).join(gone, key, "left_anti")
    return marked.where(~F.col(maybe)).unionByName(kept).drop(maybe)
