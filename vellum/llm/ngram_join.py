"""N-gram Jaccard join by grouped prefixes: components of documents whose sets of word 5-shingles have Jaccard similarity of 0.75 or more.

1. Words are A-Z lower-cased and split at ASCII white space; a set is the document's distinct 5-word shingles (as
   64-bit hashes), the whole sequence if it is shorter. Documents with equal sets collapse to one representative.
2. All shingles have one order: those of many documents last, the most frequent at the end, counted over the
   whole corpus (a bounded list, and it only orders, so nothing depends on it but speed), else by hash. Two sets that reach the
   threshold share a shingle among the first m - ceil(2t / (1 + t) * m) + 1 of the smaller one, which are indexed, and
   the first n - ceil(t * n) + 1 of the other, which probe. A shingle that only probes brings no pair.
3. Representatives with the same prefix and size form a group; a group is posted once under each prefix shingle.
4. Groups that share a shingle are candidates. Group pairs are filtered to those that can still connect something
   (see linking.resolve: the smallest group of a shingle first, then only pairs across components), expanded to
   members of sizes and shapes within the threshold, and verified on the whole sets.

Nulls: a null or empty text, or one of white space only, has an empty set and is linked with nothing. Rows of equal or
null id are documents of their own, each with its own row in the result. Ties and repeated texts share a set. Long texts
are taken whole, a slice of rows at a time; the set of one document, 8 bytes a word, must fit in a worker. Empty tables
give no rows. Only the id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import hashing, linking
from vellum.llm.common import cut, flat_bytes, fresh, row_slices, text_column, with_row_key

NUM, DEN = 75, 100
#: Cells of a set's shape: how many of its shingles fall into each, which bounds the overlap of two sets from above.
SHAPE = 256
#: Ids of a key that are paired by a join; more are paired in blocks.
FEW = 64


def sets(texts: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of rows: the first row, the distinct shingles of its rows, and where each row's begin."""
    body, offsets = flat_bytes(texts)
    for first, last in row_slices(offsets, hashing.SLICE):
        own = offsets[first : last + 1] - offsets[first]
        h, rows, _, _ = hashing.words(body[offsets[first] : offsets[last]], own)
        values, owner = hashing.shingles(h, rows, last - first, k)
        yield (first, *hashing.distinct_by_row(values, owner, last - first))


def frequent(docs: DataFrame, buckets: int, total_bytes: int, least: int = 8, demoted: int = 500_000) -> tuple[int, np.ndarray]:
    """(bits, fingerprints ascending) of the most frequent shingles of the whole corpus: those in `least` or more documents, at
    most `demoted`. A fingerprint is a shingle's upper bits, enough that few collide. Each task counts half a million at a
    time before it sends them: sorted fingerprints as differences, two bytes each as a rule, and the counts over 1."""
    bits = min(60, max(32, int(np.log2(max(total_bytes, 2))) + 4))
    down = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush():
            v, n = np.unique(np.concatenate(held), return_counts=True)
            bucket = fingerprint_bucket(v, bits, buckets)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            return linking.blob_batch([(i, squeeze(v[x:y], n[x:y])) for i, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x])

        for b in batches:
            for _, v, _ in sets(b.column(0)):
                held.append(v >> down)
                size += len(v)
                if size > 500_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in linking.one_bucket_each(batches):
            v, n = tally(map(unsqueeze, own))
            keep = n >= least
            yield pa.RecordBatch.from_arrays([pa.array(v[keep].astype(np.int64)), pa.array(n[keep])], names=["shingle", "n"])

    blobs = linking.dealt(docs.select("text").mapInArrow(run, "bucket int, blob binary"), buckets)
    counted = cut(blobs.mapInArrow(count, "shingle bigint, n bigint"))
    top = counted.orderBy(F.desc("n"), "shingle").limit(demoted).toArrow()
    order = np.argsort(top.column("shingle").to_numpy(), kind="stable")
    return bits, np.stack([top.column("shingle").to_numpy()[order].astype(np.uint64), top.column("n").to_numpy()[order].astype(np.uint64)])


def tally(parts: Iterator[tuple[np.ndarray, np.ndarray]], at_least: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and the sums of their counts. New parts are merged when they are as many as what is merged
    already, so the work stays in proportion."""
    merged = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    new: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merge() -> tuple[np.ndarray, np.ndarray]:
        v, n = (np.concatenate([merged[i], *[x[i] for x in new]]) for i in range(2))
        order = np.argsort(v, kind="stable")
        v, n = v[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
        return v[first], np.add.reduceat(n, first) if len(v) else n

    for part in parts:
        new.append(part)
        size += len(part[0])
        if size > max(at_least, len(merged[0])):
            merged = merge()
            new, size = [], 0
    return merge() if new else merged


def squeeze(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending distinct values with their counts: how many, the first, steps, then places and counts of those over 1."""
    steps = np.diff(values)
    small = not len(steps) or steps.max() < 1 << 16
    many = np.flatnonzero(counts > 1)
    head = np.array([len(values), small, values[0]], np.uint64).tobytes()
    return head + steps.astype(np.uint16 if small else np.uint64).tobytes() + np.concatenate([many, counts[many]]).astype(np.uint32).tobytes()


def unsqueeze(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, small, first = (int(x) for x in np.frombuffer(blob[:24], np.uint64))
    end = 24 + (n - 1) * (2 if small else 8)
    steps = np.frombuffer(blob[24:end], np.uint16 if small else np.uint64)
    values = np.uint64(first) + np.concatenate([np.zeros(1, np.uint64), np.cumsum(steps, dtype=np.uint64)])
    places, counts = np.frombuffer(blob[end:], np.uint32).reshape(2, -1)
    out = np.ones(n, np.int64)
    out[places] = counts
    return values, out


def fingerprint_bucket(v: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Ranges of equal width, so that sorted fingerprints fall into buckets in order."""
    width = np.uint64(-(-(1 << bits) // buckets))
    return (v // width).astype(np.int64)


def prefix_rows(docs: DataFrame, common: tuple[int, np.ndarray], buckets: int, per_task_memory: int = 1 << 19) -> DataFrame:
    """Two kinds of rows: documents (row, n, set_a, set_b, grp) with a null blob, and postings (bucket, blob of (shingle, grp, kind))."""
    schema = "row bigint, n bigint, set_a bigint, set_b bigint, grp bigint, shape binary, bucket int, blob binary"
    down, (last, seen_in) = np.uint64(64 - common[0]), common[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def postings():
            nonlocal size
            columns = [np.concatenate([h[i] for h in held]) for i in range(3)]
            held.clear()
            size = 0
            rows = list(linking.deal(columns, buckets, columns[0]))
            none = pa.nulls(len(rows), pa.int64())
            return pa.RecordBatch.from_arrays([none] * 5 + [pa.nulls(len(rows), pa.binary()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=names)

        names = [x.split()[0] for x in schema.split(", ")]
        seen: set[int] = set()
        for b in batches:
            n_all, a_all, b_all, g_all = (np.zeros(b.num_rows, t) for t in (np.int64, np.uint64, np.uint64, np.uint64))
            shapes: list[bytes] = []
            for first, values, begin in sets(b.column(1)):
                count = np.diff(begin)
                rows = np.repeat(np.arange(len(count)), count)
                late = np.zeros(len(values), np.uint64)  # in how many documents, if that is many
                if len(last):
                    at = np.minimum(np.searchsorted(last, values >> down), len(last) - 1)
                    late = np.where(last[at] == values >> down, seen_in[at], np.uint64(0))
                order = np.lexsort((values, late, rows))  # within a row, the frequent ones last
                values = values[order]
                place = np.arange(len(values)) - np.repeat(begin[:-1], count)
                prefix = count - (count * NUM + DEN - 1) // DEN + 1
                indexed = count - (2 * count * NUM + DEN + NUM - 1) // (DEN + NUM) + 1
                inside = place < np.repeat(prefix, count)
                kind = (place >= np.repeat(indexed, count)).astype(np.uint64)
                some = count > 0
                at = begin[:-1][some]
                own = slice(first, first + len(count))
                for target, salt in ((a_all, 1), (b_all, 2)):
                    target[own][some] = np.add.reduceat(hashing.mix(values + np.uint64(salt)), at) if len(at) else 0
                g = np.zeros(len(count), np.uint64)
                if len(at):
                    weighted = np.where(inside, hashing.mix(values ^ hashing.mix(place.astype(np.uint64))), np.uint64(0))
                    g[some] = hashing.mix(np.add.reduceat(weighted, at) + count[some].astype(np.uint64))
                n_all[own], g_all[own] = count, g
                cells = np.bincount(rows * SHAPE + (values & np.uint64(SHAPE - 1)).astype(np.int64), minlength=len(count) * SHAPE)
                shapes += [x.tobytes() for x in np.minimum(cells, 255).astype(np.uint8).reshape(-1, SHAPE)]
                fresh = np.array([x not in seen for x in g.tolist()], bool) & some
                seen.update(g[some].tolist())
                if len(seen) > 500_000:
                    seen.clear()
                take = inside & fresh[rows]
                held.append((values[take], g[rows[take]], kind[take]))
                size += int(take.sum())
                if size > per_task_memory:
                    yield postings()
            nulls = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_all), pa.array(a_all.view(np.int64)), pa.array(b_all.view(np.int64)), pa.array(g_all.view(np.int64)), pa.array(shapes, pa.binary()), pa.nulls(nulls, pa.int32()), pa.nulls(nulls, pa.binary())], names=names
            )
        if size:
            yield postings()

    return docs.mapInArrow(run, schema)


def similar(pairs: DataFrame, docs: DataFrame, k: int = 5, num: int = NUM, den: int = DEN) -> DataFrame:
    """Pairs (a, b) of row keys whose sets of k-word shingles have a similarity of num / den or more. Only the texts of documents in the pairs are shuffled."""
    pairs = cut(pairs)
    ids = cut(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    needed = linking.bloom(ids, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(linking.hits(needed, b)))
            for first, values, begin in sets(b.column(1), k):
                blobs = [values[i:j].tobytes() for i, j in zip(begin, begin[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(blobs)), pa.array(blobs, pa.binary())], names=["id", "shingles"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i in range(b.num_rows):
                x, y = b.column(2)[i].as_py(), b.column(3)[i].as_py()
                m, n = len(x) // 8, len(y) // 8
                ok = min(m, n) * den >= max(m, n) * num
                if ok:
                    both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]), kind="stable")
                    inner = int((both[1:] == both[:-1]).sum())
                    ok = den * inner >= num * (m + n - inner)
                keep.append(ok)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = docs.select("row", "text", *linking.spots("row", needed)).mapInArrow(run, "id bigint, shingles binary")
    left = wanted.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = wanted.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    full = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")
    return full.mapInArrow(judge, "a bigint, b bigint")


def may_overlap(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and shapes allow the threshold; an upper bound, so no link is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (flat_bytes(b.column(i))[0].reshape(-1, SHAPE) for i in (4, 5))
            most = np.minimum(x, y).astype(np.int64).sum(1) + ((x == 255) & (y == 255)).sum(1) * (1 << 30)
            m, n = b.column(2).to_numpy(), b.column(3).to_numpy()
            ok = (DEN + NUM) * most >= NUM * (m + n)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return pairs.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a bigint, b bigint")


def similar_shapes(left: pa.Table, right: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For linking.in_blocks: pairs whose labels differ, whose prefixes meet as they must, and whose sizes and shapes allow the
    threshold."""
    x, y = (flat_bytes(t.column("shape"))[0].reshape(-1, SHAPE) for t in (left, right))
    m, n = (t.column("n").to_numpy() for t in (left, right))
    (label, kind), (labels, kinds) = ([t.column(c).to_numpy() for c in ("label", "kind")] for t in (left, right))
    for i in range(len(x)):
        sized = (np.minimum(m[i], n) * DEN >= np.maximum(m[i], n) * NUM) & (label[i] != labels)
        sized &= ((kind[i] == 0) & (m[i] <= n)) | ((kinds == 0) & (n <= m[i]))
        j = np.flatnonzero(sized)
        if len(j):
            both = np.minimum(x[i], y[j])
            most = both.sum(1, dtype=np.int64) + (both == 255).any(1) * (1 << 30)
            j = j[(DEN + NUM) * most >= NUM * (m[i] + n[j])]
            yield np.full(len(j), i), j


def rows_with_components(docs: DataFrame) -> DataFrame:
    """row, n, label (the smallest row key of the component) of rows (row, text), whose keys are unique and not null."""
    total = linking.text_bytes(docs)
    buckets = linking.bucket_count(total)
    made = cut(prefix_rows(docs, frequent(docs, buckets, total), buckets))
    described = made.where("blob is null").select("row", "n", "set_a", "set_b", "grp", "shape")
    blobs = made.where("blob is not null").select("bucket", "blob")
    posted = linking.by_bucket(blobs, buckets, linking.live_postings, 3, ["key", "grp", "kind"])
    reps = cut(described.where("n > 0").groupBy("set_a", "set_b", "n", "grp").agg(F.min("row").alias("rep")))
    sizes = cut(described.join(reps.select(F.col("rep").alias("row")), "row", "left_semi").select(F.col("row").alias("rep"), "n", "shape"))
    # a group's members are candidates of each other, and of the members of every group that shares a prefix shingle
    first = reps.groupBy("grp").agg(F.min("rep").alias("first"), F.count("*").alias("members"))
    heads = posted.join(first, "grp").select("key", F.col("first").alias("id"), "kind")
    inside = reps.join(first.where("members > 1"), "grp").select(F.col("grp").alias("key"), F.col("rep").alias("id"), F.lit(0).cast("bigint").alias("kind"))
    others = posted.join(reps.join(first.where("members > 1"), "grp").where("rep != first").select("grp", "rep"), "grp").select("key", F.col("rep").alias("id"), "kind")
    postings = cut(heads.unionByName(inside).unionByName(others).distinct())

    def verify(pairs: DataFrame) -> DataFrame:
        x = sizes.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("shape").alias("xa"))
        y = sizes.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("shape").alias("xb"))
        near = pairs.join(x, "a").join(y, "b").where(F.least("na", "nb") * DEN >= F.greatest("na", "nb") * NUM)
        return similar(may_overlap(near), docs)

    def may_be_similar(x: str, y: str):
        """By their sizes, and by the prefixes that the key stands in: an indexed one of the smaller set."""
        m, n, i, j = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.kind"), F.col(f"{y}.kind")
        return (F.least(m, n) * DEN >= F.greatest(m, n) * NUM) & (((i == 0) & (m <= n)) | ((j == 0) & (n <= m)))

    shapes = sizes.select(F.col("rep").alias("id"), "shape")

    def candidates(rest: DataFrame) -> DataFrame:
        many = cut(rest.groupBy("key").agg(F.count("*").alias("ids")).where(F.col("ids") > FEW).select("key"))
        few = linking.joined(rest.join(many, "key", "left_anti"), may_be_similar)
        return few.unionByName(linking.in_blocks(rest.join(many, "key"), shapes, similar_shapes)).distinct()

    labels = linking.components(linking.resolve(postings, verify, sizes.select(F.col("rep").alias("id"), "n"), candidates))
    of_set = reps.join(labels, F.col("rep") == F.col("id"), "left").select("set_a", "set_b", "n", F.coalesce("label", "rep").alias("label"))
    return described.drop("shape").join(of_set, ["set_a", "set_b", "n"], "left").select("row", "n", F.coalesce("label", "row").alias("label"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable over links (null if no row there has an id)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_column().alias("text"))
    docs, unique = with_row_key(docs, "row")
    found = rows_with_components(docs.select("row", "text"))
    if unique:
        return found.select(F.col("row").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("label").alias("component_id"))
    named = found.join(docs.select("row", "doc_id"), "row")
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the one with the smallest id stays (of rows with one id or
    none, any one)."""
    key = fresh(docs, "row")
    keyed, unique = with_row_key(docs, key)
    found = rows_with_components(keyed.select(F.col(key).alias("row"), text_column().alias("text")))
    if unique:
        gone = found.where("row <> label")
    else:
        named = found.join(keyed.select(F.col(key).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id")), "row")
        kept = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("stays"))
        gone = named.join(kept, "label").where("row <> stays.row")
    return linking.without(keyed, key, gone.select(F.col("row").alias(key))).drop(key)
