"""Line dedup by a segment-partition edit join.

Two lines are near-duplicates if they differ by at most TAU byte insertions, deletions or substitutions (UTF-8 bytes).
Cut into TAU + 1 segments, a line that is within TAU edits of another keeps at least one segment whole, so each line
is indexed under (length, segment number, segment) and probes, for each length that a partner may have, the substrings
at the few places where that segment can still stand (the multi-match-aware ranges for a length difference). Lines
that meet under a key are candidates; an edit distance on a band of diagonals, one machine word wide and bit-parallel,
verifies them.

With `words`, lines of MIN_WORDS words or more are near-duplicates as well if one word was put in, taken out or replaced,
of whatever length it is; a CJK character or an emoji counts as a word (see WORD). Such lines share their first or their
last half. Of lines that share a half with another, and of those alone, the other half is then indexed without one word
each; lines that meet there are near-duplicates, all with all, so each is verified against one of them only.

See linking.resolve for how groups of copies are linked without all their pairs.

Lines linked directly or over others are one class. The first line of each class (by doc_id, then line number) stays;
the others are removed. Equal lines are one class at any length from min_bytes on, which is every line but blank ones
(nothing but ASCII white space: they part paragraphs and stay), and are told by 128 bits of hash. Near ones count from
edit_bytes on: in a shorter line TAU edits are too large a share of it, so only equal ones go.

Nulls: a null text stays null and has no lines; an empty one has one empty line. Rows of equal or null id are documents of
their own (null ids first, any order among equal ones), so all but one of repeated rows lose their lines; repeated lines
of one document count as well. Texts and lines of any length are taken whole. Empty tables give empty ones. All columns
of the input are kept; only the text changes. A column that is named as a count keeps its name, and the count gets
underscores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import hashing, linking
from vellum.llm.common import cut, flat_bytes, fresh, row_slices, text_column, with_row_key

TAU = 2
#: Bytes are counted by class in lanes of 8 bits, LANES classes to a number; an edit changes two counts by one at most.
LANES = 7
#: Columns of such counts, each with classes of its own.
COUNTS = ("s1", "s2", "s3", "s4")
#: What the lowest bits of a key say: found by a segment, by the first half of a line's words, by the last half.
SEGMENT, FIRST, LAST = 0, 1, 2
WORD = re.compile(rb"[\xE3-\xE9]..|[\xF0-\xF4]...|[^\x20\x09-\x0D\xE3-\xE9\xF0-\xF4]+", re.S)
MIN_WORDS = 6
WIDTH = 64
FULL = (1 << WIDTH) - 1


def edit_distance(a: bytes, b: bytes, most: int) -> int:
    """The edit distance if at most `most` (< 31), else most + 1. Bit-parallel over the band of diagonals that can matter;
    bit WIDTH-1 follows the lower edge of the band, which moves down one row a column."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    start = common_prefix(a, b)
    a, b = a[start:], b[start:]
    end = common_prefix(a[::-1], b[::-1])
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not b:
        return len(a)
    bound, most = most + 1, min(most, len(a))  # no more edits than the longer one has bytes
    # columns: b; rows: a, reaching `most` rows below the diagonal
    rows: dict[int, tuple[int, int]] = {}  # byte: its rows in the window, and the column that they were stored at

    def enter(row: int, column: int) -> None:
        if row < len(a):
            bits, at = rows.get(a[row], (0, column))
            shift = column - at
            rows[a[row]] = ((bits >> shift if shift < WIDTH else 0) | 1 << (WIDTH - 1), column)

    for row in range(most):
        enter(row, row - most)
    plus, minus, score = FULL << (WIDTH - most - 1) & FULL, 0, most
    across = 1 << (WIDTH - 2)
    for column in range(len(b)):
        enter(column + most, column)
        bits, at = rows.get(b[column], (0, column))
        match = bits >> (column - at) if column - at < WIDTH else 0
        diagonal = ((((match & plus) + plus) & FULL) ^ plus) | match | minus
        up = minus | (~(diagonal | plus) & FULL)
        down = diagonal & plus
        if column < len(a) - most:  # along the lower edge
            score += not diagonal >> (WIDTH - 1) & 1
        else:  # along the last row
            score += bool(up & across)
            score -= bool(down & across)
            across >>= 1
        plus = down | (~((diagonal >> 1) | up) & FULL)
        minus = (diagonal >> 1) & up
    return min(score, bound)


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def class_counts(body: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
    """The counts of each line's bytes in LANES classes, one after another in a number (modulo its size)."""
    lane = (hashing.mix(np.arange(256, dtype=np.uint64) + np.uint64(salt << 8)) % np.uint64(LANES)) * np.uint64(8)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((np.uint64(1) << lane)[body])])
    return ((sums[end] - sums[start]) & np.uint64((1 << 8 * LANES) - 1)).astype(np.int64)


def one_word_changed(x: bytes, y: bytes) -> bool:
    """Whether lines of MIN_WORDS words or more differ in at most one word, put in, taken out or replaced."""
    a, b = WORD.findall(x), WORD.findall(y)
    if len(a) > len(b):
        a, b = b, a
    if len(a) < MIN_WORDS or len(b) - len(a) > 1:
        return False
    at = next((i for i, (v, w) in enumerate(zip(a, b)) if v != w), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def close_counts(x: str, y: str):
    """Whether two lines' class counts differ by 2 * TAU in sum at most, as they do within TAU edits. Lanes are read as signed
    digits, exact for small differences; large ones may pass by chance."""
    ok = F.lit(True)
    for c in COUNTS:
        d = F.col(f"{x}.{c}") - F.col(f"{y}.{c}") + sum(128 << 8 * i for i in range(LANES))
        lanes = [F.abs(F.shiftright(d, 8 * i).bitwiseAND(F.lit(255).cast("bigint")) - 128) for i in range(LANES)]
        ok &= sum(lanes) <= 2 * TAU
    return ok


class Lines:
    """The lines of min_bytes or more, blank ones left out, of some rows' bytes."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray, min_bytes: int):
        breaks = np.flatnonzero(body == 10)
        start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
        start = start[start < len(body)]
        row = np.searchsorted(offsets, start, "right") - 1
        following = np.searchsorted(breaks, start)
        end = np.minimum(np.append(breaks, len(body))[following], offsets[row + 1])
        ink = np.concatenate([np.zeros(1, np.int64), np.cumsum(~hashing.SPACE[body])])
        keep = (end - start >= min_bytes) & (ink[end] > ink[start])
        self.start, self.end, self.row = start[keep], end[keep], row[keep]
        self.number = following[keep] - np.searchsorted(breaks, offsets[self.row])
        self.body, self.view = body, hashing.pieces(body)
        self.ids = hashing.ranges(self.view, self.start, self.end) & ~np.uint64(1)

    def checks(self, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The other half of their hashes."""
        return hashing.ranges(self.view, self.start[which], self.end[which], 1)

    def part(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray, length: np.ndarray, segment: int) -> np.ndarray:
        tag = hashing.mix(length.astype(np.uint64) * np.uint64(TAU + 1) + np.uint64(segment + 1))
        return kind_of_key(hashing.mix(hashing.substrings(sums, start, end) ^ tag), SEGMENT)

    def postings(self, which: np.ndarray, shortest: int) -> list[np.ndarray]:
        """Keys, ids and 0 for an indexed segment, 1 for a probe."""
        sums = hashing.prefix_sums(self.body)
        first, n, ids = self.start[which], (self.end - self.start)[which], self.ids[which]
        keys, owners, kinds = [], [], []
        for less in range(TAU + 1):
            length = n - less
            base, longer = length // (TAU + 1), length % (TAU + 1)
            place = np.zeros(len(n), np.int64)
            for segment in range(TAU + 1):
                size = base + (segment >= TAU + 1 - longer)
                for shift in range(max(-segment, less - (TAU - segment)), min(segment, less + TAU - segment) + 1):
                    at = place + shift
                    ok = (at >= 0) & (at + size <= n) & (length >= shortest)
                    s = (first + at)[ok]
                    keys.append(self.part(sums, s, s + size[ok], length[ok], segment))
                    owners.append(ids[ok])
                    kinds.append(np.full(len(s), less > 0 or shift != 0, np.uint64))
                place = place + size
        return [np.concatenate(x) for x in (keys, owners, kinds)]


def kind_of_key(key: np.ndarray, kind: int) -> np.ndarray:
    return key & ~np.uint64(3) | np.uint64(kind)


class Words:
    """The words of some ranges of bytes, as WORD finds them."""

    def __init__(self, body: np.ndarray, view: np.ndarray, edges: np.ndarray, start: np.ndarray, end: np.ndarray):
        """edges: where a word ends in any case."""
        inside = ~hashing.SPACE[body]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        for low, high, size in ((0xE3, 0xE9, 3), (0xF0, 0xF4, 4)):
            lead = np.flatnonzero((body >= low) & (body <= high))
            first[lead] = True
            after = lead + size
            first[after[after < len(body)]] = True
        first[edges[edges < len(body)]] = True
        first &= inside
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        at, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        hashes = hashing.ranges(view, at, stop)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * hashing.powers(len(at)))])
        self.down = hashing.powers(len(self.sums) + 1, "down")
        self.first, self.end = np.searchsorted(at, start), np.searchsorted(at, end)

    def key(self, value: np.ndarray, at: np.ndarray, *tags: np.ndarray) -> np.ndarray:
        label = hashing.combine([t.astype(np.uint64) for t in tags], 7)
        return hashing.mix(value * self.down[at] ^ label)

    def halves(self, ids: np.ndarray) -> list[np.ndarray]:
        """As Lines.postings: the first and the last half of the words, for the own number of words and for one less."""
        keys, owners, kinds = [], [], []
        for less in (0, 1):
            n = self.end - self.first - less
            some = n >= MIN_WORDS
            length, a, b = n[some], self.first[some], self.end[some]
            half = length // 2
            c = b - (length - half)
            keys.append(kind_of_key(self.key(self.sums[a + half] - self.sums[a], a, length, length * 0), FIRST))
            keys.append(kind_of_key(self.key(self.sums[b] - self.sums[c], c, length, length * 0 + 1), LAST))
            owners += [ids[some]] * 2
            kinds += [np.full(len(length), less, np.uint64)] * 2
        return [np.concatenate(x) for x in (keys, owners, kinds)]

    def without_one(self, ids: np.ndarray, sides: np.ndarray) -> list[np.ndarray]:
        """As Lines.postings: the words without one of them in the half that another line may not share (sides: FIRST and LAST
        added up, the halves that one does share). With the place, for a replaced word; without it, as a probe for the
        lines of all words but that, which are indexed."""
        n = self.end - self.first
        low = np.where(sides & LAST, 0, (n - 1) // 2)
        high = np.where(sides & FIRST, n, n // 2 + 1)
        line = np.repeat(np.arange(len(n)), high - low)
        gone = np.arange(len(line)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[line]
        a, b, at = self.first[line], self.end[line], self.first[line] + gone
        rest = (self.sums[at] - self.sums[a]) + (self.sums[b] - self.sums[at + 1]) * self.down[1]
        replaced = self.key(rest, a, n[line], gone + 1)
        fewer = self.key(rest, a, n[line] - 1, gone * 0)
        whole = self.key(self.sums[self.end] - self.sums[self.first], self.first, n, n * 0)
        zero = np.zeros(len(line), np.uint64)
        return [np.concatenate([replaced, fewer, whole]), np.concatenate([ids[line], ids[line], ids]), np.concatenate([zero, zero + np.uint64(1), np.zeros(len(n), np.uint64)])]


def line_rows(docs: DataFrame, buckets: int, min_bytes: int, edit_bytes: int, words: bool) -> DataFrame:
    """Lines (row, line, id, check) with a null blob, and postings (bucket, blob)."""
    names = ["row", "line", "id", "check", "bucket", "blob"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        seen = np.zeros(0, np.uint64)  # ids posted by this task, so that a line found everywhere is posted once a task

        def flush():
            columns = [np.concatenate([h[i] for h in held]) for i in range(3)]
            rows = list(linking.deal(columns, buckets, columns[0]))
            none = pa.nulls(len(rows), pa.int64())
            return pa.RecordBatch.from_arrays([none] * 4 + [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=names)

        for b in batches:
            body, offsets = flat_bytes(b.column(1))
            for first, last in row_slices(offsets, hashing.SLICE):
                own = offsets[first : last + 1] - offsets[first]
                lines = Lines(body[offsets[first] : offsets[last]], own, min_bytes)
                n = len(lines.ids)
                docs_of = b.column(0).take(pa.array(lines.row + first))
                columns = [docs_of, pa.array(lines.number), pa.array(lines.ids.view(np.int64)), pa.array(lines.checks().view(np.int64))]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
                _, which = np.unique(lines.ids, return_index=True)
                which = which[(lines.end - lines.start)[which] >= edit_bytes]
                which = which[~np.isin(lines.ids[which], seen)]
                if len(which):
                    seen = np.union1d(seen, lines.ids[which]) if len(seen) < 500_000 else np.sort(lines.ids[which])
                    held.append(lines.postings(which, edit_bytes))
                    if words:
                        held.append(Words(lines.body, lines.view, own[:-1], lines.start[which], lines.end[which]).halves(lines.ids[which]))
                if sum(len(h[0]) for h in held) > 750_000:
                    yield flush()
                    held = []
        if held:
            yield flush()

    return docs.mapInArrow(run, "row bigint, line bigint, id bigint, check bigint, bucket int, blob binary")


def line_texts(docs: DataFrame, ids: DataFrame, min_bytes: int) -> DataFrame:
    """id, check, line and its class counts of the lines whose id is among ids (id). Only those are shuffled. Should lines of
    different checks share an id, the one of the least check has it."""
    needed = linking.bloom_of_hashes(ids, "id")
    names = ["id", "check", "line", *COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            body, offsets = flat_bytes(b.column(1))
            for first, last in row_slices(offsets, hashing.SLICE):
                lines = Lines(body[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], min_bytes)
                _, hit = np.unique(lines.ids, return_index=True)
                hit = hit[linking.in_bloom_of_hashes(needed, lines.ids[hit])]
                hit = hit[[x not in seen for x in lines.ids[hit].tolist()]] if len(hit) else hit
                if not len(hit):
                    continue
                seen.update(lines.ids[hit].tolist())
                if len(seen) > 200_000:
                    seen.clear()
                start, end = lines.start[hit], lines.end[hit]
                raw = lines.body.tobytes()
                counts = [pa.array(class_counts(lines.body, start, end, salt)) for salt in range(1, len(COUNTS) + 1)]
                texts = pa.array([raw[i:j] for i, j in zip(start.tolist(), end.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(lines.ids[hit].view(np.int64)), pa.array(lines.checks(hit).view(np.int64)), texts, *counts], names=names)

    found = docs.mapInArrow(run, "id bigint, check bigint, line binary, " + ", ".join(f"{c} bigint" for c in COUNTS))
    found = found.join(ids, "id", "left_semi")
    return found.groupBy("id").agg(F.min("check").alias("check"), *[F.min_by(c, "check").alias(c) for c in ("line", *COUNTS)])


def verified(pairs: DataFrame, texts: DataFrame, near) -> DataFrame:
    """The pairs (a, b) of line ids whose texts are near each other."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [near(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("id").alias("a"), F.col("line").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("line").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(judge, "a bigint, b bigint")


def edit_links(postings: DataFrame, texts: DataFrame) -> DataFrame:
    near = lambda x, y: edit_distance(x, y, TAU) <= TAU
    return linking.resolve(postings, lambda pairs: verified(pairs, texts, near), texts.select("id", *COUNTS), lambda rest: linking.joined(rest, close_counts))


def word_links(postings: DataFrame, texts: DataFrame, buckets: int) -> DataFrame:
    """Links by one changed word among the lines that share a half with another."""
    sides = postings.groupBy("id").agg(F.bit_or(F.col("key").bitwiseAND(F.lit(3).cast("bigint"))).alias("sides"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body, offsets = flat_bytes(b.column(1))
            for first, last in row_slices(offsets, hashing.SLICE // 4):
                own, part = offsets[first : last + 1] - offsets[first], body[offsets[first] : offsets[last]]
                ids = b.column(0).to_numpy()[first:last].view(np.uint64)
                words = Words(part, hashing.pieces(part), own[:-1], own[:-1], own[1:])
                columns = words.without_one(ids, b.column(2).to_numpy()[first:last])
                yield linking.blob_batch(list(linking.deal(columns, buckets, columns[0])))

    blobs = texts.join(sides, "id").select("id", "line", "sides").mapInArrow(run, "bucket int, blob binary")
    met = cut(linking.by_bucket(blobs, buckets, linking.live_postings, 3, ["key", "id", "kind"]))
    hubs = met.where("kind = 0").groupBy("key").agg(F.min("id").alias("hub"))
    pairs = met.join(hubs, "key").where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    return verified(pairs, texts, one_word_changed)


def removed_lines(docs: DataFrame, min_bytes: int = 1, edit_bytes: int = 32, words: bool = False) -> DataFrame:
    """row, lines: the 0-based numbers of the lines to remove, for the rows (row, id, text) that have any. row is unique."""
    texts = docs.select("row", "text")
    buckets = linking.bucket_count(linking.text_bytes(docs))
    made = cut(line_rows(texts, buckets, min_bytes, edit_bytes, words))
    lines = made.where("blob is null").select("row", "line", "id", "check")
    blobs = made.where("blob is not null").select("bucket", "blob")
    postings = cut(linking.by_bucket(blobs, buckets, linking.live_postings, 3, ["key", "id", "kind"]))
    found = cut(line_texts(texts, cut(postings.select("id").distinct()), max(min_bytes, edit_bytes)))
    kind = F.col("key").bitwiseAND(F.lit(3).cast("bigint"))
    links = edit_links(postings.where(kind == SEGMENT).select("key", "id"), found)
    if words:
        links = cut(links.unionByName(word_links(postings.where(kind != SEGMENT), found, buckets)))
    labels = linking.components(links).join(found.select("id", "check"), "id")
    line = F.col("line")
    # a class is a label, or an id and a check where there is none
    classed = lines.join(labels, ["id", "check"], "left").select("row", line, F.coalesce("label", "id").alias("class"), F.when(F.col("label").isNull(), F.col("check")).alias("check"))
    if "id" in docs.columns:  # rows in another order than their ids
        classed = classed.join(docs.select("row", F.col("id").alias("doc")), "row")
        order = F.struct(F.col("doc").isNotNull(), "doc", "row", "line")
    else:
        order = F.struct("row", "line")
    least = classed.groupBy("class", "check").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    least = cut(least.select(F.col("class").alias("of_class"), F.col("check").alias("of_check"), F.col("first.row").alias("first_row"), F.col("first.line").alias("first_line")))
    both = classed.join(least, (F.col("class") == F.col("of_class")) & F.col("check").eqNullSafe(F.col("of_check")))
    gone = both.where((F.col("row") != F.col("first_row")) | (F.col("line") != F.col("first_line")))
    return cut(gone.groupBy("row").agg(F.collect_list("line").alias("lines")))


def dedup_lines(docs: DataFrame, min_bytes: int = 1, edit_bytes: int = 32, words: bool = False, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """The rows with repeated lines cut from their text, plus n_lines (before) and n_removed."""
    taken = {c.lower() for c in docs.columns}
    n_lines, n_removed = (next(n for n in (c + "_" * k for k in range(len(taken) + 1)) if n.lower() not in taken) for c in counts)
    key, lines, columns = fresh(docs, "row", n_lines, n_removed), fresh(docs, "lines", n_lines, n_removed), docs.columns
    docs, unique = with_row_key(docs, key)
    text = docs.select(F.col(key).alias("row"), *([] if unique else [F.col("doc_id").cast("bigint").alias("id")]), text_column().alias("text"))
    gone = removed_lines(text, min_bytes, edit_bytes, words).select(F.col("row").alias(key), F.col("lines").alias(lines))
    maybe = fresh(docs, "maybe", n_lines, n_removed, lines)
    of_text = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    docs = docs.withColumn(n_lines, F.when(F.col("text").isNull(), 0).otherwise(of_text).cast("bigint"))
    docs = docs.withColumn(maybe, linking.passes(linking.bloom(gone, key), key))
    rest = docs.where(~F.col(maybe)).withColumn(n_removed, F.lit(0).cast("bigint")).drop(key, maybe)
    work = docs.where(maybe).join(gone, key, "left").drop(key, maybe)
    work = work.withColumn(n_removed, F.greatest(F.size(lines), F.lit(0)).cast("bigint"))
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for value, drop in zip(b.column("text").to_pylist(), b.column(lines).to_pylist()):
                if drop:
                    drop = set(drop)
                    value = "\n".join([x for i, x in enumerate(value.split("\n")) if i not in drop])
                out.append(value)
            yield b.set_column(at, b.schema.field(at), pa.array(out, b.schema.field(at).type)).drop_columns([lines])

    shape = work.drop(lines).schema
    return rest.unionByName(work.mapInArrow(run, shape))
