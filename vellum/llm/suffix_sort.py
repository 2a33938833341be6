"""Suffix-array dedup: bytes covered by strings of WINDOW bytes that occur more than once, by deep-shallow sorting.

A full suffix array of a corpus is a sort of every byte. Here only suffixes at anchors are sorted: a place is an anchor
if the hash of its next GRAM bytes is the least in some WINDOW-byte string around it, so every such string holds an
anchor, at the same place in all its occurrences, and about one place in sixty is one.

1. Anchors are dealt by their hash; those that occur once go no further. Of occurrences whose whole surroundings
   (all that a WINDOW around the anchor can reach) are equal, every byte of them is covered, and one representative
   stands for them from here on.
2. Representatives that differ are dealt by the anchor's hash with their surroundings: the suffix from the anchor and
   the reversed prefix before it. Both are sorted by deep-shallow sorting: multikey quicksort down to SHALLOW bytes,
   then a blind trie for each group whose common prefix goes on. With the longest common prefixes of neighbours in both
   orders, a string that begins l bytes before the anchor occurs twice exactly if two representatives share the class
   of suffixes of WINDOW - l equal bytes and the class of prefixes of l equal bytes; so all l are judged by counting
   class pairs, however large a group is.
3. Covered ranges are merged for each document and cut out.

Strings are judged on the input, never cross documents, and may overlap. Only texts of documents with shared anchors are
shuffled (a Bloom filter of fixed size leaves the others in place).

Nulls: a null text is empty: no bytes, nothing removed. Texts shorter than WINDOW have no such string. Rows of equal or
null id are documents of their own, each with its own row in the result. Repeated texts cover each other wholly (from
WINDOW bytes on). A text of any length is taken whole. Empty tables give none. Only the id and text are read, so other
columns may have any name. That surroundings are equal is told by 128 bits: those of the anchor and of its surroundings,
which are too short for the texts that can be built against a polynomial hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import hashing, linking
from vellum.llm.common import cut, flat_bytes, row_slices, text_column, with_row_key

WINDOW, GRAM = 200, 72
REACH = WINDOW - GRAM
SHALLOW = 16


def multikey_quicksort(words: np.ndarray) -> list[np.ndarray]:
    """Groups of rows that agree in all columns (unsigned words), in ascending order: three-way partition on one column at
    a time around a pivot; what equals the pivot goes on with the next column."""
    done: list[np.ndarray] = []
    todo = [(np.arange(len(words)), 0)] if len(words) else []
    while todo:
        rows, column = todo.pop()
        if len(rows) == 1 or column == words.shape[1]:
            done.append(rows)
            continue
        own = words[rows, column]
        if len(rows) > 2048:
            pivot = np.partition(own[:: len(own) // 31], 15)[15]
            parts = [(rows[own < pivot], column), (rows[own == pivot], column + 1), (rows[own > pivot], column)]
        else:  # a small range: all its pivots at once
            order = np.argsort(own, kind="stable")
            ends = np.flatnonzero(np.diff(own[order].view(np.int64))) + 1
            parts = [(p, column + 1) for p in np.split(rows[order], ends)]
        todo += [p for p in reversed(parts) if len(p[0])]
    return done


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differing = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differing.bit_length() + 7) // 8


class BlindTrie:
    """Strings in order by their branching places only. A search goes down without looking at skipped bytes, compares
    whole strings once, at the leaf, and inserts where that comparison says."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None  # a leaf: [-1, rows]; a node: [place, {byte or -1 at the end: child}]

    def insert(self, row: int) -> None:
        s = self.strings[row]
        if self.root is None:
            self.root = [-1, [row]]
            return
        node = self.root
        while node[0] >= 0:
            at = s[node[0]] if node[0] < len(s) else -1
            node = node[1].get(at) or next(iter(node[1].values()))
        other = self.strings[node[1][0]]
        if s == other:
            node[1].append(row)
            return
        same = common_prefix(s, other)
        parent, edge, node = None, None, self.root
        while 0 <= node[0] < same:
            parent, edge = node, (s[node[0]] if node[0] < len(s) else -1)
            node = node[1][edge]
        new = s[same] if same < len(s) else -1
        if node[0] == same:
            node[1][new] = [-1, [row]]
            return
        branch = [same, {new: [-1, [row]], (other[same] if same < len(other) else -1): node}]
        if parent is None:
            self.root = branch
        else:
            parent[1][edge] = branch

    def in_order(self) -> list[int]:
        out, todo = [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if node[0] < 0:
                out += node[1]
            else:
                todo += [node[1][k] for k in sorted(node[1], reverse=True)]
        return out


def deep_shallow_sort(strings: list[bytes]) -> tuple[list[int], np.ndarray]:
    """The order of the strings, and the common prefix of each with the one before it in that order (0 for the first)."""
    n = len(strings)
    if not n:
        return [], np.zeros(0, np.int64)
    head = np.frombuffer(b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings), ">u8").reshape(n, -1).astype(np.uint64)
    length = np.minimum([len(s) for s in strings], SHALLOW).astype(np.uint64)  # parts an end from bytes of zero
    order: list[int] = []
    for group in multikey_quicksort(np.column_stack([head, length])):
        if len(group) == 1 or length[group[0]] < SHALLOW:
            order += group.tolist()
            continue
        trie = BlindTrie(strings)
        for row in group.tolist():
            trie.insert(row)
        order += trie.in_order()
    lcp = np.zeros(n, np.int64)
    for i in range(1, n):
        a, b = strings[order[i - 1]], strings[order[i]]
        lcp[i] = len(a) if a == b else common_prefix(a, b)
    return order, lcp


def repeated_around(suffixes: list[bytes], prefixes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each occurrence of an anchor, with its suffix (from the anchor) and reversed prefix: the least and the greatest l
    such that the WINDOW bytes from l before the anchor occur with another one too; -1 if none does. What they cover
    together has no gap, since each holds the anchor's own bytes."""
    n = len(suffixes)
    low, high = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    by_suffix, suffix_lcp = deep_shallow_sort(suffixes)
    by_prefix, prefix_lcp = deep_shallow_sort(prefixes)
    by_suffix, by_prefix = np.array(by_suffix, np.int64), np.array(by_prefix, np.int64)
    right = np.array([len(s) for s in suffixes], np.int64)
    left = np.array([len(s) for s in prefixes], np.int64)
    suffix_class, prefix_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for l in range(REACH + 1):  # noqa: E741
        suffix_class[by_suffix] = np.cumsum(suffix_lcp < WINDOW - l)
        prefix_class[by_prefix] = np.cumsum(prefix_lcp < l)
        at = np.flatnonzero((left >= l) & (right >= WINDOW - l))
        pair = suffix_class[at] * (n + 1) + prefix_class[at]
        order = np.argsort(pair, kind="stable")
        same = pair[order][1:] == pair[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        hit = at[twice]
        low[hit] = np.where(low[hit] < 0, l, low[hit])
        high[hit] = l
    return low, high


def sliding(a: np.ndarray, width: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over each `width` neighbours: one value for each place where they fit."""
    n = len(a)
    if n < width:
        return a[:0]
    padded = np.full(-(-n // width) * width, fill, a.dtype)
    padded[:n] = a
    blocks = padded.reshape(-1, width)
    forward = op.accumulate(blocks, axis=1).reshape(-1)
    backward = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return op(backward[: n - width + 1], forward[width - 1 : n])


def anchors(body: np.ndarray, offsets: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, rows and hashes of the anchors."""
    none = np.zeros(0, np.int64)
    n = len(body)
    if n < WINDOW:
        return none, none, none.astype(np.uint64)
    grams = n - GRAM + 1
    down = hashing.powers(n + 1, "down")
    h = hashing.mix((sums[GRAM:] - sums[:grams]) * down[:grams])
    least = sliding(h, REACH + 1, np.minimum, np.iinfo(np.uint64).max)
    ends = np.repeat(offsets[1:], np.diff(offsets))  # the end of each byte's row
    least[ends[: len(least)] < np.arange(len(least)) + WINDOW] = 0
    padded = np.zeros(len(least) + 2 * REACH, np.uint64)
    padded[REACH : REACH + len(least)] = least
    best = sliding(padded, REACH + 1, np.maximum, 0)
    at = np.flatnonzero(best[:grams] == h)
    return at, np.searchsorted(offsets, at, "right") - 1, h[at]


def anchor_blobs(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush():
            columns = [np.concatenate([x[i] for x in held]) for i in range(4)]
            held.clear()
            return linking.blob_batch(list(linking.deal(columns, buckets, columns[0])))

        for b in batches:
            body, offsets = flat_bytes(b.column(1))
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for first, last in row_slices(offsets, hashing.SLICE):
                own = offsets[first : last + 1] - offsets[first]
                part = body[offsets[first] : offsets[last]]
                sums = hashing.prefix_sums(part)
                at, rows, h = anchors(part, own, sums)
                if not len(at):
                    continue
                left = np.minimum(at - own[rows], REACH)
                right = np.minimum(own[rows + 1] - at, WINDOW)
                around = hashing.substrings(sums, at - left, at + right)
                around = hashing.mix(around ^ hashing.mix((left * (WINDOW + 1) + right).astype(np.uint64)))
                place = ((at - own[rows]) << 8 | right).astype(np.uint64)
                held.append((h, around, ids[rows + first].astype(np.int64).view(np.uint64), place))
                if sum(len(x[0]) for x in held) > 400_000:
                    yield flush()
        if held:
            yield flush()

    return docs.mapInArrow(run, "bucket int, blob binary")


def shared(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Rows (doc, start, end, place, key) from a bucket's anchors: ranges that are covered wholly (place -1), and occurrences
    to be sorted (place of the anchor): one for each distinct surrounding of an anchor that has several."""
    key, around, doc, place = columns
    order = np.lexsort((place, doc, around, key))
    key, around, doc, place = key[order], around[order], doc[order], place[order]
    n = len(key)
    new_key, new_pair = np.ones(n, bool), np.ones(n, bool)
    new_key[1:] = key[1:] != key[:-1]
    new_pair[1:] = new_key[1:] | (around[1:] != around[:-1])
    key_no, pair_no = np.cumsum(new_key) - 1, np.cumsum(new_pair) - 1
    copies = np.bincount(pair_no)[pair_no] if n else np.zeros(0, np.int64)
    kinds = np.bincount(key_no[new_pair])[key_no] if n else np.zeros(0, np.int64)
    at, right = (place >> np.uint64(8)).astype(np.int64), (place & np.uint64(255)).astype(np.int64)
    start, end = at - np.minimum(at, REACH), at + right
    whole = (copies > 1) & (end - start >= WINDOW)
    sort = new_pair & (kinds > 1)
    pick = lambda c, x: np.concatenate([c[whole], x[sort]]).astype(np.int64)
    none = np.full(int(whole.sum()), -1)
    return [pick(doc.view(np.int64), doc.view(np.int64)), pick(start, start), pick(end, end), np.concatenate([none, at[sort]]), np.concatenate([none * 0, key.view(np.int64)[sort]])]


def surroundings(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, row, place, left, bytes around) of the occurrences to be sorted."""
    asked = found.where("place >= 0").groupBy("row").agg(F.collect_list(F.struct("place", "start", "end", "key")).alias("asked"))
    asked = cut(asked)
    texts = docs.where(linking.passes(linking.bloom(asked, "row"), "row")).join(asked, "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "row", "place", "left", "around"]
        for b in batches:
            rows: list[tuple] = []
            for doc, text, wanted in zip(*(b.column(i).to_pylist() for i in range(3))):
                raw = text.encode()
                rows += [(w["key"], doc, w["place"], w["place"] - w["start"], raw[w["start"] : w["end"]]) for w in wanted]
            for at in range(0, len(rows), 20_000):
                columns = list(zip(*rows[at : at + 20_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 4 else pa.int64()) for i, c in enumerate(columns)], names=names)

    return texts.select("row", "text", "asked").mapInArrow(run, "key bigint, row bigint, place bigint, left bigint, around binary")


def sorted_ranges(occurrences: DataFrame, buckets: int) -> DataFrame:
    """Covered ranges (row, start, end) by sorting the occurrences of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [x for x in batches if x.num_rows]
        if not whole:
            return
        t = pa.Table.from_batches(whole)
        lefts, around = t.column("left").to_pylist(), t.column("around").to_pylist()
        low, high = repeated_around([a[n:] for a, n in zip(around, lefts)], [a[:n][::-1] for a, n in zip(around, lefts)])
        hit = np.flatnonzero(high >= 0)
        place = t.column("place").to_numpy()[hit]
        yield pa.RecordBatch.from_arrays([pa.array(t.column("row").to_numpy()[hit]), pa.array(place - high[hit]), pa.array(place - low[hit] + WINDOW)], names=["row", "start", "end"])

    return occurrences.repartition(buckets, "key").mapInArrow(run, "row bigint, start bigint, end bigint")


def covered_ranges(docs: DataFrame) -> DataFrame:
    """row, ranges array<struct<start, end>> of the documents in which some string repeats; ranges may overlap."""
    buckets = linking.bucket_count(linking.text_bytes(docs))
    found = cut(linking.by_bucket(anchor_blobs(docs, buckets), buckets, linking.whole(shared), 4, ["row", "start", "end", "place", "key"]))
    ranges = found.where("place < 0").select("row", "start", "end").unionByName(sorted_ranges(surroundings(found, docs), buckets))
    return cut(ranges.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("ranges")))


def merge(ranges: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (runs removed), kept_sha256 (of the remaining bytes), kept (binary)."""
    docs, _ = with_row_key(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_column().alias("text")), "row")
    ranges = covered_ranges(docs.select("row", "text"))
    docs = docs.withColumn("maybe", linking.passes(linking.bloom(ranges, "row"), "row"))
    zero = F.lit(0).cast("bigint")
    kept = F.encode("text", "UTF-8")
    rest = docs.where("not maybe").select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256"), kept.alias("kept"))
    work = docs.where("maybe").join(ranges, "row", "left").select("doc_id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        for b in batches:
            sizes, removed, spans, digests, bodies = [], [], [], [], []
            for text, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = text.encode()
                runs = merge([(r["start"], r["end"]) for r in own or ()])
                edges = [0, *(x for r in runs for x in r), len(raw)]
                left = b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2]))
                sizes.append(len(raw))
                removed.append(len(raw) - len(left))
                spans.append(len(runs))
                digests.append(hashlib.sha256(left).hexdigest())
                bodies.append(left)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(digests, pa.string()), pa.array(bodies, pa.binary())], names=names)

    done = work.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return rest.unionByName(done)
