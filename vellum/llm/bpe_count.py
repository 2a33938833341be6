"""Token counts without tokens: byte-pair merging with a heap over a doubly linked list.

The pair of lowest rank is popped (leftmost first among equals), its two symbols become one, and the two pairs
around it are pushed. A popped pair that has changed since is skipped. A piece of n symbols and m merges has
n - m tokens, so no identifiers are made.

Nulls: a null text has 0 bytes and 0 tokens. Rows are independent. Columns other than the id and text are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vellum.llm.bpe_encode import Forgetful, stands_alone
from vellum.llm.common import text_column


class Counter:
    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        vocab: dict[str, int] = model["vocab"]
        self.joined: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.joined[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.symbol = [vocab[c] for c in byte_characters()]
        self.special = [t["content"] for t in file.get("added_tokens", [])]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.split = regex.compile(pattern).findall
        self.pieces = Forgetful(self.count_piece)
        self.words = Forgetful(self.count_word)

    def count_piece(self, piece: str) -> int:
        sym = [self.symbol[b] for b in piece.encode()]
        n = len(sym)
        joined = self.joined.get
        heap = [(hit[0], i) for i in range(n - 1) if (hit := joined((sym[i], sym[i + 1])))]
        if not heap:
            return n
        heapify(heap)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if sym[i] < 0 or j >= n:
                continue
            hit = joined((sym[i], sym[j]))
            if hit is None or hit[0] != rank:
                continue
            sym[i], sym[j] = hit[1], -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if hit := joined((sym[i], sym[k])):
                    heappush(heap, (hit[0], i))
            h = before[i]
            if h >= 0 and (hit := joined((sym[h], sym[i]))):
                heappush(heap, (hit[0], h))
        return n - merges

    def count_word(self, word: str) -> int | None:
        """Of a word and the single space before it; None if that depends on what stands around."""
        return sum(map(self.pieces.__getitem__, self.split(f" {word}"))) if stands_alone(word) else None

    def count(self, text: str) -> int:
        """Special strings in the text are one token each, as the library takes them by default; what stands between is split alone."""
        if self.cut is not None and any(s in text for s in self.special):
            parts = self.cut.split(text)
            return len(parts) - 1 + sum(map(self.count_plain, parts))
        return self.count_plain(text)

    def count_plain(self, text: str) -> int:
        first, *rest = text.split(" ")
        if stands_alone(first):
            words = list(map(self.words.__getitem__, rest))
            if None not in words:
                return sum(words) + sum(map(self.pieces.__getitem__, self.split(first)))
        return sum(map(self.pieces.__getitem__, self.split(text)))


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in such vocabularies: itself if printable in Latin-1, else the next free one from U+0100."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


_COUNTERS: dict[tuple[str, str], Counter] = {}


def counter(path: str, pattern: str) -> Counter:
    if (path, pattern) not in _COUNTERS:
        _COUNTERS[path, pattern] = Counter(path, pattern)
    return _COUNTERS[path, pattern]


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each row's whole text. A map over the
    rows: no shuffle. An empty or null text counts 0 and is never over a limit of 0 or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = [c.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    picked = docs.select(docs[id_col].cast("bigint").alias(id_col), text_column(text_col).alias("text"))
    return picked.mapInArrow(run, f"{id_col} bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
