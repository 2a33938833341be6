"""Byte-level BPE by longest matches and backtracking, exact in linear time.

A sequence of tokens is the merge result of its bytes if and only if each two neighbours are *compatible*:
merging the bytes of just those two gives the same two back. So the encoder takes the longest vocabulary entry
at each place (an Aho-Corasick automaton over the bytes as Latin-1 characters finds them all in one pass), tries
shorter prefixes while the neighbour to the left is incompatible, and steps back when none is left. Places that
were stepped back from are marked and never tried again, which bounds the work by the length.

Nulls: a null text has no tokens. Rows are independent, so ties, repeats and empty tables need no rule. Columns
of the input other than the id and the text are dropped.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vellum.llm.common import text_column

#: Entries that a worker remembers, so that its memory stays bounded; what is dropped is computed anew.
REMEMBERED = 400_000
#: Longer pieces are encoded but not remembered.
LONGEST_KEY = 64
OUT = "{id} bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_plainly(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: join the neighbours of lowest rank, leftmost first, until none joins. Quadratic; for short pieces."""
    rank, none = ranks.get, 1 << 60
    cuts = list(range(len(piece) + 1))
    pairs = [rank(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (lowest := min(pairs)) < none:
        i = pairs.index(lowest)
        del cuts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = rank(piece[cuts[i] : cuts[i + 2]], none)
        if i:
            pairs[i - 1] = rank(piece[cuts[i - 1] : cuts[i + 1]], none)
    return [ranks[piece[i:j]] for i, j in zip(cuts, cuts[1:])]


class Forgetful(dict):
    """A memo that computes what it lacks and starts anew when it is full."""

    def __init__(self, compute: Callable, limit: int = REMEMBERED):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) >= self.limit:
            self.clear()
        if not isinstance(key, str) or len(key) <= LONGEST_KEY:
            self[key] = value
        return value


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        # An entry that its own bytes don't merge to can only be a whole piece, never a part of one.
        reachable = {t: r for t, r in ranks.items() if len(t) == 1 or self.merges_to_itself(t)}
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in reachable.items():
            self.trie.add_word(token.decode("latin-1"), rank)
        self.rank_of = {token.decode("latin-1"): rank for token, rank in reachable.items()}
        self.widest = max(map(len, reachable), default=1)
        self.reachable = reachable
        self.shorter = Forgetful(self.next_shorter)
        self.fits = Forgetful(self.compatible)
        self.pieces = Forgetful(self.encode_piece)
        self.words = Forgetful(self.encode_word)
        self.length = {rank: len(token) for rank, token in self.token.items()}
        self.width = max(self.token, default=0) + 1
        self.digits = [str(i) for i in range(max(ranks.values(), default=0) + 1)]

    def merges_to_itself(self, token: bytes) -> bool:
        return merge_plainly(token, self.ranks) == [self.ranks[token]]

    def next_shorter(self, rank: int) -> int:
        """The longest other entry that the token begins with, or -1."""
        token = self.token[rank]
        return next((self.reachable[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.reachable), -1)

    def compatible(self, pair: int) -> bool:
        """pair: the left rank times the width, plus the right rank."""
        left, right = divmod(pair, self.width)
        return merge_plainly(self.token[left] + self.token[right], self.ranks) == [left, right]

    def longest(self, data: str, at: int) -> int:
        """The longest entry that the bytes begin with at this place, or -1. The trie's path may go on past the last whole entry."""
        n = self.trie.longest_prefix(data[at : at + self.widest])
        while n:
            if (rank := self.rank_of.get(data[at : at + n])) is not None:
                return rank
            n -= 1
        return -1

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        if raw in self.ranks:
            return (self.ranks[raw],)
        data = raw.decode("latin-1")
        n, length, shorter, fits, width = len(data), self.length, self.shorter, self.fits, self.width
        dead: set[int] = set()
        out: list[int] = []
        at, candidate, last = 0, self.longest(data, 0), -1
        while at < n:
            while candidate >= 0:
                end = at + length[candidate]
                if end not in dead and (last < 0 or fits[last * width + candidate]):
                    break
                candidate = shorter[candidate]
            if candidate >= 0:
                out.append(candidate)
                last, at = candidate, end
                candidate = self.longest(data, at)
            else:
                if last < 0:
                    raise ValueError("a byte of the text is no entry of the vocabulary")
                dead.add(at)
                candidate = out.pop()
                at -= length[candidate]
                last = out[-1] if out else -1
        return tuple(out)

    def encode_word(self, word: str) -> tuple[int, ...] | None:
        """What a word and the single space before it become; None if that depends on what stands around."""
        if not stands_alone(word):
            return None
        return tuple(chain.from_iterable(map(self.pieces.__getitem__, self.split(f" {word}"))))

    def encode(self, text: str) -> list[int]:
        """A single space before a word belongs to that word's first piece, so words are looked up one by one, unless white
        space meets a space or an end of the text: then the pattern splits the text as a whole."""
        first, *rest = text.split(" ")
        if stands_alone(first):
            words = list(map(self.words.__getitem__, rest))
            if None not in words:
                return [*chain.from_iterable(map(self.pieces.__getitem__, self.split(first))), *chain.from_iterable(words)]
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def stands_alone(word: str) -> bool:
    return word != "" and not word[0].isspace() and not word[-1].isspace()


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One a worker process."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(load_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each row's whole text encoded, and the ids decoded again: the id column, n_tokens, ids_sha256 (decimal ids joined by
    commas), decoded_sha256; with_ids adds ids array<int>. A map over the rows: no shuffle. An empty or null text has no
    tokens and the digests of nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in batches:
            counts, ids_sha, decoded_sha, all_ids = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = e.encode(text)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(e.digits.__getitem__, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(e.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids)
            columns = [batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    picked = docs.select(docs[id_col].cast("bigint").alias(id_col), text_column(text_col).alias("text"))
    return picked.mapInArrow(run, OUT.format(id=id_col) + ", ids array<int>" * with_ids)
