"""Words and shingles of whole Arrow columns as 64-bit hashes, without a Python loop over words.

Two kinds of hashes. `ranges` decides equality: a sum over 8-byte pieces, each mixed with its place, so that no
structure of the bytes makes two ranges collide; different ones do so about once in 2^64 pairs (twice that many bits
with two seeds). `substrings` only proposes: a polynomial modulo 2^64 from prefix sums, constant work a range however long
it is, but built texts of 1,024 bytes or more (Thue-Morse words) collide, so whatever it matches is verified.
"""

from __future__ import annotations

import numpy as np

from vellum.llm import common  # noqa: F401  (settings of a worker's memory)

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that are hashed at once: what bounds a worker's memory.
SLICE = 1 << 18

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def powers(n: int, way: str = "up") -> np.ndarray:
    """BASE^0 .. BASE^(n-1), or of its inverse."""
    if len(_powers[way]) < n:
        base = int(BASE) if way == "up" else inverse(int(BASE))
        steps = np.full(max(n + 1, SLICE + 2), base, np.uint64)
        steps[0] = 1
        _powers[way] = np.multiply.accumulate(steps)
    return _powers[way][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(body: np.ndarray) -> np.ndarray:
    out = np.empty(len(body) + 1, np.uint64)
    out[0] = 0
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * powers(len(body)), out=out[1:])
    return out


def substrings(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of byte ranges, to propose candidates; equal bytes, equal hashes, wherever they stand."""
    down = powers(len(sums), "down")
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def pieces(body: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number; zeros follow the last byte."""
    padded = np.zeros(len(body) + 8, np.uint8)
    padded[: len(body)] = body
    return np.ndarray(len(body) + 1, "<u8", padded.data, strides=(1,))


#: Keeps the first 0 .. 8 bytes of a piece.
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def ranges(view: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the byte ranges of a body, given its pieces; equal bytes, equal hashes, wherever they stand."""
    size = end - start
    salt = np.uint64((0xD6E8FEB86659FD93 + seed * 0xA24BAED4963EE407) & (1 << 64) - 1)
    place = lambda j: mix(j.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + salt)
    h = mix((view[start] & KEEP[np.minimum(size, 8)]) ^ place(np.zeros(1, np.int64))[0])
    longer = np.flatnonzero(size > 8)
    if len(longer):
        count = (size[longer] - 1) // 8  # pieces after the first
        begin = np.cumsum(count) - count
        owner = np.repeat(np.arange(len(longer)), count)
        j = np.arange(len(owner)) - begin[owner] + 1
        left = size[longer][owner] - 8 * j
        value = view[start[longer][owner] + 8 * j] & KEEP[np.minimum(left, 8)]
        h[longer] += np.add.reduceat(mix(value ^ place(j)), begin)
    return mix(h + size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def words(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word (A-Z lower-cased, split at ASCII white space): hash, row, first byte, end."""
    body = LOWER[body]
    inside = ~SPACE[body]
    if not len(body):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    edges = offsets[:-1][np.diff(offsets) > 0]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    last[ends] = inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    rows = np.searchsorted(offsets, start, "right") - 1
    return ranges(pieces(body), start, end), rows, start, end


def combine(parts: list[np.ndarray], seed: int) -> np.ndarray:
    """An ordered tuple's hash from its parts' hashes."""
    h = np.full(len(parts[0]), seed, np.uint64)
    for p in parts:
        h = h * np.uint64(0xFF51AFD7ED558CCD) + p
    return mix(h)


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all k-word shingles, repeats included; a row of fewer words has them all as its only one."""
    n = len(hashes)
    count = np.bincount(rows, minlength=n_rows)
    parts = []
    if n >= k:
        at = np.flatnonzero(rows[: n - k + 1] == rows[k - 1 :])
        parts.append((combine([hashes[at + j] for j in range(k)], k), rows[at]))
    begin = np.concatenate([[0], np.cumsum(count)])[:-1]
    for few in range(1, k):
        own = np.flatnonzero(count == few)
        if len(own):
            parts.append((combine([hashes[begin[own] + j] for j in range(few)], few), own))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def distinct_by_row(values: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row, ascending, row after row, and where each row begins (n_rows + 1 places)."""
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[keep], r[keep]
    return v, np.searchsorted(r, np.arange(n_rows + 1))
