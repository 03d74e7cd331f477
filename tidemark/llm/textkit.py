"""Vectorised word reading shared by the operators on whole texts.

Everything works on the UTF-8 bytes of an Arrow string column, block by block, so
memory is bounded by the block and not by the partition.  A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes that one block of whole documents holds (a longer document is a block alone).
BLOCK_BYTES = 1 << 20

U64 = np.uint64


def splitmix(x: np.ndarray | int, seed: int = 0) -> np.ndarray:
    """The 64-bit finaliser of the public splitmix64 generator, on arrays."""
    with np.errstate(over="ignore"):
        z = np.asarray(x, dtype=U64) + U64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
        z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
        return z ^ (z >> U64(31))


def combine(a: np.ndarray, b: np.ndarray | int, seed: int = 0) -> np.ndarray:
    """An ordered 64-bit mix of two words."""
    with np.errstate(over="ignore"):
        return splitmix(np.asarray(a, dtype=U64) * U64(0xD6E8FEB86659FD93) + np.asarray(b, dtype=U64), seed)


def byte_class(pattern_bytes: Iterator[int]) -> np.ndarray:
    """A table of 256 flags: which bytes belong to words."""
    out = np.zeros(256, dtype=bool)
    out[list(pattern_bytes)] = True
    return out


#: Words between blanks: [^\x20\x09-\x0D]+
BLANK_SPLIT = byte_class(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words of letters and digits, any non-ASCII byte included: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
ALNUM_SPLIT = byte_class(b for b in range(256) if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)

_BYTE_VALUES = splitmix(np.arange(256), seed=11)
_FOLDED_VALUES = _BYTE_VALUES.copy()
_FOLDED_VALUES[0x41:0x5B] = _BYTE_VALUES[0x61:0x7B]
_STEP = 0xA24BAED4963EE407 | 1
_STEP_INVERSE = pow(_STEP, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK_BYTES + 1), base, dtype=U64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = _POWERS[base] = np.multiply.accumulate(steps)
    return have


@dataclass
class Words:
    """The words of a block of documents, in order."""

    data: np.ndarray  #: bytes of the block
    starts: np.ndarray  #: first byte of each word
    ends: np.ndarray  #: byte after each word
    ptr: np.ndarray  #: words ptr[d]..ptr[d+1] belong to document d of the block
    hashes: np.ndarray  #: 64-bit hash of each word
    first: int  #: row of the block's first document in its batch

    @property
    def docs(self) -> int:
        return len(self.ptr) - 1

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), np.diff(self.ptr))


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hashes of byte spans; the spans are read in pieces that bound the prefix sums."""
    out = np.empty(len(starts), dtype=U64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            base = int(starts[at])
            upto = max(at + 1, int(np.searchsorted(ends, base + BLOCK_BYTES, side="right")))
            s, e = starts[at:upto] - base, ends[at:upto] - base
            size = int(e[-1])
            prefix = np.empty(size + 1, dtype=U64)
            prefix[0] = 0
            np.cumsum(values[data[base : base + size]] * _powers(_STEP, size)[:size], out=prefix[1:])
            out[at:upto] = (prefix[e] - prefix[s]) * _powers(_STEP_INVERSE, size + 1)[s] + (e - s).astype(U64)
            at = upto
    return splitmix(out, seed=3)


def blocks(texts: pa.Array, split: np.ndarray, fold: bool = False, block_bytes: int = BLOCK_BYTES) -> Iterator[Words]:
    """The words of each block of whole documents of a string column."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * texts.offset)
    raw = texts.buffers()[2]
    raw = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    values = _FOLDED_VALUES if fold else _BYTE_VALUES
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block_bytes, side="right")) - 1)
        data = raw[offsets[at] : offsets[upto]]
        bounds = offsets[at : upto + 1] - offsets[at]
        inside = split[data]
        before = np.empty(len(data), dtype=bool)
        if len(data):
            before[0] = False
            before[1:] = inside[:-1]
            before[bounds[:-1][bounds[:-1] < len(data)]] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty(len(data), dtype=bool)
        if len(data):
            after[-1] = False
            after[:-1] = inside[1:]
            last = bounds[1:] - 1
            after[last[last >= 0]] = False
        ends = np.flatnonzero(inside & ~after) + 1
        yield Words(data, starts, ends, np.searchsorted(starts, bounds), _hash_spans(data, starts, ends, values), at)
        at = upto


def rolling(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of k consecutive entries (len(h) - k + 1 of them), by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    base = int(splitmix(0, seed + 77)) | 1
    with np.errstate(over="ignore"):
        power, width, piece = base, 1, splitmix(h, seed + 5)
        out, done = None, 0
        rest = k
        while rest:
            if rest & 1:
                if out is None:
                    out = piece[: len(h)].copy()
                else:
                    m = len(h) - done - width + 1
                    out = out[:m] * U64(power) + piece[done : done + m]
                done += width
            rest >>= 1
            if rest:
                m = len(piece) - width
                piece = piece[:m] * U64(power) + piece[width : width + m]
                power = power * power % 2**64
                width *= 2
    return splitmix(out[:n], seed + 9)


def within(ptr: np.ndarray, k: int) -> np.ndarray:
    """Flags of the places where k entries fit before the end of their document."""
    total = int(ptr[-1])
    n = max(0, total - k + 1)
    ok = np.ones(n, dtype=bool)
    if k > 1 and n:
        ends = ptr[1:-1]
        for back in range(1, k):
            at = ends - back
            at = at[(at >= 0) & (at < n)]
            ok[at] = False
        # a boundary b spoils the places b-k+1 .. b-1; places before their own document's start are spoiled too
    return ok
