"""Byte-level BPE encoding and decoding of whole texts with the ranks of a public vocabulary.

A text is cut by the vocabulary's pattern into pieces, and each piece is encoded by itself: as one token if it is one,
else from single bytes by merging, again and again, the leftmost of the neighbours whose join has the least rank.
The ranks of the joins stand in a segment tree over the byte positions of the piece: a leaf holds (rank, position) of
the join of the part that begins there with the part after it, a node the least of its two, so the root is the next
merge.  A merge changes three leaves, those of the two joined parts and of the part before, each in a logarithmic
number of steps, so a piece of n bytes takes n log n steps however long it is.  Short pieces whose trees have the same
size are merged in step, as rows of one array of trees; a longer piece has a tree of its own.

Texts are read where they are, batch by batch, and nothing is shuffled.  The vocabulary is read once, where the
query starts, and sent to the workers; it holds at most MOST_RANKS tokens.  A worker remembers the ids of at most
REMEMBERED short pieces.

Cases: a null text counts as empty and has no tokens.  Rows that repeat are encoded each.  No rows give no rows.
Columns of the input stay where the function carries them; results that would clash with them get underscores before
their names.  Null ids decode to null.  Letters and digits are those of the Unicode version of the `regex` library; it knows
some 17 000 rare ones (mostly CJK extension J) that the library tiktoken, of an older version, takes for symbols.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .shared import each_batch, free_name, small_batches

#: Tokens of a vocabulary, at most: it is broadcast.
MOST_RANKS = 1 << 20
#: Pieces whose ids a worker remembers, the longest of them in bytes, and how many are merged in step.
REMEMBERED, SHORT, IN_STEP = 1 << 19, 64, 4096
#: Characters of texts that are cut into pieces at a time (a longer text is cut alone).
BLOCK = 1 << 20
#: A leaf is rank << PLACE_BITS | position.
PLACE_BITS = 40
_PLACE = (1 << PLACE_BITS) - 1
_NONE = 1 << 62


def read_ranks(path: str, most: int = MOST_RANKS) -> dict[bytes, int]:
    """Token bytes and their ranks of a file with a line `<base64 of the token> <rank>` for each token."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if len(ranks) > most:
        raise ValueError(f"{len(ranks)} tokens are too many to broadcast")
    if absent := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"a byte-level vocabulary has all bytes; these are missing: {absent[:5]}")
    return ranks


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece of at least one byte."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    rank = ranks.get
    leaves = 1 << (n - 2).bit_length()
    tree = [_NONE] * (2 * leaves)
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            tree[leaves + i] = r << PLACE_BITS | i
    for node in range(leaves - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b

    def put(node: int, value: int) -> None:
        """A leaf's new value; the nodes above change as far as their least does."""
        tree[node] = value
        while node > 1:
            other = tree[node ^ 1]
            if other < value:
                value = other
            node >>= 1
            if tree[node] == value:
                return
            tree[node] = value

    # of the live part that begins at i: where the next and the one before begin
    after, before = list(range(1, n + 1)), list(range(-1, n))
    while (least := tree[1]) != _NONE:
        i = least & _PLACE
        j = after[i]
        stop = after[i] = after[j]
        put(leaves + j, _NONE) if stop < n else None
        value = _NONE
        if stop < n:
            before[stop] = i
            r = rank(piece[i : after[stop]])
            if r is not None:
                value = r << PLACE_BITS | i
        put(leaves + i, value)
        if i:
            h = before[i]
            r = rank(piece[h:stop])
            put(leaves + h, _NONE if r is None else r << PLACE_BITS | h)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Joins:
    """The ranks of all joins of two tokens, for arrays of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        found = [(ranks[left] << 32 | ranks[right], rank) for token, rank in ranks.items() for left, right in ((token[:i], token[i:]) for i in range(1, len(token))) if left in ranks and right in ranks]
        found.sort()
        self.pairs = np.array([pair for pair, _ in found] + [np.iinfo(np.int64).max], dtype=np.int64)
        self.of_pair = np.array([rank for _, rank in found] + [-1], dtype=np.int64)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.of_bytes = self(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256))

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, -1 where two tokens have no join."""
        wanted = left << 32 | right
        at = np.searchsorted(self.pairs, wanted)
        return np.where(self.pairs[at] == wanted, self.of_pair[at], -1)


def merged_in_step(pieces: list[bytes], leaves: int, joins: Joins) -> list[tuple[int, ...]]:
    """The ids of pieces of 2 to leaves + 1 bytes."""
    size = np.array([len(p) for p in pieces])
    rows, width = len(pieces), leaves + 2
    data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(rows, width)
    ids = joins.of_byte[data]
    # of the live part that begins at a byte: where the next and the one before begin
    after, before = (np.tile(np.arange(width + 1) + step, (rows, 1)) for step in (1, -1))
    tree = np.full((rows, 2 * leaves), _NONE, dtype=np.int64)
    place = np.arange(leaves)
    first = joins.of_bytes[data[:, :leaves].astype(np.int64) << 8 | data[:, 1 : leaves + 1]]
    tree[:, leaves:] = np.where((first >= 0) & (place < size[:, None] - 1), first << PLACE_BITS | place, _NONE)
    for node in range(leaves - 1, 0, -1):
        np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
    while len(live := np.flatnonzero(tree[:, 1] != _NONE)):
        least = tree[live, 1]
        i, rank = least & _PLACE, least >> PLACE_BITS
        j = after[live, i]
        stop = after[live, j]
        h = before[live, i]
        ids[live, i] = rank
        after[live, i] = stop
        before[live, stop] = i
        inner, last = stop < size[live], h < 0
        following = joins(rank, ids[live, np.where(inner, stop, 0)])
        previous = joins(ids[live, np.maximum(h, 0)], rank)
        # leaves of the part that is gone, of the joined part and of the one before (the last two may have none)
        gone = np.where(inner, j, i)
        nodes = np.stack([gone, i, np.where(last, i, h)])
        own = np.where(inner & (following >= 0), following << PLACE_BITS | i, _NONE)
        values = np.stack([np.where(inner, _NONE, own), own, np.where(last, own, np.where(previous >= 0, previous << PLACE_BITS | h, _NONE))])
        nodes += leaves
        tree[live, nodes] = values
        while nodes[0, 0] > 1:
            nodes >>= 1
            tree[live, nodes] = np.minimum(tree[live, 2 * nodes], tree[live, 2 * nodes + 1])
    # the parts that live: those that can be reached from the first
    starts = np.zeros((rows, width), dtype=bool)
    at, here = np.zeros(rows, dtype=np.int64), np.arange(rows)
    while len(here):
        starts[here, at] = True
        at = after[here, at]
        more = at < size[here]
        here, at = here[more], at[more]
    flat, ends = ids[starts].tolist(), np.cumsum(starts.sum(axis=1)).tolist()
    return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


class Vocabulary:
    """Encodes and decodes with one table of ranks and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pieces, self.joins = ranks, regex.compile(pattern).findall, Joins(ranks)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.known: dict[str, tuple[int, ...]] = {}

    def ids_of(self, pieces: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The ids of distinct pieces."""
        found, alike = {}, {}
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                found[piece] = (whole,)
            elif len(raw) > SHORT:
                found[piece] = tuple(merged(raw, self.ranks))
            else:
                alike.setdefault(1 << (len(raw) - 2).bit_length(), []).append((piece, raw))
        for leaves, group in alike.items():
            for at in range(0, len(group), IN_STEP):
                part = group[at : at + IN_STEP]
                found.update(zip((p for p, _ in part), merged_in_step([raw for _, raw in part], leaves, self.joins), strict=True))
        return found

    def encode(self, texts: Iterable[str]) -> list[array]:
        """The ids of each text; texts are taken together up to BLOCK characters."""
        out, block, size = [], [], 0
        for text in texts:
            if block and size + len(text) > BLOCK:
                out += self._encoded(block)
                block, size = [], 0
            block.append(text)
            size += len(text)
        return out + self._encoded(block)

    def _encoded(self, texts: list[str]) -> list[array]:
        cut = [self.pieces(text) for text in texts]
        new = set(chain.from_iterable(cut)).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set(chain.from_iterable(cut))
        self.known.update(self.ids_of(new))
        out = [array("I", chain.from_iterable(map(self.known.__getitem__, pieces))) for pieces in cut]
        for piece in new:
            if len(piece) > SHORT:
                del self.known[piece]
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_OPEN: dict[str, Vocabulary] = {}


def _opened(shared: Broadcast, pattern: str, name: str) -> Vocabulary:
    """The worker's copy, made once: workers are used for many tasks."""
    if name not in _OPEN:
        _OPEN.clear()
        _OPEN[name] = Vocabulary(shared.value, pattern)
    return _OPEN[name]


def _little_endian(ids: array) -> bytes:
    if array("I", [1]).tobytes()[0] != 1:
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def _vocabulary(spark: SparkSession, path: str, pattern: str) -> tuple[Broadcast, str]:
    small_batches(spark)
    ranks = read_ranks(path)
    name = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    return spark.sparkContext.broadcast(ranks), name


def with_token_ids(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with token_ids, the ids of each whole text in order."""
    shared, name = _vocabulary(docs.sparkSession, path, pattern)
    out = free_name(docs, "token_ids")

    def encode(batch: pa.RecordBatch):
        vocabulary = _opened(shared, pattern, name)
        lists = vocabulary.encode(t.as_py() or "" for t in batch.column(text_col))
        sizes = pa.array([0, *map(len, lists)], pa.int64()).to_numpy().cumsum()
        flat = pa.array(chain.from_iterable(lists), pa.int32())
        ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, out])

    return each_batch(encode, StructType([*docs.schema, StructField(out, ArrayType(IntegerType()))]), docs)


def with_decoded(rows: DataFrame, path: str, ids_col: str = "token_ids") -> DataFrame:
    """rows with decoded, the bytes (binary) that the ids in ids_col stand for."""
    shared, name = _vocabulary(rows.sparkSession, path, "")
    out = free_name(rows, "decoded")

    def decode(batch: pa.RecordBatch):
        vocabulary = _opened(shared, "", name)
        raw = [None if ids is None else vocabulary.decode(ids) for ids in batch.column(ids_col).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=[*batch.schema.names, out])

    return each_batch(decode, StructType([*rows.schema, StructField(out, BinaryType())]), rows)


def token_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers) and decoded_sha256 (of the bytes that
    the ids decode to) of each text, without carrying the ids themselves."""
    shared, name = _vocabulary(docs.sparkSession, path, pattern)

    def digest(batch: pa.RecordBatch):
        vocabulary = _opened(shared, pattern, name)
        counts, of_ids, of_bytes = [], [], []
        for ids in vocabulary.encode(t.as_py() or "" for t in batch.column(1)):
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(_little_endian(ids)).hexdigest())
            of_bytes.append(hashlib.sha256(vocabulary.decode(ids)).hexdigest())
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    return each_batch(digest, f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", texts).withColumnRenamed("_id", id_col)
