"""Byte-level BPE by monoid tree reduction, and decoding up the same tree.

The ids of a byte string form a monoid element; two neighbours join by encoding
the bytes around their border again. Every match of the split pattern is a tree
of its own: halves are encoded recursively down to short leaves, which merge
directly, and join upwards. The join encodes a window of ``k`` tokens on either
side of the border and doubles ``k`` until the window's outer tokens stand next
to the untouched ones as a valid pair. A pair is valid if encoding its bytes
gives back just that pair, and a token sequence is the encoding of its bytes
exactly if all its neighbouring pairs are valid; so nothing outside the window
can change. Decoding concatenates the bytes of the halves.

Ranks, not merge lists, decide as in the tiktoken library: of all neighbouring
pairs that make a known token the lowest rank merges first, and a match that is
a token itself is that token.

Memory a task: the vocabulary (broadcast, a few MB), one Arrow batch, and two
caches of bounded size. Edge cases: null and empty texts have no tokens; texts
of any length are encoded whole, a match without a break in O(n log n) joins;
repeated rows repeat; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

LEAF = 24
CACHED_MATCHES = 300_000
CACHED_PAIRS = 300_000
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from lines of base64 and rank."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    out = [b""] * (max(int(rank) for _, rank in pairs) + 1)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class TreeCodec:
    """Encodes and decodes byte strings by reducing a tree of their parts."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens) if t}
        self.split = regex.compile(pattern)
        self.matches: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a short byte string: the lowest rank among neighbouring pairs merges, leftmost first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        pair_ranks = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, rank in enumerate(pair_ranks):
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pair_ranks[at]
            if at < len(pair_ranks):
                pair_ranks[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                pair_ranks[at - 1] = ranks.get(parts[at - 1] + parts[at])

    def valid(self, left: int, right: int) -> bool:
        """Whether two tokens can stand side by side in an encoding."""
        known = self.pairs.get((left, right))
        if known is None:
            known = self.reduce(self.tokens[left] + self.tokens[right], direct=True) == [left, right]
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            self.pairs[(left, right)] = known
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the concatenated bytes of two encodings."""
        if not left or not right or self.valid(left[-1], right[0]):
            return left + right
        k = 2
        while True:
            head, tail = max(len(left) - k, 0), min(k, len(right))
            window = self.merge(self.decode(left[head:] + right[:tail]))
            if (not head or self.valid(left[head - 1], window[0])) and (
                tail == len(right) or self.valid(window[-1], right[tail])
            ):
                return left[:head] + window + right[tail:]
            k *= 2

    def reduce(self, piece: bytes, direct: bool = False) -> list[int]:
        """Ids of a byte string, by halves; depth is the logarithm of its length."""
        if direct or len(piece) <= LEAF:
            return self.merge(piece)
        middle = len(piece) // 2
        return self.join(self.reduce(piece[:middle]), self.reduce(piece[middle:]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def decode_tree(self, ids: list[int], leaf: int = 65_536) -> bytes:
        """Bytes of a token sequence, concatenated up a tree of halves."""
        if len(ids) <= leaf:
            return self.decode(ids)
        middle = len(ids) // 2
        return self.decode_tree(ids[:middle], leaf) + self.decode_tree(ids[middle:], leaf)

    def encode_match(self, match: str) -> bytes:
        """Packed ids of one match of the pattern."""
        piece = match.encode()
        whole = self.ranks.get(piece)
        ids = [whole] if whole is not None else self.reduce(piece)
        packed = np.asarray(ids, dtype="<u4").tobytes()
        if len(match) <= 64:
            if len(self.matches) >= CACHED_MATCHES:
                self.matches.clear()
            self.matches[match] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        known, encode = self.matches, self.encode_match
        return b"".join([known.get(m) or encode(m) for m in self.split.findall(text)])

    def bytes_of(self, packed: bytes) -> bytes:
        return self.decode_tree(np.frombuffer(packed, dtype="<u4").tolist())


def encode_decode(
    docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: token count, digest of its ids, digest of the bytes decoded from them; ids themselves on demand.

    The rank file is read by the driver and broadcast: its size is that of one
    vocabulary, whatever the data.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = TreeCodec(shared.value, pattern)
        for batch in batches:
            counts, ids_digest, text_digest, all_ids = [], [], [], []
            for t in batch.column("text").to_pylist():
                packed = codec.encode(t) if t else b""
                counts.append(len(packed) // 4)
                ids_digest.append(hashlib.sha256(packed).hexdigest())
                text_digest.append(hashlib.sha256(codec.bytes_of(packed)).hexdigest())
                if with_ids:
                    all_ids.append(np.frombuffer(packed, dtype="<u4").astype(np.int32))
            arrays = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    read = docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"cast(`{text}` as string) as text")
    return read.mapInArrow(per_batch, RESULT + (", ids array<int>" if with_ids else ""))
