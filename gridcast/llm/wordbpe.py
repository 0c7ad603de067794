"""BPE encoding and decoding by batched merge rounds in numpy.

The distinct words of a batch of texts lie one behind the other in a single flat
array of symbol ids. A round looks up the rank of every neighbouring pair by
binary search over the sorted pair keys, finds the lowest rank of every word by
one segmented minimum, and merges all pairs of that rank, leftmost first where
they overlap. Words without a known pair leave the array. Merging all pairs of a
word's lowest rank at once is the one-by-one rule, because a merge's parts are
made by merges of lower rank only (checked when the file is read).

Words longer than any token do not wait for their lowest rank: a pair whose rank
is the lowest within a token's length on both sides merges as well. Only a pair
that is made later and reaches into its symbols could come before it, and all
merges that build such a pair lie in that window and rank lower. So a run of a
million letters takes hundreds of rounds, not one for every rank in it.

Texts are read as the vocabulary file says: strings of special tokens are cut
out first, what lies between is composed (NFC), lower-cased code point by code
point and split by the file's pattern. Characters that Python's tables do not
know yet but a newer pattern library may are left to the file's own reader,
text by text. Decoding joins the ids' tokens by one space, since the file names
no decoder.

Memory a task: the vocabulary (broadcast, a few MB), the matches of one piece of
about a million characters, and a cache of bounded size. Edge cases: null and
empty texts have no tokens; texts of any length are encoded whole; repeated rows
repeat; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from gridcast.llm.common import parts

ROWS = 128
PIECE = 1 << 20
CACHED_WORDS, CACHED_LENGTH = 300_000, 64
NONE = np.iinfo(np.int32).max
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where Latin-1 prints it, else the next free one from 256 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printed)]
    return [chr(256 + others.index(b)) if b in others else chr(b) for b in range(256)]


def unassigned() -> np.ndarray:
    """Of every code point whether Python's tables leave it unassigned."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)])


@dataclass
class Vocabulary:
    """What tasks need of a tokenizer file: a few MB, sent once."""

    source: str
    tokens: list[str]
    first: np.ndarray
    last: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    pattern: str
    specials: dict[str, int]
    longest: int
    newer: np.ndarray


def read_vocabulary(path: str) -> Vocabulary:
    """Reads a BPE file with word ends whose words are split by one pattern; anything else is refused."""
    with open(path, encoding="utf-8") as file:
        source = file.read()
    spec = json.loads(source)
    model, split, kinds = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0], [n["type"] for n in spec["normalizer"]["normalizers"]]
    if model["type"] != "BPE" or not model["end_of_word_suffix"] or kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"]:
        raise ValueError(f"{path} is no BPE vocabulary with word ends, composed and lower-cased words.")
    ids: dict[str, int] = model["vocab"]
    specials = {t["content"]: t["id"] for t in spec["added_tokens"] if not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"])}
    if len(specials) != len(spec["added_tokens"]):
        raise ValueError(f"{path} holds added tokens that are no plain strings.")
    tokens = [""] * (max([*ids.values(), *specials.values()]) + 1)
    for token, i in [*ids.items(), *specials.items()]:
        tokens[i] = token
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    left, right = (np.array([ids[m[k]] for m in merges], dtype=np.int64) for k in (0, 1))
    made = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
    rank_of = {int(t): i for i, t in enumerate(made)}
    if len(rank_of) < len(made) or any(rank_of.get(int(p), -1) >= i for i, pair in enumerate(zip(left, right)) for p in pair):
        raise ValueError(f"{path} merges tokens before it makes them.")
    keys = left * len(tokens) + right
    order = np.argsort(keys)
    symbols = byte_symbols()
    return Vocabulary(
        source=source,
        tokens=tokens,
        first=np.array([ids[s] for s in symbols], dtype=np.int64),
        last=np.array([ids[s + model["end_of_word_suffix"]] for s in symbols], dtype=np.int64),
        keys=keys[order],
        ranks=order.astype(np.int32),
        made=made[order],
        pattern=split["pattern"]["Regex"],
        specials=specials,
        longest=max(map(len, ids)),
        newer=unassigned(),
    )


def window_least(values: np.ndarray, reach: int) -> np.ndarray:
    """Of each place the least value at most ``reach`` places away, by doubling."""
    width, out = 1, values
    padded = np.concatenate([np.full(reach, NONE, values.dtype), out, np.full(reach, NONE, values.dtype)])
    while width < 2 * reach + 1:
        step = min(width, 2 * reach + 1 - width)
        padded = np.minimum(padded[: len(padded) - step], padded[step:])
        width += step
    return padded


class BatchCodec:
    """Encodes lists of words together and texts word by word."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.split = regex.compile(vocabulary.pattern)
        self.oldest = int(vocabulary.newer.argmax())
        longest_first = sorted(vocabulary.specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.known: dict[str, tuple[int, bytes, bytes]] = {s: self.shown([i]) for s, i in vocabulary.specials.items()}
        self.reader: Tokenizer | None = None

    def shown(self, ids: Iterable[int]) -> tuple[int, bytes, bytes]:
        """Number, decimal digits and tokens of ids, the latter two joined by spaces."""
        ids = list(ids)
        return len(ids), " ".join(map(str, ids)).encode(), " ".join([self.v.tokens[i] for i in ids]).encode()

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """Ids of every word; none of them empty."""
        v, raw = self.v, [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum(lengths)
        symbols = v.first[data]
        symbols[ends - 1] = v.last[data[ends - 1]]
        owner = np.repeat(np.arange(len(words)), lengths)
        done: list[np.ndarray | None] = [None] * len(words)
        while len(symbols):
            keys = symbols[:-1] * len(v.tokens) + symbols[1:]
            at = np.minimum(np.searchsorted(v.keys, keys), len(v.keys) - 1)
            joined = (v.keys[at] == keys) & (owner[:-1] == owner[1:])
            rank = np.append(np.where(joined, v.ranks[at], NONE), NONE).astype(np.int32)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(starts, len(symbols)))
            least = np.minimum.reduceat(rank, starts)
            ready = np.repeat(least, sizes)
            chosen = (rank == ready) & (rank < NONE)
            if sizes.max() > v.longest:
                chosen |= (rank == window_least(rank, v.longest)) & (rank < NONE)
            # Neighbouring pairs of one rank are one symbol repeated: every second of them, counted from the first.
            place = np.arange(len(rank))
            first = np.append(True, (rank[1:] != rank[:-1]) | (owner[1:] != owner[:-1]))
            run = np.maximum.accumulate(np.where(first, place, 0))
            chosen &= chosen[run] & ((place - run) % 2 == 0)
            merged = np.flatnonzero(chosen)
            symbols[merged] = v.made[at[merged]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[merged + 1] = False
            finished = least == NONE
            for w in np.flatnonzero(finished):
                done[owner[starts[w]]] = symbols[starts[w] : starts[w] + sizes[w]].copy()
            keep &= ~np.repeat(finished, sizes)
            symbols, owner = symbols[keep], owner[keep]
        return done

    def unknown_letters(self, text: str) -> bool:
        if text.isascii():
            return False
        codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        return bool(codes.max() >= self.oldest and self.v.newer[codes].any())

    def words(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if self.unknown_letters(text):
            if self.reader is None:
                self.reader = Tokenizer.from_str(self.v.source)
            text = self.reader.normalizer.normalize_str(text)
            return [text[a:b] for _, (a, b) in self.reader.pre_tokenizer.pre_tokenize_str(text)]
        # A final sigma is no exception here: every code point is lower-cased by itself.
        return self.split.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Words and special tokens of a text, in pieces cut before white space, which no word holds."""
        start = 0
        while start < len(text):
            end = len(text)
            if end - start > PIECE:
                gap = re.compile(r"[ \n]").search(text, start + PIECE)
                end = gap.start() if gap else end
            found = []
            for i, part in enumerate(self.special.split(text[start:end]) if self.special else [text[start:end]]):
                found.extend([part] if i % 2 else self.words(part))
            yield found
            start = end

    def encode(self, texts: Iterable[str | None]) -> Iterator[Iterator[tuple[int, bytes, bytes]]]:
        """Per text its words' (number, ids, tokens); words that are new to a batch of texts merge together."""
        lots, new = [], set()
        for text in texts:
            if text and len(text) > PIECE:
                # A long text goes by itself, piece by piece.
                lots.append(text)
                continue
            lots.append([w for piece in self.pieces(text or "") for w in piece])
            new.update(lots[-1])
        known = self.learn(new)
        for lot in lots:
            yield self.long(lot) if isinstance(lot, str) else map(known.__getitem__, lot)

    def long(self, text: str) -> Iterator[tuple[int, bytes, bytes]]:
        for piece in self.pieces(text):
            yield from map(self.learn(set(piece)).__getitem__, piece)

    def learn(self, words: set[str]) -> dict[str, tuple[int, bytes, bytes]]:
        """A table that holds all ``words``; the cache where it has room for them, which holds special tokens always."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known = {s: self.known[s] for s in self.v.specials}
            new = [w for w in words if w not in self.known]
        coded = {w: self.shown(ids.tolist()) for w, ids in zip(new, self.merge(new))} if new else {}
        short = {w: c for w, c in coded.items() if len(w) <= CACHED_LENGTH}
        self.known.update(short)
        return self.known if len(short) == len(coded) else {**{w: self.known[w] for w in words if w in self.known}, **coded}


def digest(words: Iterable[tuple[int, bytes, bytes]], ids: list[bytes] | None = None) -> tuple[int, str, str]:
    """Number of ids, digest of the ids joined by spaces, digest of the text decoded from them."""
    total, of_ids, of_text, gap = 0, hashlib.sha256(), hashlib.sha256(), b""
    held: list[tuple[bytes, bytes]] = []

    def flush() -> None:
        nonlocal gap
        if held:
            of_ids.update(gap + b" ".join([h[0] for h in held]))
            of_text.update(gap + b" ".join([h[1] for h in held]))
            if ids is not None:
                ids.extend(h[0] for h in held)
            gap = b" "
            held.clear()

    for n, some_ids, some_tokens in words:
        total += n
        held.append((some_ids, some_tokens))
        if len(held) >= 65_536:
            flush()
    flush()
    return total, of_ids.hexdigest(), of_text.hexdigest()


def encode_decode(docs: DataFrame, path: str, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: token count, digest of its ids, digest of the text decoded from them; ids themselves on demand.

    The vocabulary file is read by the driver and broadcast: its size is that of
    one vocabulary, whatever the data.
    """
    # Plain values: a broadcast class would have to be importable where the task runs.
    shared = docs.sparkSession.sparkContext.broadcast(vars(read_vocabulary(path)))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = BatchCodec(Vocabulary(**shared.value))
        for batch in parts(batches, ROWS):
            rows, all_ids = [], []
            for words in codec.encode(batch.column("text").to_pylist()):
                kept = [] if with_ids else None
                rows.append(digest(words, kept))
                if with_ids:
                    all_ids.append([int(i) for word in kept for i in word.split()])
            counts, of_ids, of_text = zip(*rows) if rows else ((), (), ())
            arrays = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    read = docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"cast(`{text}` as string) as text")
    return read.mapInArrow(per_batch, RESULT + (", ids array<int>" if with_ids else ""))
