"""Word BPE against the tokenizers library; spelling variants and hard negatives against every pair."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridcast.llm import negatives, queries, spelling
from gridcast.llm.wordbpe import BatchCodec, digest, encode_decode, read_vocabulary

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- word BPE -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def wanted(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def texts():
    draw = random.Random(11)
    letters = "abcdeilnorst'éÀΣσ🙂 ́\t1٣½你ᲉꟋ\U0003fc36≠İ"
    odd = ["".join(draw.choice(letters) for _ in range(draw.randrange(60))) for _ in range(800)]
    runs = ["a" * 5000, "aab" * 900, "!" * 333 + "?!" * 200, "".join(draw.choice("etaoinshrdlu") for _ in range(6000))]
    return [None, "", " \n", "x<|endoftext|>y <|startoftext|>", "ΑΣ ΟΔΟΣ", "don't 'stop", *runs, *odd]


def test_codec_equals_the_library(library):
    given = texts()
    codec = BatchCodec(read_vocabulary(PATH))
    assert [digest(words) for words in codec.encode(given)] == [wanted(library, t) for t in given]


def test_codec_cuts_long_texts_where_no_word_stands(library, monkeypatch):
    import gridcast.llm.wordbpe as module

    monkeypatch.setattr(module, "PIECE", 50)
    monkeypatch.setattr(module, "CACHED_WORDS", 40)
    given = [" ".join(f"word{i}ing <|endoftext|> été" for i in range(300)), "x" * 400, "short text"]
    codec = BatchCodec(read_vocabulary(PATH))
    assert [digest(words) for words in codec.encode(given)] == [wanted(library, t) for t in given]


def test_op11_on_the_given_documents(spark, library):
    given = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    rows = {r.doc_id: r for r in queries.op11_word_bpe(spark, SF).collect()}
    assert rows.keys() == given.keys()
    for doc, text in given.items():
        r = rows[doc]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == wanted(library, text)


def test_op11_nulls_repeats_and_clashing_columns(spark, library):
    rows = [(1, "one two", "a"), (1, "one two", "b"), (None, None, "c"), (3, "z" * 1_200_000 + " end", "d")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_tokens string")
    found = encode_decode(docs, PATH, with_ids=True).collect()
    assert sorted((r.n_tokens, r.doc_id or 0) for r in found)[:3] == [(0, 0), (2, 1), (2, 1)]
    long = next(r for r in found if r.doc_id == 3)
    assert (long.n_tokens, long.ids_sha256, long.decoded_sha256) == wanted(library, rows[3][1])
    assert long.ids == library.encode(rows[3][1], add_special_tokens=False).ids
    assert encode_decode(docs.limit(0), PATH).count() == 0


# --- spelling variants ------------------------------------------------------------------


def by_pairs(rows, every=31, shortest=7, seldom=2):
    """The contract's own words, read letter by letter, and all pairs through shared deletions."""
    count = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            count[word] += 1
    n = {w: k for w, k in count.items() if len(w) >= shortest and k >= seldom}
    cut = collections.defaultdict(set)
    for w in n:
        for i in range(len(w)):
            cut[w[:i] + w[i + 1 :]].add((w, i))
    near = collections.defaultdict(set)
    for shorter, places in cut.items():
        for w, i in places:
            if shorter in n:
                near[w].add(shorter)
                near[shorter].add(w)
            near[w] |= {v for v, j in places if v != w and i == j}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def found_by(frame):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def test_op12_on_the_given_documents(spark):
    given = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    frame = queries.op12_spelling_variants(spark, SF)
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert found_by(frame) == by_pairs(given)


@pytest.fixture(scope="module")
def invented():
    """Few letters, so that many words are anagrams or one edit apart; some words lead on to others."""
    draw = random.Random(5)
    words = ["".join(draw.choice("abé") for _ in range(draw.randrange(7, 10))) for _ in range(900)]
    rows = [(i, " ".join(draw.choices(words, k=40))) for i in range(120)]
    chain = ["spelling"] * 400 + ["spellinq"] * 40 + ["spallinq"] * 4
    return [*rows, (None, " ".join(chain)), (None, None), (7, ""), (8, "Ab" * 40_000 + " " + "Ab" * 40_000), (8, "ÀÿÀÿÀÿÀÿ ×÷×÷×÷×÷")]


@pytest.mark.parametrize("limits", [{}, {"sample": 200, "cell": 20, "asked": 30, "leaf": 4}])
def test_op12_crowded_cells_and_chains(spark, invented, limits):
    docs = spark.createDataFrame([(d, t, 1) for d, t in invented], "doc_id long, text string, n int").repartition(5)
    rows = found_by(spelling.group_variants(docs, every=10**9, **limits))
    assert rows == by_pairs(invented, every=10**9)
    assert ("spallinq", "spellinq", "spelling", 4, 1, 40) in rows


def test_op12_empty_table_and_single_words(spark):
    schema = "doc_id long, text string"
    assert spelling.group_variants(spark.createDataFrame([], schema)).count() == 0
    assert found_by(spelling.group_variants(spark.createDataFrame([(1, "seventh seventh sixths")], schema), every=10**9)) == {("seventh", None, "seventh", 2, 0, None)}


def test_k_d_search_returns_exactly_the_range():
    draw = np.random.default_rng(3)
    points = ["".join(draw.choice(list("abcdeé"), 8)) for _ in range(400)]
    for size in (8, 7):
        asked = ["".join(draw.choice(list("abcdeé"), size)) for _ in range(300)]
        more, fewer = (1, 1) if size == 8 else (1, 0)
        p, q = spelling.letter_counts(points), spelling.letter_counts(asked)
        apart = p[None] - q[:, None]
        every = (np.maximum(apart, 0).sum(2) == more) & (np.minimum(apart, 0).sum(2) == -fewer)
        found = [(int(a), int(b)) for rows in spelling.in_range(p, q, more, fewer, 16) for a, b in zip(*rows)]
        assert len(found) == len(set(found)) and set(found) == set(map(tuple, np.argwhere(every).tolist()))


# --- hard negatives -------------------------------------------------------------------


def mined_by_pairs(rows, anchors, positives=5, negatives_=5):
    kept = [(i, label, v) for i, label, v in rows if i is not None and label is not None and v is not None and None not in v]
    out = []
    for a, label, v in {(i, str(label), tuple(v)) for i, label, v in kept if anchors(i)}:
        def best(same, least=None, top=None, most=5):
            scored = [(-sum(x * y for x, y in zip(v, w)), i) for i, other, w in kept if len(w) == len(v) and (str(other) == label) == same and (not same or i != a)]
            inside = [(s, i) for s, i in scored if least is None or least <= -100 * s <= top]
            return sorted(inside)[:most]
        for p, i in best(True, most=positives):
            for rank, (s, j) in enumerate(best(False, -80 * p, -100 * p, negatives_), 1):
                out.append((a, i, rank, j, -p, -s))
    return sorted(out)


def mined(frame):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in frame.collect())


SCHEMA = "vec_id long, label string, vector array<long>, score string"


def vectors(count, width, scale, seed=2):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(4, width))
    out = []
    for i in range(count):
        v = middle[draw.integers(4)] + 0.5 * draw.normal(size=width)
        out.append((i, str(draw.integers(3)), [int(x) for x in np.floor(scale * v)]))
    return out


@pytest.mark.parametrize("width,scale", [(64, 256.0), (16, 3.0), (5, 2.0**28)])
def test_op13_against_every_pair(spark, width, scale):
    rows = vectors(240, width, scale)
    rows += [(240, "0", rows[10][2]), (240, "0", rows[10][2]), (20, "1", rows[20][2]), (None, "1", rows[1][2]), (300, None, rows[2][2])]
    rows += [(320, "2", None), (340, "2", [None] * width), (360, "2", [1, 2]), (380, "1", [1, 2]), (400, "2", []), (420, "1", [0] * width)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    found = mined(negatives.hard_negatives(frame, F.col("vec_id") % 20 == 0, values=width * 50))
    assert found == mined_by_pairs(rows, lambda i: i % 20 == 0) and found


def test_op13_summaries_leave_out_rows_and_keep_the_best():
    # Neighbouring components alike, which is what segments can summarise.
    rows = [(i, label, np.repeat(v, 8).tolist()) for i, label, v in vectors(3000, 8, 256.0, seed=9)]
    group = negatives.Group(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=object), np.array([r[2] for r in rows]))
    anchor, every = np.array(rows[0][2]), np.arange(3000)
    kept = group.narrowed(every, anchor, negatives.at_least_best(5))
    scores = group.scores(every, anchor)
    assert set(negatives.first(group.ids, scores, 5)) <= set(kept.tolist()) and len(kept) < 1500


def test_op13_empty_table_and_no_anchor(spark):
    rows = vectors(20, 8, 10.0)
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert negatives.hard_negatives(frame.limit(0), F.col("vec_id") == 0).count() == 0
    assert negatives.hard_negatives(frame, F.lit(False)).count() == 0
