"""Every operator against a brute-force version on the given small tables."""

from __future__ import annotations

import collections
import hashlib
import html
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from gridcast.llm import queries
from gridcast.llm.bpe import TreeCodec, read_ranks
from gridcast.llm.edits import bounded

SF = "/root/testdata/sf0.01"


def given(sql):
    return duckdb.sql(sql.replace("{sf}", SF)).fetchall()


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


@pytest.fixture(scope="module")
def documents():
    return dict(given("select doc_id, text from '{sf}/documents.parquet'"))


def result(spark, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, SF).collect()]


def test_op1_reads_back_every_turn(spark):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in given("select conv_id, turn, role, text from '{sf}/conversations.parquet'"):
        turns[conv].append((turn, role, text or ""))
    planted = r"\### Assistant: </turn> ok"
    turns[-7] = [(0, "user", planted), (1, "assistant", planted)]
    rows = {r["conv_id"]: r for r in result(spark, "op1_chat_formatting")}
    assert rows.keys() == turns.keys()
    for conv, found in turns.items():
        found.sort()
        loss = "".join(t for _, role, t in found if role == "assistant")
        r = rows[conv]
        assert r["n_turns"] == len(found)
        assert r["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for _, role, t in found))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
        assert r["formatted_chars"] >= sum(len(t) for _, _, t in found)
        assert r["n_examples"] == sum(role == "assistant" for _, role, _ in found)


def test_op2_scores_held_out_rows_well(spark, documents):
    labels = dict(given("select doc_id, toxic from '{sf}/labels.parquet'"))
    rows = {r["doc_id"]: r for r in result(spark, "op2_toxicity")}
    assert rows.keys() == documents.keys()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())


def test_op2_tells_held_out_toxic_rows(spark):
    sf = SF.replace("0.01", "0.1")
    labels = dict(given(f"select doc_id, toxic from '{sf}/labels.parquet'"))
    rows = [r for r in queries.op2_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    toxic = np.array([r["score"] for r in rows if labels[r["doc_id"]]])
    clean = np.array([r["score"] for r in rows if not labels[r["doc_id"]]])
    assert (toxic[:, None] > clean[None, :]).mean() > 0.9
    assert (clean >= 0.5).mean() < 0.02


def test_op3_extracts_the_article(spark):
    rows = {r["page_id"]: r for r in result(spark, "op3_html_extraction")}
    for page_id, url, page in given("select page_id, url, html from '{sf}/pages.parquet'"):
        inner = re.search(r"<article>(.*)</article>", page, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        expected = "\n".join(b for b in blocks if b)
        assert rows[page_id]["text"] == expected
        assert (rows[page_id]["url"], rows[page_id]["n_chars"]) == (url, len(expected))


def test_op4_equals_the_tokenizer_library(spark, documents):
    ranks = {t: i for i, t in enumerate(read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = {r["doc_id"]: r for r in result(spark, "op4_byte_bpe")}
    assert rows.keys() == documents.keys()
    for doc, text in documents.items():
        ids = library.encode_ordinary(text)
        r = rows[doc]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(np.array(ids, dtype="<u4").tobytes()))
        assert r["decoded_sha256"] == sha(text)


def test_op4_long_matches_and_odd_texts():
    tokens = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    codec = TreeCodec(tokens, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rng = np.random.default_rng(5)
    alphabets = ["a", "ab", "abcdefgh", "thesinond", "éèaçß", "日本語文字", "0123456789", " ", "\n\t ", "=-_*", "a b", "é1 \n!"]
    for alphabet in alphabets:
        for size in (1, 2, 23, 24, 25, 49, 300, 5000):
            text = "".join(rng.choice(list(alphabet), size))
            packed = codec.encode(text)
            assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)
            assert codec.bytes_of(packed) == text.encode()
    assert codec.encode("") == b""


def brute_print(text: str) -> int:
    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m.group().lower(), text))
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + 4]) for i in range(max(len(parts) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closest(pairs, nodes):
    """Smallest node reachable, by union."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_op5_equals_all_pairs(spark, documents):
    rows = {r["doc_id"]: r for r in result(spark, "op5_simhash_near_dedup")}
    prints = {d: brute_print(t) for d, t in documents.items()}
    ids = sorted(prints)
    values = np.array([prints[d] for d in ids], dtype=np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    roots = closest([(ids[i], ids[j]) for i, j in zip(*np.nonzero(near))], ids)
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in rows.items()} == {d: (f"{prints[d]:016x}", roots[d]) for d in ids}


def test_op6_drops_only_repeats_and_all_equal_lines(spark, documents):
    rows = {r["doc_id"]: r for r in result(spark, "op6_line_dedup")}
    assert rows.keys() == documents.keys()

    def words(line):
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(r"[A-Z]", lambda m: m.group().lower(), line)) if w]

    kept = collections.Counter()
    everything = collections.defaultdict(int)
    for doc, text in documents.items():
        lines, left = text.split("\n"), rows[doc]["text"].split("\n")
        assert rows[doc]["n_lines"] == len(lines)
        if rows[doc]["n_dropped"] < len(lines):
            assert len(left) == len(lines) - rows[doc]["n_dropped"]
        it = iter(lines)
        assert all(any(x == y for y in it) for x in left if left != [""])
        kept.update(tuple(words(x)) for x in left if len(words(x)) >= 5)
        for x in lines:
            everything[tuple(words(x))] += 1
        assert [x for x in lines if len(words(x)) < 5] == [x for x in left if len(words(x)) < 5] or not any(left)
    assert max(kept.values()) == 1  # of equal lines exactly one stays, or one of its group
    gone = [w for w in everything if len(w) >= 5 and w not in kept]
    assert gone  # fuzzy copies: each is near a line that is kept, or chained to one
    direct = sum(any(bounded(list(g), list(k), int(0.2 * max(len(g), len(k)) + 1e-9)) is not None for k in kept if 0.8 <= len(k) / len(g) <= 1.25) for g in gone[:40])
    assert direct >= 0.9 * len(gone[:40])


def test_op7_finds_every_verbatim_passage(spark, documents):
    items = dict(given("select item_id, text from '{sf}/benchmark.parquet'"))
    norm = lambda t: " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())) + " "
    keys = {i: norm(t) for i, t in items.items()}
    expected = {(d, i) for d, t in documents.items() for i, k in keys.items() if k in norm(t)}
    rows = result(spark, "op7_benchmark_decontamination")
    exact = {(r["doc_id"], r["item_id"]) for r in rows if r["similarity"] == 1}
    assert exact == expected and expected
    for r in rows:
        window = norm(documents[r["doc_id"]]).split()[r["start_word"] :]
        m = r["n_words"]
        assert bounded(keys[r["item_id"]].split(), window[: m + m // 5], m // 5, free_end=True) == round(m * (1 - r["similarity"]))


def test_op8_spans_repeat_earlier_text(spark, documents):
    rows = result(spark, "op8_substring_dedup")
    texts = {d: t.encode() for d, t in documents.items()}
    firsts: dict[bytes, int] = {}
    for d in sorted(texts):
        firsts.setdefault(texts[d], d)
    flagged = collections.defaultdict(int)
    for r in rows:
        piece = texts[r["doc_id"]][r["start_byte"] : r["start_byte"] + r["n_bytes"]]
        assert len(piece) == r["n_bytes"] >= 150
        piece.decode()
        assert r["source_doc_id"] <= r["doc_id"]
        assert piece[:24] in texts[r["source_doc_id"]]
        flagged[r["doc_id"]] += r["n_bytes"]
    for d, t in texts.items():
        if firsts[t] != d and len(t) >= 150:
            assert flagged[d] == len(t)  # whole copies go whole


def test_op9_equals_brute_force(spark):
    data = given("select vec_id, label, embedding from '{sf}/embeddings.parquet'")
    ids = np.array([d[0] for d in data])
    units = np.array([d[2] for d in data], dtype=float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    labels = np.array([d[1] for d in data])
    near = (units @ units.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    roots = closest([(ids[i], ids[j]) for i, j in zip(*np.nonzero(near))], ids.tolist())
    rows = {r["vec_id"]: r for r in result(spark, "op9_embedding_near_dedup")}
    assert {v: (r["n_links"], r["component_id"], r["kept"]) for v, r in rows.items()} == {
        int(v): (int(n), int(roots[v]), bool(roots[v] == v)) for v, n in zip(ids, near.sum(axis=1))
    }


def test_op10_equals_plain_search(spark, documents):
    base = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    rows = {r["doc_id"]: r for r in result(spark, "op10_license_scans")}
    assert rows.keys() == documents.keys()
    for doc, text in documents.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(r"[A-Z]", lambda m: m.group().lower(), text))
        places = [(i, label) for p, label in base.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        r = rows[doc]
        starts = [i for i, _ in places]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert (r["score"] > 0) == bool(r["labels"])
