"""Nulls, empty texts and tables, repeated rows and clashing column names, for every operator."""

from __future__ import annotations

import uuid

import public_tokenizers
import pytest

from gridcast.llm import bpe, chat, chunks, common, contamination, extraction, licenses, lines, neighbours, shingles, simhash, toxicity

DOCS = "doc_id long, text string, score double, _row string"
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
ROWS = [
    (1, LONG, 0.5, "x"),
    (2, LONG, 0.5, "x"),
    (2, LONG, 0.5, "x"),
    (3, None, None, None),
    (4, "", 1.0, "y"),
    (None, LONG.upper(), 2.0, "z"),
    (5, "short", 0.0, "w"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(rows, column):
    return sorted(((r["doc_id"], r[column]) for r in rows), key=str)


def test_tokens(docs, none):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = bpe.encode_decode(docs, path, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(ROWS)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4)} == {0}
    assert bpe.encode_decode(none, path, public_tokenizers.PATTERN).count() == 0


def test_licenses(docs, none):
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(ROWS)
    assert {(r["n_words"], r["labels"], r["score"]) for r in rows if r["doc_id"] in (3, 4)} == {(0, "", 0.0)}
    assert licenses.scan(none).count() == 0
    names, free = licenses.evaluate(licenses.postfix(b"(MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0"))
    assert names == {"mit", "gpl-2.0-only", "gpl-2.0-only-with-classpath-exception-2.0", "apache-2.0"} and free
    assert licenses.postfix(b"MIT AND") is None


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert by_id(rows, "component_id") == sorted([(1, 1), (2, 1), (2, 1), (3, 3), (4, 3), (None, 1), (5, 5)], key=str)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5]
    assert simhash.keep_first(none).count() == 0


def test_lines(docs, none):
    rows = lines.drop_lines(docs).collect()
    assert by_id(rows, "text") == sorted([(1, LONG), (2, ""), (2, ""), (3, None), (4, ""), (None, ""), (5, "short")], key=str)
    assert lines.drop_lines(none).columns == none.columns


def test_chunks(docs, none):
    spans = chunks.repeated_spans(docs, 20).collect()
    assert {(r["doc_id"], r["source_doc_id"], r["n_bytes"]) for r in spans} == {(2, 1, len(LONG))}
    assert by_id(chunks.drop_repeats(docs, 20).collect(), "text")[1] == (2, "")
    assert chunks.drop_repeats(none).count() == 0


def test_contamination(spark, docs, none):
    items = spark.createDataFrame([(7, LONG), (7, LONG), (8, None), (9, "short")], "item_id long, text string")
    rows = contamination.matches(docs, items).collect()
    assert by_id(rows, "item_id") == sorted([(1, 7), (2, 7), (2, 7), (None, 7)], key=str)
    kept = contamination.keep_clean(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5]
    assert contamination.matches(none, items).count() == 0
    assert contamination.matches(docs, items.where("item_id = 8")).count() == 0


def test_toxicity_without_labels(spark, docs, none):
    labels = spark.createDataFrame([(1, None), (99, 1)], "doc_id long, toxic int")
    rows = toxicity.score(docs, labels.where("doc_id = 1")).collect()
    assert len(rows) == len(ROWS) and {r["predicted"] for r in rows} == {0}
    assert toxicity.keep_clean(none, labels).columns == none.columns


def test_chat(spark):
    rows = [(1, 1, "assistant", "a<b\\l"), (1, 0, "user", None), (1, 1, "assistant", "a<b\\l"), (None, None, None, "x"), (2, 0, "user", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.segments(turns)).collect()}
    assert {k: (r["n_turns"], r["loss_chars"], r["n_examples"]) for k, r in got.items()} == {1: (3, 10, 2), None: (1, 0, 0), 2: (1, 0, 0)}
    placed = chat.segments(turns)
    inputs = sorted(r["input"] for r in chat.example_texts(placed).collect())
    assert inputs[1].startswith(inputs[0]) and inputs[0].startswith("<turn>user<text></turn><turn>assistant<text>a\\lb\\\\l")
    assert chat.digests(chat.segments(turns.where("conv_id = 77"))).count() == 0


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "v", "<article><p>Text &amp; more<p>again</article>")], "page_id long, url string, html string")
    assert {(r["page_id"], r["text"]) for r in extraction.extract(pages).collect()} == {(1, ""), (2, ""), (None, "Text & more\nagain")}
    assert extraction.extract(pages.where("page_id = 9")).count() == 0


def test_embeddings(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, a, 1), (2, a, 1), (3, [0.99, 0.01], 1), (4, a, 2), (5, None, 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [1.0, float("nan")], 1), (9, a, None), (10, b, 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neighbours.near_duplicates(vectors).collect()}
    alone = {i: (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10)}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), **alone}
    assert neighbours.near_duplicates(vectors.where("vec_id = 77")).count() == 0


def test_shingles(docs, none):
    kept = shingles.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in simhash.keep_first(docs).collect())
    assert shingles.keep_first(none).count() == 0


def test_line_dedup_leaves_only_the_lines_to_drop_on_disk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _, purpose: f"{tmp_path}/{purpose}-{uuid.uuid4().hex}")
    docs = spark.createDataFrame([(i, f"one two three four five six\nseven {i}") for i in range(4)], "doc_id long, text string")
    assert sorted(lines.drop_lines(docs).collect())[3] == (3, "seven 3")
    assert len(list(tmp_path.iterdir())) == 1
