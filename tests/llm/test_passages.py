"""Passages that documents share, against where they were planted."""

from __future__ import annotations

import random

from gridcast.llm import chunks


def text_of(rng, words):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(words))


def test_planted_passages_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(8)
    phrases = [text_of(rng, 40) for _ in range(20)]
    rows, planted = [], {}
    for i in range(300):
        passage = text_of(rng, rng.choice((51, 51, 55, 60, 80)))
        for doc in (i, 1000 + i):
            before, after = text_of(rng, rng.randrange(5, 80)), text_of(rng, rng.randrange(5, 80))
            rows.append((doc, f"{before} {passage} {after}"))
            planted[doc] = (len(before) + 1, len(passage))
    rows += [(5000 + i, f"{text_of(rng, 30)} {phrases[i % 20]} {text_of(rng, 30)}") for i in range(200)]
    found = {}
    for r in chunks.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert not [d for d in found if d < 1000 or d >= 5000]
    caught = [d for d in planted if d >= 1000 and d in found]
    assert len(caught) >= 0.98 * 300
    for d in caught:
        start, size = planted[d]
        (span,) = found[d]
        # A chance letter may agree on either side.
        assert start - 4 <= span["start_byte"] <= start and start + size <= span["start_byte"] + span["n_bytes"] <= start + size + 4
        assert span["source_doc_id"] == d - 1000


def test_a_passage_from_two_sources_and_repeated_rows(spark):
    rng = random.Random(9)
    a, b = text_of(rng, 90), text_of(rng, 90)
    rows = [(1, a), (2, b), (3, f"{a} {b}"), (3, f"{a} {b}"), (4, f"{a} {b}"), (None, b), (5, ""), (6, None), (7, "漢字" * 400), (8, "仮" + "漢字" * 400)]
    found = {(r["doc_id"], r["start_byte"], r["n_bytes"], r["source_doc_id"]) for r in chunks.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {x for x in found if x[0] in (None, 4, 1, 2, 5, 6)} == {(None, 0, len(b), 2), (4, 0, len(a) + len(b) + 1, 1)} or {
        x for x in found if x[0] in (None, 4, 1, 2, 5, 6)
    } == {(None, 0, len(b), 2), (4, 0, len(a) + len(b) + 1, 3)}
    assert sum(x[2] for x in found if x[0] == 3) in (len(a) + len(b), len(a) + len(b) + 1)


def test_op6_counts_beside_columns_of_that_name(spark):
    from gridcast.llm import lines

    docs = spark.createDataFrame([(1, "one two three four five", 7), (2, "one two three four five\nand more of other words", 8)], "doc_id long, text string, n_lines int")
    left = {r["doc_id"]: (r["text"], r["n_lines"], r["n_lines_"], r["n_dropped"]) for r in lines.drop_lines(docs, counted=True).collect()}
    assert left == {1: ("one two three four five", 7, 1, 0), 2: ("and more of other words", 8, 2, 1)}
