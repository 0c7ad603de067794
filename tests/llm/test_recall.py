"""What the operators find, against brute force over planted near copies."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from gridcast.llm import licenses, lines, shingles, simhash
from gridcast.llm.edits import bounded


def edited(rng, line, edits):
    line = list(line)
    for _ in range(edits):
        kind, at = rng.choice("rid"), rng.randrange(len(line))
        if kind == "r":
            line[at] = f"w{rng.randrange(400)}"
        elif kind == "i":
            line.insert(at, f"w{rng.randrange(400)}")
        else:
            del line[at]
    return line


def test_op6_finds_every_similar_pair(spark):
    rng = random.Random(6)
    every = []
    for size in (5, 6, 9, 10, 14, 20, 30, 40, 60):
        for _ in range(12):
            base = [f"w{min(rng.randrange(400), rng.randrange(400))}" for _ in range(size)]
            every += [base, edited(rng, base, size // 5), edited(rng, base, max(size // 10, 1)), edited(rng, base, size // 5 + 2)]
    # A crowd of like lines, and lines that repeat a word.
    crowd = [f"w{rng.randrange(400)}" for _ in range(25)]
    every += [edited(rng, crowd, rng.randrange(6)) for _ in range(60)] + [["the"] * n for n in (5, 6, 7, 12, 14, 40)]
    every = [x for x in dict.fromkeys(map(tuple, every)) if len(x) >= lines.LEAST_WORDS]
    root = list(range(len(every)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(every):
        for j in range(i):
            if bounded(a, every[j], int(0.2 * max(len(a), len(every[j])) + 1e-9)) is not None:
                x, y = sorted((top(i), top(j)))
                root[y] = x
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(every)], "doc_id long, text string")
    found = {r["doc_id"]: r["kept_doc_id"] for r in lines.dropped_lines(docs).collect()}
    assert found == {i: top(i) for i in range(len(every)) if top(i) != i}


def test_pipeline_drops_every_near_copy_at_a_similarity_of_four_fifths(spark):
    rng = random.Random(5)
    texts = []
    for size in (3, 5, 8, 30, 60, 120, 300, 300, 300):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        texts += [base, *(edited(rng, base, k) for k in (0, 1, max(size // 60, 1), size // 45, size // 30))]
    crowd = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts += [edited(rng, crowd, rng.randrange(4)) for _ in range(50)] + [[], []]
    sets = [{tuple(t[i : i + 5]) for i in range(max(len(t) - 4, 1))} if t else set() for t in texts]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9:
                x, y = sorted((top(i), top(j)))
                root[y] = x
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    kept = [r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()]
    assert sorted(kept) == [i for i in range(len(sets)) if top(i) == i]


def test_pipeline_drops_what_simhash_links(spark):
    rng = random.Random(8)
    phrase = [f"p{i}" for i in range(7)] * 50
    texts = [" ".join([*(phrase if i < 2 else []), *(f"w{rng.randrange(5000)}" for _ in range(12))]) for i in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs).collect()) == [0, 2]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == [0, 2]


def test_pipeline_drops_exact_repeats_of_short_lines(spark):
    texts = ["Read more\n\n漢字漢字漢字漢字\none two three four", "read  MORE!\n\nread less", "漢字漢字漢字漢字\none two three for\none two three four", "---\n---"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_stage(spark, docs, "").collect()}
    assert left == {0: texts[0], 1: "\nread less", 2: "one two three for", 3: texts[3]}


def test_op10_reads_every_tag_of_a_line():
    tag = b"SPDX-License-Identifier: "
    phrases = licenses.automaton([*licenses.BASE, *licenses.NOTICES, licenses.TAG])
    _, _, _, _, _, labels, tags, permissive, _ = licenses.scan_text(tag + b"MIT */ a(); /* " + tag + b"GPL-2.0 OR BSD */ // " + tag + b"AGPL-3.0\nno", phrases)
    assert (labels, tags, permissive) == ("agpl-3.0,bsd,gpl-2.0,mit", 3, False)


def test_op6_counts_every_document(spark):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(40)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = np.zeros(1 << lines.SLOT_BITS, dtype=np.int64)
    for word in " ".join(texts).encode().split():
        counts[int(lines.hashes_of([word])[0]) >> (64 - lines.SLOT_BITS)] += 1
    assert (lines.word_levels(docs) == np.minimum(8 * np.log2(1.0 + counts), 255).astype(np.uint8)).all()


def test_op6_tells_long_strangers_of_a_crowd_apart_without_their_texts(spark, monkeypatch):
    rng = random.Random(11)
    rare = ["rare", "couple"]
    every = [[f"w{rng.randrange(3000)}" for _ in range(180)] + rare for _ in range(60)]
    every += [edited(rng, every[0], 30), edited(rng, every[1], 10)]
    compared = []

    def counted(pairs, real=lines.verified):
        compared.append(pairs.count())
        return real(pairs)

    monkeypatch.setattr(lines, "verified", counted)
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(every)], "doc_id long, text string")
    found = {r["doc_id"]: r["kept_doc_id"] for r in lines.dropped_lines(docs).collect()}
    assert found == {60: 0, 61: 1}
    assert sum(compared) <= 10


def test_op6_compares_all_near_nodes_of_a_crowd_whose_roots_differ():
    rng = random.Random(12)
    bases = {}
    for size in (8, 30, 95, 96, 120, 240):
        base = [f"w{rng.randrange(900)}" for _ in range(size)]
        bases.update(dict.fromkeys([tuple(base), *(tuple(edited(rng, base, rng.randrange(size // 4 + 1))) for _ in range(20))], size))
    every = list(bases)
    words = [w.encode() for line in every for w in line]
    sizes = np.array([len(x) for x in every])
    hashed = lines.hashes_of(words)
    keys, bits, wide = lines.digests(hashed, sizes), lines.sketches(hashed, sizes), lines.wide_sketches(hashed, sizes)
    roots = np.where(np.arange(len(every)) % 3 == 0, keys[0], keys)
    texts = [" ".join(x).encode() for x in every]
    columns = {"key": keys, "text": texts, "block": np.arange(len(every)) % 2, "blocks": [[i % 2] for i in range(len(every))], "words": sizes, "high": bits[:, 0], "low": bits[:, 1], "root": roots}
    batch = pa.RecordBatch.from_arrays([*map(pa.array, columns.values()), *wide], names=[*columns, *lines.WIDE])
    parts = [batch.slice(0, 50), batch.slice(50)]
    found, edges = set(), [p for b in lines.crowd_edges(iter(parts)) for p in zip(b.column("a").to_pylist(), b.column("b").to_pylist())]
    for rows, _, places in lines.crowd_pairs(iter(parts)):
        key = rows.column("key").to_numpy()
        found |= {(min(key[i], key[j]), max(key[i], key[j])) for left, right in places for i, j in zip(left, right)}
    expected = set()
    for i in range(len(every)):
        for j in range(i):
            most = int(lines.edits_allowed(max(sizes[i], sizes[j])))
            if i % 2 == j % 2 and roots[i] != roots[j] and bounded(every[i], every[j], most) is not None:
                expected.add((min(keys[i], keys[j]), max(keys[i], keys[j])))
    assert expected and expected <= found
    base = dict(zip(keys.tolist(), bases.values()))
    assert all(base[a] == base[b] for a, b in found)
    # Edges link what all similar pairs link, and are fewer than rows.
    known = {frozenset(p) for p in expected}
    assert all(frozenset(p) in known for p in edges) and len(edges) < len(every)

    def groups(pairs):
        top = dict(zip(keys.tolist(), roots.tolist()))
        for a, b in pairs:
            low, high = sorted((top[a], top[b]))
            top = {k: low if r == high else r for k, r in top.items()}
        return top

    assert groups(edges) == groups(expected)


def test_op5_never_broadcasts_generated_anchors(spark):
    # A range, whose size Spark knows to be small.
    prints = spark.range(50).selectExpr("id * 7919 AS print")
    assert "BroadcastHashJoin" not in simhash.links(prints)._jdf.queryExecution().executedPlan().toString()


def test_pipeline_never_broadcasts_pairs(spark, monkeypatch):
    pairs = spark.range(9).selectExpr("id AS a", "id + 1 AS b")
    nodes = spark.range(9).selectExpr("id AS print", "1 AS size", "CAST('12345678' AS BINARY) AS sketch")
    texts = spark.range(9).selectExpr("id AS key", "CAST('one two' AS BINARY) AS words")
    seen = []
    monkeypatch.setattr(lines, "stage", lambda df: seen.append(df) or df)
    lines.edges_of(texts, pairs)
    for made in (shingles.likely(pairs, nodes), *seen):
        assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()


def test_sketches_tell_at_most_what_sets_have_apart():
    rng = np.random.default_rng(3)
    every = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 40, 300, 345, 2000)]
    every += [np.unique(np.concatenate([x[: len(x) * 9 // 10], every[1]])) for x in every]
    pairs = [(a, b) for a in every for b in every]
    found = shingles.odd_slots(*(pa.array([shingles.sketch(p[i]) for p in pairs], pa.binary()) for i in (0, 1)))
    apart = np.array([len(np.setxor1d(a, b)) for a, b in pairs])
    assert (found <= apart).all() and (found % 2 == apart % 2).all()
    assert (found[[a is b for a, b in pairs]] == 0).all()


def test_pipeline_compares_no_strangers_that_share_a_passage(spark, monkeypatch):
    rng = random.Random(13)
    passages = [[f"p{i}x{j}" for j in range(9)] for i in range(12)]
    texts = [[*(f"w{rng.randrange(9000)}" for _ in range(150)), *(w for p in passages for w in p), *(f"w{rng.randrange(9000)}" for _ in range(150))] for _ in range(20)]
    texts.append(edited(rng, texts[0], 3))
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    found = shingles.sets(docs, 5).cache()
    nodes = found.select("print", "row", "size", "sketch")
    pairs = shingles.candidates(shingles.meetings(found), spark.createDataFrame([], "print long, root long"))
    alike = {frozenset(r["print"] for r in found.where("doc_id in (0, 20)").collect())}
    assert pairs.count() > 100
    assert {frozenset(r) for r in shingles.likely(pairs, nodes).collect()} == alike
    # More pairs than nodes are told apart and verified in shares.
    monkeypatch.setattr(shingles, "PAIRS_A_NODE", 2)
    everything = found.select(F.col("print").alias("a")).join(found.select(F.col("print").alias("b"))).where("a < b")
    verified = shingles.edges_of(docs, nodes.withColumn("sketch", F.lit(bytes(8))), everything, 5)
    assert {frozenset(r) for r in verified.collect()} == alike
