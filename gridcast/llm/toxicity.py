"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney bigram models, one of toxic and one of ordinary
texts, are compared by their log-likelihoods per word. Both back off to the same
unigram counts of the whole corpus. A word or bigram keeps counts of its own
class only where the labelled texts show that the classes differ on it (a
likelihood-ratio test whose bound is chosen on texts that the models have not seen);
rarer and neutral expressions are smoothed to the shared counts, where both
classes agree up to a constant. A logistic curve, fitted on the same unseen texts, turns the difference into a score.

Labels are read only through ``train``; texts of all documents give the shared
counts. The models are fitted on at most about ``SAMPLE_ROWS`` labelled rows a class
(chosen by a hash of their id, the same number from either class, so that neither class
backs off more than the other) and keep at most ``KEPT`` expressions; this
bounds what is broadcast to a few MB. All other counts cover all documents.

Edge cases: null and empty texts have no words and difference 0; rows with a null
label or no matching document teach nothing; repeated labels count once, contradicting ones
each; if a class has no labelled row every score is the share of toxic
labels (0 without labels); repeated rows repeat; an empty table gives an empty
result; other columns are kept by ``keep_clean`` and not read otherwise.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.llm.common import stage, unused

SAMPLE_ROWS = 10_000
KEPT = 100_000
DISCOUNT = 0.75
LEAST_COUNT = 4
#: Bounds of the likelihood-ratio test that are tried on the texts left for the curve; the best one stays.
BOUNDS = (8.0, 12.0, 18.0, 27.0, 40.0)
FOLDS, HELD_OUT, CURVE = 5, 0, 4
#: Distinct words a task counts before it hands them on.
COUNTED = 200_000
START = ""

#: ASCII punctuation and control characters separate words; lower-casing is done on characters before.
SEPARATORS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(SEPARATORS).split() if text else []


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def shared_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents; tasks count before the shuffle."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
            )
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(words(text))
                if len(counts) >= COUNTED:
                    yield flush()
        yield flush()

    partial = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(per_batch, "word binary, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def class_counts(sample: DataFrame) -> DataFrame:
    """(v, w, ordinary, toxic): bigram counts of the sampled labelled texts by class."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Counter(), Counter())
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                found = words(text)
                counts[label].update(zip([START.encode(), *found], found))
            pairs = list(counts[0].keys() | counts[1].keys())
            arrays = [pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)]
            arrays += [pa.array([c[p] for p in pairs], pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays(arrays, names=["v", "w", "ordinary", "toxic"])

    read = sample.select(F.col("text").cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic"))
    partial = read.mapInArrow(per_batch, "v binary, w binary, ordinary long, toxic long")
    return partial.groupBy("v", "w").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def g2(a: str, b: str, all_a: Column, all_b: Column) -> Column:
    """Likelihood-ratio statistic of two counts against equal rates."""
    rate = (F.col(a) + F.col(b)) / (all_a + all_b)
    part = lambda n, total: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / (total * rate))).otherwise(0.0)
    return 2 * (part(a, all_a) + part(b, all_b))


def telling(counts: DataFrame, a: str, b: str, all_a: Column, all_b: Column) -> DataFrame:
    """The rows on which the classes differ by at least the lowest bound, with their statistic ``g2``."""
    tested = counts.where(F.col(a) + F.col(b) >= LEAST_COUNT).withColumn("g2", g2(a, b, all_a, all_b))
    return tested.where(F.col("g2") >= BOUNDS[0]).orderBy(F.desc("g2"), *counts.columns[:2]).limit(KEPT)


class Model:
    """Log-likelihood differences (toxic less ordinary) by word and bigram; small, and the same for every task."""

    def __init__(self, unigrams, bigrams, contexts, totals, shared, corpus_words, vocabulary):
        """unigrams: (word, continuations by class); bigrams: (v, w, counts by class); contexts: v's counts by class;
        totals: sums of the continuations by class; shared: corpus counts of the words named."""
        kept = [u[0] for u in unigrams]
        prior = {w: (shared.get(w, 0) + 1) / (corpus_words + vocabulary + 1) for w in {*kept, *(b[1] for b in bigrams)}}
        rest = max(1 - sum(prior[w] for w in kept), 1e-9)
        self.unigram: list[dict[bytes, float]] = []
        self.others: list[float] = []
        for c in (0, 1):
            own = {u[0]: max(u[1 + c] - DISCOUNT, 0.0) / totals[c] for u in unigrams}
            # One discount per word with own counts backs these off; words without own counts share the rest as the corpus does.
            freed = DISCOUNT * len(unigrams) / totals[c]
            left = 1 - sum(own.values())
            self.unigram.append({w: p + max(freed, 1e-12) * prior[w] for w, p in own.items()})
            self.others.append(max(left, 1e-9) / rest)
        self.prior = prior
        listed: dict[bytes, list] = {}
        for v, w, *counts in bigrams:
            listed.setdefault(v, []).append((w, counts))
        self.words = {w: i + 1 for i, w in enumerate(sorted({*kept, *listed, *(b[1] for b in bigrams)}))}
        self.gain = np.full(len(self.words) + 1, math.log(self.others[1] / self.others[0]))
        for w in kept:
            self.gain[self.words[w]] = math.log(self.unigram[1][w] / self.unigram[0][w])
        self.context = np.zeros(len(self.words) + 1)
        keys, extra = [], []
        for v, rows in listed.items():
            own = [[max(n[c] - DISCOUNT, 0.0) / contexts[v][c] for _, n in rows] for c in (0, 1)]
            left = [max(1 - sum(x), 1e-4) for x in own]
            drift = self.context[self.words[v]] = math.log(left[1] / left[0])
            for i, (w, _) in enumerate(rows):
                p = [own[c][i] + left[c] * self.probability(w, c) for c in (0, 1)]
                keys.append(self.words[v] * (len(self.words) + 1) + self.words[w])
                extra.append(math.log(p[1] / p[0]) - drift - self.gain[self.words[w]])
        order = np.argsort(keys) if keys else np.zeros(0, dtype=int)
        self.keys, self.extra = np.array(keys, dtype=np.int64)[order], np.array(extra)[order]

    def probability(self, w: bytes, c: int) -> float:
        found = self.unigram[c].get(w)
        return self.others[c] * self.prior[w] if found is None else found

    def difference(self, text: str | None) -> float:
        """Log-likelihood of the text under the toxic less that under the ordinary model, per word."""
        found = words(text)
        if not found:
            return 0.0
        get = self.words.get
        ids = np.array([get(START.encode(), 0), *[get(w, 0) for w in found]], dtype=np.int64)
        total = self.gain[ids[1:]].sum() + self.context[ids[:-1]].sum()
        if len(self.keys):
            keys = ids[:-1] * (len(self.words) + 1) + ids[1:]
            keys = keys[(ids[:-1] > 0) & (ids[1:] > 0)]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            total += self.extra[at[self.keys[at] == keys]].sum()
        return float(total) / len(found)


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Loss, slope and offset of a logistic curve through (difference, label): Newton steps, a weak prior on the slope."""
    scale = float(x.std()) or 1.0
    z = np.column_stack([x / scale, np.ones(len(x))])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -35, 35)))
        w = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve(z.T @ (z * w[:, None]) + np.diag([1e-3, 1e-6]), z.T @ (y - p) - np.array([1e-3, 1e-6]) * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ beta, -35, 35))), 1e-12, 1 - 1e-12)
    loss = -float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())
    return loss, float(beta[0]) / scale, float(beta[1])


def differences(docs: DataFrame, model: Model, *columns: str) -> DataFrame:
    """``columns`` of ``docs`` with the model's difference as the last one; the model (bounded by ``KEPT``) goes with the tasks."""
    scored, found_as = unused(docs, "_scored"), unused(docs, "_difference")
    read = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").cast("string").alias(scored))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.difference
        for batch in batches:
            found = [of(t) for t in batch.column(scored).to_pylist()]
            arrays = [*(batch.column(c) for c in columns), pa.array(found, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, found_as])

    return read.mapInArrow(per_batch, T.StructType([*read.schema.fields[:-1], T.StructField(found_as, T.DoubleType())]))


def sampled(labelled: DataFrame, where: Column) -> DataFrame:
    """The same number of rows of either class, about ``SAMPLE_ROWS`` at most, by a hash of the row."""
    rows = labelled.where(where)
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").agg(F.count("*")).collect()}
    wanted = min([SAMPLE_ROWS, *sizes.values()])
    share = F.lit(0.0)
    for label, size in sizes.items():
        share = F.when(F.col("toxic") == label, F.lit(wanted / size)).otherwise(share)
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30))


def train(docs: DataFrame, labels: DataFrame) -> tuple[Model | None, float, float]:
    """Model and curve from documents and labels; rows of the held-out fold are never read."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    base = known.where("toxic in (0, 1) and doc_id is not null").where(fold() != HELD_OUT).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = {r[0]: r[1] for r in base.groupBy("toxic").agg(F.count("*")).collect()}
    if len(sizes) < 2:
        rate = sizes.get(1, 0) / max(sum(sizes.values()), 1)
        return None, 0.0, math.log(max(rate, 1e-9) / max(1 - rate, 1e-9))
    to_fit = sampled(base, fold() != CURVE).select("doc_id", "toxic", F.lit(True).alias("fit"))
    curve_rows = base.where(fold() == CURVE)
    curve_size = curve_rows.count()
    thinned = curve_rows.where(F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(1 << 30)) < min(1.0, SAMPLE_ROWS / max(curve_size, 1)) * (1 << 30))
    chosen = to_fit.unionByName(thinned.select("doc_id", "toxic", F.lit(False).alias("fit")))
    # At most three samples of ids: small enough to broadcast at any size of the corpus.
    chosen = stage(texts.join(F.broadcast(chosen), "doc_id"))
    counts = stage(class_counts(chosen.where("fit")))
    unigrams = counts.groupBy("w").agg(*[F.sum((F.col(c) > 0).cast("long")).alias(c) for c in ("ordinary", "toxic")])
    named = ("ordinary", "toxic")
    totals = unigrams.agg(*[F.sum(c) for c in named]).first()
    contexts = counts.groupBy("v").agg(F.sum("ordinary").alias("all_o"), F.sum("toxic").alias("all_t"))
    if not totals[0] or not totals[1]:
        rate = sizes[1] / sum(sizes.values())
        return None, 0.0, math.log(rate / (1 - rate))
    kept = telling(unigrams, *named, F.lit(totals[0]), F.lit(totals[1])).collect()
    known = counts.join(contexts.where("all_o > 0 and all_t > 0"), "v").select("v", "w", *named, "all_o", "all_t")
    pairs = telling(known, *named, F.col("all_o"), F.col("all_t")).collect()
    corpus = stage(shared_counts(docs))
    asked = docs.sparkSession.createDataFrame([(bytes(w),) for w in sorted({bytes(r["w"]) for r in [*kept, *pairs]})], "word binary")
    all_words = corpus.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shared = {bytes(r["word"]): r["n"] for r in corpus.join(F.broadcast(asked), "word").collect()}
    unseen = chosen.where("not fit") if curve_size else chosen
    best = None
    for bound in BOUNDS:
        model = Model(
            [(bytes(r["w"]), r["ordinary"], r["toxic"]) for r in kept if r["g2"] >= bound],
            [(bytes(r["v"]), bytes(r["w"]), r["ordinary"], r["toxic"]) for r in pairs if r["g2"] >= bound],
            {bytes(r["v"]): (r["all_o"], r["all_t"]) for r in pairs},
            totals, shared, *all_words,
        )
        points = differences(unseen, model, "toxic").collect()
        loss, slope, offset = fit_curve(np.array([p[1] for p in points]), np.array([p[0] for p in points], dtype=float))
        if best is None or loss < best[0]:
            best = (loss, model, slope, offset)
    return best[1:]


def scored(docs: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of every row of ``docs`` with its score (0 to 1, higher: toxic) as the last one."""
    name = unused(docs, "_score")
    model, slope, offset = train(docs, labels)
    named = [F.col(f"`{c}`") for c in columns]
    if model is None:
        return docs.select(*named, F.lit(1 / (1 + math.exp(-offset))).alias(name))
    found = differences(docs, model, *columns)
    curve = 1 / (1 + F.exp(-(F.col(found.columns[-1]) * slope + offset)))
    return found.select(*named, curve.alias(name))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored(read, labels, "doc_id").select(
        "doc_id",
        (fold() == HELD_OUT).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns kept."""
    found = scored(docs, labels, *docs.columns)
    return found.where(F.col(found.columns[-1]) < 0.5).drop(found.columns[-1])
