"""Toxicity: words as averaged bags of subword embeddings under a linear softmax, trained jointly, so misspellings share n-grams.

A document's score is calibrated from its words' odds: its three largest and the number above even. One average over the
document's whole bag was tried first and dilutes a few toxic words beyond use; the README has the figures of both."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_crc, remembered, small_batches, table
from .subwords import EDGES, WordLogits, bags, train

SIZES = (2, 3, 4, 5)
BUCKETS = 1 << 17
#: The model is fitted on at most so many labelled rows of each label, those with the smallest id hashes.
TRAIN_ROWS_PER_LABEL = 1500
THRESHOLD = 0.7
#: Rows of the sample's mix that each word is taken to have been seen in besides its own.
SMOOTHING = 1.0
#: Passes over the words at least, batches in all at least, and the step size.
EPOCHS, STEPS, RATE = 8, 1500, 0.5
TOP = 3
#: The mean of the logits of several trainings varies less than one does.
SEEDS = (7, 8, 9)


@dataclass
class Model:
    table: np.ndarray
    mean: np.ndarray
    weights: np.ndarray  # of the calibration, over the document's features, the bias last


def _features(memo: WordLogits, words: set[str]) -> np.ndarray:
    """The document's largest word log-odds, and the share of words above even odds; a word is its subwords' average."""
    memo.learn(words)
    rows = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
    odds = memo.logits[rows]
    odds = np.clip(odds[:, 1] - odds[:, 0], -20, 20)
    top = np.sort(np.partition(odds, -TOP)[-TOP:] if len(odds) > TOP else np.concatenate([odds, np.full(TOP - len(odds), -8.0)]))[::-1]
    return np.concatenate([top, [np.log1p((odds > 0).sum())]])


def _words(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def fit(texts: list[str | None], toxic: list[int], prior: float | None = None) -> Model:
    """prior is the share of toxic rows in the table that the sample is from (None: as in the sample). Each distinct word of a row is an example with the row's label, so a word that toxic rows alone have gets high
    odds and words of all rows get the share of toxic rows. Every fourth row of each label is held back to calibrate the rows' scores."""
    counts: dict[str, list[int]] = {}
    held = []
    nth: Counter = Counter()
    for text, y in zip(texts, toxic, strict=True):
        words = _words(text)
        nth[y] += 1
        if nth[y] % 4 == 0:
            held.append((words, y))
            continue
        for w in {w.strip(EDGES) for w in words}:
            counts.setdefault(w, [0, 0])[int(y)] += 1
    empty = Model(np.zeros((BUCKETS, 2), np.float32), np.zeros(TOP + 1), np.array([0.0] * (TOP + 1) + [-2.0]))
    vocabulary = sorted(counts)  # the order of sets changes from process to process, and SGD goes by order
    if not vocabulary or len({y for _, y in held}) < 2:
        return empty
    seen = np.array([counts[w] for w in vocabulary], np.float32)
    base = np.bincount(np.array(toxic), minlength=2)[None, :] / len(toxic)
    shares = (seen + SMOOTHING * base) / (seen.sum(1, keepdims=True) + SMOOTHING)  # a word seen once says little
    bag, targets = bags([[w] for w in vocabulary], SIZES, BUCKETS), (shares * seen.sum(1, keepdims=True)).astype(np.float32)
    weights = np.mean([train(bag, targets, BUCKETS, steps=STEPS, epochs=EPOCHS, batch=512, rate=RATE, seed=seed) for seed in SEEDS], axis=0, dtype=np.float32)
    memo = WordLogits(weights, SIZES)
    x = np.stack([_features(memo, w) for w, _ in held])
    y = np.array([y for _, y in held], float)
    mean = x.mean(0)
    own = y.mean()
    weight = np.where(y == 1, (prior if prior else own) / own, (1 - (prior if prior else own)) / (1 - own))  # as in the whole table
    design = np.column_stack([x - mean, np.ones(len(x))])
    w = np.zeros(design.shape[1])
    for _ in range(50):  # ridge logistic regression by Newton steps
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = design.T @ (design * (weight * p * (1 - p))[:, None]) + 0.5 * np.eye(len(w))
        w -= np.linalg.solve(hessian, design.T @ (weight * (p - y)) + 0.5 * w)
    return Model(weights, mean, w)


def _score(fitted: Model, place: int):
    key = hash(fitted.table.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = remembered(("toxicity", key), lambda: WordLogits(fitted.table, SIZES))
        for batch in batches:
            scores = []
            for text in batch.column(place).to_pylist():
                x = _features(memo, _words(text)) - fitted.mean
                scores.append(float(1 / (1 + np.exp(-np.clip(x @ fitted.weights[:-1] + fitted.weights[-1], -30, 30)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return run


def training_sample(docs: DataFrame, labels: DataFrame, per_label: int) -> tuple[list[tuple[str | None, int]], float | None]:
    """At most per_label rows of each label, by the smallest id hashes, and the share of toxic ones in all; only the
    sample's texts come to the driver."""
    usable = labels.filter((id_crc("doc_id") % 3 != 1) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic").distinct()
    counts = {r[0]: r[1] for r in usable.groupBy("toxic").count().collect()}
    order = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40))
    bound = F.lit(0)
    for y, n in counts.items():
        bound = F.when(F.col("toxic") == y, F.lit(int((1 << 40) * min(1.0, 1.2 * per_label / n + 20 / n)))).otherwise(bound)
    chosen = usable.withColumn("_order", order).filter(F.col("_order") <= bound).orderBy("_order", "doc_id", "toxic").limit(4 * per_label + 200)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text", "_order").orderBy("_order", "toxic", F.xxhash64("text")).limit(8 * per_label + 400).collect()
    taken: Counter = Counter()
    out = []
    for y, text, _ in sorted(texts, key=lambda r: (r[2], r[0], r[1] or "")):
        if taken[y] < per_label:
            taken[y] += 1
            out.append((text, y))
    return out, counts.get(1, 0) / max(1, sum(counts.values())) or None


def model(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_ROWS_PER_LABEL) -> Model:
    """Fitted on labelled rows whose crc32(doc_id as text) mod 3 is not 1; without both labels all scores are low and equal."""
    sample, prior = training_sample(docs, labels, per_label)
    return fit([t for t, _ in sample], [y for _, y in sample], prior)


def apply(docs: DataFrame, fitted: Model) -> DataFrame:
    """docs with all its columns and score (0 to 1), by whole texts; no other column is an input of it.

    Null and empty texts get the score of a text without words. Repeated rows and ids each get their score; an empty
    table gives none; a column named score is replaced."""
    names = [c for c in docs.columns if c != "score"]
    place = names.index("text")
    kept = docs.select(*names)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(_score(fitted, place), f"{kind}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scored = apply(docs, model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (id_crc("doc_id") % 3 == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
