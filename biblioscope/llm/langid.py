"""Language identification: averaged hashed subword embeddings with a linear softmax and calibrated rejection."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_crc, remembered, small_batches, table
from .subwords import WordLogits, bags, train

SIZES = (1, 2, 3, 4)
BUCKETS = 1 << 16
#: The model is fitted on at most so many texts of each language, those with the smallest id hashes.
TRAIN_ROWS_PER_LANGUAGE = 300
#: Batches of SGD at least, however few the rows.
STEPS = 300
#: Few held-back texts say little about their least score; beyond this no prediction is rejected.
HIGHEST_FLOOR = 0.95
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    temperature: float
    floor: float  # below this calibrated score a prediction is marked as rejected


def fit(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    """Trains on 60-word and shorter stretches of all parts of the texts; every fifth text is held back to fit the temperature and the rejection floor."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(langs))
    rows: list[tuple[list[str], int]] = []
    held: list[tuple[list[str], int]] = []
    for i, (text, lang) in enumerate(zip(texts, langs, strict=True)):
        words = (text or "").split()
        if not any(c.isalpha() for c in text or ""):
            continue
        y = languages.index(lang)
        if i % 5 == 4:
            held.append((words, y))
            continue
        for k in rng.permutation(max(1, len(words) // 60))[:4]:
            rows.append((words[60 * k : 60 * k + 60], y))
        for n in (1, 3, 8):
            at = int(rng.integers(0, max(1, len(words) - n + 1)))
            rows.append((words[at : at + n], y))
    if not rows:
        return Model(languages, np.zeros((BUCKETS, max(1, len(languages))), np.float32), 1.0, 0.0)
    targets = np.zeros((len(rows), len(languages)), np.float32)
    targets[np.arange(len(rows)), [y for _, y in rows]] = 1
    # every language weighs the same
    targets *= (len(rows) / len(languages) / np.maximum(1, targets.sum(0)))[None, :]
    weights = train(bags([w for w, _ in rows], SIZES, BUCKETS), targets, BUCKETS, steps=STEPS)
    model = Model(languages, weights, 1.0, 0.0)
    if held:
        memo = WordLogits(weights, SIZES)
        logits = np.stack([_logits(memo, w) for w, _ in held])
        y = np.array([y for _, y in held])
        fits = {t: float(-np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-9)).mean()) for t in np.geomspace(0.5, 20, 60)}
        model.temperature = min(fits, key=fits.get)
        model.floor = min(HIGHEST_FLOOR, float(np.quantile(_softmax(logits / model.temperature).max(1), 0.01)))
    return model


def _softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


def _logits(memo: WordLogits, words: list[str]) -> np.ndarray:
    memo.learn(set(words))
    rows = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
    return memo.logits[rows].mean(0, dtype=np.float64)


def _predict(model: Model):
    key = hash(model.table.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = remembered(("languages", key), lambda: WordLogits(model.table, SIZES))
        for batch in batches:
            texts = batch.column(2).to_pylist()
            langs, scores, rejected = [], [], []
            bags = [text.split() if text and any(map(str.isalpha, text)) else None for text in texts]
            for words in bags:
                if words is None or not model.languages:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                p = _softmax(_logits(memo, words) / model.temperature)
                k = int(p.argmax())
                langs.append(model.languages[k])
                scores.append(float(p[k]))
                rejected.append(bool(p[k] < model.floor))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def training_sample(rows: DataFrame, lang_col: str, per_language: int) -> list[tuple[str, str]]:
    """At most per_language (text, language) pairs of each language: those with the smallest hashes of the id.

    Counts by language set a hash bound for each, so only about that many rows leave the executors."""
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return []
    order = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40))
    bound: Column = F.lit(0)
    for lang, n in counts.items():
        bound = F.when(F.col(lang_col) == lang, F.lit(int((1 << 40) * min(1.0, 1.5 * per_language / n + 20 / n)))).otherwise(bound)
    found = rows.withColumn("_order", order).filter(F.col("_order") <= bound).select(lang_col, "text", "_order").collect()
    taken: Counter = Counter()
    out = []
    for lang, text, _ in sorted(found, key=lambda r: (r[2], r[1] or "")):
        if taken[lang] < per_language:
            taken[lang] += 1
            out.append((text, lang))
    return out


def identify(docs: DataFrame, train_rows: DataFrame, per_language: int = TRAIN_ROWS_PER_LANGUAGE) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score, rejected) for docs (doc_id, held_out, text).

    train_rows has (doc_id, text, lang), lang not null. A null text, or one without any letter, gets `und`, score 0
    and rejected. Whole texts are scored. rejected marks calibrated scores below what 99 % of held-back training texts
    reach (0.95 at most). Without training rows all is `und`. Repeated rows and ids give a row each; an empty table gives none."""
    sample = training_sample(train_rows, "lang", per_language)
    model = fit([t for t, _ in sample], [x for _, x in sample])
    return docs.select("doc_id", "held_out", "text").mapInArrow(_predict(model), "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all documents; learns only from those whose crc32(doc_id as text) mod 5 is not 0."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang").withColumn("held_out", id_crc("doc_id") % 5 == 0)
    return identify(docs, docs.filter(~F.col("held_out") & F.col("lang").isNotNull()).select("doc_id", "text", "lang"))
