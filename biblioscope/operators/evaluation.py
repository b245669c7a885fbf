"""Classifier evaluation as aggregates over prediction rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))


def f1_by_class(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Rows (label, tp, n_true, n_guess, f1); 0 where undefined."""
    cells = confusion(df, truth, guess)
    parts = cells.select(F.col("truth").alias("label"), F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("t"), F.lit(0).alias("g")).unionByName(cells.select(F.col("guess").alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("t"), F.col("n").alias("g")))
    own = parts.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("t").alias("n_true"), F.sum("g").alias("n_guess"))
    return own.withColumn("f1", F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("n_true") + F.col("n_guess"))).otherwise(F.lit(0.0)))


def single_label(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: macro and weighted F1, accuracy."""
    own = f1_by_class(df, truth, guess)
    return own.agg(F.avg("f1").alias("f1_macro"), (F.sum(F.col("f1") * F.col("n_true")) / F.sum("n_true")).alias("f1_weighted"), (F.sum("tp") / F.sum("n_true")).alias("accuracy"))


def calibration_error(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """One row: expected calibration error over right-closed bins; a confidence of 0 is in none."""
    own = df.filter(F.col(confidence) > 0).withColumn("bin", F.ceil(F.col(confidence) * bins)).groupBy("bin")
    each = own.agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(correct).cast("double")).alias("a"))
    return each.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total")))).agg(F.sum(F.col("n") / F.col("total") * F.abs(F.col("c") - F.col("a"))).alias("ece"))  # one row beside ten


def brier(df: DataFrame, truth: str, probabilities: dict[str, str]) -> DataFrame:
    """One row: mean squared distance of the probabilities (label -> column) from the one-hot truth."""
    error = sum(((F.col(c) - (F.col(truth) == label).cast("double")) * (F.col(c) - (F.col(truth) == label).cast("double")) for label, c in probabilities.items()), F.lit(0.0))
    return df.agg(F.avg(error).alias("brier"))


def multi_label(df: DataFrame, flags: Sequence[tuple[str, str, str]]) -> DataFrame:
    """One row for flags (truth, guess, probability): F1 and Brier of each, macro F1, Hamming loss, mean Jaccard (0 of 0 is 0)."""
    out = []
    for t, g, p in flags:
        tp = F.count_if((F.col(t) == 1) & (F.col(g) == 1))
        both = F.sum(F.col(t)) + F.sum(F.col(g))
        out += [F.when(tp > 0, 2 * tp / both).otherwise(F.lit(0.0)).alias(f"f1_{t}"), F.avg((F.col(p) - F.col(t)) * (F.col(p) - F.col(t))).alias(f"brier_{t}")]
    off = sum((F.col(t) != F.col(g)).cast("int") for t, g, _ in flags)
    inter = sum((F.col(t) * F.col(g)) for t, g, _ in flags)
    union = sum(F.greatest(F.col(t), F.col(g)) for t, g, _ in flags)
    own = df.agg(*out, (F.sum(off) / (F.count(F.lit(1)) * len(flags))).alias("hamming"), F.avg(F.when(union > 0, inter / F.when(union > 0, union)).otherwise(F.lit(0.0))).alias("jaccard"))
    return own.withColumn("f1_macro", sum((F.col(f"f1_{t}") for t, _, _ in flags), F.lit(0.0)) / len(flags))


def long_predictions(df: DataFrame, keys: Sequence[str], dimensions: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """One row for each (name, probability, guess, truth): keys, dimensao, prob, pred, verdade, acerto."""
    rows = F.array(*(F.struct(F.lit(n).alias("dimensao"), F.col(p).cast("double").alias("prob"), F.col(g).cast("string").alias("pred"), F.col(t).cast("string").alias("verdade")) for n, p, g, t in dimensions))
    own = df.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*")
    return own.withColumn("acerto", F.col("pred") == F.col("verdade"))


def best_runs(metrics: DataFrame, by: Sequence[str], score: str = "f1_macro_teste") -> DataFrame:
    """The run of highest score in each group, among those that ended well (status ok)."""
    own = metrics.filter("status = 'ok'")
    best = own.groupBy(*by).agg(F.max_by(F.struct(*(c for c in own.columns if c not in by)), F.struct(F.col(score), F.col(score))).alias("x"))
    return best.select(*by, "x.*")


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index of two labelings, from their contingency table."""
    pairs = lambda n: F.sum(F.col(n).cast("double") * (F.col(n) - 1) / 2)
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    both = cells.agg(pairs("n").alias("s"), F.sum("n").alias("t"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(pairs("n").alias("ra"))
    columns = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(pairs("n").alias("rb"))
    expected = F.col("ra") * F.col("rb") / (F.col("t").cast("double") * (F.col("t") - 1) / 2)
    return both.crossJoin(rows).crossJoin(columns).select(F.when((F.col("ra") + F.col("rb")) / 2 != expected, (F.col("s") - expected) / ((F.col("ra") + F.col("rb")) / 2 - expected)).otherwise(F.lit(1.0)).alias("ari"))  # one row each
