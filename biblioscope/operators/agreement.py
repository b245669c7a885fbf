"""Chance-corrected agreement over nominal ratings in long form (item, category): sums over items, no matrix."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import scores as S


def cells(ratings: DataFrame, item: str = "item", category: str = "category") -> DataFrame:
    """Votes by item and category; missing ratings are absent."""
    return ratings.filter(F.col(category).isNotNull()).groupBy(F.col(item).alias("item"), F.col(category).cast("string").alias("category")).agg(F.count(F.lit(1)).cast("double").alias("r"))


def coefficients(ratings: DataFrame, item: str = "item", category: str = "category") -> DataFrame:
    """One row: Krippendorff's alpha (nominal), Fleiss' kappa and Gwet's AC1, with items, raters, categories, ratings, and
    standard errors, 95 % intervals and p-values of alpha and kappa: Gwet's variance over items and Student's t.

    Null where undefined (fewer than two ratings on every item; all in one category gives 1 for alpha and AC1)."""
    counts = cells(ratings, item, category)
    of_item = counts.groupBy("item").agg(F.sum("r").alias("n"), F.sum(F.col("r") * (F.col("r") - 1)).alias("agree"))
    rows = counts.join(of_item, "item")
    shared = F.col("n") >= 2
    total = of_item.agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(shared).cast("double").alias("paired"),
        F.avg(F.when(shared, F.col("n"))).alias("mean_n"),
        F.avg(F.when(shared, F.col("agree") / (F.col("n") * (F.col("n") - 1)))).alias("pa"),
        F.avg(F.when(shared, F.col("agree") / (F.col("n") - 1))).alias("pa_raw"),
        F.max("n").alias("raters"),
        F.sum("n").alias("ratings"),
    )
    shares = rows.groupBy("category").agg(F.sum(F.col("r") / F.col("n")).alias("share"), F.sum(F.when(shared, F.col("r")).otherwise(0.0)).alias("votes"))
    chance = shares.crossJoin(F.broadcast(total)).agg(  # one row beside a row for each category
        F.sum((F.col("share") / F.col("items")) * (F.col("share") / F.col("items"))).alias("pe_kappa"),
        F.sum((F.col("share") / F.col("items")) * (1 - F.col("share") / F.col("items"))).alias("spread"),
        F.sum(F.try_divide(F.col("votes"), F.col("paired") * F.col("mean_n")) * F.try_divide(F.col("votes"), F.col("paired") * F.col("mean_n"))).alias("pe_alpha"),
        F.count(F.lit(1)).alias("categories"),
    )
    one = total.crossJoin(chance)  # one row each
    small = F.try_divide(F.lit(1.0), F.col("paired") * F.col("mean_n"))
    pa_alpha = (1 - small) * F.col("pa_raw") / F.col("mean_n") + small
    pe_gwet = F.when(F.col("categories") > 1, F.col("spread") / (F.col("categories") - 1)).otherwise(F.lit(0.0))
    corrected = lambda pa, pe: F.when(pe < 1, (pa - pe) / F.when(pe < 1, 1 - pe))
    alpha = F.when((F.col("categories") == 1) & (F.col("paired") > 0), F.lit(1.0)).otherwise(corrected(pa_alpha, F.col("pe_alpha")))
    out = one.select("items", "paired", "raters", "categories", "ratings", "pa", "pe_kappa", "pe_alpha", alpha.alias("alpha"), corrected(F.col("pa"), F.col("pe_kappa")).alias("kappa"), corrected(F.col("pa"), pe_gwet).alias("ac1"))
    # each item's contribution, less what it adds to the chance agreement, gives the variance over items
    spread = rows.join(F.broadcast(shares.crossJoin(F.broadcast(total.select(F.col("items").alias("N"), F.col("paired").alias("m"), "mean_n")))  # one row beside a row for each category
        .select("category", (F.col("share") / F.col("N")).alias("pk"), F.try_divide("votes", F.col("m") * F.col("mean_n")).alias("pl"))), "category")
    per = spread.groupBy("item", "n", "agree").agg(F.sum(F.col("r") * F.col("pk")).alias("ck"), F.sum(F.col("r") * F.col("pl")).alias("cl"))
    per = per.crossJoin(F.broadcast(out.join(total.select("mean_n", F.col("pa_raw")), how="cross").select("items", "paired", "pa", "alpha", "kappa", "pe_kappa", "pe_alpha", "mean_n", (F.col("pa_raw") / F.col("mean_n")).alias("prime"))))  # one row
    two = F.col("n") >= 2
    rest_k, rest_l = (F.nullif(1 - F.col(c), F.lit(0.0)) for c in ("pe_kappa", "pe_alpha"))  # null, not an error, where all are in one category
    drift = (F.col("n") - F.col("mean_n")) / F.col("mean_n")
    of_kappa = F.col("items") / F.nullif(F.col("paired"), F.lit(0.0)) * F.when(two, F.try_divide(F.col("agree"), F.col("n") * (F.col("n") - 1)) - F.col("pe_kappa")).otherwise(0.0) / rest_k
    of_kappa = of_kappa - 2 * (1 - F.col("kappa")) * (F.col("ck") / F.col("n") - F.col("pe_kappa")) / rest_k
    prime = (F.col("prime") - F.col("pe_alpha")) / rest_l
    of_alpha = (F.try_divide(F.col("agree"), F.col("mean_n") * (F.col("n") - 1)) - F.col("prime") * drift - F.col("pe_alpha")) / rest_l
    of_alpha = of_alpha - 2 * (1 - prime) * (F.col("cl") / F.col("mean_n") - drift - F.col("pe_alpha")) / rest_l
    squares = lambda own, centre: F.sum((own - centre) * (own - centre))
    error = per.agg(
        F.sqrt(F.try_divide(squares(F.when(two, of_alpha), prime), F.max(F.col("paired") * (F.col("paired") - 1)))).alias("alpha_se"),
        F.sqrt(F.try_divide(squares(of_kappa, F.col("kappa")), F.max(F.col("items") * (F.col("items") - 1)))).alias("kappa_se"),
    )
    out = out.crossJoin(error)  # one row each
    for c, n in (("alpha", "paired"), ("kappa", "items")):
        tail = student(F.col(c).cast("double"), F.col(f"{c}_se").cast("double"), (F.col(n) - 1).cast("double"))
        out = out.withColumn("_t", tail).withColumns({f"{c}_low": F.col("_t.low"), f"{c}_high": F.col("_t.high"), f"{c}_p": F.col("_t.p")}).drop("_t")
    return out


def _beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, out = 1.0, 1.0 / (1 - (a + b) * x / (a + 1) or 1e-300), 0.0
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1 + top * d or 1e-300)
            c = 1 + top / c or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def student_p(t: float, freedom: float) -> float:
    """Two-sided p-value of Student's t."""
    return _beta_share(freedom / (freedom + t * t), freedom / 2, 0.5)


def student_quantile(p: float, freedom: float) -> float:
    """The t beyond which, on both sides, lies a share p; by bisection."""
    low, high = 0.0, 1.0
    while student_p(high, freedom) > p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if student_p(mid, freedom) > p else (low, mid)
    return (low + high) / 2


@F.pandas_udf(StructType([StructField(c, DoubleType()) for c in ("low", "high", "p")]))
def student(value: pd.Series, error: pd.Series, freedom: pd.Series) -> pd.DataFrame:
    """95 % interval (within -1 and 1) and two-sided p-value by Student's t; for tables of a row or a few. Null where undefined."""
    rows = []
    for v, e, f in zip(value, error, freedom, strict=True):
        if not (v == v and e == e and e > 0 and f > 0):
            rows.append((None, None, None))
            continue
        half = student_quantile(0.05, f) * e
        rows.append((max(-1.0, v - half), min(1.0, v + half), student_p(v / e, f)))
    return pd.DataFrame(rows, columns=["low", "high", "p"], dtype="float64")


def alpha(ratings: DataFrame, item: str = "item", category: str = "category") -> DataFrame:
    return coefficients(ratings, item, category).select("alpha")


def fleiss_kappa(ratings: DataFrame, item: str = "item", category: str = "category") -> DataFrame:
    return coefficients(ratings, item, category).select("kappa")


def interval_alpha(ratings: DataFrame, item: str = "item", value: str = "value") -> DataFrame:
    """One row: Krippendorff's alpha with squared differences; on 0/1 values it is the nominal one."""
    own = ratings.filter(F.col(value).isNotNull()).select(F.col(item).alias("item"), F.col(value).cast("double").alias("x"))
    of_item = own.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).filter("n >= 2")
    total = of_item.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(2 * (F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") - 1)).alias("seen"))
    expected = 2 * (F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") - 1)
    return total.select(F.when(expected > 0, 1 - F.col("seen") / F.when(expected > 0, expected)).otherwise(F.when(F.col("n") > 0, F.lit(1.0))).alias("alpha"))


def gates(row: DataFrame, cluster_gate: float = S.ALPHA_GATE_CLUSTER, flag_gate: float = S.ALPHA_GATE_EPI, floor: float = S.DN_FLOOR) -> DataFrame:
    """Verdicts on one row (alpha_cluster, alpha_positivista, alpha_interpretativa, alpha_doutrinario, kappa_cluster, ac1_cluster)."""
    passed = lambda c, g: F.coalesce(F.col(c) >= g, F.lit(False))
    own = row.withColumns(
        {
            "cluster_ok": passed("alpha_cluster", cluster_gate),
            "positivista_ok": passed("alpha_positivista", flag_gate),
            "interpretativa_ok": passed("alpha_interpretativa", flag_gate),
            "doutrinario_ok": passed("alpha_doutrinario", flag_gate),
            "doutrinario_floor_ok": passed("alpha_doutrinario", floor),
            "cluster_band": S.agreement_band(F.col("alpha_cluster")),
            "prevalence_paradox": F.coalesce(F.col("ac1_cluster") - F.col("kappa_cluster") > 0.15, F.lit(False)),
        }
    )
    return own.withColumn("all_ok", F.col("cluster_ok") & F.col("positivista_ok") & F.col("interpretativa_ok") & F.col("doutrinario_ok"))


def calibration_verdict(alpha_dn: Column, all_zero: Column, floor: float = S.DN_FLOOR, alarm: float = 0.15) -> Column:
    """Verdict and alarm of a calibration round, as a struct."""
    verdict = F.when(alpha_dn.isNull() | F.isnan(alpha_dn), "inconclusivo").when(alpha_dn >= floor, "aprovado").otherwise("reprovado")
    return F.struct(verdict.alias("verdict"), (all_zero > alarm).alias("all_zero_alarm"))
