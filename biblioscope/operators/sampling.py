"""Stratified draws: features, quotas by largest remainder, seeded order without random numbers."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S

REPRESENTATIVES, FRONTIER, SEEDS = 250, 250, (42, 123, 2026)


def seeded(key: Column, seed: int) -> Column:
    """A fixed order for each seed: Knuth's multiplicative hash of an integer key; other keys are hashed first."""
    return F.pmod(key.cast("decimal(38,0)") * F.lit(2654435761) + F.lit(seed), F.lit(4294967296)).cast("bigint")


def seeded_text(key: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(4294967296))


#: Stretches of the values' range in which quantiles are looked for; hash orders run below ORDER.
STRETCHES, ORDER = 256, 1 << 32


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float]:
    """Exact quantiles (between two values by straight line) of the column's values that aren't null; none without any.

    Values are counted, then counts summed by STRETCHES of the range; only the stretches that hold a wanted rank are put in
    order. So no task gets all values, and STRETCHES numbers reach the driver."""
    counts = df.select(F.col(column).cast("double").alias("v")).filter("v is not null and not isnan(v)").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("n")).first()
    if not whole.n:
        return []
    width = (whole.hi - whole.lo) / STRETCHES
    stretch = F.least(F.lit(STRETCHES - 1), F.floor((F.col("v") - whole.lo) / width).cast("int")) if width > 0 else F.lit(0)
    placed = counts.withColumn("stretch", stretch)
    before, total = {}, 0
    for r in placed.groupBy("stretch").agg(F.sum("n").alias("n")).orderBy("stretch").collect():
        before[r.stretch] = total
        total += r.n
    ranks = sorted({min(total - 1, int((total - 1) * q) + k) for q in shares for k in (0, 1)})
    wanted = {r: max(s for s, n in before.items() if n <= r) for r in ranks}
    running = F.sum("n").over(Window.partitionBy("stretch").orderBy("v"))
    ordered = placed.filter(F.col("stretch").isin(*set(wanted.values()))).withColumn("upto", running)
    least = [F.min(F.when((F.col("stretch") == s) & (F.col("upto") > r - before[s]), F.col("v"))).alias(f"r{r}") for r, s in wanted.items()]
    at = ordered.agg(*least).first().asDict()
    out = []
    for q in shares:
        place = (total - 1) * q
        low, high = at[f"r{int(place)}"], at[f"r{min(total - 1, int(place) + 1)}"]
        out.append(low + (high - low) * (place - int(place)))
    return out


def numbered_part(df: DataFrame, stratum: str, key: str, order: Column, shares: Sequence[float], out: str) -> DataFrame:
    """Adds the number (from 0) of the part that a row falls in when its stratum, in the order of (order, key), is cut at
    round(size * share) rows for each of the rising shares.

    The order is a hash below ORDER, so the cut at a share lies near that share of ORDER: rows below a band around it are
    counted, those in the band ranked, and all rows compared with the row at the cut. Where a band misses its cut (an
    order that isn't spread evenly), whole strata are ranked."""
    own = df.withColumn("_order", order)
    sizes = own.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    same = F.col(f"x.{stratum}").eqNullSafe(F.col(f"y.{stratum}"))
    cut = [F.round(F.col("_n") * s) for s in shares]
    room = [6 * F.sqrt(F.greatest(c, F.lit(0.0))) + 20 for c in cut]
    bands = {f"_k{i}": c.cast("bigint") for i, c in enumerate(cut)}
    bands |= {f"_lo{i}": F.greatest(F.lit(0.0), (c - r) / F.col("_n") * ORDER) for i, (c, r) in enumerate(zip(cut, room, strict=True))}
    bands |= {f"_hi{i}": (c + r) / F.col("_n") * ORDER for i, (c, r) in enumerate(zip(cut, room, strict=True))}
    dealt = own.alias("x").join(F.broadcast(sizes.withColumns(bands)).alias("y"), same).select("x.*", "_n", *bands)  # a row for each stratum
    numbers = range(len(shares))
    seen = dealt.groupBy(stratum).agg(*(F.count_if(F.col("_order") < F.col(f"_lo{i}")).alias(f"_below{i}") for i in numbers), *(F.count_if(F.col("_order") < F.col(f"_hi{i}")).alias(f"_upto{i}") for i in numbers), *(F.first(f"_k{i}").alias(f"_k{i}") for i in numbers))
    missed = functools.reduce(lambda a, b: a | b, (F.col(f"_below{i}") >= F.greatest(F.col(f"_k{i}"), F.lit(1)) for i in numbers)) | functools.reduce(lambda a, b: a | b, (F.col(f"_upto{i}") < F.col(f"_k{i}") for i in numbers))
    if seen.filter(missed).limit(1).count():
        by = Window.partitionBy(stratum)
        place, size = F.row_number().over(by.orderBy("_order", key)), F.count(F.lit(1)).over(by)
        return own.withColumn(out, sum(((place > F.round(size * s)).cast("int") for s in shares), F.lit(0))).select(*df.columns, out)
    near = None
    for i in numbers:
        band = dealt.filter((F.col("_order") >= F.col(f"_lo{i}")) & (F.col("_order") < F.col(f"_hi{i}"))).select(stratum, F.lit(i).alias("_i"), F.col(f"_k{i}").alias("_k"), "_order", key)
        near = band if near is None else near.unionByName(band)
    below = seen.select(stratum, F.posexplode(F.array(*(F.col(f"_below{i}") for i in numbers))).alias("_i", "_below"))
    ranked = near.withColumn("_place", F.row_number().over(Window.partitionBy(stratum, "_i").orderBy("_order", key))).alias("x").join(F.broadcast(below).alias("y"), same & (F.col("x._i") == F.col("y._i")))
    at = ranked.filter("_place = _k - _below").groupBy(F.col(f"x.{stratum}").alias(stratum)).agg(*(F.max(F.when(F.col("x._i") == i, F.struct(F.col("_order").alias("o"), F.col(key).alias("k")))).alias(f"_cut{i}") for i in numbers))
    cuts = sizes.select(stratum).alias("x").join(at.alias("y"), same, "left").select("x.*", *(f"_cut{i}" for i in numbers))
    row = F.struct(F.col("_order").alias("o"), F.col(key).alias("k"))
    passed = sum((F.when(F.col(f"_cut{i}").isNull() | (row > F.col(f"_cut{i}")), 1).otherwise(0) for i in numbers), F.lit(0))
    both = own.alias("x").join(F.broadcast(cuts).alias("y"), same).select("x.*", *(f"_cut{i}" for i in numbers))
    return both.withColumn(out, passed).select(*df.columns, out)


def quartile(df: DataFrame, column: str, out: str = "quartil_citacoes") -> DataFrame:
    """Adds the quartile 0 to 3 by exact quantile edges (right-closed, equal edges merged); all equal gives 0, null stays null."""
    edges = list(dict.fromkeys(quantiles(df, column, (0.0, 0.25, 0.5, 0.75, 1.0))))
    n = sum((F.when(F.col(column) > e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0)) if len(edges) > 2 else F.lit(0)
    return df.withColumn(out, F.when(F.col(column).isNotNull(), n).cast("tinyint"))


def first_of(df: DataFrame, stratum: str, quotas: DataFrame, key: str, order: Column) -> DataFrame:
    """Of each stratum the first rows by (order, key), as many as quotas (stratum, n, quota) says; quotas has a row for each stratum.

    The order is a hash below ORDER, so the first rows lie below quota / n of it, and a little more to be safe; only those
    are ranked, so a hot stratum isn't put in order by one task. Where too few lie there (an order that isn't spread
    evenly), all are ranked."""
    slack = 6 * F.sqrt(F.col("quota").cast("double")) + 20
    bounds = quotas.select(stratum, "quota", F.least(F.lit(float(ORDER)), (F.col("quota") + slack) / F.greatest(F.col("n"), F.lit(1)) * ORDER).alias("_bound"))
    same = F.col(f"x.{stratum}").eqNullSafe(F.col(f"y.{stratum}"))
    own = df.withColumn("_order", order).alias("x").join(F.broadcast(bounds).alias("y"), same).select("x.*", "quota", "_bound")
    near = own.filter(F.col("_order") < F.col("_bound"))
    found = near.groupBy(stratum).agg(F.count(F.lit(1)).alias("_found"))
    short = bounds.alias("x").join(found.alias("y"), same, "left").filter("coalesce(_found, 0) < quota").limit(1).count()
    ranked = (own if short else near).withColumn("_place", F.row_number().over(Window.partitionBy(stratum).orderBy("_order", key)))
    return ranked.filter("_place <= quota").select(*df.columns)


def features(df: DataFrame, score_columns: Sequence[str], year: str = "ano", language: str = "idioma_detectado", journal: str = "periodico_source_id", cited: str = "citacoes", cluster: str = "cluster_primario_llm") -> DataFrame:
    """Adds quartile, stratum keys of three grains, best score, gap, entropy and the frontier flag."""
    own = [F.col(c) for c in score_columns]
    out = quartile(df, cited)
    q = F.col("quartil_citacoes")
    return out.withColumns(
        {
            "estrato": S.stratum(F.col(year), F.col(language), F.col(journal), q, F.col(cluster)),
            "estrato_reduzido": S.stratum(F.col(cluster), q),
            "estrato_cluster": S.stratum(F.col(cluster)),
            "confianca_cluster": S.ordered(own)[0],
            "gap_top1_top2": S.gap(own),
            "entropia_llm": S.entropy_nats(own),
            "eh_fronteira": S.at_sampling_frontier(own),
        }
    )


def coverage(df: DataFrame, grains: Sequence[str] = ("estrato", "estrato_reduzido", "estrato_cluster")) -> DataFrame:
    """Rows (grain, coverage, strata): the share of rows in strata of two or more, and how many such strata there are."""
    out = None
    for grain in grains:
        own = df.groupBy(grain).agg(F.count(F.lit(1)).alias("n")).agg((F.sum(F.when(F.col("n") >= 2, F.col("n")).otherwise(0)) / F.sum("n")).alias("coverage"), F.count_if(F.col("n") >= 2).alias("strata"))
        own = own.select(F.lit(grain).alias("grain"), "coverage", "strata")
        out = own if out is None else out.unionByName(own)
    return out


def allocate(sizes: DataFrame, n: int, stratum: str) -> DataFrame:
    """Adds `quota`: n dealt in proportion to the column n of strata, by largest remainder (ties: larger stratum, then name).

    Works on one row for each stratum."""
    total = F.sum("n").over(Window.partitionBy())
    exact = F.lit(float(n)) * F.col("n") / total
    own = sizes.withColumns({"_exact": exact, "_floor": F.floor(exact).cast("bigint")})
    left = F.lit(n) - F.sum("_floor").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), F.desc("n"), F.asc(stratum)))
    return own.withColumn("quota", F.least(F.col("n"), F.col("_floor") + (rank <= left).cast("bigint"))).drop("_exact", "_floor")


def stratified(df: DataFrame, n: int, stratum: str, key: str, seed: int, order: Column | None = None) -> DataFrame:
    """Exactly n rows in proportion to the strata (all rows if there are no more)."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    quotas = allocate(sizes, n, stratum)
    quotas = quotas.withColumn("quota", F.when(F.sum("n").over(Window.partitionBy()) <= n, F.col("n")).otherwise(F.col("quota")))
    return first_of(df, stratum, quotas, key, seeded_text(F.col(key), seed) if order is None else order)


def representatives(df: DataFrame, n: int = REPRESENTATIVES, seed: int = 42, key: str = "id", order: Column | None = None) -> DataFrame:
    """n rows off the frontier, by the finest grain whose strata of two or more cover half of them: full key, then
    cluster and quartile, then cluster. Rows of single-row strata are left out."""
    rest = df.filter(~F.col("eh_fronteira"))
    shares = {r.grain: r.coverage or 0.0 for r in coverage(rest).collect()}
    grain = next((g for g in ("estrato", "estrato_reduzido") if shares[g] >= 0.5), "estrato_cluster")
    valid = rest.groupBy(grain).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").select(grain)
    return stratified(rest.join(F.broadcast(valid), grain, "left_semi"), n, grain, key, seed, order)


def frontier(df: DataFrame, n: int = FRONTIER, seed: int = 42, key: str = "id", order: Column | None = None) -> DataFrame:
    """The n frontier rows of highest entropy; equals in seeded order."""
    return df.filter("eh_fronteira").orderBy(F.desc("entropia_llm"), seeded_text(F.col(key), seed) if order is None else order, key).limit(n)


def draws(df: DataFrame, n_representatives: int = REPRESENTATIVES, n_frontier: int = FRONTIER, seeds: Sequence[int] = SEEDS, key: str = "id", order: Callable[[Column, int], Column] = seeded_text) -> DataFrame:
    """For each seed both samples, with columns semente and criterio."""
    out = None
    for seed in seeds:
        by = order(F.col(key), seed)
        for name, own in (("representativo", representatives(df, n_representatives, seed, key, by)), ("fronteira", frontier(df, n_frontier, seed, key, by))):
            own = own.withColumns({"semente": F.lit(seed), "criterio": F.lit(name)}).select(*df.columns, "semente", "criterio")
            out = own if out is None else out.unionByName(own)
    return out


def pilot(df: DataFrame, n: int, stratum: str, key: str, seed: int, order: Column | None = None) -> DataFrame:
    """In each stratum max(1, size * n / N rounded half to even) rows; of these the first n in seeded order."""
    own_order = seeded_text(F.col(key), seed) if order is None else order
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    quotas = sizes.select(stratum, "n", F.least(F.col("n"), F.greatest(F.lit(1), F.bround(F.col("n") * n / F.sum("n").over(Window.partitionBy()), 0))).cast("bigint").alias("quota"))
    return first_of(df, stratum, quotas, key, own_order).orderBy(own_order, key).limit(n)


def boost(pool: DataFrame, drawn: DataFrame, n: int, key: str, seed: int, order: Column | None = None) -> DataFrame:
    """n rows of another pool (all if there are no more), none of which is in the draw; an empty pool is an error."""
    if not pool.limit(1).count():
        raise ValueError("the boost pool is empty")
    rest = pool.join(drawn.select(key).distinct(), key, "left_anti").select(*pool.columns)
    return rest.orderBy(seeded_text(F.col(key), seed) if order is None else order, key).limit(n)


def scored_corpus(scores: DataFrame, corpus: DataFrame, key: str = "id") -> DataFrame:
    """Scores with the corpus' columns; an empty result is an error, since then the keys don't fit."""
    out = scores.join(corpus.select(key, *(c for c in corpus.columns if c not in scores.columns)), key)
    if not out.limit(1).count():
        raise ValueError(f"no {key} of the scores is in the corpus")
    return out


def split(df: DataFrame, stratum: str, key: str, seed: int, test: float = 0.15, validation: float = 0.15, order: Column | None = None) -> DataFrame:
    """Adds `part` (train, validation, test) by seeded order in each stratum; the validation share is of the whole.

    A stratum of one row can't be split: then the whole table is split without strata."""
    single = df.groupBy(stratum).count().filter("count < 2").limit(1).count()
    own_order = seeded_text(F.col(key), seed) if order is None else order
    if single:
        x = F.pmod(own_order, F.lit(10_000)) / 10_000
        return df.withColumn("part", F.when(x < test, "test").when(x < test + validation, "validation").otherwise("train"))
    names = F.array(*map(F.lit, ("test", "validation", "train")))
    return numbered_part(df, stratum, key, own_order, (test, test + validation), "_part").withColumn("part", F.get(names, F.col("_part"))).drop("_part")
