"""Annotation exports flattened, votes consolidated, gold rows assembled."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S

FIELDS = ("cluster_primario", *S.FLAGS)


def _field(name: str) -> Column:
    """The first result item of the name that has a value: its first choice, else its first text."""
    own = F.transform(F.filter("result", lambda r: r["from_name"] == name), lambda r: F.coalesce(F.get(r["value"]["choices"], F.lit(0)), F.get(r["value"]["text"], F.lit(0))))
    return F.get(F.filter(own, lambda v: v.isNotNull()), F.lit(0))


def flatten(tasks: DataFrame) -> DataFrame:
    """One row for each annotation with results, of tasks (id, data.id, annotations)."""
    own = tasks.select(F.coalesce(F.nullif(F.col("data.id"), F.lit("")), F.col("id").cast("string")).alias("id_artigo"), F.posexplode("annotations").alias("_pos", "_a"))
    own = own.select("id_artigo", "_pos", F.coalesce("_a.completed_by.email", F.lit("desconhecido")).alias("anotador"), F.col("_a.result").alias("result")).filter(F.size("result") > 0)
    truthy = lambda c: F.coalesce(F.trim(c).isin("1", "True", "true", "sim"), F.lit(False)).cast("int")
    second = _field("cluster_secundario")
    return own.select(
        "id_artigo",
        "_pos",
        "anotador",
        _field("cluster_primario").alias("cluster_primario"),
        F.when(second != "nenhum", second).alias("cluster_secundario"),
        F.coalesce(_field("cluster_status"), F.lit("classificado")).alias("cluster_status"),
        F.coalesce(_field("cluster_confianca"), F.lit("media")).alias("cluster_confianca"),
        *(truthy(_field(f)).alias(f) for f in S.FLAGS),
        F.coalesce(_field("epi_confianca"), F.lit("media")).alias("epi_confianca"),
        _field("notas").alias("notas"),
    )


def majority(votes: DataFrame, item: str, value: str, order: str, keep_null: bool = True) -> DataFrame:
    """Rows (item, label, agreement, n_votes): unanimous; 2_de_3 for any strict majority; disputa_pendente without a label;
    sem_dados without votes. Null votes count in the number of votes (unless keep_null is false) but can't win; equals go
    to the first seen. Counted in two steps, so a hot item shrinks before it moves."""
    own = votes if keep_null else votes.filter(F.col(value).isNotNull())
    counts = own.groupBy(item, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = F.max(F.when(F.col(value).isNotNull(), F.struct(F.col("n"), (-F.col("first").cast("bigint")).alias("f"), F.col(value).alias("v"))))
    one = counts.groupBy(item).agg(best.alias("b"), F.sum("n").alias("n_votes"))
    agreement = F.when(F.col("b").isNull(), "sem_dados").when(F.col("b.n") == F.col("n_votes"), "unanime").when(2 * F.col("b.n") > F.col("n_votes"), "2_de_3").otherwise("disputa_pendente")
    return one.withColumn("agreement", agreement).select(item, F.when(F.col("agreement").isin("unanime", "2_de_3"), F.col("b.v")).alias("label"), "agreement", "n_votes")


def mode(votes: DataFrame, item: str, value: str, order: str, default: str) -> DataFrame:
    """The commonest value that isn't null, the first seen of equals."""
    counts = votes.groupBy(item, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = F.max(F.when(F.col(value).isNotNull(), F.struct("n", (-F.col("first").cast("bigint")).alias("f"), F.col(value).alias("v"))))
    return counts.groupBy(item).agg(F.coalesce(best["v"], F.lit(default)).alias(value))


def gold(annotations: DataFrame) -> DataFrame:
    """One row for each article: resolved labels with their agreement, orientation, tags, annotators and the dispute flag.

    An empty table gives an empty one."""
    item, order = "id_artigo", "_pos"
    out = annotations.groupBy(item).agg(F.array_join(F.array_sort(F.collect_set("anotador")), ";").alias("anotadores"), F.count(F.lit(1)).cast("int").alias("n_anotadores"))
    for f in FIELDS:
        own = majority(annotations, item, f, order).select(item, F.col("label").alias(f), F.col("agreement").alias(f"concordancia_{f}"))
        out = out.join(own, item)
    out = out.withColumn("concordancia_cluster_primario", F.when((F.col("concordancia_cluster_primario") == "unanime") & (F.col("n_anotadores") < 2), "anotacao_unica").otherwise(F.col("concordancia_cluster_primario")))
    out = out.withColumns({f: F.coalesce(F.col(f), F.lit(0)) for f in S.FLAGS})
    second = majority(annotations, item, "cluster_secundario", order, keep_null=False).select(item, F.col("label").alias("cluster_secundario"))
    out = out.join(second, item, "left")
    for c, default in (("cluster_confianca", "media"), ("epi_confianca", "media"), ("cluster_status", "classificado")):
        out = out.join(mode(annotations, item, c, order, default), item, "left")
    tags = annotations.filter(F.col(S.FLAGS[2]) == 1).withColumn("tag", S.doctrine_tag(F.col("notas"))).filter("tag is not null")
    tag = mode(tags, item, "tag", order, "").withColumnRenamed("tag", "dn_subtag")
    out = out.join(tag, item, "left").withColumn("dn_subtag", F.when(F.col(S.FLAGS[2]) == 1, F.col("dn_subtag")))
    disputed = F.exists(F.array(*(F.col(f"concordancia_{f}") for f in FIELDS)), lambda c: c == "disputa_pendente")
    return S.derive(out.withColumn("em_disputa", disputed))


def gold_report(annotations: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row: status (ok, or sem_anotacoes for an export without any), annotations, annotators, articles, disputed ones, and
    whether the gate can be open at all."""
    one = annotations.agg(F.count(F.lit(1)).alias("n_anotacoes"), F.count_distinct("anotador").alias("n_anotadores_unicos"))
    two = resolved.agg(F.count(F.lit(1)).alias("n_artigos"), F.count_if("em_disputa").alias("n_disputas"))
    status = F.when(F.col("n_anotacoes") > 0, "ok").otherwise("sem_anotacoes")
    return one.crossJoin(two).select(status.alias("status"), "*", (F.col("n_anotadores_unicos") > 1).alias("gate_possivel"))  # one row each


def disputes(annotations: DataFrame, resolved: DataFrame) -> DataFrame:
    """Disputed articles with each field's votes in order, joined by |."""
    votes = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce(F.col(f).cast("string"), F.lit("")).alias("v")))), lambda x: x["v"]), "|").alias(f"votos_{f}") for f in FIELDS]
    return annotations.join(resolved.filter("em_disputa").select("id_artigo"), "id_artigo", "left_semi").groupBy("id_artigo").agg(*votes)


def usable(resolved: DataFrame, label: str | None = "cluster_primario") -> DataFrame:
    """Gold rows fit for training: classified, undisputed, labelled."""
    out = resolved.filter((F.col("cluster_status") == "classificado") & (F.col("concordancia_cluster_primario") != "disputa_pendente"))
    return out.filter(F.col(label).isNotNull()) if label else out


def with_texts(resolved: DataFrame, corpus: DataFrame, key: str = "id_artigo", corpus_key: str = "id") -> DataFrame:
    """Gold rows with the corpus' columns; columns of both are the corpus'."""
    mine = [c for c in resolved.columns if c == key or c not in corpus.columns]
    return resolved.select(*mine).join(corpus, F.col(key) == F.col(corpus_key).cast("string"))


def with_metadata(resolved: DataFrame, metadata: DataFrame, key: str = "id_artigo", metadata_key: str = "id") -> DataFrame:
    """All gold rows, with the metadata of those that have some."""
    mine = [c for c in resolved.columns if c == key or c not in metadata.columns]
    return resolved.select(*mine).join(metadata, F.col(key) == F.col(metadata_key).cast("string"), "left")


def prepass_summary(df: DataFrame, scores: Sequence[str] = tuple(f"score_{f.removeprefix('epi_')}" for f in S.FLAGS)) -> DataFrame:
    """One row of a model's first pass: rows, those with the doctrine score (the last) at 0.5 or more, mixed orientation,
    inconclusive, and all scores below 0.5 (missing ones count as 0), each with its percentage."""
    n = F.count(F.lit(1))
    high = {c: F.coalesce(F.col(c), F.lit(0.0)) >= 0.5 for c in scores}
    none = functools.reduce(lambda x, y: x & y, (~c for c in high.values()))
    counts = {"dn": F.count_if(high[scores[-1]]), "mixed": F.count_if(F.col("orientacao_proeminente") == "mixed"), "inconclusiva": F.count_if(F.col("inconclusiva") == 1), "all_zero": F.count_if(none)}
    return df.agg(n.alias("n"), *(c.alias(f"n_{k}") for k, c in counts.items()), *(F.round(100 * F.try_divide(c, n), 2).alias(f"pct_{k}") for k, c in counts.items()))


def subtags(df: DataFrame, notes: str = "notas") -> DataFrame:
    """Rows (subtag, n): the doctrine tags of rows that carry the doctrine flag, 'none' for those without."""
    own = df.filter(F.col(S.FLAGS[2]) == 1).select(F.coalesce(S.doctrine_tag(F.col(notes)), F.lit("none")).alias("subtag"))
    return own.groupBy("subtag").agg(F.count(F.lit(1)).alias("n"))


def disagreements(ratings: DataFrame, item: str, rater: str, flag: str) -> DataFrame:
    """Items that two raters label differently: (item, first, second) by rater name."""
    own = ratings.groupBy(item).agg(F.min(F.struct(rater, flag)).alias("x"), F.max(F.struct(rater, flag)).alias("y"), F.count(F.lit(1)).alias("n"))
    return own.filter((F.col("n") == 2) & (F.col(f"x.{flag}") != F.col(f"y.{flag}"))).select(item, F.col(f"x.{flag}").alias("first"), F.col(f"y.{flag}").alias("second"))


def patterns(df: DataFrame) -> DataFrame:
    """Rows (configuracao, n, pct) over the flags' combinations."""
    own = S.derive(df).groupBy("configuracao").agg(F.count(F.lit(1)).alias("n"))
    return own.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))  # eight rows at most
