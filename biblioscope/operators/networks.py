"""Bibliographic networks: authors and articles, citations, and pairs that share a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def authorships(corpus: DataFrame, authors: str = "autores") -> DataFrame:
    """One row for each authorship with an author id: ordinal, first, last, corresponding, institutions and countries.

    `authors` is a list of structs (author, author_position, is_corresponding, institutions, countries); countries of the
    institutions go before those of the authorship. An author is first by position or by place, and likewise last."""
    own = corpus.select("id", "ano", F.size(authors).alias("_n"), F.posexplode(authors).alias("_i", "x"))
    own = own.filter(F.coalesce(F.col("x.author.id") != "", F.lit(False)))
    given = lambda c: F.filter(c, lambda v: v.isNotNull() & (v != ""))
    of_institutions = given(F.coalesce(F.transform("x.institutions", lambda i: i["country_code"]), F.array().cast("array<string>")))
    countries = F.when(F.size(of_institutions) > 0, of_institutions).otherwise(given(F.coalesce("x.countries", F.array().cast("array<string>"))))
    return own.select(
        F.col("id").alias("id_artigo"),
        F.col("x.author.id").alias("author_id"),
        F.coalesce("x.author.display_name", F.lit("")).alias("display_name"),
        (F.col("_i") + 1).alias("ordem_autoria"),
        (F.coalesce(F.col("x.author_position") == "first", F.lit(False)) | (F.col("_i") == 0)).alias("is_first"),
        (F.coalesce(F.col("x.author_position") == "last", F.lit(False)) | (F.col("_i") == F.col("_n") - 1)).alias("is_last"),
        F.coalesce("x.is_corresponding", F.lit(False)).alias("is_corresponding"),
        given(F.coalesce(F.transform("x.institutions", lambda i: i["id"]), F.array().cast("array<string>"))).alias("institution_ids"),
        countries.alias("country_codes"),
        "ano",
    )


def author_nodes(edges: DataFrame, home: str = "BR") -> DataFrame:
    """One row for each author of authorships(): articles, roles, first name seen that isn't empty, places, years."""
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))), ";")
    name = F.min_by("display_name", F.when(F.col("display_name") != "", F.struct("id_artigo", "ordem_autoria")))
    own = edges.groupBy("author_id").agg(
        F.count_distinct("id_artigo").alias("n_artigos"),
        F.sum(F.col("is_first").cast("int")).alias("n_primeiro"),
        F.sum(F.col("is_last").cast("int")).alias("n_ultimo"),
        F.sum(F.col("is_corresponding").cast("int")).alias("n_correspondente"),
        F.coalesce(name, F.lit("")).alias("display_name"),
        joined("institution_ids").alias("institution_ids"),
        joined("country_codes").alias("country_codes"),
        F.min("ano").alias("ano_min"),
        F.max("ano").alias("ano_max"),
    )
    places = F.split("country_codes", ";")
    return own.withColumns({"n_paises": F.size(F.filter(places, lambda p: p != "")), "tem_br": F.array_contains(places, home)})


def citation_edges(citing: DataFrame, corpus_ids: DataFrame, references: str = "referencias") -> DataFrame:
    """Rows (citing, cited, ano_citing, eh_interna); empty references are skipped."""
    own = citing.select(F.col("id").alias("citing"), F.col("ano").alias("ano_citing"), F.explode(references).alias("cited")).filter("cited != ''")
    return flag_internal(own, corpus_ids)


def flag_internal(edges: DataFrame, corpus_ids: DataFrame) -> DataFrame:
    """Adds eh_interna: whether the cited work is in the corpus."""
    ids = corpus_ids.select(F.col("id").alias("cited")).distinct().withColumn("_in", F.lit(True))
    return edges.join(ids, "cited", "left").withColumn("eh_interna", F.coalesce("_in", F.lit(False))).drop("_in")


def citation_stats(edges: DataFrame) -> DataFrame:
    """One row: works citing and cited, internal citations, references to each citing work (mean and median)."""
    per = edges.groupBy("citing").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("eh_interna").cast("int")).alias("i"))
    one = per.agg(F.count(F.lit(1)).alias("n_citing"), F.sum("i").alias("n_internal"), F.avg("n").alias("mean_refs"), F.median("n").alias("median_refs"), F.sum("n").alias("n_edges"))
    return one.crossJoin(edges.agg(F.count_distinct("cited").alias("n_cited")))  # one row each


def pairs(df: DataFrame, group: str, member: str, least: int = 1) -> DataFrame:
    """Rows (a, b, weight), a < b: distinct groups that two members share, at least `least` of them.

    Members of fewer than `least` groups can't be in such a pair and go first, then groups left with one member. The two
    sides join on the group, so AQE splits groups that are hot; the count is combined before it is shuffled."""
    own = df.select(F.col(group).alias("g"), F.col(member).alias("m")).filter("g is not null and m is not null").distinct()
    if least > 1:
        often = own.groupBy("m").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("m")
        own = own.join(often, "m", "left_semi")
    both = own.alias("x").join(own.alias("y"), F.expr("x.g = y.g and x.m < y.m"))
    found = both.groupBy(F.col("x.m").alias("a"), F.col("y.m").alias("b")).agg(F.count(F.lit(1)).alias("weight"))
    return found.filter(F.col("weight") >= least) if least > 1 else found


def coauthorship(edges: DataFrame, article: str = "id_artigo", author: str = "author_id") -> DataFrame:
    return pairs(edges, article, author)


def cocitation(edges: DataFrame, least: int = 3) -> DataFrame:
    """Works cited together by `least` works or more."""
    return pairs(edges, "citing", "cited", least)


def coupling(edges: DataFrame, least: int = 5) -> DataFrame:
    """Works that share `least` references or more."""
    return pairs(edges, "cited", "citing", least)


def ordered(edges: DataFrame) -> DataFrame:
    return edges.orderBy(F.desc("weight"), "a", "b")


def top(df: DataFrame, column: str, n: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(column), *ties).limit(n)


def count_by(df: DataFrame, column: str | Column) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def with_metadata(metrics: DataFrame, metadata: DataFrame, key: str = "node") -> DataFrame:
    return metrics.join(metadata, key, "left")
