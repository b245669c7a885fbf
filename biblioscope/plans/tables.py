"""The driver's tables, seen as the tables of a bibliographic corpus; the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import CLUSTERS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as works: the title is the first line, citations the number of characters."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("abstract"), F.col("lang").alias("idioma"), F.col("source").alias("journal"), F.col("n_chars").alias("citacoes"), (F.lit(2000) + F.col("doc_id") % 25).cast("int").alias("ano"), F.split("text", "\n")[0].alias("titulo"))


CORPUS = """corpus AS (SELECT doc_id AS id, text AS abstract, lang AS idioma, source AS journal, n_chars AS citacoes,
  CAST(2000 + doc_id % 25 AS INTEGER) AS ano, split_part(text, chr(10), 1) AS titulo FROM documents)"""


#: A normalised title in SQL, of the column or expression t.
NORMAL = r"trim(regexp_replace(regexp_replace(lower(nfc_normalize({t})), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
#: DuckDB compares bytes; normalised titles have no capitals and no marks, so these stand in one to one for letters of two bytes.
ONE_BYTE = "translate({t}, 'ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&*')"


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited"))


def pair_sql(group: str, member: str, least: int = 1, source: str = "lineitem") -> str:
    return f"""SELECT x.m AS a, y.m AS b, count(*) AS weight FROM (SELECT DISTINCT {group} AS g, {member} AS m FROM {source}) x
  JOIN (SELECT DISTINCT {group} AS g, {member} AS m FROM {source}) y ON x.g = y.g AND x.m < y.m GROUP BY 1, 2 HAVING count(*) >= {least}"""


#: Raw scores of six clusters, some negative, by arithmetic on the id.
RAW = tuple(f"(((id * {i + 3}) % 11) - 1) / 10.0" for i in range(6))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with raw scores raw_0 .. raw_5."""
    return corpus(spark, sf_dir).withColumns({f"raw_{i}": F.expr(f"cast((((id * {i + 3}) % 11) - 1) as double) / 10.0D") for i in range(6)})


def _total() -> str:
    return " + ".join(f"greatest(CAST((((id * {i + 3}) % 11) - 1) AS DOUBLE) / 10.0, 0.0)" for i in range(6))


SCORED = f"""{CORPUS}, raw AS (SELECT *, {", ".join(f"greatest(CAST((((id * {i + 3}) % 11) - 1) AS DOUBLE) / 10.0, CAST(0 AS DOUBLE)) AS r{i}" for i in range(6))} FROM corpus),
total AS (SELECT *, r0 + r1 + r2 + r3 + r4 + r5 AS t FROM raw),
scored AS (SELECT *, {", ".join(f"CASE WHEN t <= 0 THEN CAST(1.0 AS DOUBLE) / 6 ELSE r{i} / t END AS s{i}" for i in range(6))} FROM total),
ranked AS (SELECT *, list_reverse_sort([s0, s1, s2, s3, s4, s5]) AS o, CASE list_position([s0, s1, s2, s3, s4, s5], list_max([s0, s1, s2, s3, s4, s5])) {" ".join(f"WHEN {i + 1} THEN '{c}'" for i, c in enumerate(CLUSTERS))} END AS best FROM scored)"""
