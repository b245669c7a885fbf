"""The corpus pipeline: toxicity, near-duplicates, decontamination, personal data, packing; each stage works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biblioscope.llm import decontaminate, near_dedup, packing, pii, toxicity
from biblioscope.llm.common import small_batches, table
from biblioscope.storage import passing, stored


def _beside(docs: DataFrame, name: str, operator: Callable[[DataFrame], DataFrame], condition: Column) -> DataFrame:
    """Rows of docs for which the operator's column `name` meets the condition; a column of docs that has this name stays as it is."""
    own = docs.withColumnRenamed(name, f"_own_{name}") if name in docs.columns else docs
    kept = operator(own).filter(condition).drop(name)
    return kept.withColumnRenamed(f"_own_{name}", name).select(*docs.columns)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; the score learns from documents and labels of sf_dir."""
    small_batches(spark)
    model = toxicity.model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return _beside(docs, "score", lambda own: toxicity.apply(own, model), F.col("score") < toxicity.THRESHOLD)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8), the one with the smallest id.

    Of rows that share an id one stays; rows with a null id all stay."""
    small_batches(spark)
    kept = near_dedup.near_duplicates(docs, k=5, percent=80).filter("kept and doc_id is not null").select("doc_id").distinct()
    some = docs.join(kept, "doc_id", "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(*(F.col(c) for c in docs.columns if c != "doc_id"))))
    return some.withColumn("_nth", nth).filter("_nth = 1").select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    small_batches(spark)
    return _beside(docs, "matches", lambda own: decontaminate.annotate(own, table(spark, sf_dir, "benchmark")), F.size("matches") == 0)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; n_chars follows the new text."""
    small_batches(spark)
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of 2048 tokens: a row for each piece."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path(packing.MODEL))


STAGES = [
    ("toxicity", keep_clean),
    ("near_dedup", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: The stages aren't expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each returns is written to the shared folder and read again. Tables that a
    stage needed on its way go once its result is written, and the results of all but the last written stage at the end."""
    docs = table(spark, sf_dir, "documents")
    with passing(spark):
        for name, stage in STAGES[:-1]:
            with passing(spark):
                docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
