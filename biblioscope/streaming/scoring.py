"""Scoring as a stream: new files are scored once, by prompt version, and survive restarts by the stream's checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..storage import exists


def score_stream(source: DataFrame, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, version: str, key: str = "id") -> StreamingQuery:
    """Appends score(batch) to sink, partitioned by prompt version; what the sink has for this version is not scored again.

    Each batch takes all files that are new and then stops (availableNow). A batch repeated after a failure finds its rows
    in the sink and adds none twice."""
    spark = source.sparkSession

    def batch(df: DataFrame, _: int) -> None:
        own = df.dropDuplicates([key])
        if exists(spark, sink):
            done = spark.read.parquet(sink).filter(F.col("prompt_version") == version).select(key)
            own = own.join(done, key, "left_anti")
        score(own).withColumn("prompt_version", F.lit(version)).write.mode("append").partitionBy("prompt_version").parquet(sink)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resumed(pending: DataFrame, done: DataFrame | None, version: str, key: str = "id") -> DataFrame:
    """Rows without a score of this prompt version; scores of other versions don't count."""
    if done is None:
        return pending
    return pending.join(done.filter(F.col("prompt_version") == version).select(key).distinct(), key, "left_anti")
