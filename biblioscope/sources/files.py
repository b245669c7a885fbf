"""Files: tables in any of the usual formats, source lists, annotation tasks, embeddings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import ANNOTATION_EXPORT, assert_schema
from ..storage import exists


def read_any(spark: SparkSession, base: str, schema: StructType | None = None) -> DataFrame:
    """base.parquet if it is there, else base.csv (with the schema)."""
    if exists(spark, f"{base}.parquet"):
        return spark.read.parquet(f"{base}.parquet")
    if exists(spark, f"{base}.csv"):
        return read_csv(spark, f"{base}.csv", schema)
    raise FileNotFoundError(f"neither {base}.parquet nor {base}.csv")


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV file with a header; without a schema all columns are strings."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, base: str, kind: str = "parquet") -> str:
    """Writes base.parquet (snappy) or base.csv (header), replacing what is there; the job commits as a whole."""
    path = f"{base}.{kind}"
    if kind == "csv":
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        df.write.mode("overwrite").option("compression", "snappy").parquet(path)
    return path


def write_report(df: DataFrame, path: str) -> None:
    """A report table as JSON lines, nulls included."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids, one for each line; blank lines and lines that begin with # don't count."""
    return spark.read.text(path).select(F.trim("value").alias("id")).filter("id != '' and not id like '#%'")


def annotation_tasks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One JSON string `task` for each row, {"data": {...}}, missing values as null."""
    own = F.struct(F.struct(*(F.col(c) for c in columns if c in df.columns)).alias("data"))
    return df.select(F.to_json(own, {"ignoreNullFields": "false"}).alias("task"))


def write_annotation_tasks(df: DataFrame, columns: Sequence[str], path: str) -> None:
    annotation_tasks(df, columns).write.mode("overwrite").text(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """An annotation export: a JSON list of tasks, or one task a line."""
    return spark.read.option("multiLine", True).schema(ANNOTATION_EXPORT).json(path)


def read_matrix(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """Rows (doc_id, embedding) of a .npy matrix whose rows follow ids.doc_id in order; the file is read by the driver,
    piece by piece, so it must fit its disk but not its memory."""
    own = np.load(path, mmap_mode="r")
    names = [r.doc_id for r in ids.select("doc_id").collect()]
    if len(names) != len(own):
        raise ValueError(f"{len(own)} vectors for {len(names)} ids")
    return spark.createDataFrame([(n, v.astype(float).tolist()) for n, v in zip(names, own, strict=True)], "doc_id string, embedding array<double>")


def write_matrix(df: DataFrame, path: str, order: str = "doc_id", vector: str = "embedding") -> tuple[int, int]:
    """The vectors as a .npy matrix of float32, rows by `order`; they stream through the driver, one partition at a time. Returns its shape."""
    n = df.count()
    wide = len(df.select(vector).first()[0]) if n else 0
    out = np.lib.format.open_memmap(path, mode="w+", dtype=np.float32, shape=(n, wide)) if n else None
    if out is None:
        np.save(path, np.zeros((0, 0), np.float32))
        return 0, 0
    for k, row in enumerate(df.select(order, vector).orderBy(order).toLocalIterator()):
        out[k] = row[1]
    out.flush()
    return n, wide


def write_checked(df: DataFrame, path: str, schema: str) -> DataFrame:
    """Writes df as Parquet after its columns and types are held against the schema; other or missing ones are an error. Returns the table as read."""
    want = StructType.fromDDL(schema)
    assert_schema(df, want)
    if more := [c for c in df.columns if c not in want.fieldNames()]:
        raise ValueError(f"columns beyond the schema: {', '.join(more)}")
    df.select(*want.fieldNames()).write.mode("overwrite").option("compression", "snappy").parquet(path)
    return df.sparkSession.read.schema(want).parquet(path)


def appended(df: DataFrame, path: str) -> None:
    """Adds rows to a table; rows already there stay."""
    df.write.mode("append").parquet(path)
