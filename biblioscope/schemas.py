"""Table schemas, and checks of tables against them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

AUTHORSHIPS = "array<struct<author: struct<id: string, display_name: string>, author_position: string, is_corresponding: boolean, institutions: array<struct<id: string, country_code: string>>, countries: array<string>>>"
_KINDS = {"string": StringType(), "int": IntegerType(), "double": DoubleType(), "boolean": BooleanType()}


def flat(columns: str) -> StructType:
    """A schema of plain columns, "name type, ..."; no session is needed."""
    return StructType([StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in columns.split(","))])


CORPUS_RAW = flat(
    "id string, doi string, titulo string, abstract_raw string, abstract string, ano int, data_publicacao string, periodico_nome string, periodico_source_id string, "
    "periodico_issn_l string, idioma string, citacoes int, tipo_obra string, is_retracted boolean, autores string, referencias string, concepts string, data_coleta string"
)
_VALUE = StructType([StructField("choices", ArrayType(StringType())), StructField("text", ArrayType(StringType()))])
_RESULT = StructType([StructField("from_name", StringType()), StructField("value", _VALUE)])
_ANNOTATION = StructType([StructField("completed_by", flat("email string")), StructField("result", ArrayType(_RESULT))])
ANNOTATION_EXPORT = StructType([StructField("id", LongType()), StructField("data", flat("id string")), StructField("annotations", ArrayType(_ANNOTATION))])
RATINGS = flat("item string, rater string, category string")
EDGES = flat("a string, b string, weight double")
LEXICON = flat("cluster string, lemma string")


def mismatches(df: DataFrame, schema: StructType) -> list[str]:
    """Columns of the schema that df lacks or has with another type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    out = [f"missing column {f.name}" for f in schema.fields if f.name not in have]
    return out + [f"column {f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in schema.fields if f.name in have and have[f.name] != f.dataType]


def assert_schema(df: DataFrame, schema: StructType) -> DataFrame:
    if found := mismatches(df, schema):
        raise ValueError("; ".join(found))
    return df


def available(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that df has, in the order wanted."""
    return df.select(*(c for c in wanted if c in df.columns))


def output_report(df: DataFrame, required: Sequence[str], n_input: int | None = None, probabilities: Sequence[str] = (), tolerance: float = 1e-4) -> DataFrame:
    """One row: rows, missing columns, columns that are all null, whether the count is suspicious, rows whose probabilities
    don't sum to 1 and the largest deviation. One aggregate pass."""
    present = [c for c in required if c in df.columns]
    own = [c for c in probabilities if c in df.columns]
    off = F.abs(sum((F.coalesce(F.col(c), F.lit(0.0)) for c in own), F.lit(0.0)) - 1)
    rows = F.count(F.lit(1))
    empty = F.array_compact(F.array(*(F.when((F.count(c) == 0) & (rows > 0), F.lit(c)) for c in present), F.lit(None).cast("string")))
    bad = F.count_if(off > tolerance) if own else F.lit(0).cast("bigint")
    most = F.max(off) if own else F.lit(None).cast("double")
    limit = F.lit(n_input).cast("bigint")
    return df.agg(rows.alias("n_rows"), F.array_join(empty, ";").alias("all_null"), bad.alias("n_bad_sums"), most.alias("largest_deviation")).select(
        "n_rows",
        F.lit(";".join(sorted((set(required) | set(probabilities)) - set(df.columns)))).alias("missing"),
        "all_null",
        ((limit > 0) & (F.col("n_rows") == 0)).alias("is_empty"),
        (F.col("n_rows") > 2 * limit).alias("is_inflated"),
        "n_bad_sums",
        "largest_deviation",
    )


def validate_output(df: DataFrame, required: Sequence[str], **more) -> Mapping[str, object]:
    """The report as a mapping; missing columns or an unexpectedly empty table are errors."""
    report = output_report(df, required, **more).first().asDict()
    if report["missing"] or report["is_empty"]:
        raise ValueError(f"output is invalid: {report}")
    return report
