"""Record normalisation, the filter waterfall, exact identifiers and retraction flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import AUTHORSHIPS

#: What a corpus keeps.
KINDS, YEARS, LANGUAGES = ("article", "review"), (2000, 2024), ("en", "pt")


def records(works: DataFrame, collected: str) -> DataFrame:
    """Nested API works (struct columns id, doi, title, abstract_inverted_index, ...) as flat rows with defaults."""
    get = lambda c: F.col(c)
    source = "primary_location.source"
    return works.select(
        F.regexp_replace(get("id"), "^https://[^/]+/", "").alias("id"),
        F.coalesce(get("doi"), F.lit("")).alias("doi"),
        F.coalesce(get("title"), F.lit("")).alias("titulo"),
        F.to_json("abstract_inverted_index").alias("abstract_raw"),
        F.coalesce(T.rebuild_abstract(get("abstract_inverted_index")), F.lit("")).alias("abstract"),
        get("publication_year").cast("int").alias("ano"),
        F.coalesce(get("publication_date"), F.lit("")).alias("data_publicacao"),
        F.coalesce(get(f"{source}.display_name"), F.lit("")).alias("periodico_nome"),
        F.regexp_replace(get(f"{source}.id"), "^https://[^/]+/", "").alias("periodico_source_id"),
        get(f"{source}.issn_l").alias("periodico_issn_l"),
        get("language").alias("idioma"),
        F.coalesce(get("cited_by_count"), F.lit(0)).cast("int").alias("citacoes"),
        F.coalesce(get("type"), F.lit("")).alias("tipo_obra"),
        F.coalesce(get("is_retracted"), F.lit(False)).alias("is_retracted"),
        F.to_json("authorships").alias("autores"),
        F.to_json("referenced_works").alias("referencias"),
        F.to_json("concepts").alias("concepts"),
        F.lit(collected).alias("data_coleta"),
    )


def steps(kind: Column, year: Column, language: Column, text: Column, kinds: Sequence[str] = KINDS, years: tuple[int, int] = YEARS, languages: Sequence[str] = LANGUAGES) -> list[tuple[str, Column]]:
    """The waterfall's predicates in order: type, year (numbers alone), language (null passes), text not blank."""
    true = lambda c: F.coalesce(c, F.lit(False))
    return [
        ("type", true(kind.isin(*kinds))),
        ("year", true(year.try_cast("int").between(*years))),
        ("language", true(language.isin(*languages)) | language.isNull()),
        ("text", true(F.trim(text) != "")),
    ]


def keep(df: DataFrame, predicates: Sequence[tuple[str, Column]]) -> DataFrame:
    for _, p in predicates:
        df = df.filter(p)
    return df


def waterfall(df: DataFrame, predicates: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows (step, removed, pct): how many rows each step takes out first, and how many stay; one pass."""
    first = F.lit("kept")
    for name, p in reversed(predicates):
        first = F.when(~p, name).otherwise(first)
    counts = df.select(first.alias("step")).groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over one row for each step
    return counts.select("step", "n", F.round(100 * F.col("n") / total, 2).alias("pct"))


def typed(df: DataFrame) -> DataFrame:
    """Year and citations as nullable ints (missing is not 0), retraction as a boolean that is never null."""
    return df.withColumns({"ano": F.col("ano").try_cast("int"), "citacoes": F.col("citacoes").try_cast("int"), "is_retracted": F.coalesce("is_retracted", F.lit(False))})


def check_years(df: DataFrame, years: tuple[int, int] = YEARS) -> DataFrame:
    """df, with an error at run time where a year is out of range."""
    ok = F.col("ano").between(*years)
    return df.withColumn("ano", F.when(F.coalesce(ok, F.lit(False)), F.col("ano")).otherwise(F.raise_error(F.lit("a year is out of range")).cast("int")))


def json_list(column: Column, schema: str = AUTHORSHIPS) -> Column:
    """A JSON string as a list; invalid or missing gives an empty list. Elements must be clean, see json_elements()."""
    return F.coalesce(F.from_json(column, schema), F.array().cast(schema))


def json_elements(df: DataFrame, column: str, path: str) -> DataFrame:
    """df exploded to `pos` and `value`, the elements of a JSON list whose path is a string; others are skipped one by one."""
    value = F.try_variant_get("v", path, "string")
    kind = F.schema_of_variant(F.try_variant_get("v", path, "variant"))
    own = df.withColumn("_list", F.coalesce(F.try_variant_get(F.try_parse_json(column), "$", "array<variant>"), F.array().cast("array<variant>")))
    return own.select("*", F.posexplode("_list").alias("pos", "v")).filter(kind == "STRING").select(*df.columns, "pos", value.alias("value"))


def keep_most_cited(df: DataFrame, key: str = "doi", cited: str = "citacoes", tie: str = "id") -> DataFrame:
    """One row for each normalised identifier, the most cited (ties: smallest id); rows without an identifier all stay."""
    norm = T.normalise_doi(F.col(key))
    has = F.coalesce(norm != "", F.lit(False))
    rank = F.row_number().over(Window.partitionBy("_key").orderBy(F.desc_nulls_last(cited), F.asc(tie)))
    with_key = df.filter(has).withColumn("_key", norm).withColumn("_rank", rank).filter("_rank = 1").drop("_key", "_rank")
    return with_key.unionByName(df.filter(~has))


def flag_retractions(df: DataFrame, notices: DataFrame | None = None, patterns: Sequence[str] = T.RETRACTION_MARKS, title: str = "titulo") -> DataFrame:
    """Adds flag_retratado and motivo_retracao: by the record's field, by marks in the title, by a list of identifiers."""
    by_field = F.coalesce("is_retracted", F.lit(False))
    by_title = T.marks(F.col(title), patterns)
    by_list = F.lit(False)
    if notices is not None:
        listed = notices.select(T.normalise_doi(F.col("doi")).alias("_doi")).filter("_doi is not null").distinct().withColumn("_listed", F.lit(True))
        df = df.withColumn("_doi", T.normalise_doi(F.col("doi"))).join(listed, "_doi", "left")
        by_list = F.coalesce("_listed", F.lit(False))
    reason = F.concat_ws(";", F.when(by_field, "openalex"), F.when(by_title, "keyword"), F.when(by_list, "retraction_watch"))
    return df.withColumns({"flag_retratado": by_field | by_title | by_list, "motivo_retracao": reason}).drop("_doi", "_listed")


def retraction_report(flagged: DataFrame) -> DataFrame:
    """One row: totals, percentage and counts by method."""
    has = lambda m: F.array_contains(F.split("motivo_retracao", ";"), m)
    n = F.count(F.lit(1))
    return flagged.agg(
        n.alias("n_total"),
        F.count_if("flag_retratado").alias("n_flagged"),
        F.round(100 * F.count_if("flag_retratado") / F.greatest(n, F.lit(1)), 3).alias("pct_flagged"),
        F.count_if(has("openalex")).alias("n_field"),
        F.count_if(has("keyword")).alias("n_keyword"),
        F.count_if(has("retraction_watch")).alias("n_listed"),
        F.count_if(F.col("motivo_retracao") == "keyword").alias("n_keyword_only"),
    )


def retraction_sample(flagged: DataFrame, n: int = 20, key: str = "id") -> DataFrame:
    """The first n flagged rows by key, for the report."""
    return flagged.filter("flag_retratado").orderBy(key).limit(n)


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    """The column's distinct values that aren't null, in order."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def bind_rows(*tables: DataFrame) -> DataFrame:
    """Tables of different columns one under the other; a column that a table lacks is null in its rows."""
    out = tables[0]
    for own in tables[1:]:
        out = out.unionByName(own, allowMissingColumns=True)
    return out


def detect_languages(df: DataFrame, text: str, declared: str, least: int = 21) -> DataFrame:
    """Adds idioma_detectado and idioma_confianca. A declared language stays, with confidence 1. Where none is declared, texts
    of `least` characters or more get the language of most function words (confidence 1), or null if that can't be told."""
    found = F.when(F.length(text) >= least, T.language_by_words(F.col(text)))
    value = F.coalesce(F.col(declared), found)
    return df.withColumns({"idioma_detectado": value, "idioma_confianca": F.when(value.isNotNull(), F.lit(1.0))})


def language_cell(df: DataFrame, language: str | None, column: str = "idioma_detectado") -> DataFrame:
    """Rows of one language cell ('pt' or 'en', whatever the case); None or another name keeps all."""
    return df.filter(F.lower(F.coalesce(F.col(column), F.lit(""))) == language) if language in ("pt", "en") else df


def split_suspects(df: DataFrame, title: str, abstract: str, patterns: Sequence[str] = T.INJECTION_MARKS) -> tuple[DataFrame, DataFrame]:
    """(clean rows, suspects with their reason)."""
    marked = df.withColumn("motivo", T.injection_reason(F.col(title), F.col(abstract), patterns))
    return marked.filter("motivo = ''").drop("motivo"), marked.filter("motivo != ''")


def pending(df: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows not yet done."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def scoring_estimate(df: DataFrame, abstract: str = "abstract", seconds: float = 2.0) -> DataFrame:
    """Before a scoring run: rows, median characters, tokens a call and hours in sequence."""
    own = df.agg(F.count(F.lit(1)).alias("n"), F.median(F.length(abstract)).alias("median_chars"))
    return own.select("n", "median_chars", (F.floor(F.col("median_chars") / 4) + 300).alias("tokens_per_call"), F.round(F.col("n") * seconds / 3600, 4).alias("hours"))
