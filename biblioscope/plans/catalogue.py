"""Every operator as a query over the driver's tables, with the same in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import scores as S
from ..functions import text as T
from ..operators import agreement, annotations, clean, dedup, evaluation, grams, graph, models, networks, sampling, terms, validity
from ..sources import export, files
from ..storage import shared_path, stored
from ..streaming import scoring
from .tables import CORPUS, NORMAL, ONE_BYTE, SCORED, citations, corpus, pair_sql, scored, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# networks


@query(pair_sql("l_orderkey", "l_suppkey").replace("x.m AS a, y.m AS b", "x.m AS author_a, y.m AS author_b"))
def coauthorship_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id_artigo"), F.col("l_suppkey").alias("author_id"))
    return networks.coauthorship(edges).select(F.col("a").alias("author_a"), F.col("b").alias("author_b"), "weight")


@query(pair_sql("l_orderkey", "l_partkey", 3))
def cocitation_edges(spark: SparkSession, d: str) -> DataFrame:
    return networks.cocitation(citations(spark, d), 3)


@query(pair_sql("l_partkey", "l_orderkey", 2))
def coupling_edges(spark: SparkSession, d: str) -> DataFrame:
    return networks.coupling(citations(spark, d), 2)


def _authorships(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    own = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_returnflag")))
    works = li.groupBy("l_orderkey").agg(own.alias("x"), F.min(F.year("l_shipdate")).alias("ano"))
    author = lambda r: F.struct(
        F.struct(r["l_suppkey"].cast("string").alias("id"), F.concat(F.lit("S"), r["l_suppkey"].cast("string")).alias("display_name")).alias("author"),
        F.when(r["l_linenumber"] == 1, "first").otherwise("middle").alias("author_position"),
        (r["l_returnflag"] == "R").alias("is_corresponding"),
        F.array(F.struct(F.concat(F.lit("I"), (r["l_suppkey"] % 7).cast("string")).alias("id"), F.when(r["l_suppkey"] % 3 == 0, "BR").alias("country_code"))).alias("institutions"),
        F.array(F.when(r["l_suppkey"] % 2 == 0, "PT").otherwise("US")).alias("countries"),
    )
    return networks.authorships(works.select(F.col("l_orderkey").cast("string").alias("id"), "ano", F.transform("x", author).alias("autores")))


_AUTHORS = """a AS (SELECT CAST(l_orderkey AS VARCHAR) AS id_artigo, CAST(l_suppkey AS VARCHAR) AS author_id,
  row_number() OVER w AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n, l_linenumber, l_returnflag, l_suppkey,
  min(year(l_shipdate)) OVER (PARTITION BY l_orderkey) AS ano FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_returnflag)),
e AS (SELECT id_artigo, author_id, CAST(pos AS INTEGER) AS ordem_autoria, (pos = 1 OR l_linenumber = 1) AS is_first, pos = n AS is_last, l_returnflag = 'R' AS is_corresponding,
  'I' || (l_suppkey % 7) AS inst, CASE WHEN l_suppkey % 3 = 0 THEN 'BR' WHEN l_suppkey % 2 = 0 THEN 'PT' ELSE 'US' END AS country, ano FROM a)"""


@query(f"WITH {_AUTHORS} SELECT id_artigo, author_id, ordem_autoria, is_first, is_last, is_corresponding, country FROM e")
def authorship_rows(spark: SparkSession, d: str) -> DataFrame:
    return _authorships(spark, d).select("id_artigo", "author_id", "ordem_autoria", "is_first", "is_last", "is_corresponding", F.array_join("country_codes", ";").alias("country"))


@query(f"""WITH {_AUTHORS} SELECT author_id, count(DISTINCT id_artigo) AS n_artigos, CAST(sum(CAST(is_first AS INT)) AS BIGINT) AS n_primeiro,
  CAST(sum(CAST(is_last AS INT)) AS BIGINT) AS n_ultimo, CAST(sum(CAST(is_corresponding AS INT)) AS BIGINT) AS n_correspondente, 'S' || author_id AS display_name,
  array_to_string(list_sort(list_distinct(list(inst))), ';') AS institution_ids, array_to_string(list_sort(list_distinct(list(country))), ';') AS country_codes,
  CAST(min(ano) AS INTEGER) AS ano_min, CAST(max(ano) AS INTEGER) AS ano_max, CAST(count(DISTINCT country) AS INTEGER) AS n_paises, bool_or(country = 'BR') AS tem_br FROM e GROUP BY author_id""")
def author_nodes(spark: SparkSession, d: str) -> DataFrame:
    return networks.author_nodes(_authorships(spark, d))


def _internal(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("id"))
    own = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited"), F.year("l_shipdate").alias("ano_citing"))
    return networks.flag_internal(own, ids)


_CITES = "c AS (SELECT l_orderkey AS citing, l_partkey AS cited, CAST(year(l_shipdate) AS INTEGER) AS ano_citing, l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 25) AS eh_interna FROM lineitem)"


@query(f"WITH {_CITES} SELECT * FROM c")
def citation_edges_internal(spark: SparkSession, d: str) -> DataFrame:
    return _internal(spark, d).select("citing", "cited", "ano_citing", "eh_interna")


@query(f"""WITH {_CITES}, p AS (SELECT citing, count(*) AS n, sum(CAST(eh_interna AS INT)) AS i FROM c GROUP BY 1)
  SELECT count(*) AS n_citing, CAST(sum(i) AS BIGINT) AS n_internal, round(avg(n), 6) AS mean_refs, CAST(median(n) AS DOUBLE) AS median_refs, CAST(sum(n) AS BIGINT) AS n_edges, (SELECT count(DISTINCT cited) FROM c) AS n_cited FROM p""")
def citation_stats(spark: SparkSession, d: str) -> DataFrame:
    return networks.citation_stats(_internal(spark, d)).withColumn("mean_refs", F.round("mean_refs", 6))


@query(f"SELECT * FROM ({pair_sql('l_orderkey', 'l_partkey', 2)}) ORDER BY weight DESC, a, b LIMIT 25")
def top_edges(spark: SparkSession, d: str) -> DataFrame:
    return networks.ordered(networks.cocitation(citations(spark, d), 2)).limit(25)


# cleaning


def _works(spark: SparkSession, d: str) -> DataFrame:
    year = F.when(F.col("id") % 7 == 0, "n/a").otherwise((1995 + F.col("id") % 35).cast("string"))
    return corpus(spark, d).withColumns({"tipo_obra": F.when(F.col("id") % 10 == 0, "editorial").otherwise("article"), "ano": year})


def _predicates() -> list:
    return clean.steps(F.col("tipo_obra"), F.col("ano"), F.col("idioma"), F.col("abstract"), languages=("en", "fr"))


_WORKS = f"""{CORPUS}, w AS (SELECT * REPLACE (CASE WHEN id % 7 = 0 THEN 'n/a' ELSE CAST(1995 + id % 35 AS VARCHAR) END AS ano), CASE WHEN id % 10 = 0 THEN 'editorial' ELSE 'article' END AS tipo_obra FROM corpus),
s AS (SELECT *, CASE WHEN tipo_obra NOT IN ('article', 'review') THEN 'type' WHEN coalesce(TRY_CAST(ano AS INTEGER) BETWEEN 2000 AND 2024, false) = false THEN 'year'
  WHEN NOT (idioma IS NULL OR idioma IN ('en', 'fr')) THEN 'language' WHEN abstract IS NULL OR trim(abstract) = '' THEN 'text' ELSE 'kept' END AS step FROM w)"""


@query(f"WITH {_WORKS} SELECT step, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM s), 2) AS pct FROM s GROUP BY step")
def clean_waterfall(spark: SparkSession, d: str) -> DataFrame:
    return clean.waterfall(_works(spark, d), _predicates())


@query(f"WITH {_WORKS} SELECT id, CAST(ano AS INTEGER) AS ano, idioma FROM s WHERE step = 'kept'")
def clean_corpus(spark: SparkSession, d: str) -> DataFrame:
    kept = clean.keep(_works(spark, d), _predicates()).withColumn("is_retracted", F.lit(None).cast("boolean"))
    return clean.check_years(clean.typed(kept)).select("id", "ano", "idioma")


@query("""WITH x AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 10 = 1 THEN '' ELSE ' 10.1/' || upper(source) || '.' || (n_chars % 20) || ' ' END AS doi, n_chars AS citacoes FROM documents),
  r AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(doi)) ORDER BY citacoes DESC NULLS LAST, id) AS k FROM x)
  SELECT id, doi, citacoes FROM r WHERE k = 1 OR doi IS NULL OR trim(doi) = ''""")
def doi_dedup(spark: SparkSession, d: str) -> DataFrame:
    doi = F.when(F.col("id") % 10 == 0, F.lit(None)).when(F.col("id") % 10 == 1, "").otherwise(F.concat(F.lit(" 10.1/"), F.upper("journal"), F.lit("."), (F.col("citacoes") % 20).cast("string"), F.lit(" ")))
    return clean.keep_most_cited(corpus(spark, d).select("id", doi.alias("doi"), "citacoes"))


#: A phrase for each of the library's marks, appended to the titles of 16 of 40 works, so that every mark is met.
_PHRASES = ("Retraction", "RETRACTED article", "erratum", "Corrigendum", "correction to", "expression of concern", "withdrawal", "Withdrawn", "Publisher's note", "editor's note",
  "Retratação", "retratado", "CORREÇÃO", "preocupação editorial", "retirada", "Errata")


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    phrase = F.coalesce(F.get(F.array(*map(F.lit, _PHRASES)), (F.col("id") % 40).cast("int")), F.lit(""))
    own = corpus(spark, d).select("id", F.concat("titulo", F.lit(" "), phrase).alias("titulo"), F.concat(F.lit("D"), F.col("id").cast("string")).alias("doi"), F.when(F.col("id") % 50 == 0, True).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(False).alias("is_retracted"))
    notices = table(spark, d, "labels").filter("toxic = 1").select(F.concat(F.lit(" d"), F.col("doc_id").cast("string"), F.lit(" ")).alias("doi"))
    return clean.flag_retractions(own, notices)


_QUOTED = lambda values: ", ".join("'" + v.replace("'", "''") + "'" for v in values)
_FLAGGED = rf"""{CORPUS}, m AS (SELECT id, titulo || ' ' || coalesce([{_QUOTED(_PHRASES)}][CAST(id % 40 + 1 AS INTEGER)], '') AS t FROM corpus),
f AS (SELECT id, t, id % 50 = 0 AS f1, regexp_matches(t, '(?i)(?:{"|".join(T.RETRACTION_MARKS).replace("'", "''")})') AS f2, id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS f3 FROM m),
g AS (SELECT id, f1 OR f2 OR f3 AS flag_retratado, array_to_string(list_filter([CASE WHEN f1 THEN 'openalex' END, CASE WHEN f2 THEN 'keyword' END, CASE WHEN f3 THEN 'retraction_watch' END], lambda x: x IS NOT NULL), ';') AS motivo_retracao, f1, f2, f3, t FROM f)"""


@query(f"WITH {_FLAGGED} SELECT id, flag_retratado, motivo_retracao FROM g")
def retraction_flags(spark: SparkSession, d: str) -> DataFrame:
    return _flagged(spark, d).select("id", "flag_retratado", "motivo_retracao")


@query(f"""WITH {_FLAGGED} SELECT count(*) AS n_total, count(*) FILTER (flag_retratado) AS n_flagged, round(100.0 * count(*) FILTER (flag_retratado) / count(*), 3) AS pct_flagged, count(*) FILTER (f1) AS n_field,
  count(*) FILTER (f2) AS n_keyword, count(*) FILTER (f3) AS n_listed, count(*) FILTER (motivo_retracao = 'keyword') AS n_keyword_only FROM g""")
def retraction_report(spark: SparkSession, d: str) -> DataFrame:
    return clean.retraction_report(_flagged(spark, d))


@query(f"WITH {_FLAGGED} SELECT id, t AS titulo, motivo_retracao FROM g WHERE flag_retratado ORDER BY id LIMIT 20")
def retraction_sample(spark: SparkSession, d: str) -> DataFrame:
    return clean.retraction_sample(_flagged(spark, d)).select("id", "titulo", "motivo_retracao")


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_antijoin(spark: SparkSession, d: str) -> DataFrame:
    return clean.pending(corpus(spark, d), table(spark, d, "labels").select(F.col("doc_id").alias("id"))).select("id")


@query("SELECT lang AS idioma, count(*) AS n FROM documents GROUP BY 1")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return networks.count_by(corpus(spark, d), "idioma")


@query("SELECT count(*) AS n, median(length(text)) AS median_chars, CAST(floor(median(length(text)) / 4) + 300 AS BIGINT) AS tokens_per_call, round(count(*) * 2.0 / 3600, 4) AS hours FROM documents")
def scoring_estimate(spark: SparkSession, d: str) -> DataFrame:
    return clean.scoring_estimate(corpus(spark, d))


@query("""WITH x AS (SELECT *, split_part(split_part(text, chr(10), 1), ' ', 1) AS word FROM documents)
  SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 6 = 0 THEN '' ELSE '10.1/' || doc_id END AS doi, CASE WHEN doc_id % 4 = 0 THEN '' ELSE word END AS titulo, '{"' || word || '":[0]}' AS abstract_raw, word AS abstract,
  CAST(2000 + doc_id % 25 AS INTEGER) AS ano, CASE WHEN doc_id % 2 = 0 THEN '' ELSE '2020-01-0' || (1 + doc_id % 9) END AS data_publicacao, coalesce(source, '') AS periodico_nome, 'S' || (doc_id % 9) AS periodico_source_id,
  CASE WHEN doc_id % 3 = 0 THEN '1234-567' || (doc_id % 10) END AS periodico_issn_l, lang AS idioma, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE CAST(n_chars AS INTEGER) END AS citacoes, 'article' AS tipo_obra, doc_id % 5 = 0 AS is_retracted,
  CASE WHEN doc_id % 8 = 0 THEN NULL ELSE '[{"author":{"id":"A' || doc_id || '","display_name":"N"},"author_position":"first","is_corresponding":true,"institutions":[{"id":"I1","country_code":"BR"}],"countries":["BR"]}]' END AS autores,
  '["W' || (doc_id % 7) || '","W9"]' AS referencias, '["' || source || '"]' AS concepts, '2024-01-01' AS data_coleta FROM x""")
def record_normalise(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    word, text = F.split("titulo", " ")[0], F.col("id").cast("string")
    author = F.struct(
        F.struct(F.concat(F.lit("A"), text).alias("id"), F.lit("N").alias("display_name")).alias("author"),
        F.lit("first").alias("author_position"),
        F.lit(True).alias("is_corresponding"),
        F.array(F.struct(F.lit("I1").alias("id"), F.lit("BR").alias("country_code"))).alias("institutions"),
        F.array(F.lit("BR")).alias("countries"),
    )
    works = c.select(
        F.concat(F.lit("https://example.org/"), text).alias("id"),
        F.when(F.col("id") % 6 != 0, F.concat(F.lit("10.1/"), text)).alias("doi"),
        F.when(F.col("id") % 4 != 0, word).alias("title"),
        F.create_map(word, F.array(F.lit(0))).alias("abstract_inverted_index"),
        F.col("ano").alias("publication_year"),
        F.when(F.col("id") % 2 != 0, F.concat(F.lit("2020-01-0"), (1 + F.col("id") % 9).cast("string"))).alias("publication_date"),
        F.struct(
            F.struct(
                F.col("journal").alias("display_name"),
                F.concat(F.lit("https://example.org/S"), (F.col("id") % 9).cast("string")).alias("id"),
                F.when(F.col("id") % 3 == 0, F.concat(F.lit("1234-567"), (F.col("id") % 10).cast("string"))).alias("issn_l"),
            ).alias("source")
        ).alias("primary_location"),
        F.col("idioma").alias("language"),
        F.when(F.col("id") % 4 != 0, F.col("citacoes")).alias("cited_by_count"),
        F.lit("article").alias("type"),
        F.when(F.col("id") % 5 == 0, True).alias("is_retracted"),
        F.when(F.col("id") % 8 != 0, F.array(author)).cast(schemas.AUTHORSHIPS).alias("authorships"),
        F.array(F.concat(F.lit("W"), (F.col("id") % 7).cast("string")), F.lit("W9")).alias("referenced_works"),
        F.array("journal").alias("concepts"),
    )
    return clean.records(works, "2024-01-01")


# text


@query(f"WITH {CORPUS} SELECT id, {NORMAL.format(t='titulo')} AS titulo_norm FROM corpus")
def title_normalise(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).select("id", T.normalise_title(F.col("titulo")).alias("titulo_norm"))


_MORE = " <b>x</b> [1, 2] (Smith) (TAM) (Smith & Jones, 2020) [3-5]"
_AUTHOR = T.AUTHOR_CITATION.replace("'", "''")


@query(rf"""WITH {CORPUS}, a AS (SELECT id, nfc_normalize(titulo) || '{_MORE}' AS t FROM corpus), b AS (SELECT id, regexp_replace(t, '<[^>]{{1,50}}>', ' ', 'g') AS t FROM a),
  c AS (SELECT id, t AS t0, regexp_replace(t, '{T.NUMERIC_CITATION}', ' ', 'g') AS t FROM b),
  e AS (SELECT id, len(regexp_extract_all(t0, '{T.NUMERIC_CITATION}')) + len(regexp_extract_all(t, '{_AUTHOR}')) AS n, trim(regexp_replace(regexp_replace(t, '{_AUTHOR}', ' ', 'g'), '\s{{2,}}', ' ', 'g')) AS t FROM c)
  SELECT id, CAST(n AS INTEGER) AS n_citacoes, t AS limpo, CAST(len(regexp_extract_all(t, '[\p{{L}}\p{{M}}\p{{N}}_]+')) AS INTEGER) AS n_palavras, CAST(len(regexp_extract_all(t, '[\p{{L}}\p{{M}}\p{{N}}_]+|\s|[^\p{{L}}\p{{M}}\p{{N}}_\s]')) AS INTEGER) AS n_pedacos FROM e""")
def text_clean(spark: SparkSession, d: str) -> DataFrame:
    return _cleaned(corpus(spark, d))


def _cleaned(works: DataFrame) -> DataFrame:
    own = works.select("id", F.concat("titulo", F.lit(_MORE)).alias("t"))
    limpo = T.clean_text(F.col("t"))
    return own.select("id", T.citations(F.col("t")).alias("n_citacoes"), limpo.alias("limpo"), T.count_words(limpo).alias("n_palavras"), T.count_word_pieces(limpo).alias("n_pedacos"))


@query("SELECT doc_id AS id, CASE WHEN len(string_split(text, ' ')) > 10001 THEN '' ELSE trim(text) END AS rebuilt FROM documents")
def inverted_index_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 256)  # a batch's words are Python objects
    return corpus(spark, d).select("id", T.inverted_index(F.col("abstract")).alias("index")).select("id", T.rebuild_abstract(F.col("index")).alias("rebuilt"))


@query(r"""WITH w AS (SELECT doc_id AS id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents) SELECT id, string_agg(w, ' ' ORDER BY i) AS rebuilt FROM w GROUP BY id""")
def inverted_index_compact(spark: SparkSession, d: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 256)
    return corpus(spark, d).select("id", T.inverted_index(F.col("abstract")).alias("index")).select("id", T.rebuild_abstract_compact(F.col("index")).alias("rebuilt"))


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_TOKENS = rf"""{CORPUS}, tok AS (SELECT id, journal, CASE WHEN length(abstract) >= 10 THEN list_filter(string_split_regex(regexp_replace(lower(abstract), '[^{T.TOKEN_LETTERS}\s]', ' ', 'g'), '\s+'),
  lambda w: length(w) >= 3 AND NOT regexp_full_match(w, '[0-9]+') AND w NOT IN ({_STOP})) ELSE [] END AS t FROM corpus),
w AS (SELECT id, journal, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM tok),
three AS (SELECT id, journal, w, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM w WINDOW p AS (PARTITION BY id ORDER BY i)),
grams AS (SELECT id, journal, w AS term FROM three UNION ALL SELECT id, journal, w || ' ' || w2 FROM three WHERE w2 IS NOT NULL UNION ALL SELECT id, journal, w || ' ' || w2 || ' ' || w3 FROM three WHERE w3 IS NOT NULL),
terms AS (SELECT id, journal, term, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY id) AS DOUBLE) AS tf FROM grams GROUP BY 1, 2, 3)"""


@query(f"""WITH {_TOKENS} SELECT term, count(*) AS df, round(sum(tf), 6) AS freq_global, CAST(sum(n) AS BIGINT) AS n_ocorrencias, round(ln((SELECT count(*) FROM documents) / CAST(count(*) AS DOUBLE)), 6) AS idf,
  round(ln((SELECT count(*) FROM documents) / CAST(count(*) AS DOUBLE)) * sum(tf) / count(*), 6) AS tfidf_medio FROM terms GROUP BY term HAVING count(*) >= 5""")
def ngrams_tfidf(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    own = terms.tfidf(terms.document_terms(c, "abstract"), c.count(), 5)
    return own.withColumns({x: F.round(x, 6) for x in ("freq_global", "idf", "tfidf_medio")})


@query(f"""WITH {_TOKENS}, v AS (SELECT term FROM terms GROUP BY term HAVING count(*) >= 5), k AS (SELECT term, journal, count(*) AS n FROM terms WHERE term IN (SELECT term FROM v) GROUP BY 1, 2)
  SELECT term, array_to_string(list_sort(list(journal || ':' || n)), ';') AS freq_por_cluster FROM k GROUP BY term""")
def term_cluster_freq(spark: SparkSession, d: str) -> DataFrame:
    return grams.cluster_counts(corpus(spark, d), "abstract", "journal")


def _pmi_sql(floor: int) -> str:
    return f"""WITH {_TOKENS}, v AS (SELECT term, count(*) AS df FROM terms GROUP BY term HAVING count(*) >= {floor}), u AS (SELECT id, t.term, df FROM terms t JOIN v USING (term)),
  p AS (SELECT x.term AS a, y.term AS b, count(*) AS n, any_value(x.df) AS da, any_value(y.df) AS db FROM u x JOIN u y ON x.id = y.id AND x.term < y.term GROUP BY 1, 2 HAVING count(*) >= 5),
  q AS (SELECT *, log2(n * CAST((SELECT count(*) FROM documents) AS DOUBLE) / (da * db)) AS pmi, -log2(greatest(n / CAST((SELECT count(*) FROM documents) AS DOUBLE), 1e-12)) AS h FROM p)
  SELECT a, b, round(pmi / h, 5) AS weight, round(pmi, 5) AS pmi, n AS n_co_artigos FROM q WHERE pmi >= 0.5 AND pmi / h > 0"""


def _pmi(spark: SparkSession, d: str, floor: int) -> DataFrame:
    return terms.text_cooccurrence(corpus(spark, d), "abstract", floor).select("a", "b", F.round("weight", 5).alias("weight"), F.round("pmi", 5).alias("pmi"), "n_co_artigos")


@query(_pmi_sql(5))
def term_pmi(spark: SparkSession, d: str) -> DataFrame:
    """Every term of five documents or more, the usual floor."""
    return _pmi(spark, d, 5)


@query(_pmi_sql(60))
def term_pmi_common(spark: SparkSession, d: str) -> DataFrame:
    """The network of common terms, of sixty documents or more."""
    return _pmi(spark, d, 60)


@query(f"""WITH {_TOKENS}, g AS (SELECT term, count(*) FILTER (journal = 'src0') AS n_one, count(*) FILTER (journal = 'src1') AS n_other FROM terms GROUP BY 1)
  SELECT term, n_one, n_other, round((n_one + 1) / CAST((SELECT count(*) FROM corpus WHERE journal = 'src0') + 1 AS DOUBLE) / ((n_other + 1) / CAST((SELECT count(*) FROM corpus WHERE journal = 'src1') + 1 AS DOUBLE)), 6) AS ratio FROM g WHERE n_one + n_other > 3""")
def lexical_enrichment(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    own = terms.enrichment(terms.document_terms(c, "abstract"), c.select("id", F.col("journal").alias("cluster")), "src0", "src1")
    return own.filter("n_one + n_other > 3").withColumn("ratio", F.round("ratio", 6))


_PATTERNS = (*T.INJECTION_MARKS, r"\bis\s+to\b", r"\bof\s+the\b")
_PATTERN_SQL = "(?i)(?:" + "|".join(_PATTERNS).replace("'", "''") + ")"


@query(rf"""SELECT conv_id, turn, array_to_string(list_slice(list_sort(list_distinct(list_transform(regexp_extract_all(role || chr(10) || text, '{_PATTERN_SQL}'), lambda x: lower(trim(x))))), 1, 5), '; ') AS motivo
  FROM conversations""")
def injection_flags(spark: SparkSession, d: str) -> DataFrame:
    return _injections(table(spark, d, "conversations"))


def _injections(own: DataFrame) -> DataFrame:
    return own.select("conv_id", "turn", T.injection_reason(F.col("role"), F.col("text"), _PATTERNS).alias("motivo"))


@query(rf"""WITH {CORPUS}, m AS (SELECT id, '<<<ARTICLE_BEGIN>>>' || chr(10) || 'TITLE: ' || replace(substring(regexp_replace(titulo, '^\s+|\s+$', '', 'g'), 1, 500), '<<<ARTICLE_END>>>', '') || chr(10) || chr(10) || 'ABSTRACT: ' ||
  replace(substring(regexp_replace(abstract || '<<<ARTICLE_END>>>', '^\s+|\s+$', '', 'g'), 1, 3000), '<<<ARTICLE_END>>>', '') || chr(10) || '<<<ARTICLE_END>>>' AS m FROM corpus) SELECT id, md5(m) AS digest, substring(sha256(m), 1, 12) AS version FROM m""")
def prompt_build(spark: SparkSession, d: str) -> DataFrame:
    m = T.user_message(F.col("titulo"), F.concat("abstract", F.lit(T.END)))
    return corpus(spark, d).select("id", m.alias("m")).select("id", F.md5("m").alias("digest"), T.prompt_version(F.col("m")).alias("version"))


@query(r"""WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN 'Answer: ' || props || ' done' WHEN 2 THEN 'it is "k" : ' || (event_id % 17) || ' or so' ELSE 'none' END AS t FROM events),
  j AS (SELECT event_id, t, CASE WHEN json_valid(t) THEN t WHEN json_valid(regexp_extract(t, '\{[^{}]+\}')) THEN regexp_extract(t, '\{[^{}]+\}') END AS j FROM r)
  SELECT event_id, CASE WHEN j IS NOT NULL THEN TRY_CAST(json_extract_string(j, '$.k') AS DOUBLE) ELSE TRY_CAST(nullif(regexp_extract(t, '"k"\s*:\s*([0-9.]+)', 1), '') AS DOUBLE) END AS k, NOT json_valid(t) AS fallback FROM j""")
def json_parse_fallback(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("event_id") % 4
    reply = F.when(m == 0, F.col("props")).when(m == 1, F.concat(F.lit("Answer: "), "props", F.lit(" done"))).when(m == 2, F.concat(F.lit('it is "k" : '), (F.col("event_id") % 17).cast("string"), F.lit(" or so"))).otherwise("none")
    own = table(spark, d, "events").select("event_id", reply.alias("t"))
    return own.select("event_id", T.parse_reply(F.col("t"), ["k"]).alias("x")).select("event_id", "x.k", "x.fallback")


@query("SELECT doc_id AS id, u.pos, u.value FROM documents, LATERAL (SELECT unnest([CAST(doc_id AS VARCHAR), source]) AS value, unnest([CAST(0 AS INTEGER), CAST(2 AS INTEGER)]) AS pos) u")
def json_elements(spark: SparkSession, d: str) -> DataFrame:
    own = corpus(spark, d).select("id", F.concat(F.lit('["'), F.col("id").cast("string"), F.lit('", 7, "'), "journal", F.lit('", null]')).alias("js"))
    return clean.json_elements(own, "js", "$").select("id", "pos", "value")


@query("""SELECT doc_id AS id, '{"data":{"doc_id":' || doc_id || ',"source":' || CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE '"' || source || '"' END || '}}' AS task FROM documents""")
def annotation_tasks(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").withColumn("source", F.when(F.col("doc_id") % 3 != 0, F.col("source")))
    task = files.annotation_tasks(own, ["doc_id", "source"])
    return task.select(F.get_json_object("task", "$.data.doc_id").cast("bigint").alias("id"), "task")


# scores


def _normal(spark: SparkSession, d: str) -> tuple[DataFrame, list]:
    own = scored(spark, d)
    own = own.withColumns({f"s{i}": c for i, c in enumerate(S.normalised([F.col(f"raw_{i}") for i in range(6)]))})
    return own, [F.col(f"s{i}") for i in range(6)]


_ENT = "-(" + " + ".join(f"s{i} * ln(s{i} + 1e-12)" for i in range(6)) + ") / ln(6.0)"


@query(f"""WITH {SCORED} SELECT id, {", ".join(f"round(s{i}, 6) AS s{i}" for i in range(6))}, round({_ENT}, 6) AS entropia, round(o[1] - o[2], 9) < 0.15 AS fronteira,
  CASE WHEN id % 3 = 0 THEN 'law' ELSE best END AS primario, id % 3 <> 0 AS fallback FROM ranked""")
def score_normalise_entropy(spark: SparkSession, d: str) -> DataFrame:
    own, s = _normal(spark, d)
    given = F.when(F.col("id") % 3 == 0, "law").when(F.col("id") % 3 == 1, "xx")
    label, fell = S.primary_label(given, s, S.CLUSTERS)
    return own.select("id", *(F.round(c, 6).alias(f"s{i}") for i, c in enumerate(s)), F.round(S.entropy(s), 6).alias("entropia"), S.at_frontier(s).alias("fronteira"), label.alias("primario"), fell.alias("fallback"))


_E = [f"least(1.0, greatest(0.0, CAST(((doc_id * {i + 5}) % 13) - 1 AS DOUBLE) / 10.0))" for i in range(3)]
_H = [f"CASE WHEN e{i} > 0 AND e{i} < 1 THEN -(e{i} * log2(e{i}) + (1 - e{i}) * log2(1 - e{i})) ELSE 0 END" for i in range(3)]


@query(f"""WITH x AS (SELECT doc_id AS id, {", ".join(f"{e} AS e{i}" for i, e in enumerate(_E))} FROM documents) SELECT id, round(({" + ".join(_H)}) / 3, 6) AS incerteza,
  round(abs(e0 - 0.5), 9) < 0.15 OR round(abs(e1 - 0.5), 9) < 0.15 OR round(abs(e2 - 0.5), 9) < 0.15 AS fronteira, CAST(e0 >= 0.5 AS INTEGER) AS b0 FROM x""")
def epi_uncertainty(spark: SparkSession, d: str) -> DataFrame:
    e = [S.clipped((((F.col("id") * (i + 5)) % 13) - 1).cast("double") / 10) for i in range(3)]
    return corpus(spark, d).select("id", F.round(S.uncertainty(e), 6).alias("incerteza"), S.flags_at_frontier(e).alias("fronteira"), (e[0] >= 0.5).cast("int").alias("b0"))


@query("""SELECT doc_id AS id, CASE WHEN quality = 1 AND toxic = 1 THEN 'mixed' WHEN quality = 1 THEN 'positivista' WHEN toxic = 1 THEN 'interpretativa' ELSE 'nenhuma' END AS orientacao_proeminente,
  CASE WHEN quality + toxic + doc_id % 2 = 0 THEN 'all_zero' ELSE array_to_string(list_filter([CASE WHEN quality = 1 THEN 'EE' END, CASE WHEN toxic = 1 THEN 'IC' END, CASE WHEN doc_id % 2 = 1 THEN 'DN' END], lambda x: x IS NOT NULL), '+') END AS configuracao,
  CAST(quality + toxic + doc_id % 2 = 0 AS INTEGER) AS inconclusiva FROM labels""")
def derive_orientation(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).select("id", "orientacao_proeminente", "configuracao", "inconclusiva")


def _flags(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias(S.FLAGS[0]), F.col("toxic").alias(S.FLAGS[1]), (F.col("doc_id") % 2).cast("int").alias(S.FLAGS[2]))
    return S.derive(own)


@query("""WITH c AS (SELECT CASE WHEN quality + toxic + doc_id % 2 = 0 THEN 'all_zero' ELSE array_to_string(list_filter([CASE WHEN quality = 1 THEN 'EE' END, CASE WHEN toxic = 1 THEN 'IC' END, CASE WHEN doc_id % 2 = 1 THEN 'DN' END], lambda x: x IS NOT NULL), '+') END AS configuracao FROM labels)
  SELECT configuracao, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM c), 4) AS pct FROM c GROUP BY 1""")
def flag_patterns(spark: SparkSession, d: str) -> DataFrame:
    return annotations.patterns(_flags(spark, d))


@query("""WITH x AS (SELECT doc_id AS id, quality AS q, toxic AS t, doc_id % 2 AS dn, doc_id % 5 AS c, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'EE dn:modo' WHEN 2 THEN 'none' ELSE 'unsure' END AS n0 FROM labels),
  y AS (SELECT *, CASE WHEN n0 = 'none' THEN '' ELSE n0 END AS n FROM x)
  SELECT id, array_to_string(list_filter([CASE WHEN c NOT IN (1, 2, 3) THEN 'confidence range' END, CASE WHEN c <= 1 AND n = '' THEN 'low confidence without notes' END,
    CASE WHEN c <= 1 AND n <> '' AND NOT regexp_matches(upper(n), 'EE|IC|DN') THEN 'low confidence without a named mark' END, CASE WHEN dn = 1 AND NOT regexp_matches(n, 'dn:(ambos|modo|norm)') THEN 'doctrine without a tag' END,
    CASE WHEN q = 0 AND t = 0 AND dn = 0 AND c > 1 THEN 'all zero with confidence' END], lambda v: v IS NOT NULL), '|') AS violations FROM y""")
def row_violations(spark: SparkSession, d: str) -> DataFrame:
    note = F.element_at(F.array(*map(F.lit, ("", "EE dn:modo", "none", "unsure"))), (F.col("doc_id") % 4 + 1).cast("int"))
    found = S.violations(F.col("quality").cast("string"), F.col("toxic").cast("string"), (F.col("doc_id") % 2).cast("string"), (F.col("doc_id") % 5).cast("string"), note)
    return table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.array_join(found, "|").alias("violations"))


@query("""WITH l AS (SELECT doc_id AS id, (doc_id % 7) / 2.0 AS a, (doc_id % 5) / 2.0 AS b, (doc_id % 3) / 2.0 AS c, (doc_id % 9 - 4) / 2.0 AS f FROM documents),
  m AS (SELECT *, greatest(a, b, c) AS g FROM l), p AS (SELECT *, exp(a - g) + exp(b - g) + exp(c - g) AS t FROM m), q AS (SELECT id, exp(a - g) / t AS pa, exp(b - g) / t AS pb, exp(c - g) / t AS pc, 1 / (1 + exp(-f)) AS pf FROM p)
  SELECT id, round(pa, 6) AS pa, round(greatest(pa, pb, pc), 6) AS certeza, CASE WHEN pa >= pb AND pa >= pc THEN 'x' WHEN pb >= pc THEN 'y' ELSE 'z' END AS primario,
  CASE WHEN list_reverse_sort([pa, pb, pc])[1] - list_reverse_sort([pa, pb, pc])[2] < 0.15 THEN list_sort([{'s': -pa, 'i': 0, 'x': 'x'}, {'s': -pb, 'i': 1, 'x': 'y'}, {'s': -pc, 'i': 2, 'x': 'z'}])[2].x END AS secundario, round(2 * abs(pf - 0.5), 6) AS flag_certeza FROM q""")
def apply_models(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("id")
    own = corpus(spark, d).select("id", ((x % 7) / 2).alias("la"), ((x % 5) / 2).alias("lb"), ((x % 3) / 2).alias("lc"), ((x % 9 - 4) / 2).alias("lf"))
    out = models.apply_clusters(own, ["la", "lb", "lc"], ("x", "y", "z"))
    return out.select("id", F.round("cluster_x_prob", 6).alias("pa"), F.round("cluster_certeza", 6).alias("certeza"), F.col("cluster_primario_pred").alias("primario"), F.col("cluster_secundario_pred").alias("secundario"), F.round(S.flag_certainty([S.sigmoid(F.col("lf"))]), 6).alias("flag_certeza"))


# sampling


@query("""WITH q AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.5) AS b, quantile_cont(n_chars, 0.75) AS c FROM documents) SELECT doc_id AS id, CAST(CAST(n_chars > a AS INTEGER) + CAST(n_chars > b AS INTEGER) + CAST(n_chars > c AS INTEGER) AS TINYINT) AS quartil_citacoes FROM documents, q""")
def citation_quartiles(spark: SparkSession, d: str) -> DataFrame:
    return sampling.quartile(corpus(spark, d), "citacoes").select("id", "quartil_citacoes")


def _featured(spark: SparkSession, d: str) -> DataFrame:
    own, s = _normal(spark, d)
    return sampling.features(own.withColumn("cluster", S.best_label(s, S.CLUSTERS)), [f"s{i}" for i in range(6)], language="idioma", journal="journal", cluster="cluster")


_FEATURED = f"""{SCORED}, q AS (SELECT quantile_cont(n_chars, 0.25) AS qa, quantile_cont(n_chars, 0.5) AS qb, quantile_cont(n_chars, 0.75) AS qc FROM documents),
features AS (SELECT *, CAST(citacoes > qa AS INTEGER) + CAST(citacoes > qb AS INTEGER) + CAST(citacoes > qc AS INTEGER) AS quartil, o[1] - o[2] < 0.15 OR o[1] < 0.55 AS eh_fronteira FROM ranked, q),
keyed AS (SELECT *, ano || '|' || coalesce(idioma, 'NA') || '|' || coalesce(journal, 'NA') || '|' || quartil || '|' || best AS estrato, best || '|' || quartil AS estrato_reduzido, best AS estrato_cluster FROM features)"""


@query(f"""WITH {_FEATURED} SELECT 'estrato' AS grain, round(CAST(sum(CASE WHEN n >= 2 THEN n ELSE 0 END) AS DOUBLE) / sum(n), 6) AS coverage, count(*) FILTER (n >= 2) AS strata FROM (SELECT estrato, count(*) AS n FROM keyed GROUP BY 1)
  UNION ALL SELECT 'estrato_reduzido', round(CAST(sum(CASE WHEN n >= 2 THEN n ELSE 0 END) AS DOUBLE) / sum(n), 6), count(*) FILTER (n >= 2) FROM (SELECT estrato_reduzido, count(*) AS n FROM keyed GROUP BY 1)
  UNION ALL SELECT 'estrato_cluster', round(CAST(sum(CASE WHEN n >= 2 THEN n ELSE 0 END) AS DOUBLE) / sum(n), 6), count(*) FILTER (n >= 2) FROM (SELECT estrato_cluster, count(*) AS n FROM keyed GROUP BY 1)""")
def strata_coverage(spark: SparkSession, d: str) -> DataFrame:
    return sampling.coverage(_featured(spark, d)).withColumn("coverage", F.round("coverage", 6))


_HASH = "(doc_id * 2654435761 + 42) % 4294967296"


@query(f"""WITH s AS (SELECT doc_id AS id, source || '|' || lang AS estrato, {_HASH} AS h FROM documents), z AS (SELECT estrato, count(*) AS n FROM s GROUP BY 1), e AS (SELECT *, 100.0 * n / (SELECT sum(n) FROM z) AS x FROM z),
  r AS (SELECT *, floor(x) AS f, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, n DESC, estrato) AS k FROM e), u AS (SELECT estrato, least(n, f + CASE WHEN k <= 100 - (SELECT sum(floor(x)) FROM e) THEN 1 ELSE 0 END) AS quota FROM r),
  p AS (SELECT id, estrato, row_number() OVER (PARTITION BY estrato ORDER BY h, id) AS place FROM s) SELECT id, estrato FROM p JOIN u USING (estrato) WHERE place <= quota""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    own = corpus(spark, d).withColumn("estrato", F.concat_ws("|", "journal", "idioma"))
    return sampling.stratified(own, 100, "estrato", "id", 42, sampling.seeded(F.col("id"), 42)).select("id", "estrato")


@query(f"""WITH {_FEATURED} SELECT id, round(-({" + ".join(f"(greatest(s{i}, 1e-12) / w) * ln(greatest(s{i}, 1e-12) / w)" for i in range(6))}), 6) AS entropia_llm
  FROM (SELECT *, {" + ".join(f"greatest(s{i}, 1e-12)" for i in range(6))} AS w FROM keyed) WHERE eh_fronteira ORDER BY round(-({" + ".join(f"(greatest(s{i}, 1e-12) / w) * ln(greatest(s{i}, 1e-12) / w)" for i in range(6))}), 6) DESC, (id * 2654435761 + 42) % 4294967296, id LIMIT 50""")
def frontier_topk(spark: SparkSession, d: str) -> DataFrame:
    own = _featured(spark, d).withColumn("entropia_llm", F.round("entropia_llm", 6))
    return sampling.frontier(own, 50, 42, "id", sampling.seeded(F.col("id"), 42)).select("id", "entropia_llm")


@query(f"""WITH s AS (SELECT doc_id AS id, source AS estrato, {_HASH} AS h FROM documents), z AS (SELECT estrato, greatest(1, round_even(count(*) * 60 / CAST((SELECT count(*) FROM s) AS DOUBLE), 0)) AS quota FROM s GROUP BY 1),
  p AS (SELECT id, estrato, h, row_number() OVER (PARTITION BY estrato ORDER BY h, id) AS place FROM s) SELECT id, estrato FROM p JOIN z USING (estrato) WHERE place <= quota ORDER BY h, id LIMIT 60""")
def pilot_sample(spark: SparkSession, d: str) -> DataFrame:
    own = corpus(spark, d).select("id", F.col("journal").alias("estrato"))
    return sampling.pilot(own, 60, "estrato", "id", 42, sampling.seeded(F.col("id"), 42))


@query(f"""WITH p AS (SELECT doc_id AS id, source, row_number() OVER (PARTITION BY source ORDER BY {_HASH}, doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)
  SELECT id, CASE WHEN k <= round(n * 0.15) THEN 'test' WHEN k <= round(n * 0.3) THEN 'validation' ELSE 'train' END AS part FROM p""")
def split_parts(spark: SparkSession, d: str) -> DataFrame:
    return sampling.split(corpus(spark, d), "journal", "id", 42, order=sampling.seeded(F.col("id"), 42)).select("id", "part")


# annotations and agreement


@query("""WITH v AS (SELECT l_orderkey AS item, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_returnflag END AS v FROM lineitem), c AS (SELECT item, v, count(*) AS n FROM v GROUP BY 1, 2),
  t AS (SELECT item, CAST(sum(n) AS BIGINT) AS n_votes, max(CASE WHEN v IS NOT NULL THEN n END) AS top FROM c GROUP BY 1), b AS (SELECT t.*, (SELECT min(v) FROM c WHERE c.item = t.item AND c.n = t.top AND v IS NOT NULL) AS v FROM t)
  SELECT item, CASE WHEN 2 * top > n_votes THEN v END AS label, CASE WHEN top IS NULL THEN 'sem_dados' WHEN top = n_votes THEN 'unanime' WHEN 2 * top > n_votes THEN '2_de_3' ELSE 'disputa_pendente' END AS agreement, n_votes FROM b""")
def vote_consolidation(spark: SparkSession, d: str) -> DataFrame:
    votes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.when(F.col("l_linenumber") % 5 != 0, F.col("l_returnflag")).alias("v"), "l_linenumber")
    return annotations.majority(votes, "item", "v", "l_linenumber")


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    """labels as an annotation export: three annotators, who differ by arithmetic on the id."""
    own = table(spark, d, "labels")
    choice = lambda name, c: F.struct(F.lit(name).alias("from_name"), F.struct(F.array(c).alias("choices"), F.array().cast("array<string>").alias("text")).alias("value"))
    cluster = lambda k: F.element_at(F.array(*map(F.lit, S.CLUSTERS)), (F.col("doc_id") * (1 + F.lit(k) * (F.col("doc_id") % 2)) % 6 + 1).cast("int"))
    one = lambda k: F.struct(
        F.struct(F.lit(f"a{k}@x").alias("email")).alias("completed_by"),
        F.array(choice("cluster_primario", cluster(k)), choice("epi_positivista", F.when((F.col("doc_id") + k) % 3 == 0, "1").otherwise("0")), choice("epi_doutrinario_normativa", F.when(F.col("toxic") == 1, "sim").otherwise("0"))).alias("result"),
    )
    return own.select("doc_id", F.col("doc_id").alias("id"), F.struct(F.lit(None).cast("string").alias("id")).alias("data"), F.array(one(0), one(1), one(2)).alias("annotations"))


@query("""WITH a AS (SELECT doc_id, k, (doc_id * (1 + k * (doc_id % 2))) % 6 AS c, CASE WHEN (doc_id + k) % 3 = 0 THEN 1 ELSE 0 END AS p, toxic FROM labels, (SELECT unnest([0, 1, 2]) AS k)),
  n AS (SELECT doc_id, c, count(*) AS n FROM a GROUP BY 1, 2), t AS (SELECT doc_id, max(n) AS top, max_by(c, n) AS c FROM n GROUP BY 1), f AS (SELECT doc_id, sum(p) AS p, any_value(toxic) AS toxic FROM a GROUP BY 1)
  SELECT CAST(doc_id AS VARCHAR) AS id_artigo, CASE WHEN top >= 2 THEN ['si', 'ps', 'sts', 'law', 'pa', 'bcs'][CAST(c AS INTEGER) + 1] END AS cluster_primario, CASE top WHEN 3 THEN 'unanime' WHEN 2 THEN '2_de_3' ELSE 'disputa_pendente' END AS concordancia_cluster_primario,
  CAST(p >= 2 AS INTEGER) AS epi_positivista, toxic AS epi_doutrinario_normativa, top = 1 AS em_disputa, 'a0@x;a1@x;a2@x' AS anotadores, CAST(3 AS INTEGER) AS n_anotadores FROM t JOIN f USING (doc_id)""")
def annotation_gold(spark: SparkSession, d: str) -> DataFrame:
    out = annotations.gold(stored(annotations.flatten(_tasks(spark, d)), "annotations"))
    return out.select("id_artigo", "cluster_primario", "concordancia_cluster_primario", "epi_positivista", "epi_doutrinario_normativa", "em_disputa", "anotadores", "n_anotadores")


_AGREE = """c AS (SELECT l_orderkey AS item, l_returnflag AS k, CAST(count(*) AS DOUBLE) AS r FROM lineitem GROUP BY 1, 2), i AS (SELECT item, sum(r) AS n, sum(r * (r - 1)) AS g FROM c GROUP BY 1),
  t AS (SELECT count(*) AS items, count(*) FILTER (n >= 2) AS m, avg(n) FILTER (n >= 2) AS rb, avg(g / (n * (n - 1))) FILTER (n >= 2) AS pa, avg(g / (n - 1)) FILTER (n >= 2) AS ga FROM i),
  s AS (SELECT k, sum(r / n) AS share, sum(CASE WHEN n >= 2 THEN r ELSE 0 END) AS votes FROM c JOIN i USING (item) GROUP BY 1),
  e AS (SELECT sum((share / items) ** 2) AS pk, sum(share / items * (1 - share / items)) AS sp, sum((votes / m / rb) ** 2) AS pl, count(*) AS q FROM s, t),
  z AS (SELECT *, (1 - 1 / (m * rb)) * ga / rb + 1 / (m * rb) AS pal FROM t, e), v AS (SELECT items, q AS categories, (pal - pl) / (1 - pl) AS alpha, (pa - pk) / (1 - pk) AS kappa, (pa - sp / (q - 1)) / (1 - sp / (q - 1)) AS ac1 FROM z)"""


@query(f"WITH {_AGREE} SELECT items, categories, round(alpha, 6) AS alpha, round(kappa, 6) AS kappa, round(ac1, 6) AS ac1 FROM v")
def agreement_nominal(spark: SparkSession, d: str) -> DataFrame:
    own = agreement.coefficients(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag")
    return own.select("items", "categories", *(F.round(c, 6).alias(c) for c in ("alpha", "kappa", "ac1")))


@query(f"WITH {_AGREE} SELECT alpha >= 0.67 AS cluster_ok, alpha >= 0.55 AS positivista_ok, false AS all_ok, CASE WHEN alpha >= 0.8 THEN 'firme' WHEN alpha >= 0.667 THEN 'tentativo' ELSE 'insuficiente' END AS cluster_band, ac1 - kappa > 0.15 AS prevalence_paradox FROM v")
def agreement_gates(spark: SparkSession, d: str) -> DataFrame:
    own = agreement.coefficients(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag")
    row = own.select(F.col("alpha").alias("alpha_cluster"), F.col("alpha").alias("alpha_positivista"), F.col("alpha").alias("alpha_interpretativa"), F.col("alpha").alias("alpha_doutrinario"), F.col("kappa").alias("kappa_cluster"), F.col("ac1").alias("ac1_cluster"))
    return agreement.gates(row).select("cluster_ok", "positivista_ok", "all_ok", "cluster_band", "prevalence_paradox")


@query("""WITH o AS (SELECT l_orderkey AS item, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS x FROM lineitem), i AS (SELECT count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM o GROUP BY item HAVING count(*) >= 2),
  t AS (SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(q) AS DOUBLE) AS q, sum(CAST(2 * (n * q - s * s) AS DOUBLE) / (n - 1)) AS seen FROM i) SELECT round(1 - seen / (2 * (n * q - s * s) / (n - 1)), 6) AS alpha FROM t""")
def agreement_interval(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linestatus") == "O").cast("int").alias("x"))
    return agreement.interval_alpha(own, "l_orderkey", "x").select(F.round("alpha", 6).alias("alpha"))


@query("""WITH r AS (SELECT doc_id AS item, quality AS f0, CAST(toxic AS INTEGER) AS f1 FROM labels) SELECT item, f0 AS first, f1 AS second FROM r WHERE f0 <> f1""")
def disagreements(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "labels")
    long = own.select(F.col("doc_id").alias("item"), F.lit("a").alias("rater"), F.col("quality").alias("f")).unionByName(own.select(F.col("doc_id").alias("item"), F.lit("b").alias("rater"), F.col("toxic").alias("f")))
    return annotations.disagreements(long, "item", "rater", "f")


# evaluation


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    p = ((F.col("doc_id") * 37) % 101).cast("double") / 101
    q = ((F.col("doc_id") * 53) % 97).cast("double") / 97
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("t"), F.col("toxic").alias("u"), p.alias("p"), q.alias("q"), (p >= 0.5).cast("int").alias("g"), (q >= 0.5).cast("int").alias("h"))


_PRED = "x AS (SELECT doc_id, quality AS t, toxic AS u, CAST((doc_id * 37) % 101 AS DOUBLE) / 101 AS p, CAST((doc_id * 53) % 97 AS DOUBLE) / 97 AS q FROM labels), y AS (SELECT *, CAST(p >= 0.5 AS INTEGER) AS g, CAST(q >= 0.5 AS INTEGER) AS h FROM x)"


@query(f"""WITH {_PRED}, b AS (SELECT ceil(greatest(p, 1 - p) * 10) AS b, count(*) AS n, avg(greatest(p, 1 - p)) AS c, avg(CAST(g = t AS INTEGER)) AS a FROM y GROUP BY 1)
  SELECT round((SELECT sum(n / CAST((SELECT count(*) FROM y) AS DOUBLE) * abs(c - a)) FROM b), 6) AS ece, round(avg((p - t) ** 2 + ((1 - p) - (1 - t)) ** 2), 6) AS brier FROM y""")
def ece_brier(spark: SparkSession, d: str) -> DataFrame:
    own = _predicted(spark, d).withColumns({"r": 1 - F.col("p"), "c": F.greatest(F.col("p"), 1 - F.col("p")), "ok": F.col("g") == F.col("t")})
    return evaluation.calibration_error(own, "c", "ok").crossJoin(evaluation.brier(own, "t", {1: "p", 0: "r"})).select(F.round("ece", 6).alias("ece"), F.round("brier", 6).alias("brier"))  # one row each


@query(f"""WITH {_PRED}, f AS (SELECT l, count(*) FILTER (t = l AND g = l) AS tp, count(*) FILTER (t = l) AS nt, count(*) FILTER (g = l) AS ng FROM y, (SELECT unnest([0, 1]) AS l) GROUP BY 1),
  k AS (SELECT *, CASE WHEN tp > 0 THEN 2.0 * tp / (nt + ng) ELSE 0 END AS f1 FROM f) SELECT round(avg(f1), 6) AS f1_macro, round(sum(f1 * nt) / sum(nt), 6) AS f1_weighted, round(CAST(sum(tp) AS DOUBLE) / sum(nt), 6) AS accuracy FROM k""")
def single_label_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.single_label(_predicted(spark, d), "t", "g").select(*(F.round(c, 6).alias(c) for c in ("f1_macro", "f1_weighted", "accuracy")))


@query(f"""WITH {_PRED} SELECT round(2.0 * count(*) FILTER (t = 1 AND g = 1) / (sum(t) + sum(g)), 6) AS f1_t, round(avg((p - t) ** 2), 6) AS brier_t, round(2.0 * count(*) FILTER (u = 1 AND h = 1) / (sum(u) + sum(h)), 6) AS f1_u, round(avg((q - u) ** 2), 6) AS brier_u,
  round(CAST(sum(CAST(t <> g AS INTEGER) + CAST(u <> h AS INTEGER)) AS DOUBLE) / (2 * count(*)), 6) AS hamming, round(avg(CASE WHEN greatest(t, g) + greatest(u, h) > 0 THEN CAST(t * g + u * h AS DOUBLE) / (greatest(t, g) + greatest(u, h)) ELSE 0 END), 6) AS jaccard FROM y""")
def multilabel_metrics(spark: SparkSession, d: str) -> DataFrame:
    own = evaluation.multi_label(_predicted(spark, d), [("t", "g", "p"), ("u", "h", "q")])
    return own.select(*(F.round(c, 6).alias(c) for c in ("f1_t", "brier_t", "f1_u", "brier_u", "hamming", "jaccard")))


@query(f"""WITH {_PRED} SELECT doc_id, 'quality' AS dimensao, round(p, 6) AS prob, CAST(g AS VARCHAR) AS pred, CAST(t AS VARCHAR) AS verdade, g = t AS acerto FROM y UNION ALL SELECT doc_id, 'toxic', round(q, 6), CAST(h AS VARCHAR), CAST(u AS VARCHAR), h = u FROM y""")
def predictions_long(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.long_predictions(_predicted(spark, d), ["doc_id"], [("quality", "p", "g", "t"), ("toxic", "q", "h", "u")])
    return out.withColumn("prob", F.round("prob", 6))


@query("SELECT o_orderpriority AS encoder, o_orderstatus AS idioma, max(o_totalprice) AS f1_macro_teste FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1, 2")
def best_run(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("encoder"), F.col("o_orderstatus").alias("idioma"), F.col("o_orderkey").alias("semente"), F.col("o_totalprice").alias("f1_macro_teste"), F.when(F.col("o_custkey") % 3 != 0, "ok").otherwise("erro").alias("status"))
    return evaluation.best_runs(o, ["encoder", "idioma"]).select("encoder", "idioma", "f1_macro_teste")


@query("""WITH c AS (SELECT quality AS a, toxic AS b, CAST(count(*) AS DOUBLE) AS n FROM labels GROUP BY 1, 2), s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM c), r AS (SELECT sum(n * (n - 1) / 2) AS r FROM (SELECT sum(n) AS n FROM c GROUP BY a)), k AS (SELECT sum(n * (n - 1) / 2) AS k FROM (SELECT sum(n) AS n FROM c GROUP BY b)),
  e AS (SELECT *, r * k / (t * (t - 1) / 2) AS x FROM s, r, k) SELECT round((s - x) / ((r + k) / 2 - x), 6) AS ari FROM e""")
def adjusted_rand(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.adjusted_rand(table(spark, d, "labels"), "quality", "toxic").select(F.round("ari", 6).alias("ari"))


@query("SELECT count(*) AS n_rows, '' AS missing, '' AS all_null, false AS is_empty, false AS is_inflated, count(*) FILTER (abs(CAST((doc_id * 37) % 101 AS DOUBLE) / 101 + CAST((doc_id * 53) % 97 AS DOUBLE) / 97 - 1) > 0.5) AS n_bad_sums FROM labels")
def probability_validator(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_semi").count()
    return schemas.output_report(_predicted(spark, d), ["doc_id", "p"], n_input=n, probabilities=["p", "q"], tolerance=0.5).drop("largest_deviation")


# graph


def _graph(spark: SparkSession, d: str) -> DataFrame:
    return stored(networks.coupling(citations(spark, d), 2), "edges")


_EDGES = f"e AS ({pair_sql('l_partkey', 'l_orderkey', 2)}), w AS (SELECT a AS u, b AS v, weight FROM e UNION ALL SELECT b, a, weight FROM e), deg AS (SELECT u AS node, count(*) AS degree, CAST(sum(weight) AS DOUBLE) AS strength FROM w GROUP BY 1)"


@query(f"WITH {_EDGES} SELECT o_orderkey AS node, coalesce(degree, 0) AS degree, coalesce(strength, 0.0) AS strength FROM orders LEFT JOIN deg ON node = o_orderkey UNION SELECT node, degree, strength FROM deg")
def degree_strength(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_graph(spark, d), table(spark, d, "orders").select(F.col("o_orderkey").alias("node")))


@query(f"WITH {_EDGES}, r AS (SELECT degree AS x, row_number() OVER (ORDER BY degree) AS i, count(*) OVER () AS n FROM deg) SELECT round(2.0 * sum(i * x) / (max(n) * sum(x)) - (max(n) + 1.0) / max(n), 4) AS gini FROM r")
def gini_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.gini(graph.degrees(_graph(spark, d)), "degree")


@query(f"""WITH {_EDGES} SELECT t.n AS n_triangles, CAST(d.n AS BIGINT) AS n_triples, round(3.0 * t.n / d.n, 4) AS transitivity FROM (SELECT count(*) AS n FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b) t, (SELECT sum(degree * (degree - 1) / 2) AS n FROM deg) d""")
def transitivity(spark: SparkSession, d: str) -> DataFrame:
    return graph.transitivity(_graph(spark, d))


@query(f"WITH {_EDGES} SELECT round(corr(x.degree, y.degree), 4) AS assortativity FROM w JOIN deg x ON x.node = u JOIN deg y ON y.node = v")
def assortativity(spark: SparkSession, d: str) -> DataFrame:
    return graph.assortativity(_graph(spark, d))


@query(f"""WITH {_EDGES} SELECT count(*) AS n_nodes, CAST(sum(degree) / 2 AS BIGINT) AS n_edges, round(sum(degree) / (CAST(count(*) AS DOUBLE) * (count(*) - 1)), 6) AS density, round(avg(degree), 4) AS mean_degree, max(degree) AS max_degree, CAST(0 AS BIGINT) AS n_isolated FROM deg""")
def density_summary(spark: SparkSession, d: str) -> DataFrame:
    return graph.summary(_graph(spark, d))


_SMALL = f"e AS ({pair_sql('l_orderkey', 'l_partkey', 3)})"


@query(f"WITH RECURSIVE {_SMALL}, w AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e), r AS (SELECT u AS node, u AS reach FROM w UNION SELECT r.node, w.v FROM r JOIN w ON r.reach = w.u) SELECT node, min(reach) AS component FROM r GROUP BY 1")
def components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(networks.cocitation(citations(spark, d), 3))


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    """Authors joined by far more works than usual: two standard deviations above the mean pair, or else the most of all."""
    pairs = stored(coauthorship_edges(spark, d).select(F.col("author_a").alias("x"), F.col("author_b").alias("y"), F.col("weight").alias("n_co_artigos")), "pairs")
    usual = pairs.agg(F.least(F.max("n_co_artigos").cast("double"), F.avg("n_co_artigos") + 2 * F.stddev_pop("n_co_artigos")).alias("least")).first().least
    return stored(graph.weighted(pairs.filter(F.col("n_co_artigos") >= (usual or 0.0)), "x", "y"), "edges")


_NETWORK = f"""p AS ({pair_sql("l_orderkey", "l_suppkey")}), e AS (SELECT * FROM p WHERE weight >= (SELECT least(CAST(max(weight) AS DOUBLE), avg(weight) + 2 * stddev_pop(weight)) FROM p)),
w AS (SELECT a AS u, b AS v, CAST(weight AS DOUBLE) AS w FROM e UNION ALL SELECT b, a, CAST(weight AS DOUBLE) FROM e), nodes AS (SELECT DISTINCT u AS node FROM w)"""
#: Steps of the iterations in SQL: walks, distances and cores on these graphs settle well before.
_STEPS, _HOPS = 400, 24


@query(f"""WITH RECURSIVE {_NETWORK}, o AS (SELECT u, v, w / sum(w) OVER (PARTITION BY u) AS share FROM w), n AS (SELECT count(*) AS n FROM nodes),
  r AS (SELECT node, CAST(1.0 AS DOUBLE) / n AS r, 0 AS i FROM nodes, n UNION ALL SELECT o.v, any_value(CAST(0.15 AS DOUBLE) / n.n) + CAST(0.85 AS DOUBLE) * sum(r.r * o.share), r.i + 1 FROM r JOIN o ON o.u = r.node, n WHERE r.i < 150 GROUP BY o.v, r.i)
  SELECT node, round(r, 6) AS pagerank FROM r WHERE i = 150""")
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(_weighted(spark, d)).select("node", F.round("pagerank", 6).alias("pagerank"))


@query(f"""WITH RECURSIVE {_NETWORK}, c AS (SELECT u AS node, count(*) AS core, 0 AS i FROM w GROUP BY 1
  UNION ALL SELECT u, max(least(core, place)), i + 1 FROM (SELECT w.u, c.core, c.i, row_number() OVER (PARTITION BY w.u, c.i ORDER BY c.core DESC) AS place FROM c JOIN w ON w.v = c.node WHERE c.i < {_HOPS}) GROUP BY u, i)
  SELECT node, core AS coreness FROM c WHERE i = {_HOPS}""")
def kcore(spark: SparkSession, d: str) -> DataFrame:
    return graph.coreness(_weighted(spark, d))


_REACH = f"""reach AS (SELECT node, node AS to_ FROM nodes UNION SELECT reach.node, w.v FROM reach JOIN w ON reach.to_ = w.u), comp AS (SELECT node, min(to_) AS component FROM reach GROUP BY 1),
big AS (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1), lcc AS (SELECT node FROM comp WHERE component = (SELECT component FROM big))"""


@query(f"""WITH RECURSIVE {_NETWORK}, {_REACH}, x AS (SELECT node, CAST(1.0 AS DOUBLE) AS x, 0 AS i FROM lcc
  UNION ALL SELECT node, y / max(y) OVER (PARTITION BY i), i + 1 FROM (SELECT l.u AS node, x.i, sum(x.x * l.w) AS y FROM x JOIN (SELECT u, v, w FROM w UNION ALL SELECT node, node, CAST(1.0 AS DOUBLE) FROM lcc) l ON l.v = x.node WHERE x.i < {_STEPS} GROUP BY 1, 2))
  SELECT node, round(x, 4) AS eigenvector FROM x WHERE i = {_STEPS}""")
def eigenvector(spark: SparkSession, d: str) -> DataFrame:
    return graph.eigenvector(_weighted(spark, d)).select("node", F.round("eigenvector", 4).alias("eigenvector"))


_DISTANCE = f"""dist AS (SELECT node AS s, node AS v, CAST(0.0 AS DOUBLE) AS d, 0 AS i FROM nodes
  UNION ALL SELECT dist.s, l.v, min(dist.d + l.c), dist.i + 1 FROM dist JOIN (SELECT u, v, 1 / w AS c FROM w UNION ALL SELECT node, node, 0.0 FROM nodes) l ON l.u = dist.v WHERE dist.i < {_HOPS} GROUP BY dist.s, l.v, dist.i),
far AS (SELECT s, v, d FROM dist WHERE i = {_HOPS})"""


@query(f"""WITH RECURSIVE {_NETWORK}, {_DISTANCE}, walk AS (SELECT node AS s, node AS v FROM nodes UNION ALL SELECT walk.s, w.v FROM walk JOIN w ON w.u = walk.v JOIN far f ON f.s = walk.s AND f.v = walk.v JOIN far g ON g.s = walk.s AND g.v = w.v WHERE abs(f.d + 1 / w.w - g.d) <= 1e-12),
  n AS (SELECT s, v, count(*) AS n FROM walk GROUP BY 1, 2), k AS (SELECT far.s, far.v, d, n FROM far JOIN n ON n.s = far.s AND n.v = far.v),
  b AS (SELECT x.v AS node, sum(CAST(x.n * y.n AS DOUBLE) / z.n) / 2 AS b FROM k x JOIN k y ON y.s = x.v JOIN k z ON z.s = x.s AND z.v = y.v WHERE x.s <> x.v AND y.v <> x.v AND x.s <> y.v AND abs(x.d + y.d - z.d) <= 1e-12 GROUP BY 1), m AS (SELECT count(*) AS m FROM nodes)
  SELECT t.node, round(coalesce(b, 0.0) / greatest(1.0, (m - 1) * (m - 2) / 2.0), 6) AS betweenness, round(1 / total, 6) AS closeness, round(farthest, 6) AS farthest, round(total, 6) AS total_distance
  FROM (SELECT s AS node, sum(d) AS total, max(d) AS farthest FROM far GROUP BY 1) t LEFT JOIN b ON b.node = t.node, m""")
def betweenness_closeness(spark: SparkSession, d: str) -> DataFrame:
    out = graph.path_measures(_weighted(spark, d))
    return out.select("node", *(F.round(c, 6).alias(c) for c in ("betweenness", "closeness", "farthest", "total_distance")))


@query()
def louvain(spark: SparkSession, d: str) -> DataFrame:
    return graph.communities(_weighted(spark, d))


@query(f"""WITH RECURSIVE {_NETWORK}, {_REACH}, {_DISTANCE}, deg AS (SELECT u AS node, count(*) AS degree FROM w GROUP BY 1), k AS (SELECT degree AS x, row_number() OVER (ORDER BY degree) AS i, count(*) OVER () AS n FROM deg),
  inside AS (SELECT sum(d) AS total, max(d) AS farthest, count(*) AS n FROM far WHERE s IN (SELECT node FROM lcc) AND s <> v)
  SELECT 'coautoria' AS rede, 'ok' AS status, (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, (SELECT round(sum(degree) / (CAST(count(*) AS DOUBLE) * (count(*) - 1)), 6) FROM deg) AS density, (SELECT round(avg(degree), 3) FROM deg) AS mean_degree, (SELECT max(degree) FROM deg) AS max_degree,
  CAST(0 AS BIGINT) AS n_isolated, (SELECT round(2.0 * sum(i * x) / (max(n) * sum(x)) - (max(n) + 1.0) / max(n), 4) FROM k) AS gini,
  (SELECT round(3.0 * (SELECT count(*) FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b) / sum(degree * (degree - 1) / 2), 4) FROM deg) AS transitivity, (SELECT round(corr(x.degree, y.degree), 4) FROM w JOIN deg x ON x.node = u JOIN deg y ON y.node = v) AS assortativity,
  (SELECT count(DISTINCT component) FROM comp) AS n_components, (SELECT count(*) FROM lcc) AS lcc_nodes, round(100.0 * (SELECT count(*) FROM lcc) / (SELECT count(*) FROM nodes), 1) AS lcc_pct, (SELECT round(total / n, 4) FROM inside) AS mean_path, (SELECT round(farthest, 2) FROM inside) AS diameter""")
def network_report(spark: SparkSession, d: str) -> DataFrame:
    return graph.report(spark, "coautoria", _weighted(spark, d), grouped=False).drop("modularity")


# fuzzy duplicates


def _titles(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).withColumn("titulo_norm", T.normalise_title(F.col("titulo")))


_TITLES = f"""{CORPUS}, n AS (SELECT id, ano, citacoes, {ONE_BYTE.format(t=NORMAL.format(t="titulo"))} AS t FROM corpus), y AS (SELECT DISTINCT ano AS k FROM n WHERE t <> ''),
b AS (SELECT id, t, k FROM n JOIN y ON k BETWEEN ano - 1 AND ano + 1 WHERE t <> ''), p AS (SELECT DISTINCT u.id AS a, v.id AS b, jaro_winkler_similarity(u.t, v.t) AS s FROM b u JOIN b v ON u.k = v.k AND u.id < v.id WHERE jaro_winkler_similarity(u.t, v.t) >= 0.92)"""


@query(f"WITH {_TITLES} SELECT a, b, round(s, 6) AS similarity FROM p")
def fuzzy_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.fuzzy_pairs(_titles(spark, d)).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH RECURSIVE {_TITLES}, w AS (SELECT a AS u, b AS v FROM p UNION SELECT b, a FROM p), r AS (SELECT u AS id, u AS reach FROM w UNION SELECT r.id, w.v FROM r JOIN w ON r.reach = w.u), c AS (SELECT id, min(reach) AS component FROM r GROUP BY 1),
  k AS (SELECT c.id, component, first_value(c.id) OVER (PARTITION BY component ORDER BY citacoes DESC NULLS LAST, ano, c.id) AS representative FROM c JOIN n ON n.id = c.id) SELECT id, component, representative FROM k""")
def dedup_groups(spark: SparkSession, d: str) -> DataFrame:
    own = _titles(spark, d)
    return dedup.duplicate_groups(own, dedup.Fuzzy(own).links())


@query(f"""WITH RECURSIVE {_TITLES}, w AS (SELECT a AS u, b AS v FROM p UNION SELECT b, a FROM p), r AS (SELECT u AS id, u AS reach FROM w UNION SELECT r.id, w.v FROM r JOIN w ON r.reach = w.u), c AS (SELECT id, min(reach) AS component FROM r GROUP BY 1),
  k AS (SELECT c.id, first_value(c.id) OVER (PARTITION BY component ORDER BY citacoes DESC NULLS LAST, ano, c.id) AS rep FROM c JOIN n ON n.id = c.id)
  SELECT n.id, CASE WHEN rep <> n.id THEN CAST(rep AS VARCHAR) END AS dedup_grupo, CASE WHEN rep <> n.id THEN 'titulo_fuzzy' END AS dedup_motivo FROM n LEFT JOIN k ON k.id = n.id""")
def dedup_marks(spark: SparkSession, d: str) -> DataFrame:
    own = _titles(spark, d)
    return dedup.mark_duplicates(own, dedup.duplicate_groups(own, dedup.Fuzzy(own).links())).select("id", "dedup_grupo", "dedup_motivo")


# validity, export, models


def _lexicons(spark: SparkSession, d: str) -> DataFrame:
    own = corpus(spark, d).select((F.col("id") % 6).alias("k"), F.explode(F.split("titulo", " ")).alias("lemma"))
    return validity.lexicon(own.select(F.element_at(F.array(*map(F.lit, S.CLUSTERS)), (F.col("k") + 1).cast("int")).alias("cluster"), "lemma"))


def _topics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.element_at(F.array(*map(F.lit, S.CLUSTERS)), (F.col("item_id") % 6 + 1).cast("int")).alias("cluster_origem"), F.col("item_id").alias("topic_id"), F.split("text", " ").alias("top_terms"))


_CODES = "['si', 'ps', 'sts', 'law', 'pa', 'bcs']"
_NORM = lambda c: rf"trim(regexp_replace(regexp_replace(trim(lower({c})), '[^a-zñáàâãäéèêëíîïóôõöúûüç_/ -]', '', 'g'), '\s+', ' ', 'g'))"
_VALID = f"""{CORPUS}, lw AS (SELECT id % 6 AS k, unnest(string_split(titulo, ' ')) AS w FROM corpus), lx AS (SELECT k, list(DISTINCT {_NORM("w")}) AS l FROM lw WHERE {_NORM("w")} <> '' GROUP BY 1),
tt AS (SELECT item_id, list_distinct(list_filter(list_transform(list_slice(string_split(text, ' '), 1, 30), lambda w: {_NORM("w")}), lambda w: w <> '')) AS t FROM benchmark),
j AS (SELECT item_id, k, CAST(len(list_intersect(t, l)) AS DOUBLE) / len(list_distinct(list_concat(t, l))) AS j FROM tt, lx),
b AS (SELECT item_id, max(j) AS m FROM j GROUP BY 1), v AS (SELECT b.item_id, m, (SELECT min(k) FROM j WHERE j.item_id = b.item_id AND j = m) AS k FROM b)"""


@query(f"WITH {_VALID} SELECT {_CODES}[CAST(item_id % 6 AS INTEGER) + 1] AS cluster_origem, item_id AS topic_id, {_CODES}[CAST(k AS INTEGER) + 1] AS cluster_vencedor, round(m, 6) AS max_jaccard, k = item_id % 6 AS valido FROM v")
def lexicon_validity(spark: SparkSession, d: str) -> DataFrame:
    out = validity.score_topics(_topics(spark, d), _lexicons(spark, d))
    return out.select("cluster_origem", "topic_id", "cluster_vencedor", F.round("max_jaccard", 6).alias("max_jaccard"), "valido")


@query(f"""WITH {_VALID}, s AS (SELECT {_CODES}[CAST(item_id % 6 AS INTEGER) + 1] AS cluster_origem, count(*) AS n_topicos, count(*) FILTER (k = item_id % 6) AS n_validos FROM v GROUP BY 1)
  SELECT *, round(n_validos / CAST(n_topicos AS DOUBLE), 4) AS pct, CASE WHEN n_validos / CAST(n_topicos AS DOUBLE) >= 0.8 THEN 'confirmada' WHEN n_validos / CAST(n_topicos AS DOUBLE) >= 0.6 THEN 'parcial' ELSE 'alerta' END AS status FROM s""")
def validity_summary(spark: SparkSession, d: str) -> DataFrame:
    return validity.summary(validity.score_topics(_topics(spark, d), _lexicons(spark, d)))


@query("""SELECT l.doc_id AS id, source AS periodico_nome, CAST(2000 + l.doc_id % 25 AS INTEGER) AS ano, CASE WHEN quality = 1 THEN 'si' ELSE 'ps' END AS cluster_primario_pred FROM labels l LEFT JOIN documents d USING (doc_id) ORDER BY l.doc_id""")
def export_join(spark: SparkSession, d: str) -> DataFrame:
    predictions = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "si").otherwise("ps").alias("cluster_primario_pred"))
    return export.classified(predictions, corpus(spark, d).select("id", F.col("journal").alias("periodico_nome"), "ano"))


#: The export's data dictionary, as it must be.
_ROWS = """
  ('id', 'string', '', 'identifier of the work'),
  ('doi', 'string', '', 'DOI, if it has one'),
  ('periodico_nome', 'string', '', 'journal'),
  ('ano', 'int', '2000-2024', 'year of publication'),
  ('cluster_primario_pred', 'string', 'si|ps|sts|law|pa|bcs', 'most probable cluster'),
  ('cluster_certeza', 'double', '0-1', 'its probability'),
  ('cluster_secundario_pred', 'string', 'si|ps|sts|law|pa|bcs', 'runner-up, if it is close'),
  ('cluster_si_prob', 'double', '0-1', 'probability of cluster si'),
  ('cluster_ps_prob', 'double', '0-1', 'probability of cluster ps'),
  ('cluster_sts_prob', 'double', '0-1', 'probability of cluster sts'),
  ('cluster_law_prob', 'double', '0-1', 'probability of cluster law'),
  ('cluster_pa_prob', 'double', '0-1', 'probability of cluster pa'),
  ('cluster_bcs_prob', 'double', '0-1', 'probability of cluster bcs'),
  ('epi_positivista_pred', 'int', '0|1', 'flag epi_positivista'),
  ('epi_interpretativa_pred', 'int', '0|1', 'flag epi_interpretativa'),
  ('epi_doutrinario_normativa_pred', 'int', '0|1', 'flag epi_doutrinario_normativa'),
  ('epi_positivista_prob', 'double', '0-1', 'probability of epi_positivista'),
  ('epi_interpretativa_prob', 'double', '0-1', 'probability of epi_interpretativa'),
  ('epi_doutrinario_normativa_prob', 'double', '0-1', 'probability of epi_doutrinario_normativa'),
  ('orientacao_proeminente', 'string', 'positivista|interpretativa|mixed|nenhuma', 'derived from the first axis'),
  ('inconclusiva', 'int', '0|1', '1 if all flags are 0'),
  ('epi_certeza', 'double', '0-1', 'mean distance of the flags'' probabilities from 0.5')"""


@query(f"SELECT * FROM (VALUES {_ROWS}) AS t(coluna, tipo, valores, descricao)")
def data_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return export.dictionary(spark)


@query("""WITH t AS (SELECT vec_id, i, embedding[i * 8 + 1] AS v FROM embeddings, (SELECT unnest(range(8)) AS i) WHERE (vec_id + i) % 3 <> 0) SELECT vec_id, round(avg(CAST(v AS DOUBLE)), 5) AS first_pooled, CAST(count(*) AS INTEGER) AS n_tokens FROM t GROUP BY 1""")
def embedding_meanpool(spark: SparkSession, d: str) -> DataFrame:
    places = F.sequence(F.lit(0), F.lit(7))
    tokens = F.transform(places, lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    mask = F.transform(places, lambda i: ((F.col("vec_id") + i) % 3 != 0).cast("int"))
    own = table(spark, d, "embeddings").select("vec_id", tokens.alias("tokens"), mask.alias("mask"))
    return own.select("vec_id", F.round(models.mean_pool(F.col("tokens"), F.col("mask"))[0], 5).alias("first_pooled"), F.aggregate("mask", F.lit(0), lambda a, m: a + m).alias("n_tokens"))


@query()
def kmeans_ari(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.adjusted_rand(models.cluster(table(spark, d, "embeddings"), 10), "label", "grupo")


@query()
def classifier_cv(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("y"), F.col("text").alias("texto"))
    return evaluation.single_label(models.cross_validate(models.tfidf(own), "y", "tfidf"), "truth", "guess")


@query("SELECT doc_id AS id, length(text) AS score, 'v1' AS prompt_version FROM documents")
def stream_scoring(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "documents").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/documents.parquet") if _is_folder(spark, f"{d}/documents.parquet") else spark.readStream.schema(schema).option("pathGlobFilter", "documents.parquet").parquet(d)
    sink = shared_path(spark, "scores")
    stream = scoring.score_stream(source.withColumnRenamed("doc_id", "id"), lambda df: df.select("id", F.length("text").cast("bigint").alias("score")), sink, shared_path(spark, "stream"), "v1")
    stream.awaitTermination()
    return spark.read.parquet(sink).select("id", "score", "prompt_version")


def _is_folder(spark: SparkSession, path: str) -> bool:
    """A folder's files have longer paths than its own."""
    found = spark.read.format("binaryFile").load(path).select("path").first()
    return found is None or not found.path.endswith(path.rsplit("/", 1)[-1])


@query(f"""WITH {CORPUS}, w AS (SELECT id, unnest(string_split(titulo, ' ')) AS w, generate_subscripts(string_split(titulo, ' '), 1) AS i FROM corpus), p AS (SELECT id, w || ' ' || lead(w) OVER (PARTITION BY id ORDER BY i) AS pair FROM w) SELECT id, pair FROM p WHERE pair IS NOT NULL""")
def adjacent_words(spark: SparkSession, d: str) -> DataFrame:
    words = corpus(spark, d).select("id", F.posexplode(F.split("titulo", " ")).alias("i", "w"))
    return terms.adjacent(words, "id", "i", "w")


