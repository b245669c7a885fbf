"""More operators as queries: language, training joins, draws, summaries, intervals and views of other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..operators import agreement, annotations, clean, dedup, graph, models, networks, sampling, terms
from ..storage import stored
from .catalogue import _AGREE, _EDGES, _FEATURED, _TITLES, _TOKENS, ORACLE_SQL, _featured, _graph, _tasks, _titles, query
from .tables import CORPUS, citations, corpus, pair_sql, table

# language


def _declared(spark: SparkSession, d: str) -> DataFrame:
    """The corpus, where two of three works declare no language."""
    return corpus(spark, d).withColumn("idioma", F.when(F.col("id") % 3 == 0, F.col("idioma")))


_COUNTS = ", ".join(f"{{'n': len(list_filter(t, lambda w: w IN ({', '.join(repr(w) for w in own)}))), 'lang': '{lang}'}}" for lang, own in sorted(T.FUNCTION_WORDS.items()))
_DETECTED = rf"""{CORPUS}, k AS (SELECT *, string_split_regex(lower(abstract), '\s+') AS t, CASE WHEN id % 3 = 0 THEN idioma END AS declared FROM corpus),
x AS (SELECT *, list_reverse_sort([{_COUNTS}]) AS c FROM k), l AS (SELECT *, coalesce(declared, CASE WHEN length(abstract) >= 21 AND c[1].n >= 2 AND c[1].n > c[2].n THEN c[1].lang END) AS idioma_detectado FROM x)"""


@query(f"WITH {_DETECTED} SELECT id, idioma_detectado, CASE WHEN idioma_detectado IS NOT NULL THEN CAST(1.0 AS DOUBLE) END AS idioma_confianca FROM l")
def language_detect(spark: SparkSession, d: str) -> DataFrame:
    return clean.detect_languages(_declared(spark, d), "abstract", "idioma").select("id", "idioma_detectado", "idioma_confianca")


# joins that training needs


@query("SELECT l.doc_id AS id, quality AS escore, source AS journal, CAST(2000 + l.doc_id % 25 AS INTEGER) AS ano FROM labels l JOIN documents d USING (doc_id)")
def scored_corpus(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("escore"))
    return sampling.scored_corpus(scores, corpus(spark, d)).select("id", "escore", "journal", "ano")


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return annotations.gold(stored(annotations.flatten(_tasks(spark, d)), "annotations"))


_GOLD = ORACLE_SQL["annotation_gold"]


@query(f"""WITH g AS ({_GOLD}), {_DETECTED} SELECT id_artigo, cluster_primario, idioma_detectado, md5(coalesce(titulo, '') || ' ' || coalesce(abstract, '')) AS digest
  FROM g JOIN l ON id_artigo = CAST(l.id AS VARCHAR) WHERE concordancia_cluster_primario <> 'disputa_pendente' AND cluster_primario IS NOT NULL AND lower(idioma_detectado) = 'en'""")
def training_rows(spark: SparkSession, d: str) -> DataFrame:
    works = clean.detect_languages(_declared(spark, d), "abstract", "idioma")
    own = clean.language_cell(annotations.with_texts(annotations.usable(_gold(spark, d)), works), "en")
    return own.select("id_artigo", "cluster_primario", "idioma_detectado", F.md5(models.pair_text(F.col("titulo"), F.col("abstract"))).alias("digest"))


@query(f"WITH g AS ({_GOLD}) SELECT id_artigo, cluster_primario, source AS journal, CAST(2000 + doc_id % 25 AS INTEGER) AS ano FROM g LEFT JOIN documents ON id_artigo = CAST(doc_id AS VARCHAR)")
def gold_metadata(spark: SparkSession, d: str) -> DataFrame:
    return annotations.with_metadata(_gold(spark, d), corpus(spark, d)).select("id_artigo", "cluster_primario", "journal", "ano")


# draws


def _features(spark: SparkSession, d: str) -> DataFrame:
    """The sampling features, written once as the draws read them often; a quarter of the works stands for the frontier."""
    own = _featured(spark, d).withColumns({"eh_fronteira": F.col("id") % 4 == 0, "entropia_llm": F.round("entropia_llm", 6)})
    return stored(own.drop("abstract"), "features")


_KEYED = _FEATURED.replace("keyed AS (", "keyed0 AS (") + ", keyed AS (SELECT * REPLACE (id % 4 = 0 AS eh_fronteira) FROM keyed0)"


def _representatives(seed: int, n: int = sampling.REPRESENTATIVES) -> str:
    """SQL for the draw off the frontier: the finest grain that covers half, then largest remainders, then hash order."""
    share = lambda c: f"(SELECT sum(CASE WHEN n >= 2 THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE) FROM (SELECT count(*) AS n FROM keyed WHERE NOT eh_fronteira GROUP BY {c}))"
    return f"""(WITH s AS (SELECT id, CASE WHEN {share("estrato")} >= 0.5 THEN estrato WHEN {share("estrato_reduzido")} >= 0.5 THEN estrato_reduzido ELSE estrato_cluster END AS e, (id * 2654435761 + {seed}) % 4294967296 AS h FROM keyed WHERE NOT eh_fronteira),
  z AS (SELECT e, count(*) AS n FROM s GROUP BY 1 HAVING count(*) >= 2), x AS (SELECT *, {n}.0 * n / (SELECT sum(n) FROM z) AS x FROM z), r AS (SELECT *, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, n DESC, e) AS k FROM x),
  u AS (SELECT e, CASE WHEN (SELECT sum(n) FROM z) <= {n} THEN n ELSE least(n, floor(x) + CASE WHEN k <= {n} - (SELECT sum(floor(x)) FROM x) THEN 1 ELSE 0 END) END AS quota FROM r),
  p AS (SELECT id, e, row_number() OVER (PARTITION BY e ORDER BY h, id) AS place FROM s) SELECT id FROM p JOIN u USING (e) WHERE place <= quota)"""


@query(f"WITH {_KEYED} SELECT id FROM {_representatives(42)}")
def representative_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.representatives(_features(spark, d), order=sampling.seeded(F.col("id"), 42)).select("id")


_ENTROPY = "round(-(" + " + ".join(f"(greatest(s{i}, 1e-12) / w) * ln(greatest(s{i}, 1e-12) / w)" for i in range(6)) + "), 6)"
_WIDTH = " + ".join(f"greatest(s{i}, 1e-12)" for i in range(6))


@query(
    f"WITH {_KEYED} "
    + " UNION ALL ".join(
        f"SELECT id, {seed} AS semente, 'representativo' AS criterio FROM {_representatives(seed)} UNION ALL SELECT id, {seed}, 'fronteira' FROM "
        f"(SELECT id FROM (SELECT *, {_WIDTH} AS w FROM keyed) WHERE eh_fronteira ORDER BY {_ENTROPY} DESC, (id * 2654435761 + {seed}) % 4294967296, id LIMIT {sampling.FRONTIER})"
        for seed in sampling.SEEDS
    )
)
def sample_draws(spark: SparkSession, d: str) -> DataFrame:
    return sampling.draws(_features(spark, d), order=sampling.seeded).select("id", "semente", "criterio")


_ORDER = "(doc_id * 2654435761 + 42) % 4294967296"


@query(f"""WITH s AS (SELECT doc_id AS id, source AS estrato, lang, {_ORDER} AS h FROM documents), z AS (SELECT estrato, count(*) AS n, least(count(*), greatest(1, round_even(count(*) * 60 / CAST((SELECT count(*) FROM s) AS DOUBLE), 0))) AS quota FROM s GROUP BY 1),
  p AS (SELECT id, estrato, h, row_number() OVER (PARTITION BY estrato ORDER BY h, id) AS place FROM s), c AS (SELECT id FROM p JOIN z USING (estrato) WHERE place <= quota ORDER BY h, id LIMIT 60),
  b AS (SELECT id FROM s WHERE lang = 'fr' AND id NOT IN (SELECT id FROM c) ORDER BY h, id LIMIT 20) SELECT id, 'calibracao' AS subsample FROM c UNION ALL SELECT id, 'calibracao_juridica' FROM b""")
def pilot_boost(spark: SparkSession, d: str) -> DataFrame:
    own, by = corpus(spark, d), sampling.seeded(F.col("id"), 42)
    drawn = sampling.pilot(own.select("id", F.col("journal").alias("estrato")), 60, "estrato", "id", 42, by).select("id")
    more = sampling.boost(own.filter("idioma = 'fr'").select("id"), drawn, 20, "id", 42, by)
    return drawn.withColumn("subsample", F.lit("calibracao")).unionByName(more.withColumn("subsample", F.lit("calibracao_juridica")))


@query(f"SELECT doc_id AS id, CASE WHEN ({_ORDER}) % 10000 / 10000.0 < 0.15 THEN 'test' WHEN ({_ORDER}) % 10000 / 10000.0 < 0.3 THEN 'validation' ELSE 'train' END AS part FROM documents")
def split_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Every work is its own stratum, so the split can't be by strata."""
    own = corpus(spark, d).withColumn("unico", F.col("id").cast("string"))
    return sampling.split(own, "unico", "id", 42, order=sampling.seeded(F.col("id"), 42)).select("id", "part")


# summaries


@query("SELECT DISTINCT CAST(2000 + doc_id % 25 AS INTEGER) AS ano FROM documents ORDER BY 1")
def year_list(spark: SparkSession, d: str) -> DataFrame:
    return clean.distinct_sorted(corpus(spark, d), "ano")


@query("SELECT doc_id AS id, lang AS idioma, NULL AS toxic FROM documents UNION ALL SELECT doc_id, NULL, toxic FROM labels")
def ragged_rows(spark: SparkSession, d: str) -> DataFrame:
    return clean.bind_rows(corpus(spark, d).select("id", "idioma"), table(spark, d, "labels").select(F.col("doc_id").alias("id"), "toxic"))


@query("""WITH x AS (SELECT CAST((doc_id * 5) % 13 AS DOUBLE) / 10 AS p, CAST((doc_id * 7) % 13 AS DOUBLE) / 10 AS i, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST((doc_id * 3) % 13 AS DOUBLE) / 10 END AS dn, quality AND toxic AS mixed, quality + toxic + doc_id % 2 = 0 AS zero FROM (SELECT doc_id, quality, toxic FROM labels)),
  y AS (SELECT count(*) AS n, count(*) FILTER (coalesce(dn, 0) >= 0.5) AS n_dn, count(*) FILTER (mixed) AS n_mixed, count(*) FILTER (zero) AS n_inconclusiva, count(*) FILTER (p < 0.5 AND i < 0.5 AND coalesce(dn, 0) < 0.5) AS n_all_zero FROM x)
  SELECT *, round(100.0 * n_dn / n, 2) AS pct_dn, round(100.0 * n_mixed / n, 2) AS pct_mixed, round(100.0 * n_inconclusiva / n, 2) AS pct_inconclusiva, round(100.0 * n_all_zero / n, 2) AS pct_all_zero FROM y""")
def prepass_summary(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "labels").select("doc_id", F.col("quality").alias(S.FLAGS[0]), F.col("toxic").alias(S.FLAGS[1]), (F.col("doc_id") % 2).cast("int").alias(S.FLAGS[2]))
    score = lambda k: ((F.col("doc_id") * k) % 13).cast("double") / 10
    own = S.derive(own).withColumns({"score_positivista": score(5), "score_interpretativa": score(7), "score_doutrinario_normativa": F.when(F.col("doc_id") % 9 != 0, score(3))})
    return annotations.prepass_summary(own)


@query("""WITH n AS (SELECT CASE doc_id % 5 WHEN 0 THEN 'dn:ambos ok' WHEN 1 THEN 'dn:modo' WHEN 2 THEN 'x dn:norm y' WHEN 3 THEN 'no tag' END AS t FROM labels WHERE toxic = 1)
  SELECT CASE WHEN t LIKE '%dn:ambos%' THEN 'ambos' WHEN t LIKE '%dn:modo%' THEN 'modo' WHEN t LIKE '%dn:norm%' THEN 'norm' ELSE 'none' END AS subtag, count(*) AS n FROM n GROUP BY 1""")
def subtag_counts(spark: SparkSession, d: str) -> DataFrame:
    notes = F.get(F.array(*map(F.lit, ("dn:ambos ok", "dn:modo", "x dn:norm y", "no tag"))), (F.col("doc_id") % 5).cast("int"))
    return annotations.subtags(table(spark, d, "labels").select(F.col("toxic").alias(S.FLAGS[2]), notes.alias("notas")))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS quando, substring(sha256(props), 1, 12) AS versao FROM events")
def iso_stamps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", T.iso_utc(F.col("ts")).alias("quando"), T.prompt_version(F.col("props")).alias("versao"))


@query(f"WITH {_TOKENS}, t AS (SELECT term, count(*) AS df, sum(tf) AS f FROM terms GROUP BY 1 HAVING count(*) >= 5) SELECT term, round(ln((SELECT count(*) FROM documents) / CAST(df AS DOUBLE)) * f / df, 6) AS tfidf_medio FROM t ORDER BY 2 DESC, 1 LIMIT 10")
def top_terms(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    own = terms.tfidf(terms.document_terms(c, "abstract"), c.count(), 5).select("term", F.round("tfidf_medio", 6).alias("tfidf_medio"))
    return terms.top_terms(own)


@query(f"WITH {_EDGES} SELECT node, degree, o_orderpriority AS prioridade FROM deg LEFT JOIN orders ON o_orderkey = node ORDER BY degree DESC, node LIMIT 5")
def top_nodes(spark: SparkSession, d: str) -> DataFrame:
    metadata = table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_orderpriority").alias("prioridade"))
    return networks.top(networks.with_metadata(graph.degrees(_graph(spark, d)).select("node", "degree"), metadata), "degree", 5, "node")


@query(f"SELECT a, b, CAST(weight AS DOUBLE) AS weight FROM ({pair_sql('l_orderkey', 'l_partkey', 3)})")
def weighted_edges(spark: SparkSession, d: str) -> DataFrame:
    found = networks.cocitation(citations(spark, d), 3)
    return graph.weighted(found.select(F.col("a").alias("de"), F.col("b").alias("para"), F.col("weight").alias("n_co_artigos")), "de", "para")


# agreement


@query(f"""WITH {_AGREE}, y AS (SELECT items, m, rb, ga / rb AS prime_pa, pk, pl, pa, (pa - pk) / (1 - pk) AS kappa, (ga / rb - pl) / (1 - pl) AS prime FROM z),
  o AS (SELECT c.item, any_value(i.n) AS n, any_value(i.g) AS g, sum(c.r * s.share / t.items) AS ck, sum(c.r * s.votes / (t.m * t.rb)) AS cl FROM c JOIN i ON i.item = c.item JOIN s ON s.k = c.k, t GROUP BY c.item),
  q AS (SELECT items, m, n, kappa, prime, items / CAST(m AS DOUBLE) * CASE WHEN n >= 2 THEN g / (n * (n - 1)) - pk ELSE 0 END / (1 - pk) - 2 * (1 - kappa) * (ck / n - pk) / (1 - pk) AS ki,
    CASE WHEN n >= 2 THEN (g / (rb * (n - 1)) - prime_pa * (n - rb) / rb - pl) / (1 - pl) - 2 * (1 - prime) * (cl / rb - (n - rb) / rb - pl) / (1 - pl) END AS ai FROM o, y)
  SELECT round(sqrt(sum((ai - prime) ** 2) / max(CAST(m AS DOUBLE) * (m - 1))), 8) AS alpha_se, round(sqrt(sum((ki - kappa) ** 2) / max(CAST(items AS DOUBLE) * (items - 1))), 8) AS kappa_se FROM q""")
def agreement_errors(spark: SparkSession, d: str) -> DataFrame:
    own = agreement.coefficients(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag")
    return own.select(F.round("alpha_se", 8).alias("alpha_se"), F.round("kappa_se", 8).alias("kappa_se"))


@query(f"WITH {_AGREE} SELECT round(alpha, 6) AS alpha, round(kappa, 6) AS kappa FROM v")
def agreement_single(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    one, two = agreement.alpha(li, "l_orderkey", "l_returnflag"), agreement.fleiss_kappa(li, "l_orderkey", "l_returnflag")
    return one.crossJoin(two).select(F.round("alpha", 6).alias("alpha"), F.round("kappa", 6).alias("kappa"))  # one row each


# models


@query("""WITH l AS (SELECT doc_id AS id, (doc_id % 9 - 4) / 2.0 AS a, (doc_id % 7 - 3) / 2.0 AS b, (doc_id % 5 - 2) / 2.0 AS c FROM documents), p AS (SELECT id, 1 / (1 + exp(-a)) AS a, 1 / (1 + exp(-b)) AS b, 1 / (1 + exp(-c)) AS c FROM l)
  SELECT id, CAST(a >= 0.5 AS INTEGER) AS positivista, CASE WHEN a >= 0.5 AND b >= 0.5 THEN 'mixed' WHEN a >= 0.5 THEN 'positivista' WHEN b >= 0.5 THEN 'interpretativa' ELSE 'nenhuma' END AS orientacao,
  CAST(a < 0.5 AND b < 0.5 AND c < 0.5 AS INTEGER) AS inconclusiva, round((2 * abs(a - 0.5) + 2 * abs(b - 0.5) + 2 * abs(c - 0.5)) / 3, 6) AS certeza FROM p""")
def apply_flags(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("id")
    out = models.apply_flags(corpus(spark, d).select("id", ((x % 9 - 4) / 2).alias("la"), ((x % 7 - 3) / 2).alias("lb"), ((x % 5 - 2) / 2).alias("lc")), ["la", "lb", "lc"])
    return out.select("id", F.col(S.FLAGS[0]).alias("positivista"), F.col("orientacao_proeminente").alias("orientacao"), "inconclusiva", F.round("epi_certeza", 6).alias("certeza"))


_PATTERN = "(?i)(?:" + "|".join(T.INJECTION_MARKS).replace("'", "''") + ")"


@query(f"SELECT conv_id, turn, CASE WHEN regexp_matches(role || chr(10) || text, '{_PATTERN}') THEN 'suspeito' ELSE 'limpo' END AS grupo FROM conversations")
def suspects(spark: SparkSession, d: str) -> DataFrame:
    good, bad = clean.split_suspects(table(spark, d, "conversations"), "role", "text")
    mark = lambda df, name: df.select("conv_id", "turn", F.lit(name).alias("grupo"))
    return mark(good, "limpo").unionByName(mark(bad, "suspeito"))


# replies, terms, disputes, reports


@query("""WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' ELSE 'no reply' END AS t FROM events)
  SELECT event_id, TRY_CAST(json_extract_string(CASE WHEN json_valid(regexp_extract(t, '(?s)\\{.*\\}')) THEN regexp_extract(t, '(?s)\\{.*\\}') END, '$.k') AS DOUBLE) AS k, NOT (regexp_extract(t, '(?s)\\{.*\\}') <> '' AND json_valid(regexp_extract(t, '(?s)\\{.*\\}'))) AS fallback FROM r""")
def fenced_replies(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("event_id") % 3
    reply = F.when(m == 0, F.col("props")).when(m == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise("no reply")
    own = table(spark, d, "events").select("event_id", reply.alias("t"))
    return own.select("event_id", T.parse_fenced_reply(F.col("t"), ["k"]).alias("x")).select("event_id", "x.k", "x.fallback")


@query(f"WITH {CORPUS}, t AS (SELECT id, unnest(string_split_regex(titulo || ';' || idioma || '|' || journal, '[,;|]\\s*')) AS term FROM corpus) SELECT id, term, count(*) AS n FROM t GROUP BY 1, 2")
def term_lists(spark: SparkSession, d: str) -> DataFrame:
    joined = F.concat(F.col("titulo"), F.lit(";"), F.col("idioma"), F.lit("|"), F.col("journal"))
    return corpus(spark, d).select("id", F.explode(T.split_terms(joined)).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"))


_VOTES = "a AS (SELECT doc_id, k, ['si', 'ps', 'sts', 'law', 'pa', 'bcs'][CAST((doc_id * (1 + k * (doc_id % 2))) % 6 AS INTEGER) + 1] AS c, CASE WHEN (doc_id + k) % 3 = 0 THEN 1 ELSE 0 END AS p, toxic FROM labels, (SELECT unnest([0, 1, 2]) AS k))"


@query(f"""WITH {_VOTES} SELECT CAST(doc_id AS VARCHAR) AS id_artigo, string_agg(c, '|' ORDER BY k) AS votos_cluster_primario, string_agg(CAST(p AS VARCHAR), '|' ORDER BY k) AS votos_epi_positivista, '0|0|0' AS votos_epi_interpretativa,
  string_agg(CAST(toxic AS VARCHAR), '|' ORDER BY k) AS votos_epi_doutrinario_normativa FROM a GROUP BY doc_id HAVING count(DISTINCT c) = 3""")
def disputed_votes(spark: SparkSession, d: str) -> DataFrame:
    own = stored(annotations.flatten(_tasks(spark, d)), "annotations")
    return annotations.disputes(own, annotations.gold(own))


@query(f"""WITH {_VOTES}, g AS (SELECT doc_id, count(DISTINCT c) = 3 AS d FROM a GROUP BY 1)
  SELECT 'ok' AS status, (SELECT count(*) FROM a) AS n_anotacoes, CAST(3 AS BIGINT) AS n_anotadores_unicos, (SELECT count(*) FROM g) AS n_artigos, (SELECT count(*) FROM g WHERE d) AS n_disputas, true AS gate_possivel""")
def gold_report(spark: SparkSession, d: str) -> DataFrame:
    own = stored(annotations.flatten(_tasks(spark, d)), "annotations")
    return annotations.gold_report(own, annotations.gold(own))


@query(f"""WITH RECURSIVE {_TITLES}, w AS (SELECT a AS u, b AS v FROM p UNION SELECT b, a FROM p), r AS (SELECT u AS id, u AS reach FROM w UNION SELECT r.id, w.v FROM r JOIN w ON r.reach = w.u), c AS (SELECT id, min(reach) AS component FROM r GROUP BY 1)
  SELECT (SELECT count(*) FROM corpus) AS n_total, (SELECT count(*) FROM p) AS n_pairs, (SELECT count(DISTINCT component) FROM c) AS n_groups, (SELECT count(*) - count(DISTINCT component) FROM c) AS n_marked, (SELECT CAST(least(20, count(*)) AS INTEGER) FROM p) AS n_sample, CAST(0.92 AS DOUBLE) AS threshold""")
def dedup_summary(spark: SparkSession, d: str) -> DataFrame:
    own = _titles(spark, d)
    fuzzy = dedup.Fuzzy(own)
    out = dedup.fuzzy_report(own, fuzzy, stored(dedup.duplicate_groups(own, fuzzy.links()), "groups"))
    return out.select("n_total", "n_pairs", "n_groups", "n_marked", F.size("sample").alias("n_sample"), "threshold")


@query(f"""WITH {_EDGES}, l AS (SELECT u, v, weight AS w, u % 3 = v % 3 AS same FROM w), s AS (SELECT u % 3 AS c, sum(weight) AS s FROM w GROUP BY 1)
  SELECT round((SELECT CAST(sum(CASE WHEN same THEN w ELSE 0 END) AS DOUBLE) / sum(w) FROM l) - (SELECT sum(CAST(s AS DOUBLE) * s) FROM s) / (SELECT CAST(sum(w) AS DOUBLE) * sum(w) FROM l), 4) AS modularity""")
def modularity(spark: SparkSession, d: str) -> DataFrame:
    """Of a fixed partition; that of Louvain's is in the network report."""
    edges = _graph(spark, d)
    return graph.modularity(edges, graph.nodes(edges).withColumn("community", F.col("node") % 3))


def _lloyd_sql(k: int, steps: int) -> str:
    """Steps one after the other: centres c0, members m0, centres c1, ..."""
    out = [f"v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS g, e FROM v ORDER BY vec_id LIMIT {k})"]
    near = lambda i: f"m{i} AS (SELECT vec_id, any_value(v.label) AS label, any_value(v.e) AS e, arg_min(g, (list_distance(v.e, c.e), g)) AS g FROM v, c{i} c GROUP BY vec_id)"
    for i in range(steps):
        out += [near(i), f"u{i} AS (SELECT g, unnest(e) AS x, generate_subscripts(e, 1) AS dim FROM m{i}), a{i} AS (SELECT g, dim, avg(x) AS x FROM u{i} GROUP BY 1, 2)"]
        out += [f"c{i + 1} AS (SELECT c.g, coalesce(n.e, c.e) AS e FROM c{i} c LEFT JOIN (SELECT g, list(x ORDER BY dim) AS e FROM a{i} GROUP BY g) n ON n.g = c.g)"]
    return ", ".join([*out, near(steps)])


@query(f"WITH {_lloyd_sql(10, 3)} SELECT vec_id, CAST(g AS INTEGER) AS grupo FROM m3")
def kmeans_fixed(spark: SparkSession, d: str) -> DataFrame:
    return models.lloyd(table(spark, d, "embeddings"), 10, 3, "vec_id").select("vec_id", "grupo")
