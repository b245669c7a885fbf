"""Draws, quantiles, term pairs, language, joins, collection, models' helpers."""

import collections
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from biblioscope.functions import similarity
from biblioscope.functions import text as T
from biblioscope.operators import annotations, clean, graph, models, sampling, terms, validity
from biblioscope.sources import api, files, provenance


@pytest.mark.parametrize("values", [[1.0], [5.0] * 9, [0.0, 1.0], [1, 2, 3, 4, 5, 6, 7], [0.0] * 500 + [1e9], list(np.random.default_rng(1).zipf(1.5, 2000) % 100_000)])
def test_quantiles(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    shares = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)
    assert sampling.quantiles(df, "v", shares) == pytest.approx(np.quantile(np.array(values, float), shares).tolist())


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, 1)], "v double, k int")
    assert sampling.quantiles(df, "v", (0.5,)) == [] and sampling.quartile(df, "v").first().quartil_citacoes is None


@pytest.mark.parametrize("order", ["hash", "skewed"])
def test_first_of_strata(spark, order):
    """One stratum has most rows; an order that isn't spread evenly takes the other way with the same result."""
    rows = [(i, "hot" if i % 10 else f"s{i % 7}") for i in range(3000)] + [(9999, None)]
    df = spark.createDataFrame(rows, "id bigint, s string")
    by = sampling.seeded(F.col("id"), 3) if order == "hash" else F.lit(sampling.ORDER - 1) - F.col("id")
    rank = {i: ((i * 2654435761 + 3) % 2**32 if order == "hash" else -i, i) for i, _ in rows}
    quotas = df.groupBy("s").agg(F.count(F.lit(1)).alias("n")).withColumn("quota", F.least(F.col("n"), F.lit(40)))
    found = collections.defaultdict(set)
    for r in sampling.first_of(df, "s", quotas, "id", by).collect():
        found[r.s].add(r.id)
    for s in {s for _, s in rows}:
        assert found[s] == set(sorted((i for i, t in rows if t == s), key=rank.get)[:40])


@pytest.mark.parametrize("order", ["hash", "skewed"])
@pytest.mark.parametrize("shares", [(0.15, 0.3), (0.2, 0.4, 0.6, 0.8), (0.0, 1.0)])
def test_numbered_parts(spark, order, shares):
    rows = [(i, "hot" if i % 10 else f"s{i % 7}") for i in range(4000)] + [(9999, None), (9998, "one")]
    df = spark.createDataFrame(rows, "id bigint, s string")
    by = sampling.seeded(F.col("id"), 3) if order == "hash" else F.lit(sampling.ORDER - 1) - F.col("id")
    rank = {i: ((i * 2654435761 + 3) % 2**32 if order == "hash" else -i, i) for i, _ in rows}
    out = {r.id: r.part for r in sampling.numbered_part(df, "s", "id", by, shares, "part").collect()}
    assert len(out) == len(rows)
    for s in {s for _, s in rows}:
        own = sorted((i for i, t in rows if t == s), key=rank.get)
        cuts = [math.floor(len(own) * x + 0.5) for x in shares]
        assert [out[i] for i in own] == [sum(k >= c for c in cuts) for k in range(len(own))]


def test_term_pairs(spark, monkeypatch):
    monkeypatch.setattr(terms, "HELD", 7)
    rng = np.random.default_rng(3)
    docs = [sorted({f"t{int(x)}" for x in rng.zipf(1.4, 12) if x < 40}) for _ in range(60)]
    df = collections.Counter(t for d in docs for t in d)
    rows = [(i, t) for i, d in enumerate(docs) for t in d]
    rows += rows[:5]  # repeated rows count once
    table = spark.createDataFrame(rows, "id int, term string")
    vocabulary = spark.createDataFrame(sorted(df.items()), "term string, df bigint")
    want = collections.Counter(p for d in docs for p in itertools.combinations(d, 2) if min(df[p[0]], df[p[1]]) >= 3)
    out = {(r.a, r.b): (r.weight, r.da, r.db) for r in terms.term_pairs(table, vocabulary, 3).collect()}
    assert out == {p: (n, df[p[0]], df[p[1]]) for p, n in want.items() if n >= 3} and len(out) > 10
    assert terms.term_pairs(table.limit(0), vocabulary, 1).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_similarity_bound(seed):
    """No pair is above its bound, and the linear matching is the plain one."""
    import pandas as pd

    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdé中"), rng.integers(0, 12))) for _ in range(60)]
    pairs = list(itertools.product(words, words))
    a, b = pd.Series([x for x, _ in pairs]), pd.Series([y for _, y in pairs])
    bound = similarity.highest(a, b)

    def plain(x, y):
        reach, used, mine = max(len(x), len(y)) // 2 - 1, set(), []
        for i, c in enumerate(x):
            j = next((j for j in range(max(0, i - reach), min(len(y), i + reach + 1)) if j not in used and y[j] == c), None)
            if j is not None:
                used.add(j)
                mine.append(c)
        if not mine:
            return 0.0
        m, swaps = len(mine), sum(c != y[j] for c, j in zip(mine, sorted(used), strict=True)) // 2
        return (m / len(x) + m / len(y) + (m - swaps) / m) / 3

    for k, (x, y) in enumerate(pairs):
        if x and y and x != y:
            assert similarity.jaro(x, y) == pytest.approx(plain(x, y)), (x, y)
        assert similarity.jaro_winkler_of(x, y) <= bound[k] + 1e-12


def test_iterations_by_joins_and_in_one_task(spark):
    rng = np.random.default_rng(9)
    rows = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 12, 40), rng.integers(0, 12, 40), rng.integers(1, 5, 40), strict=True) if a < b]
    edges = spark.createDataFrame(list({(a, b): (a, b, w) for a, b, w in rows}.values()), "a int, b int, weight double")
    for name in ("pagerank", "eigenvector"):
        one, many = ({r.node: r[1] for r in getattr(graph, name)(edges, small=n).collect()} for n in (1000, 0))
        assert one == pytest.approx(many, abs=1e-6) and len(one) > 5
        assert getattr(graph, name)(edges.limit(0)).count() == getattr(graph, name)(edges.limit(0), small=0).count() == 0
    with pytest.raises(Exception, match="still move"):
        graph.eigenvector(edges, most=1).collect()


def test_languages(spark):
    rows = [(1, "the cat and the dog of this house", None), (2, "le chat et les chiens dans une maison", None), (3, "o gato e os cães da casa em uma rua", None), (4, "the cat and the dog", "PT"), (5, "the and of", None), (6, None, None), (7, "zzz yyy xxx www vvv uuu ttt", None), (8, "the dog of der Hund und the", None)]
    out = {r.id: (r.idioma_detectado, r.idioma_confianca) for r in clean.detect_languages(spark.createDataFrame(rows, "id int, t string, l string"), "t", "l").collect()}
    assert out == {1: ("en", 1.0), 2: ("fr", 1.0), 3: ("pt", 1.0), 4: ("PT", 1.0), 5: (None, None), 6: (None, None), 7: (None, None), 8: ("en", 1.0)}
    assert len({w for own in T.FUNCTION_WORDS.values() for w in own}) >= sum(map(len, T.FUNCTION_WORDS.values())) - 2
    df = spark.createDataFrame([(1, "PT"), (2, "en"), (3, None)], "id int, idioma_detectado string")
    assert [clean.language_cell(df, x).count() for x in ("pt", "en", None, "fr")] == [1, 1, 3, 3]


def test_joins_for_training(spark):
    gold = spark.createDataFrame([("1", "si", "old"), ("9", "ps", None)], "id_artigo string, cluster_primario string, titulo string")
    works = spark.createDataFrame([(1, "new", "x"), (2, "other", "y")], "id bigint, titulo string, abstract string")
    assert [(r.id_artigo, r.titulo, r.abstract) for r in annotations.with_texts(gold, works).collect()] == [("1", "new", "x")]
    assert {(r.id_artigo, r.titulo) for r in annotations.with_metadata(gold, works).collect()} == {("1", "new"), ("9", None)}
    with pytest.raises(ValueError, match="corpus"):
        sampling.scored_corpus(spark.createDataFrame([(7, 1)], "id bigint, s int"), works)
    with pytest.raises(ValueError, match="empty"):
        sampling.boost(works.limit(0), works, 3, "id", 1)
    assert {r.id for r in sampling.boost(works, works.filter("id = 1"), 3, "id", 1).collect()} == {2}


def test_lexicons(spark):
    topics = spark.createDataFrame([("si", 1, ["Alpha", "beta", "beta", "x"]), ("ps", 2, []), ("ps", 2, []), ("law", 3, None)], "cluster_origem string, topic_id int, top_terms array<string>")
    lex = validity.lexicon(spark.createDataFrame([("si", "alpha"), ("si", "beta"), ("ps", "x"), ("other", "x"), ("si", "alpha ")], "cluster string, lemma string"))
    out = validity.score_topics(topics, lex).collect()
    assert len(out) == 4
    one = next(r for r in out if r.topic_id == 1)
    assert (one.jaccard_si, one.jaccard_ps, one.cobertura_si, one.jaccard_law, one.cluster_vencedor, one.valido) == (pytest.approx(2 / 3), pytest.approx(1 / 3), pytest.approx(2 / 3), 0.0, "si", True)
    assert all(r.max_jaccard == 0 for r in out if r.topic_id == 2)


def test_mean_pool(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), (2, [[1.0, 2.0]], [0]), (3, [], [])], "id int, t array<array<double>>, m array<int>")
    assert {r.id: r.p for r in df.select("id", models.mean_pool(F.col("t"), F.col("m")).alias("p")).collect()} == {1: [2.0, 3.0], 2: [0.0, 0.0], 3: []}


def test_safe_map(spark):
    def half(row):
        return {"y": 10 // row["x"], "z": str(row["x"])}

    out = {r.z: r for r in models.safe_map(spark.createDataFrame([(5,), (0,), (2,)], "x int"), half, "y int, z string").collect()}
    assert out["5"].y == 2 and out["2"].y == 5 and out[None].y is None and "ZeroDivisionError" in out[None].erro


def test_retries_wait(spark):
    waits = models.score_with(spark.createDataFrame([("a",), ("b",)], "p string").coalesce(1), lambda own: (_ for _ in ()).throw(TimeoutError()), "p", retries=2, wait=0.01)
    assert [r.resposta for r in waits.collect()] == [None, None]


def test_silhouette(spark):
    rows = [(i, [float(i % 2 * 10), float(i % 3) / 10]) for i in range(30)]
    own = models.cluster(spark.createDataFrame(rows, "id int, embedding array<double>"), 2)
    assert models.silhouette(own) > 0.9


def test_lloyd(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.5, (20, 3)) for c in (0, 5, 10)])[rng.permutation(60)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, embedding array<double>")
    centres = x[:4].copy()
    for _ in range(3):
        own = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([x[own == k].mean(0) if (own == k).any() else centres[k] for k in range(4)])
    want = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert {r.id: r.grupo for r in models.lloyd(df, 4, 3, "id").collect()} == dict(enumerate(want.tolist()))
    assert models.lloyd(df.limit(0), 4, 2, "id").count() == 0


def test_collect_goes_on(spark, tmp_path):
    read_, path = [], f"file://{tmp_path}/works"

    def read(sources):
        if "bad" in sources:
            raise OSError("gone")
        read_.append(sources)
        return spark.createDataFrame([(s, f"{{{s}}}") for s in sources if s != "none"], "source_id string, work string")

    names = [f"s{i}" for i in range(6)] + ["none", "bad"]
    with pytest.raises(OSError):
        api.collect(spark, names, path, read, every=3)
    assert read_ == [["s0", "s1", "s2"], ["s3", "s4", "s5"]]
    out = api.collect(spark, [n for n in names if n != "bad"], path, read, every=3)
    assert read_[2:] == [["none"]] and sorted(r.source_id for r in out.collect()) == names[:6]
    assert api.collect(spark, names[:7], path, read).count() == 6 and len(read_) == 3
    assert api.collect(spark, [], f"{path}-none", read).count() == 0


def test_abstracts():
    asked, waits = [], []

    def fetch(url):
        asked.append(url)
        if "doi%3A" in url:
            return {"results": [{"doi": url, "abstract_inverted_index": None if "10.2" in url else {"a": [0]}}]}
        n = len(asked)
        return {"results": [{"id": f"{n}-{k}", "abstract_inverted_index": {"a": [0]} if k else {}} for k in range(3)], "meta": {"next_cursor": str(n) if n < 9 else None}}

    assert len(list(api.abstracts("http://x", ["10.1/A", "10.2/b", "10.3/c"], fetch=fetch, sleep=waits.append))) == 2 and waits == [api.PAUSE] * 3
    asked.clear()
    assert len(list(api.abstracts("http://x", where="type:article", most=5, fetch=fetch, sleep=waits.append))) == 5 and len(asked) == 3


def test_matrix_and_checked_tables(spark, tmp_path):
    df = spark.createDataFrame([("b", [1.0, 2.0]), ("a", [3.0, 4.0])], "doc_id string, embedding array<double>")
    assert files.write_matrix(df, f"{tmp_path}/m.npy") == (2, 2)
    assert np.load(f"{tmp_path}/m.npy").tolist() == [[3.0, 4.0], [1.0, 2.0]]
    back = files.read_matrix(spark, f"{tmp_path}/m.npy", df.select("doc_id").orderBy("doc_id"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert files.write_matrix(df.limit(0), f"{tmp_path}/e.npy") == (0, 0)
    out = files.write_checked(df, f"file://{tmp_path}/t", "embedding array<double>, doc_id string")
    assert out.columns == ["embedding", "doc_id"] and out.count() == 2
    for schema in ("doc_id string", "doc_id int, embedding array<double>", "doc_id string, embedding array<double>, more int"):
        with pytest.raises(ValueError):
            files.write_checked(df, f"file://{tmp_path}/u", schema)


def test_logger(tmp_path):
    own = provenance.logger("biblioscope-test", tmp_path)
    own.info("hello")
    assert provenance.logger("biblioscope-test", tmp_path) is own and len(own.handlers) == 2
    assert "hello" in (tmp_path / "biblioscope-test.log").read_text()


def test_chat_client(monkeypatch):
    import io
    import json

    seen = []

    def urlopen(request, timeout):
        seen.append(json.loads(request.data))
        return io.BytesIO(json.dumps({"choices": [{"message": {"content": "yes"}}]}).encode())

    monkeypatch.setattr(models.urllib.request, "urlopen", urlopen)
    assert models.chat_client("http://x", "m", "be brief", "k")(["a", "b"]) == ["yes", "yes"]
    assert [(x["temperature"], x["seed"], x["messages"][1]["content"]) for x in seen] == [(0.0, 42, "a"), (0.0, 42, "b")]


def test_pmi_of_terms_always_together(spark):
    rows = [(i, t) for i in range(10) for t in (("a", "b") if i < 5 else ("c",))]
    out = terms.cooccurrence(spark.createDataFrame(rows, "id int, term string"), spark.createDataFrame([("a",), ("b",), ("c",)], "term string"), 10).collect()
    assert [(r.a, r.b, r.n_co_artigos) for r in out] == [("a", "b", 5)] and out[0].pmi == pytest.approx(1) and math.isclose(out[0].npmi, 1)
