"""Classifiers over text features, and scoring by pluggable functions. MLlib stands in for large encoders; inputs and outputs are the same."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF, NGram, StringIndexer, Tokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T


def text_features(column: str = "texto", buckets: int = 1 << 14) -> list:
    """Stages from text to hashed TF-IDF in `features`."""
    return [Tokenizer(inputCol=column, outputCol="_words"), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=buckets), IDF(inputCol="_tf", outputCol="features")]


def tfidf(df: DataFrame, column: str = "texto", size: int = 2000) -> DataFrame:
    """Adds `tfidf` over the `size` commonest uni- and bigrams (as a vector)."""
    words = Tokenizer(inputCol=column, outputCol="_words").transform(df)
    both = NGram(n=2, inputCol="_words", outputCol="_pairs").transform(words).withColumn("_terms", F.concat("_words", "_pairs"))
    counts = CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=size).fit(both).transform(both)
    return IDF(inputCol="_tf", outputCol="tfidf").fit(counts).transform(counts).drop("_words", "_pairs", "_terms", "_tf")


def pair_text(title: Column, abstract: Column) -> Column:
    """What a classifier reads: title and abstract."""
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit("")))


def train_single_label(df: DataFrame, label: str, column: str = "texto", regularisation: float = 0.01) -> PipelineModel:
    return Pipeline(stages=[StringIndexer(inputCol=label, outputCol="_y", handleInvalid="skip"), *text_features(column), LogisticRegression(labelCol="_y", family="multinomial", regParam=regularisation)]).fit(df)


def positive_weight(df: DataFrame, label: str, cap: float = S.WEIGHT_CAP) -> float:
    """Negatives over positives, capped; 1 without positives."""
    row = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    return min(row.n / row.p, cap) if row.p else 1.0


def train_flags(df: DataFrame, labels: Sequence[str], column: str = "texto", regularisation: float = 0.01) -> dict[str, PipelineModel]:
    """One weighted binary model for each flag."""
    out = {}
    for label in labels:
        own = df.withColumns({"_y": F.col(label).cast("double"), "_w": F.when(F.col(label) == 1, positive_weight(df, label)).otherwise(1.0)})
        out[label] = Pipeline(stages=[*text_features(column), LogisticRegression(labelCol="_y", weightCol="_w", regParam=regularisation)]).fit(own)
    return out


def enough(df: DataFrame, least: int) -> bool:
    return df.limit(least).count() >= least


def grid(cells: Sequence[tuple[str, DataFrame]], label: str, seeds: Sequence[int], split: Callable[[DataFrame, int], DataFrame], evaluate: Callable[[DataFrame], DataFrame], done: set[tuple[str, int]] = frozenset(), least: int = 30) -> list[tuple[str, int, str, dict]]:
    """Trains each cell by each seed unless it is done; rows (cell, seed, status, metrics on the test part)."""
    out = []
    for name, df in cells:
        for seed in seeds:
            if (name, seed) in done:
                continue
            if not enough(df, least):
                out.append((name, seed, "dados_insuficientes", {}))
                continue
            parts = split(df, seed)
            fitted = train_single_label(parts.filter("part = 'train'"), label)
            scored = fitted.transform(parts.filter("part = 'test'"))
            out.append((name, seed, "ok", evaluate(scored).first().asDict()))
    return out


def cluster(df: DataFrame, k: int = 3, seed: int = 42, features: str = "embedding") -> DataFrame:
    """Adds `grupo` by k-means over an array column."""
    own = df.withColumn("_x", array_to_vector(F.col(features).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="grupo").fit(own).transform(own).drop("_x")


def lloyd(df: DataFrame, k: int, steps: int, key: str, features: str = "embedding") -> DataFrame:
    """Adds `grupo` (0 to k - 1) by Lloyd's k-means from the k rows of smallest key, so that it is the same on any cluster: `steps`
    times every row goes to its nearest centre (the first of equals) and centres become means; one without rows stays.

    Centres (k vectors) are literals of the plan; only their sums are shuffled."""
    rows = df.orderBy(key).limit(k).select(features).collect()
    centres = [[float(x) for x in r[0]] for r in rows]

    def nearest() -> Column:
        far = [F.aggregate(F.zip_with(features, F.array(*map(F.lit, c)), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x) for c in centres]
        return T.let(F.array(*far), lambda d: F.array_position(d, F.array_min(d)).cast("int") - 1)

    for _ in range(steps if centres else 0):
        sums = df.select(nearest().alias("grupo"), F.posexplode(features).alias("at", "x")).groupBy("grupo", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
        for r in sums.collect():
            centres[r.grupo][r.at] = r.x
    return df.withColumn("grupo", nearest()) if centres else df.withColumn("grupo", F.lit(None).cast("int"))


def silhouette(df: DataFrame, group: str = "grupo", features: str = "embedding") -> float:
    own = df.withColumn("_x", array_to_vector(F.col(features).cast("array<double>")))
    return ClusteringEvaluator(featuresCol="_x", predictionCol=group).evaluate(own)


def cross_validate(df: DataFrame, label: str, features: str, folds: int = 5, seed: int = 42, one_vs_rest: bool = False) -> DataFrame:
    """Rows (id, fold, truth, guess) of stratified folds by multinomial regression, or by one model for each class."""
    from .sampling import numbered_part, seeded_text

    dealt = numbered_part(df, label, "id", seeded_text(F.col("id"), seed), [k / folds for k in range(1, folds)], "fold")
    own = StringIndexer(inputCol=label, outputCol="_y").fit(df).transform(dealt)
    out = None
    for k in range(folds):
        base = LogisticRegression(labelCol="_y", featuresCol=features, regParam=0.01)
        model = (OneVsRest(classifier=base, labelCol="_y", featuresCol=features) if one_vs_rest else base).fit(own.filter(F.col("fold") != k))
        part = model.transform(own.filter(F.col("fold") == k)).select("id", "fold", F.col("_y").alias("truth"), F.col("prediction").alias("guess"))
        out = part if out is None else out.unionByName(part)
    return out


def mean_pool(token_vectors: Column, mask: Column) -> Column:
    """The mean of those token vectors (a list of lists of one length) whose mask is 1; zeros where none is; [] without tokens."""
    empty = F.transform(F.coalesce(F.get(token_vectors, F.lit(0)), F.array().cast("array<double>")), lambda v: F.lit(0.0))
    taken = F.zip_with(token_vectors, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    total = F.aggregate(taken, empty, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
    n = F.aggregate(mask, F.lit(0), lambda acc, m: acc + m.cast("int"))
    return F.transform(total, lambda x: x / F.greatest(n, F.lit(1)))


def score_with(df: DataFrame, client: Callable[[list[str]], list[str]], prompt: str, batch: int = 32, retries: int = 5, wait: float = 2.0) -> DataFrame:
    """df with a column `resposta`: the client's replies to the prompts, in batches. A batch that fails is tried again after
    wait, 2 wait, 4 wait, ... seconds; one that keeps failing gets null replies. See chat_client() for a client."""
    place = df.columns.index(prompt)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            replies: list[str | None] = []
            for at in range(0, len(pdf), batch):
                own = pdf.iloc[at : at + batch, place].tolist()
                for attempt in range(retries):
                    try:
                        replies += client(own)
                        break
                    except (OSError, TimeoutError):
                        if attempt == retries - 1:
                            replies += [None] * len(own)
                        else:
                            time.sleep(wait * 2**attempt)
            yield pdf.assign(resposta=replies)

    return df.mapInPandas(run, f"{schema}, resposta string")


def chat_client(url: str, model: str, system: str, key: str = "", temperature: float = 0.0, seed: int = 42, timeout: float = 60.0) -> Callable[[list[str]], list[str]]:
    """A client for score_with(): one chat completion for each prompt, over HTTP, with fixed temperature and seed."""

    def ask(prompts: list[str]) -> list[str]:
        out = []
        for prompt in prompts:
            body = {"model": model, "temperature": temperature, "seed": seed, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]}
            request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {}))
            with urllib.request.urlopen(request, timeout=timeout) as reply:  # noqa: S310
                out.append(json.load(reply)["choices"][0]["message"]["content"])
        return out

    return ask


def safe_map(df: DataFrame, function: Callable[[dict], dict], schema: str) -> DataFrame:
    """function over each row as a dict, in parallel; a row that fails gives nulls and its message in `erro` instead of ending the job."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                try:
                    found = function(row)
                    rows.append([*(found[n] for n in names), None])
                except Exception as error:  # noqa: BLE001
                    rows.append([*(None for _ in names), f"{type(error).__name__}: {error}"])
            yield pd.DataFrame(rows, columns=[*names, "erro"], dtype=object)

    return df.mapInPandas(run, f"{schema}, erro string")


def apply_clusters(df: DataFrame, logits: Sequence[str], clusters: Sequence[str] = S.CLUSTERS) -> DataFrame:
    """Adds probabilities, labels, runner-up and certainty of a single-label model's logits."""
    p = S.softmax([F.col(c) for c in logits])
    out = df.withColumns({f"cluster_{c}_prob": x for c, x in zip(clusters, p, strict=True)})
    own = [F.col(f"cluster_{c}_prob") for c in clusters]
    best = S.best_label(own, clusters)
    out = out.withColumns({f"cluster_{c}_pred": (best == c).cast("int") for c in clusters})
    return out.withColumns({"cluster_primario_pred": best, "cluster_secundario_pred": S.second_label(own, clusters), "cluster_certeza": F.greatest(*own)})


def apply_flags(df: DataFrame, logits: Sequence[str], flags: Sequence[str] = S.FLAGS) -> DataFrame:
    """Adds probabilities, 0/1 predictions, orientation and certainty of a multi-label model's logits."""
    out = df.withColumns({f"{f}_prob": S.sigmoid(F.col(x)) for f, x in zip(flags, logits, strict=True)})
    out = out.withColumns({f: (F.col(f"{f}_prob") >= 0.5).cast("int") for f in flags} | {f"{f}_pred": (F.col(f"{f}_prob") >= 0.5).cast("int") for f in flags})
    return S.derive(out).withColumn("epi_certeza", S.flag_certainty([F.col(f"{f}_prob") for f in flags]))


def probabilities(df: DataFrame, column: str = "probability") -> DataFrame:
    return df.withColumn(column, vector_to_array(F.col(column)))
