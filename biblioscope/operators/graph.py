"""Graph measures over edge tables (a, b, weight): joins and steps written to shared storage, or one task for each component.

Measures that need a whole component (paths, betweenness, communities) refuse components beyond MOST_EDGES."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored

MOST_EDGES = 5_000_000
#: Arcs that one task steps through in an iteration over a whole graph (24 MB); larger graphs are stepped through by joins.
SMALL_ARCS = 1_000_000
#: Source nodes of one path task.
SOURCES = 256
#: Rounds over all arcs in which distances must settle, and numbers held at a time; else paths are found source by source.
ROUNDS, AT_A_TIME = 64, 1 << 22
#: Numbers of a stretch of arcs, which fit a core's cache, and tasks that blocks of sources are dealt to for each of them, to a bound.
CACHED, SPREAD, MOST_TASKS = 1 << 16, 4, 2000
#: Edges that are sent whole to all workers, once each; distinct weights of such a graph; bytes of distances stepped through at a time.
SENT_EDGES, MOST_WEIGHTS, STEPPED = 5_000_000, 16, 1 << 19
#: Arcs of a node that is stepped to by itself, and sources whose edges are told together (their number fits a byte).
HUB, TURN = 256, 64


def both_ways(edges: DataFrame) -> DataFrame:
    """(u, v, w) in both directions; weight 1 where there is none."""
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    one = edges.select(F.col("a").alias("u"), F.col("b").alias("v"), weight.alias("w"))
    return one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))


def weight_column(df: DataFrame) -> str | None:
    """The first of the usual names that the table has."""
    return next((c for c in ("weight", "npmi", "n_co_artigos") if c in df.columns), None)


def nodes(edges: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Distinct endpoints, and the nodes of `more` (isolated ones)."""
    own = edges.select(F.col("a").alias("node")).union(edges.select("b"))
    return (own.union(more.select("node")) if more is not None else own).distinct()


def degrees(edges: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Rows (node, degree, strength); isolated nodes of `more` have 0."""
    own = both_ways(edges).groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))
    if more is None:
        return own
    return nodes(edges, more).join(own, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("strength", F.lit(0.0)).alias("strength"))


def _labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes in order and the smallest node of each one's component: roots hook to lower neighbours, then all point to their roots."""
    names, both = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = both[: len(u)], both[len(u) :]
    label, before = np.arange(len(names)), None
    while before is None or (label != before).any():
        before = label.copy()
        low = np.minimum(before[a], before[b])
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        while (label[label] != label).any():
            label = label[label]
    return names, names[label]


def components(edges: DataFrame, small: int = SMALL_ARCS) -> DataFrame:
    """Rows (node, component), component the smallest node. Up to `small` edges are labelled in one task; more by large-star and
    small-star steps until nothing moves."""
    kind = edges.schema["a"].dataType
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "stars")
    if kind.simpleString() in ("bigint", "int", "string") and edges.schema["b"].dataType == kind and _small(now, small):

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(dict(zip(("node", "component"), _labels(pdf["u"].to_numpy(), pdf["v"].to_numpy()), strict=True)))

        return now.groupBy().applyInPandas(run, f"node {kind.simpleString()}, component {kind.simpleString()}")
    before = None
    while True:
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        both = now.select("u", "v").union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = stored(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = stored(small.filter("u != v").distinct(), "stars")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).groupBy("node").agg(F.min("component").alias("component"))
    return out.select(F.col("node").cast(kind), F.col("component").cast(kind))


def with_components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The edges with the component of both ends (labels: of components(), where they are known)."""
    return edges.join((components(edges) if labels is None else labels).withColumnRenamed("node", "a"), "a")


def summary(edges: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """One row: nodes, edges, density, mean and largest degree, isolated nodes."""
    own = degrees(edges, more)
    n, m = F.col("n_nodes"), F.col("n_edges")
    one = own.agg(F.count(F.lit(1)).alias("n_nodes"), (F.sum("degree") / 2).cast("bigint").alias("n_edges"), F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree"), F.count_if(F.col("degree") == 0).alias("n_isolated"))
    return one.select("n_nodes", "n_edges", F.round(F.when(n > 1, 2 * m / (n * (n - 1))), 6).alias("density"), F.round("mean_degree", 4).alias("mean_degree"), "max_degree", "n_isolated")


def gini(values: DataFrame, column: str) -> DataFrame:
    """One row: Gini coefficient of a non-negative column; null if empty or all 0. Works on counts by value, not on a global sort of rows."""
    from pyspark.sql import Window

    counts = values.groupBy(F.col(column).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("r", F.col("c") * before + F.col("c") * (F.col("c") + 1) / 2)  # sum of the ranks of equal values
    own = ranked.agg(F.sum("c").alias("n"), F.sum(F.col("x") * F.col("c")).alias("total"), F.sum(F.col("r") * F.col("x")).alias("s"))
    return own.select(F.round(F.when(F.col("total") > 0, 2 * F.col("s") / (F.col("n") * F.col("total")) - (F.col("n") + 1) / F.col("n")), 4).alias("gini"))


def triangles(edges: DataFrame) -> DataFrame:
    """Rows (x, y, z), x the end of least degree: edges point from lower to higher degree, so hubs don't multiply."""
    simple = edges.select("a", "b").filter("a != b").distinct()
    deg = degrees(simple).select("node", "degree")
    one, two = deg.toDF("a", "da"), deg.toDF("b", "db")
    up = simple.join(one, "a").join(two, "b")
    lower = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    arcs = stored(up.select(F.when(lower, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(lower, F.col("b")).otherwise(F.col("a")).alias("t"), F.when(lower, F.col("db")).otherwise(F.col("da")).alias("d")), "arcs")
    ranks = arcs.alias("p").join(arcs.alias("q"), F.expr("p.s = q.s and (p.d < q.d or (p.d = q.d and p.t < q.t))")).select(F.col("p.s").alias("x"), F.col("p.t").alias("y"), F.col("q.t").alias("z"))
    return ranks.join(arcs.select(F.col("s").alias("y"), F.col("t").alias("z")), ["y", "z"]).select("x", "y", "z")


def transitivity(edges: DataFrame) -> DataFrame:
    """One row: three times the triangles over the connected triples; null without triples."""
    t = triangles(edges).agg(F.count(F.lit(1)).alias("n_triangles"))
    d = F.col("degree")
    triples = degrees(edges).agg(F.sum(d * (d - 1) / 2).cast("bigint").alias("n_triples"))
    return t.crossJoin(triples).select("n_triangles", "n_triples", F.round(F.when(F.col("n_triples") > 0, 3 * F.col("n_triangles") / F.col("n_triples")), 4).alias("transitivity"))  # one row each


def assortativity(edges: DataFrame) -> DataFrame:
    """One row: correlation of the degrees at both ends; null if all are equal."""
    d = degrees(edges).select("node", F.col("degree").cast("double").alias("degree"))
    ends = both_ways(edges).join(d.toDF("u", "du"), "u").join(d.toDF("v", "dv"), "v")
    own = ends.agg(F.covar_pop("du", "dv").alias("c"), (F.stddev_pop("du") * F.stddev_pop("dv")).alias("s"))
    return own.select(F.round(F.try_divide("c", F.when(F.col("s") > 0, F.col("s"))), 4).alias("assortativity"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: Newman's Q of the labels (node, community)."""
    ways = both_ways(edges)
    strength = ways.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("s")).join(labels, "node").groupBy("community").agg(F.sum("s").alias("s"))
    inside = ways.join(labels.toDF("u", "cu"), "u").join(labels.toDF("v", "cv"), "v").agg(F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("two_m"))
    squares = strength.agg(F.sum(F.col("s") * F.col("s")).alias("squares"))
    return inside.crossJoin(squares).select(F.round(F.col("inside") / F.col("two_m") - F.col("squares") / (F.col("two_m") * F.col("two_m")), 4).alias("modularity"))  # one row each


def _small(ways: DataFrame, small: int) -> bool:
    return ways.limit(small + 1).count() <= small


def _steps(ways: DataFrame, begin: Callable, step: Callable, moved: Callable, tolerance: float, most: int, out: str) -> DataFrame:
    """An iteration over arcs (u, v, w) that one task can hold: step(x, u, v, w) on numbered nodes until moved(new, old) is below the tolerance."""
    kind = ways.schema["u"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, u = np.unique(pdf["u"].to_numpy(), return_inverse=True)
        v, w = np.searchsorted(names, pdf["v"].to_numpy()), pdf["w"].to_numpy(float)
        x = begin(len(names))
        for _ in range(most):
            new = step(x, u, v, w)
            far, x = moved(new, x), new
            if far < tolerance:
                return pd.DataFrame({"node": names, out: x})
        raise ArithmeticError(f"values still move by {far} after {most} steps")

    return ways.groupBy().applyInPandas(run, f"node {kind}, {out} double")


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-8, most: int = 500, small: int = SMALL_ARCS) -> DataFrame:
    """Rows (node, pagerank), weighted and undirected; steps until the ranks move less than the tolerance in sum. Up to
    `small` arcs are stepped through in one task, more by joins."""
    ways = both_ways(edges).groupBy("u", "v").agg(F.sum("w").alias("w"))
    if _small(ways, small):

        def step(x: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
            total = np.bincount(u, w, len(x))
            return (1 - damping) / len(x) + damping * np.bincount(v, x[u] * w / total[u], len(x))

        return _steps(ways, lambda n: np.full(n, 1.0 / max(1, n)), step, lambda new, old: float(np.abs(new - old).sum()), tolerance, most, "pagerank")
    out = ways.groupBy("u").agg(F.sum("w").alias("total"))
    arcs = stored(ways.join(out, "u").select("u", "v", (F.col("w") / F.col("total")).alias("share")), "arcs")
    n = out.count()
    ranks = stored(out.select(F.col("u").alias("node"), F.lit(1.0 / max(1, n)).alias("r")), "ranks")
    for _ in range(0, most, 5):
        for _ in range(5):  # so many steps in one job
            got = arcs.join(ranks.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.sum(F.col("r") * F.col("share")).alias("in"))
            new = ranks.select("node", F.col("r").alias("old")).join(got, "node", "left").select("node", "old", (F.lit((1 - damping) / max(1, n)) + damping * F.coalesce("in", F.lit(0.0))).alias("r"))
            ranks = new.select("node", "r")
        new = stored(new, "ranks")
        moved = new.agg(F.sum(F.abs(F.col("r") - F.col("old")))).first()[0] or 0.0
        ranks = new.select("node", "r")
        if moved < tolerance:
            return ranks.withColumnRenamed("r", "pagerank")
    raise ArithmeticError(f"ranks still move by {moved} after {most} steps")


def coreness(edges: DataFrame) -> DataFrame:
    """Rows (node, coreness), unweighted, by h-index steps: a node's bound becomes the h-index of its neighbours' bounds."""
    ways = stored(both_ways(edges.select("a", "b").filter("a != b").distinct()).select("u", "v").distinct(), "arcs")
    now = stored(ways.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("core")), "cores")
    while True:
        heard = ways.join(now.select(F.col("node").alias("v"), "core"), "v").groupBy("u", "core").agg(F.count(F.lit(1)).alias("n"))
        from pyspark.sql import Window

        least = F.sum("n").over(Window.partitionBy("u").orderBy(F.desc("core")))
        new = heard.withColumn("many", least).groupBy(F.col("u").alias("node")).agg(F.max(F.least("core", "many")).alias("new"))
        step = stored(now.join(new, "node").select("node", F.least("core", "new").alias("core"), (F.col("new") < F.col("core")).alias("moved")), "cores")
        now = step.select("node", "core")
        if not step.filter("moved").limit(1).count():
            return now.withColumnRenamed("core", "coreness")


def eigenvector(edges: DataFrame, tolerance: float = 1e-9, most: int = 2000, small: int = SMALL_ARCS) -> DataFrame:
    """Rows (node, eigenvector) for the largest component (ties: the smallest label), weighted, the largest value 1.

    Power steps of A + I, which has A's vectors and always converges. Up to `small` arcs are stepped through in one task,
    more by joins."""
    labelled = stored(with_components(edges), "labelled")
    sizes = components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    ways = stored(both_ways(labelled.join(sizes.select("component"), "component")), "arcs")
    if _small(ways, small):

        def plus(x: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
            new = x + np.bincount(u, w * x[v], len(x))
            return new / new.max()

        return _steps(ways, np.ones, plus, lambda new, old: float(np.abs(new - old).max()), tolerance, most, "eigenvector")
    now = stored(ways.select(F.col("u").alias("node")).distinct().withColumn("x", F.lit(1.0)), "vector")
    moved = 0.0
    for _ in range(0, most, 8):
        step = now
        for _ in range(8):  # so many steps in one job; values grow by (1 + largest eigenvalue)^8 at most before they are scaled
            got = ways.join(step.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.sum(F.col("w") * F.col("x")).alias("y"))
            step = step.join(got, "node").select("node", (F.col("x") + F.col("y")).alias("x"))
        new = stored(now.withColumnRenamed("x", "old").join(step, "node"), "vector")
        top = new.agg(F.max("x")).first()[0] or 1.0
        moved = new.agg(F.max(F.abs(F.col("x") / top - F.col("old")))).first()[0] or 0.0
        now = new.select("node", (F.col("x") / top).alias("x"))
        if moved < tolerance:
            return now.withColumnRenamed("x", "eigenvector")
    raise ArithmeticError(f"the vector still moves by {moved} after {most} steps")


def _adjacency(pdf: pd.DataFrame) -> tuple[list, list[list[tuple[int, float]]]]:
    if len(pdf) > MOST_EDGES:
        raise ValueError(f"a component has {len(pdf)} edges; the measure takes {MOST_EDGES} at most")
    names = sorted(set(pdf["a"]) | set(pdf["b"]))
    at = {x: i for i, x in enumerate(names)}
    return names, _neighbours(len(names), (at[x] for x in pdf["a"]), (at[x] for x in pdf["b"]), pdf["weight"])


def _neighbours(n: int, one: Iterable, other: Iterable, weights: Iterable) -> list[list[tuple[int, float]]]:
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in zip(one, other, weights, strict=True):
        near[a].append((b, float(w)))
        near[b].append((a, float(w)))
    return near


def _paths(near: list[list[tuple[int, float]]], source: int) -> tuple[list[int], dict[int, float], dict[int, float], dict[int, list[int]]]:
    """Dijkstra by 1 / weight: order of settling, distances, numbers of shortest paths, predecessors."""
    distance, paths, before, done, order = {source: 0.0}, {source: 1.0}, {source: []}, set(), []
    heap = [(0.0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        order.append(u)
        for v, w in near[u]:
            to = d + 1.0 / w
            have = distance.get(v)
            if have is None or to < have - 1e-12:
                distance[v], paths[v], before[v] = to, paths[u], [u]
                heapq.heappush(heap, (to, v))
            elif v not in done and abs(to - have) <= 1e-12:
                paths[v] += paths[u]
                before[v].append(u)
    return order, distance, paths, before


def _one_by_one(near: list[list[tuple[int, float]]], sources: np.ndarray) -> tuple[list[tuple[float, float, float]], np.ndarray]:
    """Closeness, farthest and total distance of each source, and the summed shares of shortest paths through each node."""
    found, between = [], np.zeros(len(near))
    for s in sources.tolist():
        order, distance, paths, before = _paths(near, s)
        share = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in before[v]:
                share[u] += paths[u] / paths[v] * (1 + share[v])
            if v != s:
                between[v] += share[v]
        own = sum(distance.values())
        found.append((1.0 / own if own else 0.0, max(distance.values()), own))
    return found, between


def _arcs(pdf: pd.DataFrame) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Names in order, and the arcs of both ways by their heads: tails, heads, 1 / weight."""
    if len(pdf) > MOST_EDGES:
        raise ValueError(f"a component has {len(pdf)} edges; the measure takes {MOST_EDGES} at most")
    both = pd.concat([pdf["a"], pdf["b"]])
    code, names = pd.factorize(both, sort=True)
    one, two = code[: len(pdf)].astype(np.int64), code[len(pdf) :].astype(np.int64)
    tail, head = np.concatenate([one, two]), np.concatenate([two, one])
    with np.errstate(divide="ignore"):
        cost = np.tile(1.0 / pdf["weight"].to_numpy(float), 2)
    order = np.argsort(head, kind="stable")
    return names.tolist(), tail[order], head[order], cost[order]


def _paths_together(n: int, tail: np.ndarray, head: np.ndarray, cost: np.ndarray, sources: np.ndarray, shares: bool = True) -> tuple[np.ndarray, np.ndarray] | None:
    """Distances (node by source) and the summed shares of shortest paths through each node (none without `shares`), for all sources
    at once; None where costs aren't plain or paths have more than ROUNDS arcs. Equal within 1e-12 is equal, as in _paths."""
    if not len(cost) or not (np.isfinite(cost).all() and cost.min() > 1e-9):
        return None
    k = len(sources)
    distance = np.full((n, k), np.inf)
    distance[sources, np.arange(k)] = 0.0
    first = np.flatnonzero(np.append(True, head[1:] != head[:-1]))  # of each node's arcs
    some = max(1, min(AT_A_TIME, CACHED) // k)
    cuts = [0]  # stretches of nodes whose arcs fit
    while cuts[-1] < len(first):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(first, first[cuts[-1]] + some, side="right")) - 1) if first[cuts[-1]] + some < len(head) else len(first))
    stretches = [(first[a:b], first[a], first[b] if b < len(first) else len(head)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for _ in range(ROUNDS):
        before = distance.copy()
        for own, lo, hi in stretches:
            nodes_ = head[own]
            distance[nodes_] = np.minimum(distance[nodes_], np.minimum.reduceat(distance[tail[lo:hi]] + cost[lo:hi, None], own - lo, axis=0))
        if np.array_equal(before, distance):
            break
    else:
        return None
    if not shares:
        return distance, np.zeros(n)
    found = []
    for _, lo, hi in stretches:
        arc, s = np.nonzero(np.abs(distance[tail[lo:hi]] + cost[lo:hi, None] - distance[head[lo:hi]]) <= 1e-12)
        found.append((tail[lo:hi][arc] * k + s, head[lo:hi][arc] * k + s))
    u, v = (np.concatenate(x) for x in zip(*found, strict=True))
    start = sources * k + np.arange(k)
    flow = np.zeros(n * k)
    flow[start] = 1.0
    paths = flow.copy()
    rounds = 0
    while flow.any():  # paths by their number of arcs
        flow = np.bincount(v, flow[u], n * k)
        paths += flow
        rounds += 1
    part = paths[u] / paths[v]
    share = np.zeros(n * k)
    for _ in range(rounds):
        share = np.bincount(u, part * (1 + share[v]), n * k)
    share[start] = 0.0
    return distance, share.reshape(n, k).sum(1)


def _units(weights: np.ndarray) -> tuple[dict[float, int], int] | None:
    """1 / weight of each distinct weight in units, and the units of 1; None where there are many weights or no such unit."""
    own = np.unique(weights).tolist()
    if not own or len(own) > MOST_WEIGHTS or not all(math.isfinite(w) and 0 < w < 1e9 for w in own):
        return None
    costs = [1 / Fraction(w).limit_denominator(10_000) if w >= 1e-3 else Fraction(0) for w in own]
    if any(not c or abs(float(c) * w - 1) > 1e-15 for c, w in zip(costs, own, strict=True)):
        return None
    one = math.lcm(*(c.denominator for c in costs))
    most = max(costs) * one
    return ({w: int(c * one) for w, c in zip(own, costs, strict=True)}, one) if most < 1 << 14 and one < 1 << 30 else None


def _classes(n: int, a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> list[tuple[int, list, list]]:
    """By cost the arcs of both ways: groups of heads with about as many tails each (heads, their first tails, their second, ...), and
    (head, tails) of the few with far more."""
    found = []
    for c in np.unique(cost).tolist():
        own = cost == c
        tail, head = np.concatenate([a[own], b[own]]), np.concatenate([b[own], a[own]])
        many = np.bincount(head, minlength=n)
        heads = np.argsort(-many, kind="stable")[: np.count_nonzero(many)]
        place = np.empty(n, np.int64)
        place[heads] = np.arange(len(heads))
        tail = tail[np.argsort(place[head], kind="stable")]
        many = many[heads]
        begin = np.cumsum(many) - many
        hubs = int(np.count_nonzero(many > HUB))
        groups = []
        for i in range(hubs, len(heads), STEPPED // SOURCES):
            at, n_tails = begin[i : i + STEPPED // SOURCES], many[i : i + STEPPED // SOURCES]
            groups.append((heads[i : i + STEPPED // SOURCES], [tail[at[: np.count_nonzero(n_tails > k)] + k] for k in range(n_tails[0])]))
        found.append((c, groups, [(heads[i], tail[begin[i] : begin[i] + many[i]]) for i in range(hubs)]))
    return found


def _in_units(n: int, classes: list[tuple[int, list, list]], sources: np.ndarray) -> np.ndarray | None:
    """Distances in units (source by node) in as few bytes as hold them; None where they don't settle in ROUNDS or don't fit."""
    most = max(c for c, *_ in classes)
    for kind in (np.uint8, np.uint16):
        top = np.iinfo(kind).max - most  # what is farther, so that sums fit
        if top <= most:
            continue
        distance = np.full((n, len(sources)), top, kind)
        distance[sources, np.arange(len(sources))] = 0
        held = np.empty((max(1, STEPPED // SOURCES), len(sources)), kind)

        def nearer(heads: np.ndarray, new: np.ndarray, distance: np.ndarray = distance) -> bool:
            have = distance[heads]
            if not (new < have).any():
                return False
            distance[heads] = np.minimum(new, have)
            return True

        for _ in range(ROUNDS):
            moved = False
            for c, groups, hubs in classes:
                for heads, tails in groups:
                    new = distance.take(tails[0], 0)
                    for own in tails[1:]:
                        np.take(distance, own, 0, out=held[: len(own)], mode="clip")
                        np.minimum(new[: len(own)], held[: len(own)], out=new[: len(own)])
                    moved |= nearer(heads, new + kind(c))
                for head, tails in hubs:
                    new = np.min([distance.take(tails[k : k + len(held)], 0).min(0) for k in range(0, len(tails), len(held))], axis=0)
                    moved |= nearer(head, new + kind(c))
            if not moved:
                break
        else:
            return None
        if int(distance.max()) < top:
            return np.ascontiguousarray(distance.T)
    return None


def _on_paths(a: np.ndarray, b: np.ndarray, cost: np.ndarray, near: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each source the arcs of its shortest paths. An edge's ends differ by its cost at most, so differences of unsigned
    distances are told even where they wrap."""
    a, b, cost = a.astype(np.int32), b.astype(np.int32), cost.astype(near.dtype)[:, None]
    for first in range(0, len(near), TURN):
        own = np.ascontiguousarray(near[first : first + TURN].T)
        k = own.shape[1]
        found: list[list] = [[] for _ in range(k)]
        for lo in range(0, len(a), max(1, STEPPED // TURN)):
            x, y, c = (z[lo : lo + max(1, STEPPED // TURN)] for z in (a, b, cost))
            apart = own.take(y, 0)
            apart -= own.take(x, 0)
            some = apart == c
            some |= np.negative(apart, out=apart) == c
            at = np.flatnonzero(some)
            edge, s = np.divmod(at, k) if k & (k - 1) else (at >> (k.bit_length() - 1), at & (k - 1))
            s = s.astype(np.uint8)
            edge = edge.take(np.argsort(s, kind="stable"))
            cuts = np.cumsum(np.bincount(s, minlength=k)).tolist()
            one, other = x.take(edge), y.take(edge)
            for arcs, i, j in zip(found, [0, *cuts], cuts, strict=False):
                if i < j:
                    arcs.append((one[i:j], other[i:j]))
        for arcs, d in zip(found, near[first : first + TURN], strict=True):
            one, other = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*arcs, strict=True) if arcs else ((), ())))
            there = d.take(one) < d.take(other)
            yield np.where(there, one, other), np.where(there, other, one)


def _dependencies(u: np.ndarray, v: np.ndarray, own: np.ndarray, source: int) -> np.ndarray:
    """Summed shares of the shortest paths from a source, whose arcs are (u, v), through each node."""
    level = own.take(v)
    order = np.argsort(level, kind="stable")
    u, v = u.take(order), v.take(order)
    level = level.take(order)
    cuts = [0, *(np.flatnonzero(level[1:] != level[:-1]) + 1).tolist(), len(level)]
    paths = np.zeros(len(own))
    paths[source] = 1.0
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        np.add.at(paths, v[lo:hi], paths.take(u[lo:hi]))
    part = paths.take(u) / paths.take(v)
    share = np.zeros(len(own))
    for lo, hi in zip(cuts[-2::-1], cuts[:0:-1], strict=True):
        np.add.at(share, u[lo:hi], part[lo:hi] * (1.0 + share.take(v[lo:hi])))
    share[source] = 0.0
    return share


def _by_sent(labelled: DataFrame, shares: bool) -> DataFrame | None:
    """_by_blocks() with the edges sent once to each worker and distances in units; None for graphs of too many edges, or
    of weights or distances that have no units."""
    if not _small(labelled, SENT_EDGES):
        return None
    table = labelled.select("component", "a", "b", "weight").toArrow()
    if not len(table) or any(c.null_count for c in table.columns):
        return None
    weight = table.column("weight").to_numpy()
    known = _units(weight)
    if known is None:
        return None
    units, one = known
    values = np.array(sorted(units))
    cost = np.array([units[w] for w in values.tolist()], np.int64)[np.searchsorted(values, weight)]
    code, component = pd.factorize(table.column("component").to_pandas())
    ends, names = pd.factorize(pd.concat([table.column("a").to_pandas(), table.column("b").to_pandas()]), sort=True)
    del table
    order = np.lexsort((ends[: len(code)], code))
    cuts = np.searchsorted(code[order], np.arange(len(component) + 1))
    a, b, cost = ends[: len(code)][order], ends[len(code) :][order], cost[order]
    graphs, blocks = [], []
    for g, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        own, both = np.unique(np.concatenate([a[lo:hi], b[lo:hi]]), return_inverse=True)
        graphs.append((np.asarray(names)[own], both[: hi - lo].astype(np.int32), both[hi - lo :].astype(np.int32), cost[lo:hi].astype(np.int32)))
        blocks += [(g, s) for s in range(0, len(own), SOURCES)]
        if _in_units(len(own), _classes(len(own), *(x.astype(np.int64) for x in graphs[-1][1:3]), cost[lo:hi]), np.zeros(1, np.int64)) is None:
            return None
    session = labelled.sparkSession
    tasks = min(MOST_TASKS, len(blocks))
    sent, kind = session.sparkContext.broadcast((graphs, blocks)), labelled.schema["a"].dataType
    schema = f"node {kind.simpleString()}, part double, closeness double, farthest double, total_distance double"
    plain = pa.string() if kind.simpleString() == "string" else None

    def rows(of: np.ndarray, *columns: np.ndarray | None) -> pa.RecordBatch:
        own = [pa.nulls(len(of), pa.float64()) if c is None else pa.array(c, pa.float64()) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(of, plain), *own], ["node", "part", "closeness", "farthest", "total_distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graphs, blocks = sent.value
        last, between = -1, np.zeros(0)
        for task in (t for batch in batches for t in batch.column(0).to_pylist()):
            for g, first in blocks[task * len(blocks) // tasks : (task + 1) * len(blocks) // tasks]:
                if g != last:
                    if shares and last >= 0:
                        yield rows(names, between / 2, None, None, None)
                    names, a, b, cost = graphs[g]
                    a, b, last, between = a.astype(np.int64), b.astype(np.int64), g, np.zeros(len(names))
                    classes = _classes(len(names), a, b, cost)
                sources = np.arange(first, min(len(names), first + SOURCES))
                near = _in_units(len(names), classes, sources)
                if near is None:
                    own, more = _one_by_one(_neighbours(len(names), a, b, one / cost), sources)
                    between += more
                    yield rows(names[sources], np.zeros(len(sources)), *(np.array(x) for x in zip(*own, strict=True)))
                    continue
                total = near.sum(1, dtype=np.int64) / one
                with np.errstate(divide="ignore"):
                    yield rows(names[sources], np.zeros(len(sources)), np.where(total > 0, 1.0 / total, 0.0), near.max(1) / one, total)
                if shares:
                    for s, own, (u, v) in zip(sources.tolist(), near, _on_paths(a, b, cost, near), strict=True):
                        between += _dependencies(u, v, own, s)
            if shares and last >= 0:
                yield rows(names, between / 2, None, None, None)
                last = -1

    return session.range(0, tasks, 1, tasks).mapInArrow(run, schema)


def path_measures(edges: DataFrame) -> DataFrame:
    """Rows (node, betweenness, closeness, farthest, total_distance): distances are 1 / weight.

    Betweenness is over (n - 1)(n - 2) / 2 with the n of the whole graph; closeness is 1 over the sum of distances inside
    the component. A task takes a block of sources of one component."""
    ways = _costed(edges)
    found = _by_blocks(stored(with_components(ways), "labelled"), True)
    total = nodes(ways).count()
    scale = max(1.0, (total - 1) * (total - 2) / 2)
    return found.groupBy("node").agg((F.sum("part") / scale).alias("betweenness"), F.max(F.nanvl("closeness", F.lit(None))).alias("closeness"), F.max(F.nanvl("farthest", F.lit(None))).alias("farthest"), F.max(F.nanvl("total_distance", F.lit(None))).alias("total_distance"))


def _costed(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", (F.col("weight") if "weight" in edges.columns else F.lit(1.0)).cast("double").alias("weight"))


def _by_blocks(labelled: DataFrame, shares: bool) -> DataFrame:
    """Rows (node, part, closeness, farthest, total_distance) of a stored table of edges with components: a node's distances come
    from the block of sources it is in, its part of betweenness from each block; without `shares` only the former."""
    sent = _by_sent(labelled, shares)
    if sent is not None:
        return sent
    kind = labelled.schema["a"].dataType.simpleString()
    sizes = labelled.select("component", F.col("a").alias("x")).union(labelled.select("component", "b")).distinct().groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    blocks = sizes.select("component", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / SOURCES).cast("int"))).alias("block"))
    # a block is much work for few bytes, so the number of tasks must not follow the bytes
    tasks = SPREAD * (sizes.agg(F.sum(F.ceil(F.col("n") / SOURCES))).first()[0] or 0)
    dealt = labelled.join(blocks, "component").repartition(max(int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, tasks)), "component", "block")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names, tail, head, cost = _arcs(pdf)
        between = np.zeros(len(names))
        rows = []
        near: list = []
        step = max(1, min(SOURCES, AT_A_TIME // len(names)))
        last = min(len(names), (key[1] + 1) * SOURCES)
        for lo in range(key[1] * SOURCES, last, step):
            block = np.arange(lo, min(last, lo + step))
            together = _paths_together(len(names), tail, head, cost, block, shares)
            if together is not None:
                distance, share = together
                between += share
                rows += [(names[s], 1.0 / own if own else 0.0, most, own) for s, own, most in zip(block.tolist(), distance.sum(0).tolist(), distance.max(0).tolist(), strict=True)]
                continue
            near = near or _adjacency(pdf)[1]
            own, more = _one_by_one(near, block)
            between += more
            rows += [(names[s], *x) for s, x in zip(block.tolist(), own, strict=True)]
        part = pd.DataFrame({"node": names, "part": between / 2})
        out = part.merge(pd.DataFrame(rows, columns=["node", "closeness", "farthest", "total_distance"]), on="node", how="left" if shares else "inner")
        return out[["node", "part", "closeness", "farthest", "total_distance"]]

    return dealt.groupBy("component", "block").applyInPandas(run, f"node {kind}, part double, closeness double, farthest double, total_distance double")


def louvain_labels(near: list[list[tuple[int, float]]]) -> list[int]:
    """Communities by greedy moves in node order and merging, until modularity stays."""
    n = len(near)
    label = list(range(n))
    graph = [dict() for _ in range(n)]
    for u, own in enumerate(near):
        for v, w in own:
            graph[u][v] = graph[u].get(v, 0.0) + w
    of = list(range(n))
    while True:
        k = len(graph)
        strength = [sum(g.values()) + g.get(i, 0.0) * 0 for i, g in enumerate(graph)]
        two_m = sum(strength) or 1.0
        comm, total = list(range(k)), strength[:]
        changed, moved = False, True
        while moved:
            moved = False
            for u in range(k):
                links: dict[int, float] = {}
                for v, w in graph[u].items():
                    if v != u:
                        links[comm[v]] = links.get(comm[v], 0.0) + w
                total[comm[u]] -= strength[u]
                best, gain = comm[u], links.get(comm[u], 0.0) - total[comm[u]] * strength[u] / two_m
                for c in sorted(links):
                    g = links[c] - total[c] * strength[u] / two_m
                    if g > gain + 1e-12:
                        best, gain = c, g
                total[best] += strength[u]
                if best != comm[u]:
                    comm[u], moved, changed = best, True, True
        if not changed:
            break
        number = {c: i for i, c in enumerate(sorted(set(comm)))}
        of = [number[comm[x]] for x in of]
        merged = [dict() for _ in number]
        for u, own in enumerate(graph):
            for v, w in own.items():
                a, b = number[comm[u]], number[comm[v]]
                merged[a][b] = merged[a].get(b, 0.0) + w
        graph = merged
    label = of
    return label


def communities(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Rows (node, component, community): Louvain in each component, node order fixed; a community is named by its smallest node."""
    ways = _costed(edges)
    kind = edges.schema["a"].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names, near = _adjacency(pdf)
        out = pd.DataFrame({"node": names, "label": louvain_labels(near)})
        out["component"] = key[0]
        out["community"] = out.groupby("label")["node"].transform("min")
        return out[["node", "component", "community"]]

    return with_components(ways, labels).groupBy("component").applyInPandas(run, f"node {kind}, component {kind}, community {kind}")


REPORT = "rede string, status string, n_nodes bigint, n_edges bigint, density double, mean_degree double, max_degree bigint, n_isolated bigint, gini double, transitivity double, assortativity double, n_components bigint, lcc_nodes bigint, lcc_pct double, mean_path double, diameter double, modularity double"


def report(spark: SparkSession, name: str, edges: DataFrame | None, grouped: bool = True) -> DataFrame:
    """One row of all measures of a network (modularity, which needs its communities, only where it is `grouped`). status: ok; vazia (no rows: 0 nodes and edges); sem_arestas (rows, but none joins
    two nodes); arquivo_ausente (None: there is no such table). Measures that can't be had are null."""
    status = "arquivo_ausente" if edges is None else None if edges.filter("a != b").limit(1).count() else "sem_arestas" if edges.limit(1).count() else "vazia"
    if status:
        n = None if edges is None else nodes(edges).filter("node is not null").count()
        return spark.createDataFrame([(name, status, n, None if edges is None else 0, *[None] * 13)], REPORT)
    labels = stored(components(edges), "labels")
    sizes = stored(labels.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "sizes")
    lcc = sizes.agg(F.count(F.lit(1)).alias("n_components"), F.max("n").alias("lcc_nodes"), F.sum("n").alias("n_all"))
    biggest = sizes.orderBy(F.desc("n"), "component").limit(1).select("component")
    inside = stored(with_components(_costed(edges), labels).join(biggest, "component"), "labelled")
    walk = _by_blocks(inside, False).agg(F.round(F.sum("total_distance") / (F.count(F.lit(1)) * (F.count(F.lit(1)) - 1)), 4).alias("mean_path"), F.round(F.max("farthest"), 2).alias("diameter"))
    groups = modularity(edges, communities(edges, labels).select("node", "community")) if grouped else spark.range(1).select(F.lit(None).cast("double").alias("modularity"))
    out = summary(edges).crossJoin(gini(degrees(edges), "degree")).crossJoin(transitivity(edges).select("transitivity")).crossJoin(assortativity(edges)).crossJoin(lcc).crossJoin(walk).crossJoin(groups)  # one row each
    out = out.select(F.lit(name).alias("rede"), F.lit("ok").alias("status"), "*", F.round(100 * F.col("lcc_nodes") / F.col("n_all"), 1).alias("lcc_pct"))
    return out.withColumn("mean_degree", F.round("mean_degree", 3)).select(*(F.col(x.split()[0]).cast(x.split()[1]) for x in REPORT.split(", ")))


def weighted(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges (a, b, weight) of a table whose weight is the first of its usual names, 1 without any."""
    name = weight_column(df)
    return df.select(F.col(a).alias("a"), F.col(b).alias("b"), (F.col(name).cast("double") if name else F.lit(1.0)).alias("weight"))
