"""Near-duplicates by SetSketch registers: banded register values propose pairs, a joint likelihood screens them, full sets decide."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_SPACE, chunks, lower_ascii, mix, prefix_hash, release, small_batches, span_hash, stored, table, utf8, words

#: Sketch parameters: registers, their base and rate, and rows of a band. 32 bands of 4 registers miss a pair of
#: similarity 0.8 with probability (1 - 0.8^4)^32, less than 1e-7.
REGISTERS, BASE, RATE, ROWS = 128, 1.001, 20.0, 4
BANDS = REGISTERS // ROWS
#: Pairs whose likeliest similarity is so many standard errors below the threshold are dropped before the full sets are compared.
MARGIN = 4.0
#: Members of a group that one task verifies against the group's leader.
GROUP_ROWS = 500
#: Up to so many candidate rows (40 bytes each) are broadcast to pick their texts; beyond that the texts are shuffled.
BROADCAST_ROWS = 500_000
#: A band key is hot with so many rows, and at least one HOT_KEYS-th of all, so there are HOT_KEYS of them at most.
HOT_ROWS, HOT_KEYS = 2_000, 20_000
#: Documents of a block; a task compares two blocks.
BLOCK = 512

_rng = np.random.default_rng(20_24)
_MULTIPLY = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Each document's sorted distinct shingle hashes: k words each, the whole sequence if it is shorter, none without words."""
    own = lower_ascii(data)
    start, end, first = words(own, offsets, NOT_SPACE)
    w = span_hash(prefix_hash(own), start, end)
    rolled = np.zeros(max(0, len(w) - k + 1), np.uint64)
    for j in range(k):
        rolled = mix(rolled + w[j : len(w) - k + 1 + j] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j + 1)) if len(rolled) else rolled
    for i in range(len(offsets) - 1):
        lo, hi = int(first[i]), int(first[i + 1])
        if hi - lo >= k:
            yield np.unique(rolled[lo : hi - k + 1])
        elif hi > lo:
            h = np.full(1, hi - lo, np.uint64)
            for j in range(lo, hi):
                h = mix(h * np.uint64(0xD6E8FEB86659FD93) + w[j : j + 1])
            yield h
        else:
            yield np.zeros(0, np.uint64)


def sketch(elements: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set: the least of exponential values in each, truncated to powers of the base. The
    larger of two sets' registers are their union's."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(elements), 2048):
        least = np.minimum(least, (elements[at : at + 2048, None] * _MULTIPLY[None, :] + _ADD[None, :]).min(0))
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / math.log(BASE)), 0, 65535).astype("<u2")


def likeliest(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The similarity of greatest joint likelihood, given two sketches (rows of registers) and the sizes of the sets."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = REGISTERS - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    highest = np.minimum(u / v, v / u)
    p = lambda x: -np.log(np.maximum(1 - x * (BASE - 1) / BASE, 1e-12)) / math.log(BASE)
    best, found = np.full(len(a), -np.inf), np.zeros(len(a))
    for share in np.linspace(0, 1, 101):
        j = highest * share
        up, down = np.maximum(p(u - v * j), 1e-9), np.maximum(p(v - u * j), 1e-9)
        value = more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-9))
        better = value > best
        best[better], found[better] = value[better], j[better]
    return found


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            n, digests, registers = [], [], []
            for i, j in chunks(at):
                for s in shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], k):
                    n.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    registers.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(registers, pa.binary())], ["doc_id", "n_shingles", "digest", "registers"])
        release()

    return run


def _screen(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("reg_a", "reg_b"))
            j = likeliest(a, b, *(batch.column(c).to_numpy().astype(np.float64) for c in ("n_a", "n_b")))
            keep = pa.array(j >= least)
            yield batch.select(["a", "b"]).filter(keep)

    return run


def _verify(k: int, percent: int):
    """Streams groups sorted by (leader, salt, is_member): the leader's set is held, members are compared with it one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leaders = None, []
        for batch in batches:
            a, salt, member, ids = (batch.column(c).to_pylist() for c in ("a", "salt", "is_member", "member"))
            data, at = utf8(batch.column(batch.schema.get_field_index("text")))
            found_a, found_b = [], []
            row = 0
            for i, j in chunks(at):
                for s in shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], k):
                    if group != (a[row], salt[row]):
                        group, leaders = (a[row], salt[row]), []
                    if not member[row]:
                        leaders.append(s)
                    else:
                        for other in leaders:
                            both = len(np.intersect1d(s, other, assume_unique=True))
                            if len(s) and 100 * both >= percent * (len(s) + len(other) - both):
                                found_a.append(a[row])
                                found_b.append(ids[row])
                                break
                    row += 1
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    return run


def with_texts(docs: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows (stored) with the texts of the ids in key; few rows are broadcast, so that texts stay where they are read."""
    picked = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    return docs.select(F.col("doc_id").alias(key), "text").join(picked, key)


def _across(k: int, percent: int):
    """Streams groups (a pair of blocks) sorted by group: links between documents of different components that their full
    sets give, as a spanning forest of the components in the group. Exact counts come from postings of the second block."""

    def links(rows: list[tuple], same: bool) -> Iterator[tuple[int, int]]:
        one = rows if same else [r for r in rows if r[2] == 0]
        two = rows if same else [r for r in rows if r[2] == 1]
        if not one or not two or len({r[1] for r in rows}) < 2:
            return
        shingles = np.concatenate([r[3] for r in two])
        owner = np.repeat(np.arange(len(two)), [len(r[3]) for r in two])
        order = np.argsort(shingles, kind="stable")
        shingles, owner = shingles[order], owner[order]
        sizes = np.array([len(r[3]) for r in two])
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        for doc, component, _, own in one:
            lo, hi = np.searchsorted(shingles, own), np.searchsorted(shingles, own, side="right")
            n = hi - lo
            hits = owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            both = np.bincount(hits, minlength=len(two))
            for j in np.flatnonzero(100 * both >= percent * (len(own) + sizes - both)).tolist():
                x, y = root(component), root(two[j][1])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    yield min(doc, two[j][0]), max(doc, two[j][0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        found: list[tuple[int, int]] = []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("super", "one", "two")), strict=True))
            ids, components_, sides = (batch.column(c).to_pylist() for c in ("id", "c", "side"))
            data, at = utf8(batch.column(batch.schema.get_field_index("text")))
            row = 0
            for i, j in chunks(at):
                for s in shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], k):
                    if group != keys[row]:
                        if group is not None:
                            found += links(held, group[1] == group[2])
                        group, held = keys[row], []
                    held.append((ids[row], components_[row], sides[row], s))
                    row += 1
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])
            found = []
        if group is not None:
            found += links(held, group[1] == group[2])
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    return run


def meet(rows: DataFrame, other: DataFrame, least: int) -> DataFrame:
    """rows (key, many, ...) with other (key, many, ...) by key; many is the key's number of rows. Those of hot keys stay
    where they are and get their partner by broadcast (HOT_KEYS rows at most), so no task gets a hot key."""
    hot, cold = F.col("many") >= least, F.col("many") < least
    return rows.filter(hot).join(F.broadcast(other.filter(hot).drop("many")), "key").unionByName(rows.filter(cold).join(other.filter(cold).drop("many"), "key"))


def shared_bands(classes: DataFrame) -> tuple[DataFrame, int]:
    """Rows (key, id, a, many) for the bands that several classes share: a is the smallest id, many the key's rows; and from how many a key is hot."""
    keys = F.array(*(F.xxhash64(F.lit(i), F.substring("registers", 1 + 2 * ROWS * i, 2 * ROWS)) for i in range(BANDS)))
    bands = classes.select(F.col("rep").alias("id"), F.explode(keys).alias("key"))
    leaders = bands.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("last"), F.count(F.lit(1)).alias("many")).filter("a != last")
    leaders = stored(leaders.select("key", "a", "many"), "leaders")
    least = max(HOT_ROWS, (leaders.agg(F.sum("many")).first()[0] or 0) // HOT_KEYS)
    hot = F.broadcast(leaders.filter(F.col("many") >= least))
    cold = bands.join(hot.select("key"), "key", "left_anti").join(leaders.filter(F.col("many") < least), "key")
    return stored(bands.join(hot, "key").unionByName(cold), "bands"), least


def across_components(docs: DataFrame, open_bands: DataFrame, least: int, k: int, percent: int) -> DataFrame:
    """Links (a, b) between components that share a band, for rows (key, many, id, c) of such bands.

    Documents joined by open bands make a family; a family is cut into blocks of BLOCK documents or so by hash, and every
    two of its blocks meet in a task, where full sets are compared. So nothing is left out, no task grows with a family,
    and only links that join components leave the task."""
    first = open_bands.groupBy("key", "many").agg(F.min("id").alias("a"))
    family = components(meet(open_bands, first, least).select("a", F.col("id").alias("b")).distinct())
    own = open_bands.select("id", "c").distinct().join(family.select(F.col("node").alias("id"), F.col("component").alias("super")), "id")
    own = stored(own, "families")
    blocks = own.groupBy("super").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = stored(own.join(blocks, "super").select("super", "id", "c", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")), "blocks")
    texts = with_texts(docs, rows, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = texts.select("super", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), (F.col("block") > F.col("other")).cast("int").alias("side"), "id", "c", "text")
    dealt = dealt.repartition("super", "one", "two").sortWithinPartitions("super", "one", "two")
    return stored(dealt.mapInArrow(_across(k, percent), "a bigint, b bigint"), "links")


def confirmed(docs: DataFrame, pairs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b), a < b, that the likelihood lets pass and whose full sets reach the threshold."""
    one = classes.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("reg_a"))
    two = classes.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("reg_b"))
    t = percent / 100
    sized = pairs.join(one, "a").join(two, "b").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    screened = stored(sized.select("a", "b", "n_a", "n_b", "reg_a", "reg_b").mapInArrow(_screen(t - MARGIN * math.sqrt(t * (1 - t) / REGISTERS)), "a bigint, b bigint").distinct(), "pairs")
    groups = screened.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("salts"))
    members = screened.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("is_member"), F.col("b").alias("member"))
    leaders = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("is_member"), F.col("a").alias("member"))
    texts = with_texts(docs, stored(members.unionByName(leaders), "groups"), "member").select("a", "salt", "is_member", "member", "text")
    dealt = texts.repartition("a", "salt").sortWithinPartitions("a", "salt", "is_member")
    return stored(dealt.mapInArrow(_verify(k, percent), "a bigint, b bigint"), "links")


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for the nodes of edges (a, b): the component's smallest node. Alternates large-star and
    small-star steps until the edges stay; each step is written to the shared folder."""
    spark = edges.sparkSession
    now = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if state == before or not state[0]:
            break
        before = state
        both = now.select("u", "v").union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = stored(small.filter("u != v").distinct(), "stars")
    nodes = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return stored(nodes.union(now.select("v", "v").distinct()).groupBy("node").agg(F.min("component").alias("component")), "components") if before else spark.createDataFrame([], "node bigint, component bigint")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of docs (doc_id bigint, text).

    Documents with percent * union <= 100 * intersection of their k-word shingle sets are linked; component_id is the
    smallest doc_id reachable, kept where that is the document's own. Equal sets are one class, which collapses copies
    before any join. Pairs come from bands: first each band's members with its smallest member; then, where a band
    still holds several components, its members in blocks (see across_components). Empty and null texts, and rows with a null id,
    are linked with nothing (a null id has a null component and is kept). Rows that share an id count as one document.
    An empty table gives no rows; other columns are ignored; texts are whole."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    sketches = stored(rows.mapInArrow(_sketches(k), "doc_id bigint, n_shingles bigint, digest binary, registers binary"), "sketches")
    some = sketches.filter("n_shingles > 0 and doc_id is not null")
    classes = stored(some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers")), "classes")
    shared, least = shared_bands(classes)
    texts = rows.filter("doc_id is not null")
    links = confirmed(texts, shared.filter("id != a").select("a", F.col("id").alias("b")).distinct(), classes, k, percent)
    label = components(links).withColumnRenamed("node", "id")
    # bands of three and more members that still hold several components
    named = stored(shared.filter("many > 2").join(label, "id", "left").select("key", "many", "id", F.coalesce("component", "id").alias("c")), "named")
    mixed = named.groupBy("key", "many").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low != high").select("key", "many")
    more = across_components(texts, stored(meet(named, mixed, least), "open-bands"), least, k, percent)
    label = components(links.union(more)).withColumnRenamed("node", "id")
    own = classes.select("digest", "rep").join(label.select(F.col("id").alias("rep"), "component"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = sketches.select("doc_id", "n_shingles", "digest").join(own, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all documents, by shingles of two words."""
    small_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)
