"""Benchmark decontamination: n-gram seeds join training passages to test items, Smith-Waterman scores the alignments.

Items of LONG words and more are met by two distinct three-word seeds near one diagonal. Shorter ones are met by their
rarest words in the corpus, as many as it takes: an alignment of share t matches t * n of an item's n words at least,
so one of its n - t * n + 1 rarest words is among them, and no such alignment is missed."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORDISH, chunks, mix, prefix_hash, small_batches, span_hash, table, utf8, words

#: Words of a seed, and distinct seeds of an item that a passage needs to be aligned with it; words of an item for that.
SEED, SEEDS, LONG = 3, 2, 15
#: Items of fewer words count only word for word, and of at most so many words only where they are the whole text.
EDITED, WHOLE = 6, 2
#: Smith-Waterman scores by words.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the best possible score (all words of the item in order) from which a passage counts as a copy.
THRESHOLD = 0.5
#: Test items are handled in blocks of so many words at most, which bounds what is sent to executors.
BLOCK_WORDS = 1_000_000


@dataclass
class Seeds:
    """Sorted distinct seeds, and postings (item, position in it) sorted by seed."""

    seeds: np.ndarray
    seed: np.ndarray
    item: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, parts: list[tuple[int, np.ndarray, np.ndarray]]) -> Seeds:
        """From (item, positions, seeds at them)."""
        hashes = np.concatenate([np.zeros(0, np.uint64), *(h for _, _, h in parts)])
        seeds, number = np.unique(hashes, return_inverse=True)
        item = np.concatenate([np.zeros(0, np.int64), *(np.full(len(h), t, np.int64) for t, _, h in parts)])
        place = np.concatenate([np.zeros(0, np.int64), *(p for _, p, _ in parts)])
        order = np.argsort(number, kind="stable")
        return cls(seeds, number[order], item[order], place[order])


@dataclass
class Items:
    """A block of test items: their word hashes, seeds of the long ones and rare words of the others."""

    ids: list[int]
    words: list[np.ndarray]
    long: Seeds
    rare: Seeds

    def weigh(self, counts: dict[int, int], threshold: float) -> None:
        """Picks the rare words, by how often the corpus has each word of the shorter items."""
        parts = []
        for t, own in enumerate(self.words):
            if len(own) < LONG:
                n = len(own) - math.ceil(least_share(len(own), threshold) * len(own) - 1e-9) + 1
                places = np.argsort([counts.get(int(w), 0) for w in own], kind="stable")[:n]
                parts.append((t, places.astype(np.int64), own[places]))
        self.rare = Seeds.of(parts)

    def short_words(self) -> np.ndarray:
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *(w for w in self.words if len(w) < LONG)]))


def least_share(n: int, threshold: float) -> float:
    """The share from which a passage counts as a copy of an item of n words."""
    return threshold if n >= EDITED else 1.0


def _hashed(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each stretch of documents i..j its word hashes and where each document's begin."""
    data, at = utf8(pc.utf8_lower(column))
    for i, j in chunks(at):
        own, offsets = data[at[i] : at[j]], at[i : j + 1] - at[i]
        start, end, first = words(own, offsets, WORDISH)
        yield i, j, span_hash(prefix_hash(own), start, end), first


def _seeds(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes at each word (SEED words from there), and whether they stay inside a document."""
    n = len(hashes) - SEED + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = np.zeros(n, np.uint64)
    for j in range(SEED):
        out = mix(out + hashes[j : n + j] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j + 1))
    inside = np.ones(len(hashes) + SEED, bool)
    for edge in first[1:]:
        inside[max(0, edge - SEED + 1) : edge] = False
    return out, inside[:n]


def _block(ids: list[int], found: list[np.ndarray]) -> Items:
    grams = [(t, _seeds(h, np.array([0, len(h)]))[0]) for t, h in enumerate(found) if len(h) >= LONG]
    return Items(ids, found, Seeds.of([(t, np.arange(len(g)), g) for t, g in grams]), Seeds.of([]))


def item_blocks(rows: Iterable[tuple[int | None, str | None]], most: int = BLOCK_WORDS) -> Iterator[Items]:
    """Items with a word at least, in blocks of bounded size; rows are taken one by one."""
    ids, found, total = [], [], 0
    for item_id, text in rows:
        if item_id is None or not text:
            continue
        for _, _, h, _ in _hashed(pa.array([text], pa.string())):
            if len(h):
                ids.append(item_id)
                found.append(h)
                total += len(h)
        if total >= most:
            yield _block(ids, found)
            ids, found, total = [], [], 0
    if ids:
        yield _block(ids, found)


class Lookup:
    """Finds seeds: a bitmap of their high bits first, then their place in the sorted list."""

    def __init__(self, own: Seeds) -> None:
        self.own, self.seeds = own, own.seeds
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.seeds >> np.uint64(44)).astype(np.int64)] = True
        self.starts = np.searchsorted(own.seed, np.arange(len(self.seeds) + 1))

    def find(self, hashes: np.ndarray, inside: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Places in hashes, and seed numbers."""
        if not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.bits[(hashes >> np.uint64(44)).astype(np.int64)] & inside)
        number = np.minimum(np.searchsorted(self.seeds, hashes[at]), len(self.seeds) - 1)
        same = self.seeds[number] == hashes[at]
        return at[same], number[same]

    def postings(self, hashes: np.ndarray, inside: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each hit and posting: place in hashes, item, position in the item, seed number."""
        at, number = self.find(hashes, inside)
        many = self.starts[number + 1] - self.starts[number]
        rows = np.repeat(self.starts[number], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(at, many), self.own.item[rows], self.own.place[rows], self.own.seed[rows]


def most(item: tuple[np.ndarray, np.ndarray], passage: np.ndarray) -> int:
    """The best score that an alignment can have: every word of the item (distinct words, counts) that the passage has, at most as often."""
    words_, counts = item
    at = np.minimum(np.searchsorted(words_, passage), len(words_) - 1)
    return MATCH * int(np.minimum(np.bincount(at[words_[at] == passage], minlength=len(words_)), counts).sum())


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman local alignment of two word sequences: best score, and the passage's first and last + 1 word in it.

    Rows are numpy vectors; gaps along a row are a running maximum, and starts travel with the scores."""
    n = len(passage)
    steps = np.arange(n + 1) * -GAP
    score, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for w in item:
        diagonal = score[:-1] + np.where(passage == w, MATCH, MISMATCH)
        up = score[1:] + GAP
        take_up = up > diagonal
        value = np.concatenate([[0], np.where(take_up, up, diagonal)])
        begin = np.concatenate([[0], np.where(take_up, start[1:], start[:-1])])
        fresh = value <= 0
        value[fresh], begin[fresh] = 0, np.flatnonzero(fresh)
        lifted = value + steps
        high = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == high, np.arange(n + 1), 0))
        moved = high - steps > value
        value, begin = np.where(moved, high - steps, value), np.where(moved, begin[source], begin)
        score, start = value, begin
        at = int(score.argmax())
        if score[at] > best[0]:
            best = (int(score[at]), int(start[at]), at)
    return best


Match = tuple[int, float, int, int, int]


def matches(items: Items, lookups: tuple[Lookup, Lookup], column: pa.Array, threshold: float, memo: dict) -> list[list[Match]]:
    """For each text its matches (item id, score, first word, last word + 1, seeds), the best passage for each item (of
    equal ones the first)."""
    out: list[list[Match]] = [[] for _ in range(len(column))]
    size = np.array([len(w) for w in items.words])
    bags: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i, _, hashes, first in _hashed(column):
        parts = [lookups[0].postings(*_seeds(hashes, first)), lookups[1].postings(hashes)]
        where, item, place, seed = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(where):
            continue
        doc = np.searchsorted(first, where, side="right") - 1
        shift = where - place
        order = np.lexsort((shift, item, doc))
        doc, item, shift, seed = doc[order], item[order], shift[order], seed[order]
        cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(shift) > np.maximum(4, size[item[1:]] // 2))) + 1
        best: dict[tuple[int, int], Match] = {}
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(doc)], strict=True):
            t, d = int(item[lo]), int(doc[lo])
            n = int(size[t])
            distinct = len(np.unique(seed[lo:hi]))
            if n >= LONG and distinct < SEEDS:
                continue
            if n <= WHOLE and first[d + 1] - first[d] != n:
                continue
            least = least_share(n, threshold)
            slack = 5 + n // 4 if n >= LONG else n  # the best score less the least one pays for n gaps at most
            begin = max(int(first[d]), int(shift[lo]) - slack)
            end = min(int(first[d + 1]), int(shift[hi - 1]) + n + slack)
            passage = hashes[begin:end]
            key = (t, passage.tobytes())
            if key not in memo:
                if len(memo) > 20_000:
                    memo.clear()
                if t not in bags:
                    bags[t] = np.unique(items.words[t], return_counts=True)
                memo[key] = align(items.words[t], passage) if most(bags[t], passage) >= least * MATCH * n else (0, 0, 0)
            score, s, e = memo[key]
            share = score / (MATCH * n)
            if share >= least and (share, distinct) > best.get((d, t), (0, 0.0, 0, 0, 0))[1::3]:
                best[d, t] = (items.ids[t], share, begin + s - int(first[d]), begin + e - int(first[d]), distinct)
        for (d, _), found in sorted(best.items()):
            out[i + d].append(found)
    return out


KIND = "array<struct<item_id: bigint, score: double, first_word: bigint, end_word: bigint, seeds: bigint>>"
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("seeds", pa.int64())]))


def _annotate(items: Items, place: int, threshold: float, before: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups, memo = (Lookup(items.long), Lookup(items.rare)), {}
        for batch in batches:
            found = [[dict(zip(("item_id", "score", "first_word", "end_word", "seeds"), m, strict=True)) for m in own] for own in matches(items, lookups, batch.column(place), threshold, memo)]
            columns, names = list(batch.columns), list(batch.schema.names)
            if before:
                found = [a + b for a, b in zip(columns.pop().to_pylist(), found, strict=True)]
                names.pop()
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, _ARROW)], [*names, "matches"])

    return run


def word_counts(docs: DataFrame, hashes: np.ndarray, text_col: str) -> dict[int, int]:
    """How often the corpus has each of the words (a block's at most); counted by task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, counts = Lookup(Seeds.of([(0, np.zeros(len(hashes), np.int64), hashes)])), np.zeros(len(hashes), np.int64)
        for batch in batches:
            for _, _, own, _ in _hashed(batch.column(0)):
                counts += np.bincount(lookup.find(own)[1], minlength=len(hashes))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["word", "n"])

    found = docs.select(text_col).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {int(hashes[r.word]): r.n for r in found}


def annotate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS, text_col: str = "text") -> DataFrame:
    """docs with all its columns and `matches`, the test items (item_id, text) of which the text has a copy.

    A passage near which an item's seeds stand (see above) is aligned with it word by word; score is the share of the
    item's best possible score, and passages from `threshold` on are copies. Items of three to five words count only
    where they stand word for word, items of one or two only where they are the whole text; items without words match
    nothing. Items come to the driver in blocks of bounded size, each block one pass over docs, and one more to count
    the words of its items under LONG words, if it has such. Null and empty texts match nothing; repeated rows each get
    their matches; an empty benchmark gives empty lists; of passages with equal shares the one with more seeds, then
    the first, is given. A column named matches is replaced. Texts are searched whole."""
    docs = docs.drop("matches")
    place = docs.columns.index(text_col)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out, before = docs, False
    items_found = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("text")).distinct().orderBy("item_id", "text")
    for block in item_blocks(map(tuple, items_found.toLocalIterator()), block_words):
        short = block.short_words()
        if len(short):
            block.weigh(word_counts(docs, short, text_col), threshold)
        out = out.mapInArrow(_annotate(block, place, threshold, before), f"{kind}, matches {KIND}")
        before = True
    return out if before else docs.withColumn("matches", F.array().cast(KIND))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: a row (doc_id, item_id, score, first_word, end_word, seeds) for each copy of an item of benchmark in documents."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = annotate(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
