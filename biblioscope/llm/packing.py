"""Best-fit decreasing packing of tokenized documents into sequences of bounded length."""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import remembered, small_batches, stored, table

MODEL = "word_bpe_49k.json"
SEQUENCE = 2048
#: Entries of a worker's memo of pre-tokens, beside those of one batch; when full it is emptied.
MEMO_RUNS = 500_000
#: Up to so many placements (32 bytes each) are broadcast; beyond that they are joined by stretches of so many numbers.
BROADCAST_RANGES, BUCKET = 250_000, 1 << 14
#: White space, and characters of one code point in NFC that are lower-cased one by one.
_PLAIN = re.compile(r"[ \n\t!-~¡-įı-ɏ]+")
_SPACE = re.compile("[ \n\t\r]+")
_OF = {kind: "".join(re.escape(chr(i)) for i in range(33, 0x250) if unicodedata.category(chr(i))[0] == kind) for kind in "LN"}
#: How the tokenizer's file says that words are cut into pre-tokens, for the characters of _PLAIN; letters come first
#: here, which changes nothing, as no other alternative begins with one.
_RUNS = re.compile(rf"[{_OF['L']}]+|[{_OF['N']}]|'(?:s|t|re|ve|m|ll|d)|[^\s{_OF['L']}{_OF['N']}]+")


class RunEncoder(dict):
    """Ids of texts as little-endian uint32 bytes, pre-token by pre-token with a memo.

    The tokenizer's pre-tokenizer drops white space and never matches across it, and its normalizer (NFC, white
    space to a space, lower case by character) acts on each side of it alone, so ids can be joined. Words with
    characters beyond _PLAIN, or with what may be a special token, go to the tokenizer as they are.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a pre-token
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, new: list[str]) -> None:
        """Adds pre-tokens to the memo; they are encoded together, 20,000 in a string."""
        if len(self) > MEMO_RUNS:
            self.clear()
        for k in range(0, len(new), 20_000):
            own = new[k : k + 20_000]
            ids = self.encode(" ".join(own))
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(own):
                ids = ids.tobytes()
                at = [0, *(4 * last).tolist()]
                self.update((run, ids[at[i] : at[i + 1]]) for i, run in enumerate(own))
            else:
                self.update((run, self.encode(run).tobytes()) for run in own)

    def __missing__(self, run: str) -> bytes:
        ids = self[run] = self.encode(run).tobytes()
        return ids

    def ids(self, texts: list[str]) -> list[bytes]:
        plain = {i: _RUNS.findall(text.lower()) for i, text in enumerate(texts) if _PLAIN.fullmatch(text) and "<|" not in text}
        self.learn(list(set().union(*plain.values()).difference(self)))
        return [b"".join(map(self.__getitem__, plain[i])) if i in plain else self.mixed(text) for i, text in enumerate(texts)]

    def mixed(self, text: str) -> bytes:
        out = []
        for word in _SPACE.split(text):
            if _PLAIN.fullmatch(word) and "<|" not in word:
                out += map(self.__getitem__, _RUNS.findall(word.lower()))
            elif word:
                out.append(self.encode(word).tobytes())
        return b"".join(out)


def encoder(path: str) -> RunEncoder:
    return remembered(("runs", path), lambda: RunEncoder(path))


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"


def _pieces(path: str, size: int, end_id: int):
    """Cuts each document's ids; nth numbers the pieces of one length within this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, part = encoder(path).ids, np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[at : at + 4 * size]
                    n = len(own) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(own), part, int(seen[n])))
                    seen[n] += 1
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return run


class CapacityTree:
    """A segment tree over remaining capacities 0..size: which of them some open bin has."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.leaves
        while at:
            self.open[at] += n
            at >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of at least `least` that an open bin has, in logarithmic time."""
        at = least + self.leaves
        if self.open[at]:
            return least
        while at > 1:
            if not at & 1 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Where best-fit decreasing puts counts[length] pieces of each length, in bulk.

    Rows (length, first, n, sequence, offset): the pieces numbered first .. first + n - 1 of that length go, one
    each, to sequences sequence .. sequence + n - 1, at that offset. Pieces of one length that meet equally tight
    bins are placed together, a bin being filled before the next, which gives the bins that placing them one by one
    gives; so the work and the rows follow the number of lengths, not of documents.
    """
    tree, groups, made = CapacityTree(size), {}, 0  # groups: remaining capacity -> ranges (first bin, n)
    out: list[tuple[int, int, int, int, int]] = []

    def push(capacity: int, first: int, n: int) -> None:
        own = groups.setdefault(capacity, [])
        if own and own[-1][0] + own[-1][1] == first:
            own[-1] = (own[-1][0], own[-1][1] + n)
        else:
            own.append((first, n))
        tree.add(capacity, n)

    def fill(length: int, nth: int, left: int, first: int, n: int | None, room: int) -> tuple[int, int]:
        """Puts up to `left` pieces into n like bins (None: new ones), each filled before the next; returns pieces and bins used."""
        each = room // length
        full = left // each if n is None else min(n, left // each)
        for k in range(each if full else 0):
            out.append((length, nth + k * full, full, first, size - room + k * length))
        if full:
            push(room - each * length, first, full)
        rest = left - each * full if n is None or full < n else 0
        for k in range(rest):
            out.append((length, nth + each * full + k, 1, first + full, size - room + k * length))
        if rest:
            push(room - rest * length, first + full, 1)
        return each * full + rest, full + bool(rest)

    for length in sorted(counts, reverse=True):
        left, nth = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                placed, used = fill(length, nth, left, made, None, size)
                made += used
            else:
                first, n = groups[room].pop()
                placed, used = fill(length, nth, left, first, n, room)
                if used < n:
                    groups[room].append((first + used, n - used))
                tree.add(room, -used)
            nth += placed
            left -= placed
    return out


def pack(docs: DataFrame, model_path: str, size: int = SEQUENCE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_RANGES) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts give one piece, the end id alone. Documents longer than size are cut into pieces of size;
    no other document is cut. Equal lengths are interchangeable; repeated rows and ids are packed each. An empty
    table gives no rows; other columns are ignored. The pieces are stored once, so that their numbering outlives
    executors; only counts by length (at most `size` rows) come to the driver. The placements, a few for each pair of
    length and remaining capacity, are broadcast up to broadcast_rows, else written and joined.
    """
    spark = docs.sparkSession
    made = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_pieces(model_path, size, end_id), PIECES)
    pieces = stored(made, "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = by_part.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"), "n")
    base = stored(base, "piece-counts")
    counts = {int(r.length): int(r.n) for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed = best_fit_decreasing(counts, size)
    # the counts grow with the table (one for each length and partition), so they are never broadcast
    keyed = base.select("length", "part", "base").hint("merge")
    numbered = pieces.join(keyed, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("number"))
    if len(placed) <= broadcast_rows:
        return _place(numbered, _ranges(placed))
    return _join_ranges(numbered, placed)


def _ranges(placed: list[tuple[int, int, int, int, int]]) -> dict[int, np.ndarray]:
    found: dict[int, list] = {}
    for length, *rest in placed:
        found.setdefault(length, []).append(rest)
    return {k: np.array(sorted(v), np.int64) for k, v in found.items()}


RESULT = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def _place(numbered: DataFrame, ranges: dict[int, np.ndarray]) -> DataFrame:
    """Looks up each piece's range by its number among those of its length; the ranges go to every executor."""
    ranges_sent = numbered.sparkSession.sparkContext.broadcast(ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence, offset = np.zeros_like(number), np.zeros_like(number)
            for n in np.unique(length):
                rows, own = np.flatnonzero(length == n), ranges_sent.value[int(n)]
                at = np.searchsorted(own[:, 0], number[rows], side="right") - 1
                sequence[rows] = own[at, 2] + number[rows] - own[at, 0]
                offset[rows] = own[at, 3]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], [x.split()[0] for x in RESULT.split(", ")])

    return numbered.mapInArrow(run, RESULT)


def _join_ranges(numbered: DataFrame, placed: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """The same by a join: ranges, cut at multiples of BUCKET, meet the pieces of their length and stretch of numbers."""
    spark = numbered.sparkSession
    table_ = stored(spark.createDataFrame([tuple(map(int, x)) for x in placed], "length bigint, first bigint, many bigint, sequence bigint, offset bigint"), "ranges")
    cut = table_.withColumn("bucket", F.explode(F.sequence(F.expr(f"first div {BUCKET}"), F.expr(f"(first + many - 1) div {BUCKET}")))).withColumnRenamed("offset", "at")
    joined = numbered.withColumn("bucket", F.expr(f"number div {BUCKET}")).join(cut.hint("merge"), ["length", "bucket"]).filter("number >= first and number < first + many")
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("number") - F.col("first")).alias("sequence_id"), F.col("at").alias("offset"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all documents, in sequences of 2048 tokens."""
    small_batches(spark)
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
