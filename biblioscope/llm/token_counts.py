"""Token counts through a digest cache: only texts whose digest has no stored count for this tokenizer are encoded."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remembered, shared_path, small_batches, stored, table

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Entries of a worker's memo of word counts; when full it is emptied, so it bounds memory and changes no result.
MEMO_WORDS = 300_000
#: Up to so many missing digests (48 bytes each) are broadcast to pick their texts; beyond that the texts are shuffled.
BROADCAST_ROWS = 500_000
#: How the model writes a space; the two are one character to it.
SPACE_MARK = "\u2581"
_UNITS = re.compile(" +[^ ]*|[^ ]+")


class PieceCounter(dict):
    """Counts the pieces of a text, word by word with a memo.

    No piece of such a vocabulary has the space mark after another character, so merges never cross the start of
    a run of spaces and a text's count is the sum over its words, each with the spaces before it. A text that has
    the mark itself is encoded whole, and so is every text where the vocabulary has such pieces.
    """

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces) and len(self.model.encode("  a")) > len(self.model.encode("a"))

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        n = len(self.model.encode(word)) if word else 1  # a space that ends a text is a piece
        if len(word) < 100:
            self[word] = n
        return n

    def count(self, text: str) -> int:
        if not self.by_word or "▁" in text:
            return len(self.model.encode(text))
        if not text:
            return 0
        parts = text.split(" ")
        if "" in parts:
            parts = [u[1:] for u in _UNITS.findall(" " + text)]
        return sum(map(self.__getitem__, parts))


def counter(model_path: str) -> PieceCounter:
    return remembered(("pieces", model_path), lambda: PieceCounter(model_path))


def _encode(model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path).count
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(t) for t in batch.column(1).to_pylist()], pa.int64())], ["content_digest", "n_tokens"])

    return run


def tokenizer_version(model_path: str) -> str:
    with open(model_path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def cached_counts(spark: SparkSession, cache_dir: str, version: str) -> DataFrame | None:
    """The stored counts of this tokenizer version, or None; a repeated digest (two writers) counts once."""
    path = f"{cache_dir}/tokenizer={version}"
    try:
        return spark.read.schema("content_digest binary, n_tokens bigint").parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def normalised(text_col: str) -> Column:
    """The content that counts depend on: null as empty, the model's space mark as the space it stands for. Nothing else
    is folded, since it would change counts."""
    return F.translate(F.coalesce(F.col(text_col), F.lit("")), SPACE_MARK, " ")


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, text, content_digest): the digest of the normalised content."""
    kept = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return kept.withColumn("content_digest", F.unhex(F.sha2(normalised("text").cast("binary"), 256)))


def token_counts(docs: DataFrame, model_path: str, cache_dir: str, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens), one for each row of docs.

    cache_dir holds (digest of normalised content, count) by tokenizer digest. Digests alone are shuffled to find the
    misses; one text for each (that of the smallest id) is encoded and its count appended before the join. Null texts
    count as empty (0 tokens); repeated rows and repeated or null ids each give their row; an empty table gives none;
    other columns of docs are ignored. Texts are encoded whole.
    """
    spark = docs.sparkSession
    version = tokenizer_version(model_path)
    keyed = digested(docs, id_col, text_col)
    wanted = keyed.groupBy("content_digest").agg(F.min("doc_id").alias("rep"))
    known = cached_counts(spark, cache_dir, version)
    if known is not None:
        wanted = wanted.join(known.select("content_digest"), "content_digest", "left_anti")
    wanted = stored(wanted, "missing-digests").withColumnRenamed("content_digest", "missing")
    few = wanted.count() <= broadcast_rows
    same = (F.col("content_digest") == F.col("missing")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    misses = keyed.join(F.broadcast(wanted) if few else wanted.hint("merge"), same, "left_semi").select("content_digest", "text")
    if not few:
        misses = misses.dropDuplicates(["content_digest"])
    misses.mapInArrow(_encode(model_path), "content_digest binary, n_tokens bigint").write.mode("append").parquet(f"{cache_dir}/tokenizer={version}")
    # rows that share id and content, and other writers, may have stored a digest more than once
    counts = cached_counts(spark, cache_dir, version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keyed.select("doc_id", "content_digest", F.octet_length("text").cast("bigint").alias("n_bytes")).join(counts, "content_digest").select("doc_id", "n_bytes", "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every text of documents. The cache starts empty unless spark.biblioscope.tokenCache names a lasting one."""
    small_batches(spark)
    cache = spark.conf.get("spark.biblioscope.tokenCache", None) or shared_path(spark, "token-cache")
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL), cache).withColumn("over_limit", F.col("n_tokens") > LIMIT)
