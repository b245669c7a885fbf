"""Exact repeats by a logarithmic family of suffix arrays, dealt over executors by content.

A window is a string of `size` bytes. Its anchor is the least k-gram in it by hash (the leftmost of equals), so equal
windows have equal anchors at equal places, and all that can match meets in one partition. Windows next to each other with the
same anchor travel together as a segment. In a partition, segments that are equal as a whole are resolved first; what is
left of anchors that several different segments have goes, batch by batch, through a family of suffix arrays (see
suffix_index): a batch is sorted, merge-scanned against every level for equal windows, and levels of equal size merge.
RepeatIndex keeps such a family in the shared folder, so that later batches of documents meet all earlier ones. Anchors that very many segments have (a passage that a third of all documents share) are
hot: their windows travel one by one, by their own hash, each distinct one once for a stretch, so no task gets a hot group.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, prefix_hash, release, shared_path, small_batches, span_hash, stored, table, utf8
from .suffix_index import SIZE, Level, SuffixFamily, indexed, scanned

GRAM = 32
#: Bytes whose anchors are found at a time; positions fit the low bits of a sort key.
STRETCH = 1 << 21
#: Windows of a batch of the index family.
BATCH = 1 << 14
#: Bytes of text for each partition of the second pass, at most; a task's memory follows it, whatever the table's size.
PART_BYTES = 32 << 20
_LOW = np.uint64(STRETCH * 2 - 1)
#: Bits of an anchor's hash that the first pass compares, and of those that the bitmap of repeated anchors keeps (32 MB).
COMPARED, SLOTS = 40, 28
#: Anchors that a task of the first pass holds before it sends them.
HELD = 1 << 22
#: Bytes of text whose segments a task of the second pass holds before it sends them (so blobs grow with tasks times parts, not
#: with texts times parts), and bytes of blobs of one Arrow batch.
HELD_BYTES, SENT_BYTES = 8 << 20, 1 << 20
#: An anchor is hot with so many occurrences, and at least 1 / HOT_SHARE of its part's; so a part has HOT_SHARE of them at most.
HOT, HOT_SHARE = 2_000, 64


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    out = np.zeros(n, np.uint64)
    for j in range(0, GRAM, 8):
        out = (out ^ words[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix(out)


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a stretch of documents: document, first window, windows, anchor hash, anchor place less first window."""
    n = len(data) - SIZE + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, np.zeros(0, np.uint64), none
    grams = gram_hashes(data)
    least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    span, have = SIZE - GRAM + 1, 1
    while 2 * have <= span:  # running minima over windows of doubling width
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: n], least[span - have : span - have + n])
    anchor = (least[:n] & _LOW).astype(np.int64)
    valid = np.ones(n, bool)
    for edge in offsets[1:-1]:
        valid[max(0, edge - SIZE + 1) : edge] = False
    start = np.ones(n, bool)
    start[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    first = np.flatnonzero(start & valid)
    stop = np.ones(n, bool)
    stop[:-1] = start[1:] | ~valid[1:]
    last = np.flatnonzero(stop & valid)
    doc = np.searchsorted(offsets, first, side="right") - 1
    return doc, first, last - first + 1, grams[anchor[first]], anchor[first] - first


def stretches(offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of documents that fit STRETCH bytes, as (first, last + 1, from byte, to byte); a longer document goes in parts
    that overlap by SIZE - 1 bytes, so that each window is in one part."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + STRETCH, side="right")) - 1
        if j > i:
            yield i, j, int(offsets[i]), int(offsets[j])
            i = j
            continue
        at, end = int(offsets[i]), int(offsets[i + 1])
        while True:
            yield i, i + 1, at, min(end, at + STRETCH)
            if at + STRETCH >= end:
                break
            at += STRETCH - SIZE + 1
        i += 1


PARTS = "part int, blob binary"


def _planes(values: np.ndarray) -> bytes:
    """Sorted numbers as compressed differences, byte by byte of equal weight."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _from_planes(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").reshape(-1), dtype=np.uint64)


def _edges(parts: int) -> np.ndarray:
    return np.array([(p << COMPARED) // parts for p in range(parts + 1)], np.uint64)


def _anchors(parts: int):
    """First pass: each anchor's hash, once for a task, with its count there."""

    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.searchsorted(values, _edges(parts))
        found = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
        pack = zstandard.ZstdCompressor(level=1).compress
        blobs = [pickle.dumps((_planes(values[cuts[p] : cuts[p + 1]]), pack(counts[cuts[p] : cuts[p + 1]].astype("<u4").tobytes()))) for p in found]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            data, at = utf8(batch.column(0))
            for i, j, lo, hi in stretches(at):
                anchor = segments(data[lo:hi], np.clip(at[i : j + 1] - lo, 0, hi - lo))[3]
                held.append(anchor >> np.uint64(64 - COMPARED))
                if sum(map(len, held)) > HELD:
                    yield send(held)
                    held = []
        if held:
            yield send(held)
        release()

    return run


def _repeated(parts: int):
    """The partition's stretch of the bitmap: slots of anchors that occur more than once; and its hot anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, many = None, [], []
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                values, counts = pickle.loads(blob)
                held.append(_from_planes(values))
                many.append(np.frombuffer(unpack(counts), "<u4"))
        if part is None:
            return
        values, where = np.unique(np.concatenate(held), return_inverse=True)
        counts = np.bincount(where, np.concatenate(many)).astype(np.int64)
        slots = np.unique(values[counts > 1] >> np.uint64(COMPARED - SLOTS)).astype(np.int64)
        lo, hi = (int(x) >> (COMPARED - SLOTS + 3) for x in _edges(parts)[part : part + 2])
        bits = np.zeros((hi - lo + 1) * 8, np.uint8)
        bits[slots - 8 * lo] = 1
        hot = values[counts >= max(HOT, counts.sum() // HOT_SHARE)].astype("<u8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int64()), pa.array([zstandard.ZstdCompressor(level=1).compress(np.packbits(bits, bitorder="little").tobytes())], pa.binary()), pa.array([hot], pa.binary())], ["first", "bits", "hot"])
        release()

    return run


def repeated_anchors(rows: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The bitmap of the whole table's repeated anchors (2^SLOTS bits, 32 MB, whatever the table's size) and the sorted hot ones
    (HOT_SHARE for each part at most)."""
    dealt = rows.select("text").mapInArrow(_anchors(parts), PARTS).repartitionById(parts, F.col("part"))
    out, hot = np.zeros((1 << (SLOTS - 3)) + 1, np.uint8), [np.zeros(0, np.uint64)]
    for r in dealt.mapInArrow(_repeated(parts), "first bigint, bits binary, hot binary").collect():
        own = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r.bits)), np.uint8)
        out[r.first : r.first + len(own)] |= own[: len(out) - r.first]
        hot.append(np.frombuffer(bytes(r.hot), "<u8"))
    return out, np.sort(np.concatenate(hot))


def _one_by_one(doc: np.ndarray, start: np.ndarray, many: np.ndarray, first: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments as single windows whose anchor is their own hash, each distinct one once, by its earliest owner; the others
    are known to be late and become records without bytes (lead -1): document, first window, windows."""
    step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    doc, start, first = np.repeat(doc, many), np.repeat(start, many) + step, np.repeat(first, many) + step
    h = span_hash(prefix_hash(data), first, first + SIZE)
    order = np.lexsort((start, doc, h))
    doc, start, first, h = doc[order], start[order], first[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    group = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    table_ = np.lib.stride_tricks.sliding_window_view(data, SIZE)
    fresh |= (table_[first] != table_[first[group]]).any(1)  # equal hashes of unequal windows
    late = ~fresh & ((doc != doc[group]) | (start != start[group]))
    d, p = doc[late], start[late]
    order = np.lexsort((p, d))
    d, p = d[order], p[order]
    cut = np.flatnonzero((np.diff(d) != 0) | (np.diff(p) != 1)) + 1
    lo, hi = np.concatenate([[0], cut])[: len(d)].astype(np.int64), np.concatenate([cut, [len(d)]])[: len(d)].astype(np.int64)
    n = int(fresh.sum())
    return (
        np.concatenate([doc[fresh], d[lo]]),
        np.concatenate([start[fresh], p[lo]]),
        np.concatenate([np.ones(n, np.int64), hi - lo]),
        np.concatenate([h[fresh], mix(d[lo].astype(np.uint64))]),
        np.concatenate([np.zeros(n, np.int64), np.full(len(lo), -1)]),
        np.concatenate([first[fresh], np.zeros(len(lo), np.int64)]),
    )


Columns = tuple[np.ndarray, ...]


def _bytes_of(many: np.ndarray, lead: np.ndarray) -> np.ndarray:
    return np.where(lead < 0, 0, many.astype(np.int64) + SIZE - 1)


def _gathered(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Spans of bytes, one after the other."""
    return data[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def _pack(doc: np.ndarray, start: np.ndarray, many: np.ndarray, anchor: np.ndarray, lead: np.ndarray, data: np.ndarray) -> bytes:
    """Segments of one part: five columns and their bytes, compressed."""
    raw = b"".join([np.int64(len(doc)).tobytes(), doc.astype("<i8").tobytes(), start.astype("<i8").tobytes(), many.astype("<i4").tobytes(), anchor.astype("<u8").tobytes(), lead.astype("<i4").tobytes(), data.tobytes()])
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _dealt(held: list[Columns], parts: int) -> Iterator[pa.RecordBatch]:
    """The held segments (with their text) as a blob for each part."""
    texts = [x[-1] for x in held]
    base = np.cumsum([0, *map(len, texts)])
    doc, start, many, anchor, lead, first = (np.concatenate([x[k] for x in held]) for k in range(6))
    first = first + np.repeat(base[:-1], [len(x[0]) for x in held])
    data, size = np.concatenate(texts), _bytes_of(many, lead)
    part = (anchor >> np.uint64(33)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    found, blobs, sent = [], [], 0
    for p in np.flatnonzero(np.diff(edges)).tolist():
        rows = order[edges[p] : edges[p + 1]]
        found.append(p)
        blobs.append(_pack(doc[rows], start[rows], many[rows], anchor[rows], lead[rows], _gathered(data, first[rows], size[rows])))
        sent += len(blobs[-1])
        if sent >= SENT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])
            found, blobs, sent = [], [], 0
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    for kind in ("<i8", "<i8", "<i4", "<u8", "<i4"):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return (*out, np.frombuffer(raw, np.uint8, offset=at))


def _deal(parts: int, sent):
    """Second pass: the segments of repeated anchors, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, hot = sent.value
        held: list[Columns] = []
        size = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, at = utf8(batch.column(1))
            for i, j, lo, hi in stretches(at):
                own = data[lo:hi]
                offsets = np.clip(at[i : j + 1] - lo, 0, hi - lo)
                doc, first, many, anchor, lead = segments(own, offsets)
                slot = anchor >> np.uint64(64 - SLOTS)
                some = np.flatnonzero(repeated[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
                if not len(some):
                    continue
                doc, first, many, anchor, lead = (x[some] for x in (doc, first, many, anchor, lead))
                start = first - (at[i + doc] - lo)
                doc = ids[i + doc]
                if len(hot):
                    key = anchor >> np.uint64(64 - COMPARED)
                    is_hot = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
                    if is_hot.any():
                        single = _one_by_one(doc[is_hot], start[is_hot], many[is_hot], first[is_hot], own)
                        rest = (doc, start, many, anchor, lead, first)
                        doc, start, many, anchor, lead, first = (np.concatenate([x[~is_hot], y]) for x, y in zip(rest, single, strict=True))
                held.append((doc, start, many, anchor, lead, first, own))
                size += len(own)
                if size >= HELD_BYTES:
                    yield from _dealt(held, parts)
                    held, size = [], 0
        if held:
            yield from _dealt(held, parts)
        release()

    return run


SPANS = "doc_id bigint, first bigint, last bigint"
Spans = tuple[np.ndarray, np.ndarray, np.ndarray]


def joined(docs: np.ndarray, places: np.ndarray) -> Spans:
    """Late windows as spans of bytes: documents, firsts, lasts + 1."""
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order]
    cut = np.flatnonzero((np.diff(docs) != 0) | (np.diff(places) > 1)) + 1
    lo, hi = np.concatenate([[0], cut])[: len(docs)].astype(np.int64), np.concatenate([cut, [len(docs)]])[: len(docs)].astype(np.int64) - 1
    return docs[lo], places[lo], places[hi] + SIZE


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition: spans of bytes covered by windows that start earlier elsewhere."""
    blobs = [_unpack(b) for batch in batches for b in batch.column("blob").to_pylist()]
    if not blobs:
        return
    doc, start, many, anchor, lead = (np.concatenate([b[k] for b in blobs]) for k in range(5))
    data = np.concatenate([b[5] for b in blobs])
    del blobs
    known = lead < 0
    size = _bytes_of(many, lead)
    begin = np.cumsum(size) - size
    spans: list[Spans] = [(doc[known], start[known], start[known] + many[known] + SIZE - 1)]
    texts = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.append(begin, len(data))), pa.py_buffer(data)])
    code = texts.dictionary_encode().indices.to_numpy(zero_copy_only=False)  # equal as a whole
    order = np.lexsort((start, doc, code))
    order = order[~known[order]]
    fresh = np.ones(len(order), bool)
    fresh[1:] = code[order][1:] != code[order][:-1]
    earliest = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] if len(order) else order
    late = order[(doc[order] != doc[earliest]) | (start[order] != start[earliest])]
    spans.append((doc[late], start[late], start[late] + size[late]))
    # windows of one anchor stand at the places of the anchor's bytes, so equal ones are in its different segments alone
    order = order[fresh]
    _, where, segments_of = np.unique(anchor[order], return_inverse=True, return_counts=True)
    order = order[segments_of[where] > 1]
    order = order[np.lexsort((start[order], doc[order], anchor[order]))]
    del texts, code, earliest, late, known
    family = SuffixFamily()
    windows = np.cumsum(many[order], dtype=np.int64)
    lo = 0
    while lo < len(order):
        hi = int(np.searchsorted(windows, (windows[lo - 1] if lo else 0) + BATCH)) + 1
        rows = order[lo:hi]
        spans.append(joined(*family.add(_gathered(data, begin[rows], size[rows]), np.cumsum(size[rows]) - size[rows], doc[rows], start[rows], many[rows].astype(np.int64))))
        lo = hi
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in spans]).astype(np.int64)) for k in range(3)], ["doc_id", "first", "last"])
    release()


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _merged(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the spans of each row: first bytes, last bytes + 1, rows."""
    order = np.lexsort((first, row))
    row, first, last = row[order].astype(np.int64), first[order].astype(np.int64), last[order].astype(np.int64)
    step = int(last.max(initial=0)) + 1
    reach = np.maximum.accumulate(row * step + last)  # rows don't reach into each other
    new = np.ones(len(row), bool)
    new[1:] = row[1:] * step + first[1:] > reach[:-1]
    new[1:] |= row[1:] != row[:-1]
    ends = np.append(np.flatnonzero(new)[1:], len(row))[: int(new.sum())] - 1
    return first[new], reach[ends] - row[ends] * step, row[new]


def _cut(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            raw, rows = data.tobytes(), []
            lists = batch.column(2)
            many = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            begins, ends, merging = _merged(np.repeat(np.arange(len(many)), many), *(x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten()))
            edges = np.searchsorted(merging, np.arange(len(many) + 1)).tolist()
            for i, doc in enumerate(batch.column(0).to_pylist()):
                text, kept, last = raw[at[i] : at[i + 1]], [], 0
                merged = list(zip(begins[edges[i] : edges[i + 1]].tolist(), ends[edges[i] : edges[i + 1]].tolist(), strict=True))
                for lo, hi in merged:
                    kept.append(text[last:lo])
                    last = hi
                kept.append(text[last:])
                left = b"".join(kept)
                rows.append((doc, len(text), len(text) - len(left), len(merged), hashlib.sha256(left).hexdigest(), left)[: 6 if keep_text else 5])
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 6 if keep_text else 5]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names)

    return run


def _usable(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def parts_for(rows: DataFrame) -> int:
    """Partitions that bound what a task gets: one for each PART_BYTES of text, and spark.sql.shuffle.partitions at least."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def repeats(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows (doc_id, first, last): byte spans covered by a window that also starts earlier (smaller doc_id, or same
    document, earlier place). Spans may overlap. Rows with a null id or text are left out; rows that share an id and have
    equal texts aren't repeats of each other."""
    spark = docs.sparkSession
    rows = _usable(docs)
    parts = parts or parts_for(rows)
    sent = spark.sparkContext.broadcast(repeated_anchors(rows, parts))
    dealt = rows.mapInArrow(_deal(parts, sent), PARTS).repartitionById(parts, F.col("part"))
    return dealt.mapInArrow(_resolve, SPANS)


def remove_repeats(docs: DataFrame, parts: int | None = None, keep_text: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and with keep_text the bytes kept).

    Texts are UTF-8 bytes, null is empty; each byte covered by a SIZE-byte string that also starts earlier goes, judged
    on the input. Texts shorter than SIZE lose nothing; of equal texts the one with the smallest id stays. Rows with a
    null id are kept whole. Repeated rows (one id) each give their row. An empty table gives none; other columns are ignored."""
    spans = repeats(docs, parts).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    return rows.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_cut(keep_text), RESULT + (", kept binary" if keep_text else ""))


def _segments_of(parts: int):
    """All segments of a batch of documents, by part, whether their anchors repeat or not: a later batch may hold the rest."""
    everything = type("Sent", (), {"value": (np.full(1 << (SLOTS - 3), 255, np.uint8), np.zeros(0, np.uint64))})
    return _deal(parts, everything)


def _step(merging: int):
    """One partition of an index: its levels, numbered, come first (the `merging` lowest are merged with the batch), then the batch (number -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels: dict[int, Level] = {}
        new, part = [], None
        for batch in batches:
            for part, number, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "number", "blob")), strict=True):
                if number >= 0:
                    levels[number] = Level.unpacked(blob)
                else:
                    new.append(_unpack(blob))
        if part is None:
            return
        spans: list[Spans] = []
        out = None
        if new:
            doc, start, many, _, _ = (np.concatenate([b[k] for b in new]).astype(np.int64) for k in range(5))
            size = many + SIZE - 1
            out, late = indexed(np.concatenate([b[5] for b in new]), np.cumsum(size) - size, doc, start, many)
            spans.append(joined(*late))
            for level in levels.values():
                late, of_batch, _ = scanned(level, out)
                spans.append(joined(*late))
                if of_batch.any():
                    out = out.without(of_batch)
        for number in range(merging):
            if number in levels:
                out = levels[number] if out is None else levels[number].merged(out)
        columns = [np.concatenate([np.zeros(0, np.int64), *(x[k] for x in spans)]) for k in range(3)]
        n, more = len(columns[0]), int(out is not None)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(np.append(c, [0] * more), pa.int64()) for c in columns), pa.array([None] * n + [part] * more, pa.int32()), pa.array([None] * n + ([out.packed()] if more else []), pa.binary())],
            ["doc_id", "first", "last", "part", "blob"],
        )
        release()

    return run


class RepeatIndex:
    """A lasting logarithmic index of all windows of the documents added so far, at a path that the cluster shares.

    Batch b becomes a level by itself; where levels 0 .. t - 1 are taken, they merge with it to level t, as a binary counter
    does, so n batches keep log n levels and each window is rewritten log n times. Levels are Parquet tables that nothing
    changes; `state` names the live ones of each batch, and a batch that fails before its state is written has no
    effect. A task holds one part of the levels; `parts` is fixed when the index is made."""

    def __init__(self, spark: SparkSession, path: str | None = None, parts: int = 64) -> None:
        self.spark, self.path = spark, path or shared_path(spark, "repeat-index")
        try:
            last = spark.read.parquet(f"{self.path}/state").orderBy(F.desc("batch")).first()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            last = None
        self.batches = last.batch + 1 if last else 0
        self.parts = last.parts if last else parts
        self.levels: dict[int, str] = {x.number: x.path for x in last.levels} if last else {}

    def add(self, docs: DataFrame) -> DataFrame:
        """Rows (doc_id, first, last): spans of documents of this batch that start earlier in it or in an older one, and of
        older documents that start earlier in this batch. The union over batches covers what repeats() of all documents covers.

        Rows with a null id or text are left out; an empty batch gives no rows."""
        dealt = _usable(docs).mapInArrow(_segments_of(self.parts), PARTS).select("part", F.lit(-1).alias("number"), "blob")
        for number, path in self.levels.items():
            dealt = dealt.unionByName(self.spark.read.parquet(path).select("part", F.lit(number).alias("number"), "blob"))
        merging = next(t for t in range(len(self.levels) + 1) if t not in self.levels)
        dealt = dealt.repartitionById(self.parts, F.col("part")).sortWithinPartitions("part", F.desc("number"))
        done = stored(dealt.mapInArrow(_step(merging), f"{SPANS}, part int, blob binary"), "index-step")
        path = f"{self.path}/levels/batch-{self.batches}-{uuid.uuid4().hex}"
        done.filter("part is not null").select("part", "blob").write.parquet(path)
        live = {number: own for number, own in self.levels.items() if number >= merging} | {merging: path}
        row = [(self.batches, self.parts, [(n, p) for n, p in sorted(live.items())])]
        self.spark.createDataFrame(row, "batch int, parts int, levels array<struct<number: int, path: string>>").coalesce(1).write.mode("append").parquet(f"{self.path}/state")
        self.levels, self.batches = live, self.batches + 1
        return done.filter("part is null").select("doc_id", "first", "last")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all documents."""
    small_batches(spark)
    return remove_repeats(table(spark, sf_dir, "documents"))

