"""Lossless WebP media columns: a decoder for whole VP8L streams, pixel arrays, and texts as images."""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, utf8
from .webp_format import ALPHABETS, LENGTH_ORDER, NEAR, SIDE, channels as _channels
from .webp_writer import encode_samples

UNIT = 64


class Bits:
    """Least significant bit first, over bytes."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at, self.value, self.held = data, at, 0, 0

    def fill(self, n: int) -> None:
        while self.held < n:
            own = self.data[self.at : self.at + 8]
            self.value |= int.from_bytes(own, "little") << self.held
            self.at += 8
            self.held += 64  # beyond the end there are zeros

    def read(self, n: int) -> int:
        self.fill(n)
        out = self.value & ((1 << n) - 1)
        self.value >>= n
        self.held -= n
        return out

    def position(self) -> int:
        return self.at * 8 - self.held


@functools.cache
def _reversed(n: int) -> np.ndarray:
    """For each number of n bits the number of its bits reversed."""
    out = np.zeros(1 << n, np.int64)
    for k in range(n):
        out |= ((np.arange(1 << n) >> k) & 1) << (n - 1 - k)
    return out


class Code:
    """A canonical prefix code: lengths to a table from peeked bits to (symbol, length)."""

    def __init__(self, lengths: list[int]) -> None:
        used = [(n, s) for s, n in enumerate(lengths) if n]
        self.lengths = lengths
        self.only = used[0][1] if len(used) == 1 else (0 if not used else None)
        self.symbols: list[int] = [s for _, s in sorted(used)]
        if self.only is not None:
            return
        if sum(1 << (15 - n) for n, _ in used) != 1 << 15:
            raise ValueError("prefix code isn't complete")
        self.most = max(n for n, _ in used)
        self._table: list[tuple[int, int]] | None = None

    def table(self) -> list[tuple[int, int]]:
        if self._table is None:
            self._table = [(0, 0)] * (1 << self.most)
            code, before = 0, 0
            for n, s in sorted((n, s) for s, n in enumerate(self.lengths) if n):
                code <<= n - before
                before = n
                start = int(f"{code:0{n}b}"[::-1], 2)
                for k in range(start, 1 << self.most, 1 << n):
                    self._table[k] = (s, n)
                code += 1
        return self._table

    def arrays(self) -> tuple[np.ndarray, int]:
        """16 * symbol + length by the next bits, and the mask that takes those."""
        if self.only is not None:
            return np.array([16 * self.only]), 0
        sizes = np.array([self.lengths[s] for s in self.symbols])
        return np.repeat(16 * np.array(self.symbols) + sizes, 1 << (self.most - sizes))[_reversed(self.most)], (1 << self.most) - 1

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        bits.fill(self.most)
        symbol, n = self.table()[bits.value & ((1 << self.most) - 1)]
        bits.value >>= n
        bits.held -= n
        return symbol


def _read_code(bits: Bits, alphabet: int) -> Code:
    lengths = [0] * alphabet
    if bits.read(1):
        n = bits.read(1) + 1
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if n == 2:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    own = [0] * 19
    for k in range(4 + bits.read(4)):
        own[LENGTH_ORDER[k]] = bits.read(3)
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    code, at, before = Code(own), 0, 8
    while at < alphabet and most:
        most -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            at += 1
            before = s or before
        else:
            n, value = (3 + bits.read(2), before) if s == 16 else (3 + bits.read(3), 0) if s == 17 else (11 + bits.read(7), 0)
            if at + n > alphabet:
                raise ValueError("code lengths overflow")
            lengths[at : at + n] = [value] * n
            at += n
    return Code(lengths)


def _extra(bits: Bits, symbol: int) -> int:
    """The value of a length or distance symbol."""
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


def _read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Entropy-coded ARGB pixels (uint32, row by row)."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache is too large")
    groups_of, prefix_bits, n_groups = None, 0, 1
    if main and bits.read(1):
        prefix_bits = bits.read(3) + 2
        w = (width + (1 << prefix_bits) - 1) >> prefix_bits
        h = (height + (1 << prefix_bits) - 1) >> prefix_bits
        groups_of = ((_read_image(bits, w, h, False) >> np.uint32(8)) & np.uint32(0xFFFF)).reshape(h, w)
        n_groups = int(groups_of.max()) + 1
    groups = [[_read_code(bits, a + ((1 << cache_bits) if not k and cache_bits else 0)) for k, a in enumerate(ALPHABETS)] for _ in range(n_groups)]
    n = width * height
    if groups_of is None and not cache_bits and n >= 64 and groups[0][0].only is None:
        return _parsed_pixels(bits, groups[0], width, n)
    return _pixels(bits, groups, groups_of, prefix_bits, cache_bits, width, n)


#: Bytes of a stream that are parsed at a time, and those behind them that a token may reach into.
PARSED, REACH = 1 << 15, 16
_STEP = np.arange(8)
_EXTRA = np.maximum(0, (np.arange(40) - 2) >> 1)
_FROM = np.where(np.arange(40) < 4, np.arange(40), (2 + (np.arange(40) & 1)) << _EXTRA) + 1


@functools.cache
def _near(width: int) -> np.ndarray:
    return np.array([max(1, x + y * width) for x, y in NEAR])


def _low(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n lowest bits of each."""
    return values & ((1 << n) - 1)


def _parsed_pixels(bits: Bits, group: list[Code], width: int, n: int) -> np.ndarray:
    """Pixels of one group of codes: what token would begin at each bit is looked up for all bits at once, then the
    tokens are those that follow one another from the first bit, and references are copied in turn."""
    plain = [c.only for c in group[1:4]]
    fixed = None if None in plain else np.uint32(plain[2] << 24 | plain[0] << 16 | plain[1])
    first, mask = group[0].arrays()
    far, far_mask = group[4].arrays()
    # where green alone varies, its bytes do; four times the places otherwise
    each = 1 if fixed is not None else 4
    out = bytearray(each * n)
    view = np.frombuffer(out, np.uint8 if fixed is not None else np.uint32)
    done, at = 0, bits.position()
    while done < n:
        base = at >> 3
        raw = bits.data[base : base + PARSED + REACH]
        size = min(PARSED, len(raw))
        if not size:
            raise ValueError("pixels are cut short")
        words = np.ndarray((size + REACH,), "<i8", raw + bytes(size + REACH + 8 - len(raw)), strides=(1,))
        peek = (words[:, None] >> _STEP).reshape(-1)
        limit = 8 * size
        token = first[peek[:limit] & mask]
        follow = (token & 15) + _ascending(limit)
        refs = np.flatnonzero((token >= 256 * 16) & (token < 280 * 16)) if each == 4 else np.flatnonzero(token >= 256 * 16)
        behind = follow[refs]
        if fixed is None:
            place, colour = follow.copy(), (token >> 4 << 8).astype(np.uint32)
            for code, shift in zip(group[1:4], (16, 0, 24), strict=True):
                table_, own_mask = code.arrays()
                own = table_[peek[place] & own_mask]
                colour |= (own >> 4).astype(np.uint32) << np.uint32(shift)
                place += own & 15
            follow = place
        if len(refs):
            place = behind + _EXTRA[(token[refs] >> 4) - 256]
            own = far[peek[place] & far_mask]
            follow[refs] = place + (own & 15) + _EXTRA[own >> 4]
        # tokens follow one another: eight steps at a time, then those between
        hops = [np.append(np.minimum(follow, limit), limit)]
        for _ in range(3):
            hops.append(hops[-1][hops[-1]])
        chain, p, leap, left = [], at & 7, hops[3], n - done
        while p < limit and 8 * len(chain) < left:  # a token is a pixel at least
            chain.append(p)
            p = int(leap[p])
        where = np.array(chain, np.int64)
        for hop in (hops[2], hops[1], hops[0]):
            where = np.stack([where, hop[where]], -1).reshape(-1)
        where = where[where < limit]
        found = token[where]
        referring = np.flatnonzero(found >= 256 * 16)
        many, codes = np.ones(len(where), np.int64), np.zeros(0, np.int64)
        if len(referring):
            kind, place = (found[referring] >> 4) - 256, where[referring] + (found[referring] & 15)
            many[referring] = _FROM[kind] + _low(peek[place], _EXTRA[kind])
            place += _EXTRA[kind]
            own = far[peek[place] & far_mask]
            kind = own >> 4
            codes = _FROM[kind] + _low(peek[place + (own & 15)], _EXTRA[kind])
        ends = np.cumsum(many)
        used = int(np.searchsorted(ends, left)) + 1
        where, found, many, ends = where[:used], found[:used], many[:used], ends[:used]
        referring = referring[: np.searchsorted(referring, used)]
        p = int(follow[where[-1]])
        if base * 8 + p > 8 * len(bits.data):
            raise ValueError("pixels are cut short")
        starts = done + ends - many
        literal = found < 256 * 16
        view[starts[literal]] = found[literal] >> 4 if fixed is not None else colour[where[literal]]
        codes = codes[: len(referring)]
        distances = np.where(codes > 120, codes - 120, _near(width)[np.minimum(codes, 120) - 1])
        if len(referring) and ((distances > starts[referring]).any() or int(starts[-1] + many[-1]) > n):
            raise ValueError("back-reference leaves the image")
        for to, d, k in zip((each * starts[referring]).tolist(), (each * distances).tolist(), (each * many[referring]).tolist(), strict=True):
            if d >= k:
                out[to : to + k] = out[to - d : to - d + k]
            else:
                out[to : to + k] = (out[to - d : to] * (k // d + 1))[:k]
        done += int(ends[-1])
        at = base * 8 + p
    bits.at, bits.value, bits.held = at >> 3, 0, 0
    if at & 7:
        bits.read(at & 7)
    return view.astype(np.uint32) << np.uint32(8) | fixed if fixed is not None else view


@functools.cache
def _counting() -> np.ndarray:
    return np.arange(8 * (PARSED + REACH))


def _ascending(n: int) -> np.ndarray:
    return _counting()[:n]


def _pixels(bits: Bits, groups: list[list[Code]], groups_of: np.ndarray | None, prefix_bits: int, cache_bits: int, width: int, n: int) -> np.ndarray:
    out = [0] * n
    cache = [0] * (1 << cache_bits)
    shift, at, cached = 32 - cache_bits, 0, 0
    group = groups[0]
    while at < n:
        if groups_of is not None:
            group = groups[groups_of[(at // width) >> prefix_bits, (at % width) >> prefix_bits]]
        s = group[0].read(bits)
        if s < 256:
            red, blue = group[1].read(bits), group[2].read(bits)
            out[at] = group[3].read(bits) << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            length = _extra(bits, s - 256)
            code = _extra(bits, group[4].read(bits))
            if code > 120:
                distance = code - 120
            else:
                x, y = NEAR[code - 1]
                distance = max(1, x + y * width)
            if distance > at or at + length > n:
                raise ValueError("back-reference leaves the image")
            for _ in range(length):
                out[at] = out[at - distance]
                at += 1
        else:
            for p in out[cached:at]:
                cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> shift] = p
            cached = at
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, np.uint32)


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _predict(mode: int, left: np.ndarray, up: np.ndarray, up_right: np.ndarray, up_left: np.ndarray) -> np.ndarray:
    """One pixel's prediction by mode; channels as ints."""
    if mode == 0 or mode > 13:
        return np.array([0, 0, 0, 255])
    if mode == 11:
        to_left = np.abs(up - up_left).sum()
        to_up = np.abs(left - up_left).sum()
        return left if to_left < to_up else up
    if mode == 12:
        return np.clip(left + up - up_left, 0, 255)
    if mode == 13:
        a = _average(left, up)
        d = a - up_left
        return np.clip(a + np.sign(d) * (np.abs(d) >> 1), 0, 255)
    return (left, up, up_right, up_left, _average(_average(left, up_right), up), _average(left, up_left), _average(left, up), _average(up_left, up), _average(up, up_right), _average(_average(left, up_left), _average(up, up_right)))[mode - 1]


def _predictor(argb: np.ndarray, modes: np.ndarray, block: int, add: int) -> np.ndarray:
    """Adds (add 1: decodes) or takes off (-1: encodes) the predictions."""
    height, width = argb.shape
    if add == 1 and (modes == 1).all():  # from the left everywhere: running sums
        pixels = _channels(argb.copy())
        pixels[0, 0, 3] += 255
        pixels[:, 0] = np.cumsum(pixels[:, 0], axis=0, dtype=np.uint8)
        return np.ascontiguousarray(np.cumsum(pixels, axis=1, dtype=np.uint8)).view(np.uint32)[..., 0]
    pixels = _channels(argb.copy()).astype(np.int64)
    known = pixels if add == 1 else pixels.copy()
    result = pixels if add == 1 else pixels.copy()
    for y in range(height):
        for x in range(width):
            if not y:
                guess = np.array([0, 0, 0, 255]) if not x else known[0, x - 1]
            elif not x:
                guess = known[y - 1, 0]
            else:
                right = known[y - 1, x + 1] if x + 1 < width else known[y, 0]
                guess = _predict(int(modes[y >> block, x >> block]), known[y, x - 1], known[y - 1, x], right, known[y - 1, x - 1])
            result[y, x] = (pixels[y, x] + add * guess) & 255
    return np.ascontiguousarray(result.astype(np.uint8)).view(np.uint32)[..., 0]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int64)


def _cross_colour(argb: np.ndarray, elements: np.ndarray, block: int, add: int) -> np.ndarray:
    height, width = argb.shape
    pixels = _channels(argb.copy()).astype(np.int64)
    of = _channels(np.ascontiguousarray(elements[np.arange(height)[:, None] >> block, np.arange(width)[None, :] >> block]))
    red_blue, green_blue, green_red = _signed(of[..., 2]), _signed(of[..., 1]), _signed(of[..., 0])
    green, red, blue = _signed(pixels[..., 1]), pixels[..., 2], pixels[..., 0]
    old_red = red.copy()
    red = (red + add * (green_red * green >> 5)) & 255
    blue = (blue + add * ((green_blue * green >> 5) + (red_blue * _signed(red if add == 1 else old_red) >> 5))) & 255
    pixels[..., 2], pixels[..., 0] = red, blue
    return np.ascontiguousarray(pixels.astype(np.uint8)).view(np.uint32)[..., 0]


def decode(data: bytes) -> np.ndarray:
    """The ARGB pixels (height x width uint32) of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("no VP8L chunk")
        size = struct.unpack_from("<I", data, at + 4)[0]
        at += 8 + size + (size & 1)
    size = struct.unpack_from("<I", data, at + 4)[0]
    bits = Bits(data[at + 8 : at + 8 + size])
    if bits.read(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo = []
    coded = width
    while bits.read(1):
        kind = bits.read(2)
        if kind == 2:
            undo.append((2, 0, None, coded))
        elif kind == 3:
            n = bits.read(8) + 1
            palette = np.cumsum(_channels(_read_image(bits, n, 1, False).reshape(1, n))[0], axis=0, dtype=np.uint8)
            palette = np.ascontiguousarray(palette).view(np.uint32)[:, 0]
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((3, packed, palette, coded))
            coded = (coded + (1 << packed) - 1) >> packed
        else:
            block = bits.read(3) + 2
            w, h = (coded + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block
            undo.append((kind, block, _read_image(bits, w, h, False).reshape(h, w), coded))
    argb = _read_image(bits, coded, height, True).reshape(height, coded)
    if bits.position() > 8 * len(bits.data):
        raise ValueError("pixels are cut short")
    for kind, block, more, wide in reversed(undo):
        if kind == 0:
            argb = _predictor(argb, (more >> np.uint32(8)) & np.uint32(255), block, 1)
        elif kind == 1:
            argb = _cross_colour(argb, more, block, 1)
        elif kind == 2:
            pixels = _channels(argb.copy())
            pixels[..., 0] += pixels[..., 1]
            pixels[..., 2] += pixels[..., 1]
            argb = np.ascontiguousarray(pixels).view(np.uint32)[..., 0]
        else:
            green = (argb >> np.uint32(8)) & np.uint32(255)
            if block:
                each = 8 >> block
                x = np.arange(wide)
                green = (green[:, x >> block] >> ((x & ((1 << block) - 1)) * each).astype(np.uint32)[None, :]) & np.uint32((1 << each) - 1)
            full = np.concatenate([more, np.zeros(256, np.uint32)])
            argb = full[green]
    return argb


def payload_image(payload: bytes) -> tuple[bytes, int]:
    """The payload (a multiple of 64 bytes) as 8-bit samples, and their row's width: 64, or more beyond 1 MB, the last row filled with 0."""
    rows = len(payload) // UNIT
    wide = -(-rows // SIDE)
    return payload + bytes(-(-rows // wide) * wide * UNIT - len(payload)), wide * UNIT


def features(payload: np.ndarray) -> str:
    """Mean of each fourth sample and the 16-cell mean pattern of the samples, as text."""
    means = payload.reshape(-1, 4).mean(0)
    cells = np.add.reduceat(payload, np.arange(16) * len(payload) // 16, dtype=np.float64) / (len(payload) / 16)
    return ",".join(f"{m:.3f}" for m in means) + ":" + "".join("1" if c > m else "0" for m in (means.mean(),) for c in cells)


SCHEMA = "doc_id bigint, n_bytes bigint, media binary"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8(batch.column(1))
        raw, media, known = data.tobytes(), [], {}
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            text = raw[i:j]
            if text not in known:  # copies in a batch are coded once
                known[text] = encode_samples(*payload_image(text + bytes((-len(text)) % UNIT if text else UNIT)))
            media.append(known[text])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, media): each text's UTF-8 bytes, filled with 0 to a positive multiple of 64, as a lossless grey WebP image.

    Null texts count as empty; repeated rows give a row each; an empty table gives none; texts may have up to 256 MB."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_store, SCHEMA)


def pixels(media: DataFrame, media_col: str = "media") -> DataFrame:
    """media without its files, with width, height, argb (row by row, 32 bits each) and error.

    A null file gives nulls, a file that can't be decoded nulls and the reason in error; repeated rows give a row each;
    an empty table gives none; columns with the new names are replaced."""
    kept = media.drop("width", "height", "argb", "error")
    place = kept.columns.index(media_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes, values, errors = [], [], []
            for own in batch.column(place).to_pylist():
                image, why = None, None
                if own is not None:
                    try:
                        image = decode(own)
                    except (ValueError, IndexError, OverflowError, struct.error) as error:
                        why = str(error) or type(error).__name__
                shapes.append((None, None) if image is None else image.shape)
                values.append(image)
                errors.append(why)
            sizes = np.array([0 if v is None else v.size for v in values])
            flat = np.concatenate([np.zeros(0, np.uint32), *(v.reshape(-1) for v in values if v is not None)]).view(np.int32)
            argb = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat), mask=pa.array([v is None for v in values]))
            rest = [k for k in range(batch.num_columns) if k != place]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in rest), pa.array([s[1] for s in shapes], pa.int32()), pa.array([s[0] for s in shapes], pa.int32()), argb, pa.array(errors, pa.string())],
                [*(batch.schema.names[k] for k in rest), "width", "height", "argb", "error"],
            )

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != media_col)
    return kept.mapInArrow(run, f"{kind}, width int, height int, argb array<int>, error string")


READ = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("argb"))
        samples = column.values.to_numpy().astype(np.uint8)  # blue, which is every channel of a grey pixel
        rows, at = [], column.offsets.to_numpy()
        for k, n in enumerate(batch.column(1).to_pylist()):
            payload = samples[at[k] : at[k] + max(UNIT, -(-n // UNIT) * UNIT)]
            raw = payload.tobytes()
            rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-UNIT:]), features(payload)))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string()]
        size, sha, crc, feature = (pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), size, sha, crc, batch.column(2), batch.column(3), feature], [x.split()[0] for x in READ.split(", ")])


def read_back(media: DataFrame) -> DataFrame:
    """Decodes each file that to_media() made to its pixel array, and gives the payload's digests and features."""
    sized = media.select("doc_id", "n_bytes", F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    return pixels(sized).select("doc_id", "n_bytes", "media_bytes", "media_sha256", "argb").mapInArrow(_digests, READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents, written as media, decoded to pixel arrays and read back."""
    small_batches(spark)
    return read_back(to_media(table(spark, sf_dir, "documents")))
