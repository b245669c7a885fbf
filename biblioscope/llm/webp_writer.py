"""A lossless WebP writer: Huffman codes, back-references, colour cache, and the transforms where they pay."""

from __future__ import annotations

import functools
import heapq
import itertools
import struct

import numpy as np

from .webp_format import LENGTH_ORDER, NEAR, SIDE, channels

#: Longest prefix code, and longest one of code lengths; longest back-reference and its distance.
LONGEST, LONGEST_OF_LENGTHS, REACH, WINDOW = 15, 7, 4096, (1 << 20) - 120
#: Codes are kept to this where alphabets allow it, as tables of decoders grow with the longest.
PREFERRED = 11
#: A transform must save so much of the estimated size to be used.
PAYS = 0.95
OPAQUE = np.uint32(0xFF000000)


_SMALL = [[f"{v:0{n}b}"[::-1] if n else "" for v in range(1 << n)] for n in range(9)]


class Writer:
    """Collects bits, least significant first, as text of their digits; the last many can be numbers in an array."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.tail: tuple[np.ndarray, np.ndarray] | None = None

    def put(self, value: int, n: int) -> None:
        self.parts.append(_SMALL[n][value] if n < 9 else f"{value:0{n}b}"[::-1])

    def end(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """The last tokens: numbers of up to 63 bits and their sizes."""
        self.tail = values, sizes

    def bytes(self) -> bytes:
        digits = "".join(self.parts)
        head = int(digits[::-1] or "0", 2)
        if self.tail is None:
            return head.to_bytes((len(digits) + 7) // 8, "little")
        values, sizes = self.tail
        ends = np.cumsum(sizes) + (len(digits) & 7)
        at = ends - sizes
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        total = int(ends[-1])
        out = np.zeros((total >> 6) + 2, np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.add.reduceat(values << shift, first)  # bits are apart, so sums are unions
        over = np.flatnonzero((at & 63) + sizes > 64)
        out[word[over] + 1] += values[over] >> (np.uint64(64) - shift[over])
        done = len(digits) >> 3
        body = bytearray(out.tobytes()[: (total + 7) // 8])
        body[0] |= head >> (8 * done)
        return (head & ((1 << 8 * done) - 1)).to_bytes(done, "little") + bytes(body)


def code_lengths(counts: list[int], most: int) -> list[int]:
    """Lengths of an optimal prefix code of the counts, flattened until none is longer than most."""
    used = [s for s, n in enumerate(counts) if n]
    lengths = [0] * len(counts)
    if len(used) < 2:
        for s in used:
            lengths[s] = 1
        return lengths
    weights = [counts[s] for s in used]
    while True:
        heap = [(w, k) for k, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, made = [0] * (2 * len(used) - 1), len(used)
        while len(heap) > 1:
            w, a = heapq.heappop(heap)
            v, b = heap[0]
            parent[a] = parent[b] = made
            heapq.heapreplace(heap, (w + v, made))
            made += 1
        depth = [0] * made
        for k in range(made - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[: len(used)]) <= most:
            break
        weights = [(w + 1) // 2 for w in weights]
    for s, n in zip(used, depth, strict=False):
        lengths[s] = n
    return lengths


def codes_of(lengths: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, size) of the canonical code; sizes are 0 where a symbol below 256 stands alone."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) == 1 and used[0][1] < 256:
        return [(used[0][1], 0, 0)]
    out, code, before = [], 0, 0
    for n, s in used:
        code <<= n - before
        before = n
        out.append((s, code, n))
        code += 1
    return out


def digits_of(lengths: list[int]) -> list[str]:
    """Each symbol's code as the digits that are written."""
    out = [""] * len(lengths)
    for s, code, n in codes_of(lengths):
        out[s] = f"{code:0{n}b}" if n else ""
    return out


@functools.cache
def _backwards() -> np.ndarray:
    """For each number of LONGEST bits the number of its bits reversed."""
    out = np.zeros(1 << LONGEST, np.uint64)
    for k in range(LONGEST):
        out |= ((np.arange(1 << LONGEST, dtype=np.uint64) >> np.uint64(k)) & np.uint64(1)) << np.uint64(LONGEST - 1 - k)
    return out


def code_arrays(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """By symbol: the code as a number whose lowest bit is written first, and its size."""
    own = np.array(codes_of(lengths) or [(0, 0, 0)], np.int64)
    codes, sizes = np.zeros(len(lengths), np.uint64), np.zeros(len(lengths), np.int64)
    codes[own[:, 0]] = _backwards()[own[:, 1]] >> (LONGEST - own[:, 2]).astype(np.uint64)
    sizes[own[:, 0]] = own[:, 2]
    return codes, sizes


def put_single(out: Writer, symbol: int) -> None:
    """A code of one symbol below 256."""
    out.put(1, 2)  # simple, one symbol
    out.put(int(symbol > 1), 1)
    out.put(symbol, 8 if symbol > 1 else 1)


def put_lengths(out: Writer, lengths: list[int]) -> None:
    """Writes a code's lengths."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 1 and (not used or used[0] < 256):
        return put_single(out, used[0] if used else 0)
    runs: list[tuple[int, int, int]] = []  # symbol, extra, its bits
    for value, same in itertools.groupby(lengths[: used[-1] + 1]):
        left = len(list(same))
        if value:
            runs.append((value, 0, 0))
            left -= 1
        while left >= 3:
            if value:
                k = min(6, left)
                runs.append((16, k - 3, 2))
            elif left >= 11:
                k = min(138, left)
                runs.append((18, k - 11, 7))
            else:
                k = left
                runs.append((17, k - 3, 3))
            left -= k
        runs += [(value, 0, 0)] * left
    counts = [0] * 19
    for r in runs:
        counts[r[0]] += 1
    if sum(map(bool, counts)) == 1:  # a second, unused symbol makes the code complete
        counts[next(s for s in range(19) if not counts[s])] = 1
    own = code_lengths(counts, LONGEST_OF_LENGTHS)
    out.put(0, 1)
    many = max(4, max(k for k, s in enumerate(LENGTH_ORDER) if own[s]) + 1)
    out.put(many - 4, 4)
    out.parts += [_SMALL[3][own[s]] for s in LENGTH_ORDER[:many]]
    out.put(1, 1)
    count = len(runs) - 2  # two symbols or more make two runs or more
    pairs = max(0, (count.bit_length() - 1) // 2)
    out.put(pairs, 3)
    out.put(count, 2 + 2 * pairs)
    digits = digits_of(own)
    for s, extra, n in runs:
        out.parts += (digits[s], _SMALL[n][extra])


def put_code(out: Writer, lengths: list[int]) -> list[str]:
    """Writes a code's lengths; returns its digits."""
    put_lengths(out, lengths)
    return digits_of(lengths)


def prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values (from 1) as symbols, extra bits and their number."""
    v = values - 1
    n = np.maximum(0, np.frexp(v.astype(np.float64))[1] - 2)
    n[v < 4] = 0
    symbol = np.where(v < 4, v, 2 * (n + 1) + ((v >> n) & 1))
    return symbol, v & ((1 << n) - 1), n


class _Prefixes(dict):
    """Value (from 1) -> (symbol, digits of its extra bits)."""

    def __missing__(self, value: int) -> tuple[int, str]:
        v = value - 1
        if v < 4:
            found = (v, "")
        else:
            n = v.bit_length() - 2
            found = (2 * (n + 1) + ((v >> n) & 1), f"{v & ((1 << n) - 1):0{n}b}"[::-1])
        if len(self) < 100_000:
            self[value] = found
        return found


_prefixes = _Prefixes()


def references(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Back-references (at, length, distance) that don't overlap: strings of six bytes or three pixels that stood before, the
    nearest of them, joined where their distance stays, each from where the one before it ends."""
    k = 6 if values.dtype == np.uint8 else 3
    n = len(values) - k + 1
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none, none
    keys = values[:n].astype(np.uint64)
    for j in range(1, k):
        keys = (keys << np.uint64(8) if k == 6 else keys * np.uint64(0x9E3779B97F4A7C15)) + values[j : n + j]
    order = np.argsort((keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16), kind="stable")
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    where, before = order[same + 1], order[same]
    if k == 3:  # these keys are hashes
        equal = np.logical_and.reduce([values[where + j] == values[before + j] for j in range(k)])
        where, before = where[equal], before[equal]
    distance = np.zeros(n + 1, np.int64)
    distance[where] = where - before
    if n > WINDOW:
        distance[distance > WINDOW] = 0
    edge = np.flatnonzero(distance[1:] != distance[:-1]) + 1
    some = np.flatnonzero(distance[edge])  # the first string has none before it
    first, last = edge[some], edge[some + 1]
    distance = distance[first]
    while len(first):
        start = np.maximum(first, np.concatenate([[0], last[:-1] + k - 1]))
        room = start < last
        if room.all():
            break
        first, last, distance = first[room], last[room], distance[room]
    if not len(first):
        return none, none, none
    length = last - start + k - 1
    if length.max() > REACH:  # long ones in parts
        parts = -(-length // REACH)
        step = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        start, distance = np.repeat(start, parts) + REACH * step, np.repeat(distance, parts)
        length = np.minimum(REACH, np.repeat(length, parts) - REACH * step)
    return start, length, distance


def _near(width: int) -> dict[int, int]:
    """Distance -> its shortest code, for pixels close by."""
    found: dict[int, int] = {}
    for code, (x, y) in enumerate(NEAR, 1):
        found.setdefault(max(1, x + y * width), code)
    return found


_near_of: dict[int, dict[int, int]] = {}


def _lengths(counts: list[int]) -> list[int]:
    return code_lengths(counts, PREFERRED if sum(map(bool, counts)) < 1 << (PREFERRED - 2) else LONGEST)


def put_samples(out: Writer, samples: np.ndarray, width: int, colour: int = 0xFF0000) -> None:
    """The main image, and the end of the stream: pixels whose green alone varies (red, blue and alpha are the bytes of
    `colour` from its second on), by codes and back-references."""
    out.put(0, 2)  # no colour cache, one group of codes
    if width not in _near_of:
        _near_of[width] = _near(width)
    near = _near_of[width]
    start, length, distance = references(samples)
    if len(start):
        # tokens by where they begin: literals, and references in place of the samples they cover
        inside = np.zeros(len(samples) + 1, np.int32)
        inside[start] = 1
        inside[start + length] -= 1
        plain = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
        length_symbol, length_extra, length_bits = prefixes(length)
        distance_symbol, distance_extra, distance_bits = prefixes(np.array([near.get(d) or d + 120 for d in distance.tolist()], np.int64))
        far = _lengths(np.bincount(distance_symbol, minlength=40).tolist())
    else:
        plain, far = np.arange(len(samples)), [0] * 40
    literals = samples[plain]
    counts = np.bincount(literals, minlength=280)
    if len(start):
        counts[256:] += np.bincount(length_symbol, minlength=24)
    green = _lengths(counts.tolist())
    put_lengths(out, green)
    for value in (colour >> 8 & 255, colour & 255, colour >> 16):
        put_single(out, value)
    put_lengths(out, far)
    codes, sizes = code_arrays(green)
    values, bits = codes[literals], sizes[literals]
    if len(start):
        far_codes, far_sizes = code_arrays(far)
        parts = ((codes[256 + length_symbol], sizes[256 + length_symbol]), (length_extra, length_bits), (far_codes[distance_symbol], far_sizes[distance_symbol]), (distance_extra, distance_bits))
        token, size = np.zeros(len(start), np.uint64), np.zeros(len(start), np.int64)
        for value, n in parts:
            token |= value.astype(np.uint64) << size.astype(np.uint64)
            size += n
        order = np.argsort(np.concatenate([plain, start]), kind="stable")
        values, bits = np.concatenate([values, token])[order], np.concatenate([bits, size])[order]
    out.end(values, bits)


def put_image(out: Writer, argb: np.ndarray, main: bool, width: int = 1 << 20, cache_bits: int = 0) -> None:
    """Pixels by codes, back-references and, with cache_bits, a colour cache."""
    out.put(1, 1) if cache_bits else out.put(0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)  # one group of codes
    argb = np.ascontiguousarray(argb, np.uint32)
    near = _near(width)
    jumps = {i: (n, d) for i, n, d in zip(*(x.tolist() for x in references(argb)), strict=True)}
    pixels, cache, at = argb.tolist(), {}, 0
    keys = ((argb * np.uint32(0x1E35A7BD)) >> np.uint32(32 - cache_bits)).tolist() if cache_bits else pixels
    steps: list[tuple] = []
    while at < len(pixels):
        n, d = jumps.get(at, (1, 0))
        if d:
            steps.append((_prefixes[n], _prefixes[near.get(d) or d + 120]))
        elif cache_bits and cache.get(keys[at], 0) == pixels[at]:
            steps.append((280 + keys[at],))
        else:
            steps.append((None, pixels[at]))
        if cache_bits:
            cache.update(zip(keys[at : at + n], pixels[at : at + n], strict=True))
        at += n
    counts = [[0] * (280 + ((1 << cache_bits) if cache_bits else 0)), [0] * 256, [0] * 256, [0] * 256, [0] * 40]
    for s in steps:
        if len(s) == 1:
            counts[0][s[0]] += 1
        elif s[0] is None:
            p = s[1]
            for own, v in zip(counts, (p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24), strict=False):
                own[v] += 1
        else:
            counts[0][256 + s[0][0]] += 1
            counts[4][s[1][0]] += 1
    if cache_bits and sum(map(bool, counts[0])) == 1:
        counts[0][0 if not counts[0][0] else 1] = 1  # codes beyond 255 need a second symbol
    digits = []
    for own in counts:
        digits.append(put_code(out, _lengths(own)))
    green, red, blue, alpha, far = digits
    for s in steps:
        if len(s) == 1:
            out.parts.append(green[s[0]])
        elif s[0] is None:
            p = s[1]
            out.parts += (green[p >> 8 & 255], red[p >> 16 & 255], blue[p & 255], alpha[p >> 24])
        else:
            out.parts += (green[256 + s[0][0]], s[0][1], far[s[1][0]], s[1][1])


def wrap(stream: bytes) -> bytes:
    pad = b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad


def header(out: Writer, width: int, height: int) -> None:
    if not 0 < width <= SIDE or not 0 < height <= SIDE:
        raise ValueError("image sides are 1 to 16384")
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)


def _entropy(values: np.ndarray) -> float:
    """Bits that the values take by an ideal code of their own."""
    counts = np.bincount(values, minlength=1)
    counts = counts[counts > 0]
    return float(len(values) * np.log2(len(values)) - (counts * np.log2(counts)).sum()) if len(values) else 0.0


def _from_left(samples: np.ndarray) -> np.ndarray:
    """What is left of rows of samples (any last axes) when each is predicted by its left neighbour, a row's first by the one above."""
    out = samples.copy()
    out[:, 1:] -= samples[:, :-1]
    out[1:, 0] -= samples[:-1, 0]
    return out


def _put_left_predictor(out: Writer, width: int, height: int) -> None:
    block = 9
    out.put(1, 1)
    out.put(0, 2)
    out.put(block - 2, 3)
    n = -(-width // (1 << block)) * -(-height // (1 << block))
    put_image(out, np.full(n, 1 << 8, np.uint32) | OPAQUE, False)


def _put_palette(out: Writer, colours: np.ndarray, index: np.ndarray) -> None:
    """The palette, and the rows of indices packed into bytes."""
    packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
    height, width = index.shape
    each, per = 8 >> packed, 1 << packed
    wide = -(-width // per)
    full = np.zeros((height, wide * per), np.uint8)
    full[:, :width] = index
    green = np.zeros((height, wide), np.uint8)
    for k in range(per):
        green |= full[:, k::per] << np.uint8(each * k) if packed else full[:, k::per]
    steps = np.diff(channels(np.ascontiguousarray(colours)).astype(np.int64), axis=0, prepend=0).astype(np.uint8)
    out.put(1, 1)
    out.put(3, 2)
    out.put(len(colours) - 1, 8)
    put_image(out, np.ascontiguousarray(steps).view(np.uint32)[:, 0], False)
    out.put(0, 1)
    put_samples(out, green.reshape(-1), wide)


def encode_samples(samples: bytes, width: int) -> bytes:
    """A lossless WebP file of rows of 8-bit grey samples: a palette for 16 values or fewer, else green taken off red and
    blue, after prediction from the left where that pays."""
    own = np.frombuffer(samples, np.uint8)
    height = len(own) // width
    out = Writer()
    header(out, width, height)
    values = np.flatnonzero(np.bincount(own, minlength=256))
    if len(values) <= 16:
        _put_palette(out, (values.astype(np.uint32) * np.uint32(0x010101)) | OPAQUE, np.searchsorted(values, own).reshape(height, width))
        return wrap(out.bytes())
    left = _from_left(own.reshape(height, width))
    colour = 0xFF0000
    if _entropy(left.reshape(-1)) < PAYS * _entropy(own):
        _put_left_predictor(out, width, height)
        own, colour = left.reshape(-1), 0  # alpha is predicted too
    out.put(1, 1)
    out.put(2, 2)  # subtract green
    out.put(0, 1)
    put_samples(out, own, width, colour)
    return wrap(out.bytes())


def _slope(values: np.ndarray, by: np.ndarray) -> int:
    """The multiple of by / 32 that is nearest to the values."""
    square = float((by * by).sum())
    return int(np.clip(round(32 * float((values * by).sum()) / square), -128, 127)) if square else 0


def _cross(argb: np.ndarray) -> tuple[int, np.ndarray]:
    """One element of the colour transform for the whole image, and the pixels after it."""
    own = channels(np.ascontiguousarray(argb))
    signed = own.view(np.int8).astype(np.int64)
    green, red, blue = signed[..., 1], signed[..., 2], signed[..., 0]
    to_red, to_blue = _slope(red, green), _slope(blue, green)
    out = own.copy()
    out[..., 2] = (red - (to_red * green >> 5)) & 255
    out[..., 0] = (blue - (to_blue * green >> 5)) & 255
    return (to_blue & 255) << 8 | (to_red & 255), np.ascontiguousarray(out).view(np.uint32)[..., 0]


def _bits_of(argb: np.ndarray) -> float:
    own = channels(np.ascontiguousarray(argb)).reshape(-1, 4)
    return sum(_entropy(own[:, k]) for k in range(4))


def encode(argb: np.ndarray) -> bytes:
    """A lossless WebP file of height x width pixels: a palette for 256 colours or fewer, else prediction from the left,
    the colour transform and green taken off, each where the estimate says that it pays; a colour cache where that gives
    the smaller file."""
    height, width = argb.shape
    first = Writer()
    header(first, width, height)
    colours, index = np.unique(argb, return_inverse=True)
    if len(colours) <= 256:
        _put_palette(first, colours.astype(np.uint32), index.reshape(height, width))
        return wrap(first.bytes())
    size = _bits_of(argb)
    left = _from_left(channels(np.ascontiguousarray(argb)))
    left[0, 0, 3] = (int(left[0, 0, 3]) + 1) & 255  # less 255: the first is predicted as opaque black
    left = np.ascontiguousarray(left).view(np.uint32)[..., 0]
    left_bits = _bits_of(left)
    if left_bits < PAYS * size:
        _put_left_predictor(first, width, height)
        argb, size = left, left_bits
    element, crossed = _cross(argb)
    if element and (cross_bits := _bits_of(crossed)) < PAYS * size:
        first.put(1, 1)
        first.put(1, 2)
        first.put(7, 3)
        n = -(-width // (1 << 9)) * -(-height // (1 << 9))
        put_image(first, np.full(n, element, np.uint32) | OPAQUE, False)
        argb, size = crossed, cross_bits
    own = channels(np.ascontiguousarray(argb)).copy()
    own[..., 0] -= own[..., 1]
    own[..., 2] -= own[..., 1]
    off = np.ascontiguousarray(own).view(np.uint32)[..., 0]
    if _bits_of(off) < PAYS * size:
        first.put(1, 1)
        first.put(2, 2)
        argb = off
    first.put(0, 1)
    found = []
    for cache_bits in (0, 6):
        out = Writer()
        out.parts = list(first.parts)
        put_image(out, argb.reshape(-1), True, width, cache_bits)
        found.append(out.bytes())
    return wrap(min(found, key=len))
