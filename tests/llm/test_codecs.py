"""WebP streams with every feature of the format, round trips, and what the writer chooses."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from biblioscope.llm import webp as W
from biblioscope.llm import webp_writer as V
from biblioscope.llm.webp_format import NEAR, SIDE, channels


def huffman(symbols, alphabet):
    """Lengths of a complete code in which the first symbols are shorter."""
    own = sorted(set(int(s) for s in symbols))
    lengths = [0] * alphabet
    if len(own) == 1:
        lengths[own[0]] = 1
        return lengths
    for k, s in enumerate(own[:-1]):
        lengths[s] = min(k + 1, 14)
    if len(own) <= 14:
        lengths[own[-1]] = len(own) - 1
        return lengths
    return V.code_lengths([int(s in set(own)) for s in range(alphabet)], 15)


def put_general(out, argb, width, main, cache_bits=0, references=()):
    """Literals by unequal codes, with cached colours and back-references (at, length, distance)."""
    out.put(1, 1) if cache_bits else out.put(0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    cache, steps, at = {}, [], 0
    jumps = {a: (n, d) for a, n, d in references}
    while at < len(argb):
        p = int(argb[at])
        key = (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
        if at in jumps:
            n, d = jumps[at]
            assert all(argb[at + k] == argb[at + k - d] for k in range(n))
            steps.append(("ref", n, d))
            for k in range(n):
                q = int(argb[at + k])
                if cache_bits:
                    cache[(0x1E35A7BD * q & 0xFFFFFFFF) >> (32 - cache_bits)] = q
            at += n
            continue
        if cache_bits and cache.get(key) == p:
            steps.append(("cache", key))
        else:
            steps.append(("pixel", p))
        if cache_bits:
            cache[key] = p
        at += 1

    def prefix(value):
        value -= 1
        if value < 4:
            return value, 0, 0
        high = value.bit_length() - 1
        second = (value >> (high - 1)) & 1
        return 2 * high + second, value & ((1 << (high - 1)) - 1), high - 1

    plain = {}
    for k, (x, y) in enumerate(NEAR):
        plain.setdefault(x + y * width, k + 1)
    code_of = lambda d: plain.get(d, d + 120)
    green = [s[1] >> 8 & 255 if s[0] == "pixel" else 256 + prefix(s[1])[0] if s[0] == "ref" else 280 + s[1] for s in steps]
    pixels = [s[1] for s in steps if s[0] == "pixel"] or [0]
    distances = [prefix(code_of(s[2]))[0] for s in steps if s[0] == "ref"] or [0]
    n_green = 280 + ((1 << cache_bits) if cache_bits else 0)
    sets = [(green, n_green), ([p >> 16 & 255 for p in pixels], 256), ([p & 255 for p in pixels], 256), ([p >> 24 for p in pixels], 256), (distances, 40)]
    codes = []
    for values, n in sets:
        lengths = huffman(values, n) if len(set(values)) > 1 or values[0] < 256 else huffman([0, values[0]], n)
        codes.append(V.put_code(out, lengths))
    for s, g in zip(steps, green, strict=True):
        out.parts.append(codes[0][g])
        if s[0] == "pixel":
            for k, v in ((1, s[1] >> 16 & 255), (2, s[1] & 255), (3, s[1] >> 24)):
                out.parts.append(codes[k][v])
        elif s[0] == "ref":
            _, extra, n = prefix(s[1])
            out.put(extra, n)
            d, extra, n = prefix(code_of(s[2]))
            out.parts.append(codes[4][d])
            out.put(extra, n)


def image(seed, height, width, colours=None):
    rng = np.random.default_rng(seed)
    own = rng.integers(0, 1 << 32, (height, width), dtype=np.uint32)
    if colours:
        return rng.choice(rng.integers(0, 1 << 32, colours, dtype=np.uint32), (height, width))
    return own


def grey(argb):
    own = channels(np.ascontiguousarray(argb))
    assert (own[..., 0] == own[..., 1]).all() and (own[..., 0] == own[..., 2]).all() and (own[..., 3] == 255).all()
    return own[..., 0].tobytes()


@given(st.binary(max_size=700) | st.text(alphabet="ab cdefé\n", max_size=900).map(str.encode) | st.builds(lambda b, n: b * n, st.binary(max_size=40), st.integers(0, 60)))
@settings(max_examples=150, deadline=None)
def test_payload_round_trip(data):
    payload = data + b"\0" * ((-len(data)) % 64 if data else 64)
    stored = V.encode_samples(*W.payload_image(payload))
    assert grey(W.decode(stored))[: len(payload)] == payload
    assert stored[:4] == b"RIFF" and int.from_bytes(stored[4:8], "little") == len(stored) - 8


def test_payload_beyond_one_column_of_rows():
    payload = np.random.default_rng(1).integers(0, 256, 64 * (SIDE + 5), dtype=np.uint8).tobytes()
    assert grey(W.decode(V.encode_samples(*W.payload_image(payload))))[: len(payload)] == payload


def uses(data):
    """Transforms of a file in order, and the code lengths and tokens of its main image."""
    seen = {"transforms": [], "kinds": set()}
    for name in ("_parsed_pixels", "_pixels"):
        own = getattr(W, name)

        def spy(bits, groups, *rest, own=own, name=name):
            group = groups[0] if name == "_pixels" else groups
            seen["lengths"] = {n for n in group[0].lengths if n}
            seen["kinds"] |= {"reference"} if any(group[0].lengths[256:280]) else set()
            seen["kinds"] |= {"cache"} if any(group[0].lengths[280:]) else set()
            return own(bits, groups, *rest)

        setattr(W, name, spy)
        seen[name] = own
    try:
        W.decode(data)
    finally:
        for name in ("_parsed_pixels", "_pixels"):
            setattr(W, name, seen.pop(name))
    bits = W.Bits(data[20:])
    bits.read(40)
    return seen, (bits.read(2) if bits.read(1) else None)


def test_the_writer_uses_what_pays():
    rng = np.random.default_rng(2)
    text = " ".join("".join(rng.choice(list("etaoinshrdlu"), rng.integers(1, 9))) for _ in range(300)).encode()
    text += text[200:900]
    text += bytes(-len(text) % 64)
    stored = V.encode_samples(*W.payload_image(text))
    seen, transform = uses(stored)
    assert len(seen["lengths"]) > 3 and "reference" in seen["kinds"] and transform in (2, 3) and len(stored) < 0.62 * len(text)
    assert uses(V.encode_samples(bytes(640), 64))[1] == 3  # a palette, eight samples in a byte
    ramp = (np.cumsum(rng.integers(0, 3, 64 * 64)) % 256).astype(np.uint8).tobytes()
    stored = V.encode_samples(ramp, 64)
    assert uses(stored)[1] == 0 and len(stored) < 0.4 * len(ramp) and grey(W.decode(stored)) == ramp


def smooth(seed, height=40, width=70):
    rng = np.random.default_rng(seed)
    green = np.cumsum(rng.integers(-2, 3, (height, width)), axis=1) + np.cumsum(rng.integers(-2, 3, (height, 1)), axis=0)
    own = np.stack([green // 2 + rng.integers(0, 3, green.shape), green, green * 2 + rng.integers(0, 2, green.shape), np.full(green.shape, 255)], -1)
    return np.ascontiguousarray((own & 255).astype(np.uint8)).view(np.uint32)[..., 0]


@pytest.mark.parametrize("argb", [smooth(1), smooth(2, 3, 700), np.random.default_rng(3).integers(0, 1 << 32, (30, 30), dtype=np.uint32), smooth(4)[:1], smooth(5)[:, :1]], ids=["photo", "wide", "noise", "row", "column"])
def test_colour_images(argb):
    stored = V.encode(argb)
    assert (W.decode(stored) == argb).all()


def test_colour_images_take_predictor_cross_colour_and_cache():
    plain = V.Writer()
    V.header(plain, 70, 40)
    plain.put(0, 1)
    V.put_image(plain, smooth(1).reshape(-1), True, 70)
    assert uses(V.encode(smooth(1)))[1] == 0 and len(V.encode(smooth(1))) < 0.8 * len(V.wrap(plain.bytes()))
    rng = np.random.default_rng(5)
    tones = np.stack([rng.integers(0, 256, 6000)] * 3 + [np.full(6000, 255)], -1)
    tones[:, 2] = tones[:, 1] * 2 & 255  # red follows green
    tones[:, 0] = rng.integers(0, 2, 6000)
    mixed = np.ascontiguousarray(tones.astype(np.uint8)).view(np.uint32)[..., 0].reshape(60, 100)
    assert (W.decode(V.encode(mixed)) == mixed).all()
    few = rng.choice(rng.integers(0, 1 << 32, 300, dtype=np.uint32), (60, 100), p=np.array([0.9 / 20] * 20 + [0.1 / 280] * 280))
    stored = V.encode(few)
    assert (W.decode(stored) == few).all() and "cache" in uses(stored)[0]["kinds"]


@pytest.mark.parametrize("counts", [[1], [5, 0, 1], [1] * 280, [2**k for k in range(30)]])
def test_code_lengths(counts):
    lengths = V.code_lengths(counts, 9)
    assert all(bool(n) == bool(c) for n, c in zip(lengths, counts, strict=True)) and max(lengths) <= 9
    assert sum(map(bool, counts)) == 1 or sum(2.0**-n for n in lengths if n) == 1


def test_pixel_arrays_of_null_and_broken_files(spark):
    good = V.encode(image(3, 2, 3))
    df = spark.createDataFrame([(1, good, "a"), (2, None, "b"), (3, b"RIFF", "c"), (4, good[:30], "d"), (1, good, "a")], "doc_id bigint, media binary, width string")
    out = W.pixels(df)
    assert out.columns == ["doc_id", "width", "height", "argb", "error"]
    rows = {r.doc_id: r for r in out.collect()}
    assert (rows[1].width, rows[1].height, np.array(rows[1].argb, np.int32).view(np.uint32).tolist()) == (3, 2, image(3, 2, 3).reshape(-1).tolist())
    assert rows[2][1:] == (None, None, None, None) and rows[3].argb is None and rows[3].error and rows[4].error
    assert out.count() == 5 and W.pixels(df.limit(0)).count() == 0


@pytest.mark.parametrize("cache_bits", [0, 4])
def test_prefix_codes_cache_and_references(cache_bits):
    argb = image(3, 6, 9, 7).reshape(-1)
    argb[20:34] = argb[11:25]  # one row up
    argb[36:40] = argb[35]
    out = V.Writer()
    V.header(out, 9, 6)
    out.put(0, 1)
    put_general(out, argb, 9, True, cache_bits, [(20, 9, 9), (36, 4, 1)])
    assert (W.decode(V.wrap(out.bytes())).reshape(-1) == argb).all()


def test_predictor_every_mode():
    argb = image(5, 8, 60)
    modes = np.zeros((2, 15), np.uint32)
    modes[0] = np.arange(15) % 14
    modes[1] = (np.arange(15) + 7) % 14
    out = V.Writer()
    V.header(out, 60, 8)
    out.put(1, 1)
    out.put(0, 2)
    out.put(0, 3)
    V.put_image(out, (modes << np.uint32(8) | np.uint32(0xFF000000)).reshape(-1), False)
    out.put(0, 1)
    V.put_image(out, W._predictor(argb, modes, 2, -1).reshape(-1), True)
    assert (W.decode(V.wrap(out.bytes())) == argb).all()


def test_cross_colour_and_subtract_green():
    argb, elements = image(6, 8, 8), image(7, 2, 2)
    changed = W._cross_colour(argb, elements, 2, -1)
    pixels = channels(changed.copy())
    pixels[..., 0] -= pixels[..., 1]
    pixels[..., 2] -= pixels[..., 1]
    coded = np.ascontiguousarray(pixels).view(np.uint32)[..., 0]
    out = V.Writer()
    V.header(out, 8, 8)
    for kind in (1, 2):
        out.put(1, 1)
        out.put(kind, 2)
        if kind == 1:
            out.put(0, 3)
            V.put_image(out, elements.reshape(-1), False)
    out.put(0, 1)
    V.put_image(out, coded.reshape(-1), True)
    assert (W.decode(V.wrap(out.bytes())) == argb).all()


@pytest.mark.parametrize("colours", [1, 2, 4, 11, 40])
def test_palette(colours):
    argb = image(8, 5, 13, colours)
    palette = np.unique(argb)
    index = np.searchsorted(palette, argb).astype(np.uint32)
    packed = 3 if len(palette) <= 2 else 2 if len(palette) <= 4 else 1 if len(palette) <= 16 else 0
    each, per = 8 >> packed, 1 << packed
    wide = -(-13 // per)
    green = np.zeros((5, wide), np.uint32)
    for x in range(13):
        green[:, x // per] |= index[:, x] << np.uint32(each * (x % per))
    steps = np.diff(channels(palette).astype(np.int64), axis=0, prepend=0).astype(np.uint8)
    out = V.Writer()
    V.header(out, 13, 5)
    out.put(1, 1)
    out.put(3, 2)
    out.put(len(palette) - 1, 8)
    V.put_image(out, np.ascontiguousarray(steps).view(np.uint32)[:, 0], False)
    out.put(0, 1)
    V.put_image(out, (green << np.uint32(8) | np.uint32(0xFF000000)).reshape(-1), True)
    assert (W.decode(V.wrap(out.bytes())) == argb).all()


def test_groups_of_codes():
    argb = image(9, 8, 8, 6)
    out = V.Writer()
    V.header(out, 8, 8)
    out.put(0, 1)
    out.put(0, 1)
    out.put(1, 1)
    out.put(0, 3)
    which = np.array([0, 1, 1, 0], np.uint32)
    V.put_image(out, which << np.uint32(8), False)
    group = which.reshape(2, 2)[np.arange(8)[:, None] // 4, np.arange(8)[None, :] // 4]
    parts = channels(argb)
    codes = []
    for g in (0, 1):
        own = [V.put_code(out, huffman(parts[group == g][:, c], n)) for c, n in ((1, 280), (2, 256), (0, 256), (3, 256))]
        V.put_code(out, [0] * 40)
        codes.append(own)
    for y in range(8):
        for x in range(8):
            for code, c in zip(codes[group[y, x]], (1, 2, 0, 3), strict=True):
                out.parts.append(code[int(parts[y, x, c])])
    assert (W.decode(V.wrap(out.bytes())) == argb).all()


def test_broken_files():
    for data in (b"", b"RIFF", V.encode(image(1, 2, 2))[:24], b"RIFF\0\0\0\0WEBPVP8X"):
        with pytest.raises((ValueError, IndexError, EOFError, __import__("struct").error)):
            W.decode(data)
