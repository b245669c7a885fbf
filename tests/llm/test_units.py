"""The operators' parts against brute force, without Spark."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from biblioscope.llm import common, decontaminate, licenses, near_dedup, packing, pii, suffix_dedup, suffix_index, toxicity
from biblioscope.llm.token_counts import PieceCounter

TEXTS = st.text(alphabet="aé \n\t.▁<|>'sİΣς1́中　\x85", max_size=14)


@pytest.fixture(scope="module")
def counter():
    return PieceCounter(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def encoder():
    return packing.RunEncoder(public_tokenizers.path("word_bpe_49k.json"))


@given(TEXTS)
@settings(max_examples=300, deadline=None)
def test_tokenizers_by_word(counter, encoder, text):
    assert counter.count(text) == len(counter.model.encode(text))
    assert encoder.ids([text]) == [np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


def test_special_strings(encoder):
    for text in ("<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "<|END"):
        assert encoder.ids([text]) == [encoder.encode(text).tobytes()]


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
@settings(max_examples=200, deadline=None)
def test_packing_in_bulk_is_best_fit_decreasing(counts):
    size, bins = 40, []
    for n in sorted((k for k, c in counts.items() for _ in range(c)), reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= n]
        if fits:
            i = min(fits, key=lambda i: bins[i])
            bins[i] -= n
        else:
            bins.append(size - n)
    placed = packing.best_fit_decreasing(counts, size)
    spans = sorted((q + i, o, o + n) for n, _, many, q, o in placed for i in range(many))
    used = {}
    for q, lo, hi in spans:
        assert lo == used.get(q, 0) and hi <= size
        used[q] = hi
    assert sorted(size - u for u in used.values()) == sorted(bins)
    for n, c in counts.items():
        assert sorted(f + i for m, f, many, _, _ in placed if m == n for i in range(many)) == list(range(c))


def test_utf8_of_slices_and_nulls():
    column = pa.array(["ab", None, "é", ""])[1:]
    data, at = common.utf8(column)
    assert data.tobytes() == "é".encode() and at.tolist() == [0, 0, 2, 2]
    assert common.utf8(pa.array([], pa.string()))[1].tolist() == [0]


@given(st.lists(st.text(alphabet="aB é\n", max_size=9), max_size=6))
@settings(max_examples=100, deadline=None)
def test_words_and_hashes(texts):
    data, at = common.utf8(pa.array(texts, pa.string()))
    start, end, first = common.words(data, at, common.NOT_SPACE)
    found = [[data[s:e].tobytes() for s, e in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]], strict=True)] for i in range(len(texts))]
    assert found == [re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for t in texts]
    hashes = common.span_hash(common.prefix_hash(data), start, end)
    words = [w for own in found for w in own]
    assert len(set(hashes.tolist())) == len(set(words)) == len(set(zip(words, hashes.tolist(), strict=True)))


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for share in (0.2, 0.5, 0.8, 0.95):
        both = int(1000 * 2 * share / (1 + share))
        a, b = pool[:1000], np.concatenate([pool[:both], pool[1000 : 2000 - both]])
        x, y = near_dedup.sketch(a), near_dedup.sketch(b)
        assert (np.maximum(x, y) == near_dedup.sketch(np.union1d(a, b))).all()
        found = near_dedup.likeliest(x[None], y[None], np.array([1000.0]), np.array([1000.0]))[0]
        assert abs(found - share) < 0.17


def brute_repeats(rows, size):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        data, gone = text.encode(), set()
        for p in range(len(data) - size + 1):
            w = data[p : p + size]
            if w in seen:
                gone.update(range(p, p + size))
            seen.add(w)
        out[doc] = bytes(c for i, c in enumerate(data) if i not in gone)
    return out


@pytest.mark.parametrize(("batch", "hot"), [(suffix_dedup.BATCH, 0), (200, 0), (500, 1), (500, 2)])
def test_suffix_family_finds_all_repeats(batch, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 1 << 11)
    rng = np.random.default_rng(batch)
    base = "".join(rng.choice(list("abcdé \n"), 900))
    texts = [base, base, "x" * 350, base[100:420] + "yy" + base[50:300], "", "z" * 99, "".join(rng.choice(list("ab"), 500)), base[:500] + "-" + base[501:], base[300:] + base[:700]]
    texts += ["".join(rng.choice(list("abc"), 80)) + base[200:330] + "".join(rng.choice(list("abc"), 80)) for _ in range(12)]
    rows = list(enumerate(texts))

    data = "".join(texts).encode()
    anchors = np.unique(suffix_dedup.gram_hashes(np.frombuffer(data, np.uint8)) >> np.uint64(64 - suffix_dedup.COMPARED))

    class Sent:  # none, all or half of the anchors are hot
        value = (np.full(1 << 25, 255, np.uint8), anchors[:: hot] if hot else anchors[:0])

    batch_ = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array(texts)], ["doc_id", "text"])
    dealt = list(suffix_dedup._deal(3, Sent)(iter([batch_])))
    spans: dict[int, list] = {}
    for part in range(3):
        own = [b.filter(pa.compute.equal(b.column("part"), part)) for b in dealt]
        for out in suffix_dedup._resolve(iter(own)):
            for r in out.to_pylist():
                spans.setdefault(r["doc_id"], []).append((r["first"], r["last"]))
    want = brute_repeats(rows, suffix_dedup.SIZE)
    for doc, text in rows:
        data = text.encode()
        gone = {i for lo, hi in spans.get(doc, ()) for i in range(lo, hi)}
        assert bytes(c for i, c in enumerate(data) if i not in gone) == want[doc], doc


@given(st.text(alphabet="ab", min_size=0, max_size=400), st.integers(0, 9))
@settings(max_examples=40, deadline=None)
def test_suffix_array(text, seed):
    data = np.frombuffer((text * 3).encode() + bytes(seed) + b"ab" * 60, np.uint8)
    at = np.random.default_rng(seed).permutation(len(data) - suffix_dedup.SIZE + 1)
    order, fresh = suffix_index.suffix_array(data, at)
    raw = data.tobytes()
    strings = [raw[p : p + suffix_dedup.SIZE] for p in order]
    assert strings == sorted(strings) and sorted(order) == sorted(at)
    assert [bool(x) for x in fresh] == [k == 0 or strings[k] != strings[k - 1] for k in range(len(strings))]


@pytest.mark.parametrize("chunk", [7, 1 << 15])
def test_suffix_family_levels(chunk, monkeypatch):
    """Batches in any order: all strings but the earliest are reported, levels double, packing keeps them, merges occur."""
    monkeypatch.setattr(suffix_index, "CHUNK", chunk)
    family = suffix_index.SuffixFamily()
    rng = np.random.default_rng(2)
    owners, late = {}, set()
    for doc in rng.permutation(60).tolist():
        texts = [bytes(rng.choice([97, 98], 130, p=[0.97, 0.03]).tolist()) for _ in range(int(rng.integers(1, 4)))]
        starts = np.cumsum([0] + [200] * (len(texts) - 1))
        sizes = np.array([len(t) for t in texts])
        for t, s in zip(texts, starts.tolist(), strict=True):
            for p in range(len(t) - 99):
                owners.setdefault(t[p : p + 100], set()).add((doc, s + p))
        d, p = family.add(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, np.full(len(texts), doc), starts, sizes - 99)
        late.update(zip(d.tolist(), p.tolist(), strict=True))
        assert all(len(x.order).bit_length() <= size for size, x in family.levels.items())
        family.levels = {size: suffix_index.Level.unpacked(x.packed()) for size, x in family.levels.items()}
    assert late == {o for own in owners.values() for o in own if o != min(own)}
    held = sorted(x.text[q : q + 100].tobytes() for x in family.levels.values() for q in x.order)
    assert held == sorted(owners) and family.merges > 3 and len(family.levels) > 1


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(re.sub("[ -]", "", m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@given(st.text(alphabet="a1294.@-+ ()é٣", max_size=40))
@settings(max_examples=500, deadline=None)
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


@pytest.fixture(scope="module")
def tagger():
    return pii.Tagger(pii.fit(pii.labelled_table()))


def labels(tagger, chain):
    out = np.zeros(len(chain), int)
    for (_, first), path in tagger.decode([chain]).items():
        out[first : first + len(path)] = path
    return out


def test_field_on_values_not_seen(tagger):
    """The table's sentences with values drawn anew: labels of tokens, and of those within values."""
    good, found = [], []
    for s in pii.labelled_table(seed=99)[len(pii.SENTENCES.strip().splitlines()) :][:300]:
        path = labels(tagger, [t for t, _ in s])
        good += [pii.LABELS[p] == y for p, (_, y) in zip(path, s, strict=True)]
        found += [pii.LABELS[p] == y for p, (_, y) in zip(path, s, strict=True) if y != "none"]
    assert np.mean(good) > 0.97 and np.mean(found) > 0.9


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("my password = Swordfish, he said", ["Swordfish"]),
        ('they use "password": "moonlight" for it', ["moonlight"]),
        ("x" * 64 + "123-45-6789 and more", ["x" * 64 + "123-45-6789"]),
        ("his ssn is 123-45-6789.", ["123-45-6789"]),
        ('token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" then', ["9b0b3c6a43eb78aa99cbd7049c572391524f37a8"]),
        ("call 415-555-2671 now", ["415-555-2671"]),
        ("the secret of the key to a token", []),
        ("born 1990-01-02 in room 404, version 2.3.1", []),
    ],
)
def test_added_spans(tagger, text, want):
    ((_, more),) = pii.find([text], tagger)
    assert [text[s:e] for _, s, e in more] == want


@given(st.lists(st.sampled_from(["token", "=", '"', "password", ":", "abcdef0123456789abcdef0123456789", "the", "Swordfish", "12", "123-45-6789", "4929", "x9", ",", "+1", "(212)", "a@b"]), min_size=1, max_size=12))
@settings(max_examples=150, deadline=None)
def test_stretches_give_the_best_path(tagger, chain):
    """Decoding between tokens that are none for sure equals Viterbi over the whole chain, with scores by features."""
    field = tagger.field
    names = pii._chain_features(chain)
    scores = np.stack([field.weights[[field.features[f] for f in own if f in field.features]].sum(0) for own in names])
    assert np.allclose(scores, tagger.emissions([["the"], chain, []])[1:])
    whole = tagger.viterbi(scores[None], np.array([True]), np.array([True]))[0]
    value = lambda p: field.first[p[0]] + sum(scores[i, y] for i, y in enumerate(p)) + sum(field.moves[a, b] for a, b in zip(p, p[1:], strict=False))
    mine = labels(tagger, chain)
    assert value(list(mine)) == pytest.approx(value(list(whole)))
    if len(chain) <= 4:
        import itertools

        assert value(list(mine)) == pytest.approx(max(map(value, itertools.product(range(len(pii.LABELS)), repeat=len(chain)))))


def test_redaction(tagger):
    text = 'Write to a.b@c.org, token = "3f786850e387550fdab836ed7e6dc881de23001b" or +1 (528) 555-3435 now.'
    (base, more), = pii.find([text], tagger)
    assert pii.redacted(text, base + more) == 'Write to [EMAIL], token = "[SECRET]" or [PHONE] now.'
    assert pii.find(["", "no digits here"], tagger) == [([], []), ([], [])]


def plain_align(item, passage):
    best, rows = 0, np.zeros((len(item) + 1, len(passage) + 1), int)
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            rows[i, j] = max(0, rows[i - 1, j - 1] + (2 if a == b else -1), rows[i - 1, j] - 1, rows[i, j - 1] - 1)
            best = max(best, rows[i, j])
    return best


@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=16))
@settings(max_examples=200, deadline=None)
def test_alignment(item, passage):
    a, b = np.array(item, np.uint64), np.array(passage, np.uint64)
    score, start, end = decontaminate.align(a, b)
    assert score == plain_align(item, passage)
    assert not score or plain_align(item, passage[start:end]) == score


def found_in(items, texts):
    """matches() of the items in the texts, rare words weighed by the texts, by item then text."""
    (block,) = decontaminate.item_blocks(enumerate(items))
    hashes = [h for _, _, h, _ in decontaminate._hashed(pa.array(texts))]
    block.weigh({int(w): int(n) for w, n in zip(*np.unique(np.concatenate(hashes), return_counts=True), strict=True)}, decontaminate.THRESHOLD)
    lookups = (decontaminate.Lookup(block.long), decontaminate.Lookup(block.rare))
    return block, [{m[0]: m[1] for m in own} for own in decontaminate.matches(block, lookups, pa.array(texts), decontaminate.THRESHOLD, {})]


def plain_shares(item, text):
    a, b = item.split(), text.split()
    number = {w: i for i, w in enumerate(sorted({*a, *b}))}
    return plain_align([number[w] for w in a], [number[w] for w in b]) / (2 * len(a))


@given(st.integers(0, 10_000))
@settings(max_examples=60, deadline=None)
def test_short_items_are_never_missed(seed):
    """All items under LONG words against whole texts, by plain alignment; words of few kinds, so that ties are many."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{int(rng.integers(0, 25))}"
    items = [" ".join(word() for _ in range(rng.integers(1, decontaminate.LONG))) for _ in range(8)]
    texts = []
    for item in [*items, *items]:
        own = [w if rng.random() > 0.25 else word() for w in item.split() if rng.random() > 0.1]
        texts.append(" ".join([word() for _ in range(rng.integers(0, 15))] + own + [word() for _ in range(rng.integers(0, 15))]) or "x")
    _, found = found_in(items, [*texts, *items])
    for text, own in zip([*texts, *items], found, strict=True):
        for t, item in enumerate(items):
            n, share = len(item.split()), plain_shares(item, text)
            if n <= decontaminate.WHOLE:
                want = item == text
            else:
                want = share >= decontaminate.least_share(n, decontaminate.THRESHOLD) - 1e-12
            assert (t in own) == want, (item, text, share)
            assert not want or own[t] == pytest.approx(share)


@pytest.mark.parametrize("n", [3, 6, 10, 15, 30, 59])
@pytest.mark.parametrize("rate", [0.0, 0.15, 0.25, 0.33])
def test_recall_of_edited_items(n, rate):
    """Of copies whose share reaches the threshold of their length, 0.9 at least are found."""
    rng = np.random.default_rng(n)
    word = lambda: f"w{int(rng.zipf(1.3)) % 5000}"
    items = [" ".join(word() for _ in range(n)) for _ in range(60)]
    around = lambda: " ".join(word() for _ in range(20))
    texts = [f"{around()} {' '.join('new' if rng.random() < rate else w for w in item.split())} {around()}" for item in items]
    _, found = found_in(items, texts)
    due = [t for t in range(60) if plain_shares(items[t], texts[t]) >= decontaminate.least_share(n, decontaminate.THRESHOLD)]
    assert not due or np.mean([t in found[t] for t in due]) >= 0.9


def test_license_phrases_and_templates():
    index = licenses.build_index()
    index.weigh(np.ones(len(index.vocabulary)), 100)
    texts = ["Licensed under CC BY-NC 4.0.", "CC-by, cc  BY cc. by", "by cc", None, "x All rights reserved. the GNU General Public License", "Permission is hereby granted, free of charge, to anyone at all obtaining a copy of this software and documentation files"]
    (_, _, ids, first), = licenses._word_ids(index, pa.array(texts))
    base = {label: licenses._places(ids, first, phrase).tolist() for phrase, label in index.base}
    assert base["cc-by"] == [int(first[0]) + 2, int(first[1]), int(first[1]) + 2, int(first[1]) + 4]
    assert len(base["gpl"]) == 1 and len(base["reserved"]) == 1
    labels = [licenses.match(index, ids[first[i] : first[i + 1]])[0] for i in range(len(texts))]
    assert "cc-by-nc" in labels[0] and "mit" in labels[5] and not labels[2] and not labels[3]


def test_toxicity_learns_words_and_misspellings():
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(["an", "the", "or", "in", "re", "st", "on"], 3)) for _ in range(300)]
    bad = ["horribleword", "nastiness", "villainous"]
    texts, labels = [], []
    for i in range(1200):
        own = list(rng.choice(vocabulary, 40))
        if i % 4 == 0:
            own.insert(int(rng.integers(0, 40)), bad[i % 3])
        texts.append(" ".join(own))
        labels.append(int(i % 4 == 0))
    model = toxicity.fit(texts, labels)
    memo = toxicity.WordLogits(model.table, toxicity.SIZES)
    score = lambda t: 1 / (1 + np.exp(-(((toxicity._features(memo, toxicity._words(t)) - model.mean) @ model.weights[:-1]) + model.weights[-1])))
    clean = " ".join(vocabulary[:40])
    assert score(clean) < 0.3 < 0.7 < score(clean + " Horribleword!") and score(clean + " horriblew0rd") > score(clean)
    assert 0 <= score("") <= 0.5 and 0 <= toxicity.fit([], []).weights[-1] + 5


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


BASE_WORDS = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "x", "mit", "the", "é"]


@given(st.lists(st.sampled_from(BASE_WORDS), max_size=40), st.lists(st.sampled_from([" ", "-", ". ", "\n"]), min_size=41, max_size=41))
@settings(max_examples=200, deadline=None)
def test_license_base_places(words_, gaps):
    """Base places against a plain search, and every found template has its phrases near its start."""
    text = "".join(w.upper() + g if i % 3 else w + g for i, (w, g) in enumerate(zip(words_, gaps, strict=False)))
    index = licenses.build_index()
    index.weigh(np.arange(len(index.vocabulary)) % 7, 50)
    row = next(licenses._scan(index)(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])]))).to_pylist()[0]
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    places = sorted((i, label) for phrase, label in licenses.BASE for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split())
    assert row["n_words"] == len(own) and row["n_base"] == len(places)
    assert (row["first_word"], row["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
    assert row["base_labels"] == ",".join(sorted({label for _, label in places}))
    assert set(row["base_labels"].split(",")) <= set(row["labels"].split(",")) or not places


@pytest.mark.parametrize("t", range(len(licenses.TEMPLATES)))
@pytest.mark.parametrize("df", ["rare", "everywhere"])
def test_every_license_template_is_found(t, df):
    """A whole notice amid other words gets its label, however frequent its words are."""
    label, text, _ = licenses.TEMPLATES[t]
    index = licenses.build_index()
    index.weigh(np.full(len(index.vocabulary), 1.0 if df == "rare" else 1000.0), 1000)
    number = {w: i for i, w in enumerate(index.vocabulary)}
    ids = np.array([-1] * 30 + [number[w] for w in text.split()] + [number["of"], number["the"]] * 20)
    labels, score, spans = licenses.match(index, ids)
    assert label in labels and score >= 0.99 and (label, 30) in {s[:2] for s in spans}
    lookups = licenses.candidates(index, ids)
    assert any(lo <= 30 <= hi for lo, hi in lookups[t])


def test_license_label_needs_no_word_that_other_files_lack():
    index = licenses.build_index()
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."
    texts = ["some words before. " + notice] * 10 + ["the name of a place and of a day"] * 990
    rows = [(ids[first[i] : first[i + 1]]) for _, _, ids, first in licenses._word_ids(index, pa.array(texts)) for i in range(len(first) - 1)]
    df = np.zeros(len(index.vocabulary))
    for own in rows:
        df[np.unique(own[own >= 0])] += 1
    index.weigh(df, len(rows))
    assert [index.weight[index.vocabulary.index(w)] for w in ("associated", "documentation", "files")] == [index.weight.max()] * 3  # df 0
    labels, score, spans = licenses.match(index, rows[0])
    assert labels == {"mit"} and 0.5 < score < 1 and spans[0][:2] == ("mit", 3)
    assert licenses.match(index, rows[-1])[0] == set()


def _level(texts: list[bytes], first_doc: int) -> suffix_index.Level:
    size = np.array([len(t) for t in texts])
    many = size - suffix_index.SIZE + 1
    return suffix_index.indexed(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, np.arange(first_doc, first_doc + len(texts)), np.zeros(len(texts), np.int64), many)[0]


def test_small_batch_gallops_through_a_large_level(monkeypatch):
    """A batch costs its own size, not the level's, and finds the same places."""
    draw = np.random.default_rng(1)
    texts = [bytes(draw.choice([0, 1, 97, 98, 255], 150).astype(np.uint8)) for _ in range(400)]
    level, batch = _level(texts, 0), _level([*texts[7:9], bytes(101), bytes([255]) * 120], 500)
    read = []
    strings = suffix_index.Level.strings
    monkeypatch.setattr(suffix_index.Level, "strings", lambda self, *a: read.append(len(out := strings(self, *a))) or out)
    place, equal = level.places_of(batch)
    assert equal.sum() == 102 and sum(read) < len(level.order) // 4
    monkeypatch.setattr(suffix_index, "FAR", 10**9)
    scanned = level.places_of(batch)
    assert (place == scanned[0]).all() and (equal == scanned[1]).all()


def test_second_pass_sends_a_blob_for_each_task_and_part():
    """Blobs grow with tasks and parts, not with the batches of a task."""
    everything = type("Sent", (), {"value": (np.full(1 << (suffix_dedup.SLOTS - 3), 255, np.uint8), np.zeros(0, np.uint64))})
    draw = np.random.default_rng(2)
    text = ["".join(map(chr, draw.integers(97, 123, 400))) for _ in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([t])], ["doc_id", "text"]) for i, t in enumerate(text)]
    sent = [x for b in suffix_dedup._deal(3, everything)(iter(batches)) for x in b.column("blob").to_pylist()]
    assert len(sent) == 3
    doc, start, many = (np.concatenate([suffix_dedup._unpack(b)[k] for b in sent]) for k in range(3))
    assert sorted((d, s + i) for d, s, n in zip(doc.tolist(), start.tolist(), many.tolist(), strict=True) for i in range(n)) == [(d, i) for d in range(40) for i in range(301)]
