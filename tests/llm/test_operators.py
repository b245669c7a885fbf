"""The operators and the pipeline on small tables: brute force, nulls, empty and long texts, repeats, empty tables, clashing columns."""

import collections
import hashlib
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from biblioscope.llm import decontaminate, langid, licenses, near_dedup, packing, pii, queries, suffix_dedup, token_counts, toxicity, webp
from biblioscope.llm.common import shared_path

UPPER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def sentence(rng, n):
    return " ".join("".join(rng.choice(["an", "the", "or", "in", "re", "st", "on", "é"], rng.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    base = [sentence(rng, 60) for _ in range(12)]
    texts = [None, "", "   ", "One", "A. b@c.de", "x" * 5000, "Ünï cödé 中文 <|endoftext|> ▁", *base]
    texts += [base[0], base[0].upper(), base[1] + " more", "lead " + base[1], " ".join(base[2].split()[5:] + ["tail"]), base[3][:150] + base[4][:150]]
    near = base[5].split()
    for i in range(20):
        own = list(near)
        own[i * 2] = f"w{i}"
        texts.append(" ".join(own))
    texts.append(sentence(rng, 30_000))
    out = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    out.append((7, texts[7], "en", "src", 1))  # a repeated row
    out.append((None, base[0], "en", "src", 1))
    out.append((None, None, None, None, None))
    return out


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clash(df):
    """Extra columns with the operators' own names."""
    return df.withColumns({c: F.lit(3) for c in ("n", "key", "rep", "score", "matches", "component", "digest", "length", "part", "spans", "a", "b", "held_out", "nth")})


def by_text(rows):
    return collections.Counter((r[0], r[1]) for r in rows)


def test_suffix_dedup(spark, docs, empty, rows):
    out = suffix_dedup.remove_repeats(clash(docs), parts=3, keep_text=True).collect()
    assert len(out) == len(rows)
    seen, kept = set(), {}
    for doc, text in sorted({(r[0], r[1] or "") for r in rows if r[0] is not None}):
        data, gone = text.encode(), set()
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone.update(range(p, p + 100))
            seen.add(data[p : p + 100])
        kept[doc] = bytes(c for i, c in enumerate(data) if i not in gone)
        runs = sum(1 for i in gone if i - 1 not in gone)
        for r in (r for r in out if r.doc_id == doc):
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), len(gone), runs, hashlib.sha256(kept[doc]).hexdigest())
            assert bytes(r.kept) == kept[doc]
    assert all(not r.n_removed for r in out if r.doc_id is None)
    assert suffix_dedup.remove_repeats(empty, parts=2).count() == 0


def test_suffix_dedup_of_later_batches(spark, docs, rows):
    """Documents added in three batches to a lasting index, read anew each time, give what one run gives."""
    spans = lambda df: {(r.doc_id, i) for r in df.collect() for i in range(r.first, r.last)}
    want = spans(suffix_dedup.repeats(docs, parts=3))
    path, found, levels = shared_path(spark, "index"), set(), []
    for k in (2, 0, 1, 3):
        index = suffix_dedup.RepeatIndex(spark, path, parts=3)
        found |= spans(index.add(docs.filter(f"pmod(doc_id, 4) = {k}")))
        levels.append(sorted(index.levels))
    assert found == want and levels == [[0], [1], [0, 1], [2]]
    assert not spans(suffix_dedup.RepeatIndex(spark, path).add(docs.limit(0)))


def stored_counts(spark, path):
    return [r for f in __import__("glob").glob(path.removeprefix("file://") + "/*/part-*") for r in spark.read.parquet("file://" + f).collect()]


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_token_counts_and_cache(spark, docs, empty, rows, broadcast_rows):
    path, model = shared_path(spark, "cache"), public_tokenizers.path(token_counts.MODEL)
    counter = token_counts.PieceCounter(model)
    count = lambda df: collections.Counter(map(tuple, token_counts.token_counts(df, model, path, broadcast_rows=broadcast_rows).collect()))
    want = collections.Counter((r[0], len((r[1] or "").encode()), len(counter.model.encode(r[1] or ""))) for r in rows)
    assert count(clash(docs)) == want
    first = stored_counts(spark, path)
    assert len({bytes(r.content_digest) for r in first}) == len({(r[1] or "").replace("\u2581", " ") for r in rows})
    assert count(docs) == want
    assert sorted(stored_counts(spark, path)) == sorted(first)  # nothing was missing, so nothing was encoded
    more = spark.createDataFrame([(1000, "a new text", "en", "s", 1), (1001, "a\u2581new text", "en", "s", 1)], SCHEMA)
    assert {(r[0], r[2]) for r in count(more.union(docs))} >= {(1000, 3), (1001, 3)}
    assert len(stored_counts(spark, path)) == len(first) + 1  # both spellings of the space are one content
    assert not count(empty)


def test_token_counts_query_uses_the_cache(spark, tmp_path):
    """The registered query over one table twice: the second time every digest is a hit."""
    if not os.path.exists("/root/testdata/sf0.001"):
        pytest.skip("no test data")
    spark.conf.set("spark.biblioscope.tokenCache", f"file://{tmp_path}/cache")
    try:
        once = sorted(token_counts.query(spark, "/root/testdata/sf0.001").collect())
        held = sorted(stored_counts(spark, f"file://{tmp_path}/cache"))
        assert sorted(token_counts.query(spark, "/root/testdata/sf0.001").collect()) == once
        assert sorted(stored_counts(spark, f"file://{tmp_path}/cache")) == held and len(held) < len(once)
    finally:
        spark.conf.unset("spark.biblioscope.tokenCache")


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_packing(spark, docs, empty, rows, broadcast_rows, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 4)
    tokenizer = packing.RunEncoder(public_tokenizers.path(packing.MODEL)).tokenizer
    out = packing.pack(clash(docs), public_tokenizers.path(packing.MODEL), size=64, broadcast_rows=broadcast_rows).collect()
    want = collections.Counter()
    for doc, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 64)):
            own = ids[at : at + 64]
            want[doc, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    used = collections.defaultdict(list)
    for r in out:
        used[r.sequence_id].append((r.offset, r.length))
    for own in used.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 64
    total = sum(r.length for r in out)
    assert -(-total // 64) <= len(used) <= -(-total // 64) * 11 // 9 + 1
    assert packing.pack(empty, public_tokenizers.path(packing.MODEL), broadcast_rows=broadcast_rows).count() == 0


def test_webp(spark, docs, empty, rows):
    media = webp.to_media(clash(docs))
    out = webp.read_back(media).collect()
    assert len(out) == len(rows)
    want = collections.Counter()
    for doc, text, *_ in rows:
        data = (text or "").encode()
        data_ = data + b"\0" * ((-len(data)) % 64 if data else 64)
        want[doc, len(data), len(data_), hashlib.sha256(data_).hexdigest(), zlib.crc32(data_[-64:])] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out) == want
    same = collections.defaultdict(set)
    for r in out:
        same[r.payload_sha256].add((r.media_sha256, r.feature, r.media_bytes))
    assert all(len(s) == 1 for s in same.values())
    one = webp.pixels(media.filter("doc_id = 8")).first()
    assert one.width * one.height == len(one.argb)
    assert webp.read_back(webp.to_media(empty)).count() == 0


def test_licenses(spark, docs, empty, rows):
    more = spark.createDataFrame([(2000, "Released under the MIT License.", "en", "s", 1), (2001, "cc-BY cc by all rights reserved", "en", "s", 1)], SCHEMA)
    out = {r.doc_id: r for r in licenses.scan(clash(docs.union(more))).collect()}
    assert len(out) == len({r[0] for r in rows}) + 2
    assert out[2000].labels == "mit" and out[2000].base_labels == "" and 0.5 <= out[2000].score <= 1
    assert (out[2001].n_base, out[2001].first_word, out[2001].last_word, out[2001].base_labels) == (3, 0, 4, "cc-by,reserved")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for doc, text, *_ in rows:
        assert doc is None or out[doc].n_words == len(pattern.findall((text or "").translate(UPPER)))
    assert out[0].first_word is None and out[0].score == 0
    assert licenses.scan(empty).count() == 0


def test_pii(spark, docs, empty, rows):
    field = pii.fit(pii.labelled_table())
    out = pii.scan(clash(docs), field).collect()
    assert len(out) == len(rows) and sum(r.n_email for r in out) == 1
    one = next(r for r in out if r.doc_id == 4)
    assert one.spans == "email:3:9" and one.base_sha256 == hashlib.sha256(b"email:3:9").hexdigest()
    redacted = pii.redact(clash(docs), field)
    assert redacted.columns == clash(docs).columns
    assert {r.text for r in redacted.filter("doc_id = 4").collect()} == {"A. [EMAIL]"}
    assert redacted.filter("text is null").count() == sum(r[1] is None for r in rows)
    assert pii.scan(empty, field).count() == 0 and pii.redact(empty, field).count() == 0


def test_decontamination(spark, docs, empty, rows):
    rng = np.random.default_rng(77)
    items = [sentence(rng, 30) for _ in range(6)]
    edited = items[1].split()
    for i in (4, 11, 19, 26):
        edited[i] = "changed"
    del edited[15]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(8, None), (None, items[0]), (9, "two words"), (1, items[1])], "item_id bigint, text string")
    more = [(3000, "before. " + items[0].upper() + " after", "en", "s", 1), (3001, " ".join(edited), "en", "s", 1), (3002, sentence(rng, 40), "en", "s", 1), (3003, items[2] + " and " + items[3] + " and " + items[2], "en", "s", 1), (3004, "Two words!", "en", "s", 1), (3005, "no two words here", "en", "s", 1)]
    both = clash(docs.union(spark.createDataFrame(more, SCHEMA)))
    for words in (decontaminate.BLOCK_WORDS, 40):
        out = decontaminate.annotate(both, bench, block_words=words)
        assert [c for c in out.columns if c != "matches"] == [c for c in both.columns if c != "matches"]
        found = {(r.doc_id, m.item_id) for r in out.collect() for m in r.matches}
        assert found == {(3000, 0), (3001, 1), (3003, 2), (3003, 3), (3004, 9)}
    assert out.filter("doc_id = 3000").first().matches[0].score == 1.0
    assert {m.item_id: m.first_word for m in out.filter("doc_id = 3003").first().matches}[2] == 0  # of two equal passages the first
    assert decontaminate.annotate(empty, bench).count() == 0
    assert decontaminate.annotate(docs, bench.limit(0)).filter(F.size("matches") > 0).count() == 0


def test_decontamination_of_many_edited_copies(spark):
    item = sentence(np.random.default_rng(78), 15)
    edited = item.split()
    for i in (2, 7, 12):
        edited[i] = "changed"
    rows = [(i, "a " + " ".join(edited), "en", "s", 1) for i in range(1, 41)] + [(0, "b " + item, "en", "s", 1)]
    bench = spark.createDataFrame([(5, item)], "item_id bigint, text string")
    out = decontaminate.annotate(spark.createDataFrame(rows, SCHEMA), bench).collect()
    assert {r.doc_id: [(m.item_id, round(m.score, 6)) for m in r.matches] for r in out} == {0: [(5, 1.0)]} | {i: [(5, 0.7)] for i in range(1, 41)}


def plain_components(rows, k):
    sets = {}
    for doc, text, *_ in rows:
        if doc is not None:
            w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
            sets[doc] = frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, docs, empty, rows, k):
    out = near_dedup.near_duplicates(clash(docs), k=k).collect()
    want = plain_components(rows, k)
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    assert near_dedup.near_duplicates(empty, k=k).count() == 0


@pytest.mark.parametrize("hot_rows", [2, near_dedup.HOT_ROWS])
def test_near_duplicates_in_a_chain(spark, hot_rows, monkeypatch):
    monkeypatch.setattr(near_dedup, "HOT_ROWS", hot_rows)  # at 2 every shared band is hot
    """Neighbours are linked, the ends aren't: the component needs every link."""
    words = [f"w{i}" for i in range(160)]
    rows = [(i, " ".join(words[i * 3 : i * 3 + 40]), "en", "s", 1) for i in range(40)]
    out = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), k=2).collect()}
    assert out == {d: c for d, (_, c) in plain_components(rows, 2).items()}


def test_language(spark, empty):
    rng = np.random.default_rng(5)
    stems = {"xx": ["zul", "kra", "bon"], "yy": ["mie", "lou", "eau"], "zz": ["sch", "ung", "ver"]}
    rows = []
    for i in range(300):
        lang = list(stems)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(stems[lang], 2)) for _ in range(int(rng.integers(1, 80)))), lang, "s", 1))
    rows += [(1000, None, "xx", "s", 1), (1001, "12 34 !", "yy", "s", 1), (1002, "", None, "s", 1), (None, "zulkra", "xx", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("held_out", F.col("doc_id") % 5 == 0)
    out = langid.identify(df, df.filter("not held_out and lang is not null")).collect()
    good = sum(r.lang_pred == rows[r.doc_id][2] for r in out if r.doc_id is not None and r.doc_id < 300 and r.held_out)
    assert len(out) == len(rows) and good >= 0.97 * 60
    assert all(0 <= r.score <= 1 for r in out) and {r.lang_pred for r in out if r.doc_id in (1000, 1001, 1002)} == {"und"}
    nothing = empty.withColumn("held_out", F.lit(False))
    assert langid.identify(nothing, nothing).count() == 0
    assert {r.lang_pred for r in langid.identify(df, df.limit(0)).collect()} == {"und"}


def test_toxicity(spark, docs, empty, rows):
    labels = spark.createDataFrame([(r[0], i % 2, int(i % 5 == 0)) for i, r in enumerate(rows)] + [(None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.model(docs, labels)
    out = toxicity.apply(clash(docs), model)
    assert out.columns == [c for c in clash(docs).columns if c != "score"] + ["score"]
    found = out.collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert toxicity.apply(empty, toxicity.model(empty, labels.limit(0))).count() == 0


def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline as P

    rng = np.random.default_rng(21)
    item = sentence(rng, 30)
    own = [r for r in rows if r[0] is not None] + [(500 + i, sentence(rng, 40) + (" horribleword" if i % 3 == 0 else ""), "en", "s", 1) for i in range(240)]
    own += [(900, "intro " + item, "en", "s", 1), (901, "mail a.b@c.org", "en", "s", 1)]
    labels = [(500 + i, 1, int(i % 3 == 0)) for i in range(240)]
    spark.createDataFrame(own, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        path = shared_path(spark, "stage")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        assert len(kept[name]) == docs.count() - (name == "toxicity")  # a repeated row
    toxic = {500 + i for i in range(240) if i % 3 == 0}
    assert len(toxic & set(kept["toxicity"])) < 8 and len(set(kept["toxicity"]) - toxic) >= len({r[0] for r in own}) - len(toxic) - 5
    left = [(d, t) for d, t in kept["toxicity"].items()]
    assert set(kept["near_dedup"]) == {d for d, (_, c) in plain_components(left, 5).items() if d == c}
    assert set(kept["near_dedup"]) - set(kept["decontamination"]) == {900}
    assert set(kept["pii"]) == set(kept["decontamination"]) and kept["pii"][901] == "mail [EMAIL]"
    pieces = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(kept["pii"])


def write_tables(spark, path, documents, schema, labels=(), items=()):
    spark.createDataFrame(documents, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as P

    write_tables(spark, tmp_path, [], SCHEMA)
    out = P.run(spark, str(tmp_path))
    assert out.count() == 0 and "sequence_id" in out.columns


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null ids, texts and labels, repeated rows, and columns with the operators' own names, which stay as they are."""
    import corpus_pipeline as P

    rng = np.random.default_rng(31)
    item, base = sentence(rng, 25), sentence(rng, 50)
    texts = [(1, base), (2, base), (2, base), (3, None), (4, ""), (5, "x " + item), (6, "mail a.b@c.org"), (None, base), (None, None), (7, sentence(rng, 60))]
    schema = SCHEMA + ", score int, matches string, key string, _nth int, piece string, component bigint"
    rows = [(i, t, "en", None, 1, k, f"m{k}", "k", k, "p", 5) for k, (i, t) in enumerate(texts)]
    write_tables(spark, tmp_path, rows, schema, [(1, 1, None), (None, 0, 1), (7, None, 0), (999, 1, 1)], [(1, item), (2, None), (None, item)])
    docs, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), [c.split()[0] for c in schema.split(", ")]
    ids = {}
    for name, stage in P.STAGES[:-1]:
        path = shared_path(spark, "odd")
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        own = docs.collect()
        assert all(r.matches == f"m{r.score}" and r.key == "k" and r.component == 5 for r in own)
        ids[name] = collections.Counter(r.doc_id for r in own)
    assert ids["toxicity"] == collections.Counter(i for i, _ in texts)
    assert ids["near_dedup"] == {1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, None: 2}
    assert ids["decontamination"] == ids["near_dedup"] - collections.Counter([5]) == ids["pii"]
    assert {r.text for r in docs.filter("doc_id = 6").collect()} == {"mail [EMAIL]"}
    out = P.run(spark, str(tmp_path)).collect()
    assert collections.Counter(r.doc_id for r in out) == ids["pii"]


def test_languages_of_odd_tables(spark):
    rows = [(1, "the house of the man"), (2, None), (2, None), (None, "12 34"), (3, "the " * 50_000), (4, "der Mann und das Haus")]
    docs = spark.createDataFrame([(i, t, False, "x", 7) for i, t in rows], "doc_id bigint, text string, held_out boolean, lang_pred string, score int")
    train = spark.createDataFrame([(i, ("the house of the man", "der Mann und das Haus")[i % 2], ("en", "de")[i % 2]) for i in range(40)], "doc_id bigint, text string, lang string")
    out = langid.identify(docs, train).collect()
    assert collections.Counter((r.doc_id, r.lang_pred) for r in out) == collections.Counter([(1, "en"), (2, "und"), (2, "und"), (None, "und"), (3, "en"), (4, "de")])
    assert all(r.score == 0 and r.rejected for r in out if r.lang_pred == "und") and all(0 <= r.score <= 1 for r in out)
    nothing = langid.identify(docs, train.limit(0)).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_registry():
    names = sorted(queries.QUERIES)
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11))
