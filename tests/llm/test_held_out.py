"""Held-out accuracy of the trained operators on the driver's tables."""

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from biblioscope.llm import langid, toxicity

DATA = "/root/testdata"


def read(sf, name):
    path = f"{DATA}/{sf}/{name}.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    return pq.read_table(path).to_pylist()


def bucket(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_language_of_held_out_texts(sf):
    rows = [r for r in read(sf, "documents") if r["lang"] and r["text"]]
    learned, taken = [], {}
    for r in rows:
        if bucket(r["doc_id"], 5) and taken.get(r["lang"], 0) < langid.TRAIN_ROWS_PER_LANGUAGE:
            taken[r["lang"]] = taken.get(r["lang"], 0) + 1
            learned.append((r["text"], r["lang"]))
    model = langid.fit([t for t, _ in learned], [x for _, x in learned])
    held = [r for r in rows if not bucket(r["doc_id"], 5) and any(c.isalpha() for c in r["text"])]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(held))), pa.array([True] * len(held)), pa.array([r["text"] for r in held])], ["doc_id", "held_out", "text"])
    found = next(langid._predict(model)(iter([batch])))
    assert np.mean([a == r["lang"] for a, r in zip(found.column(2).to_pylist(), held, strict=True)]) >= 0.97
    assert all(0 <= s <= 1 for s in found.column(3).to_pylist())


@pytest.mark.parametrize(("sf", "recall"), [("sf0.01", 0.7), ("sf0.1", 0.8)])
def test_toxicity_of_held_out_rows(sf, recall):
    toxic = {r["doc_id"]: r["toxic"] for r in read(sf, "labels")}
    rows = [r for r in read(sf, "documents") if r["doc_id"] in toxic]
    learned, taken = [], [0, 0]
    for r in rows:
        y = toxic[r["doc_id"]]
        if bucket(r["doc_id"], 3) != 1 and taken[y] < toxicity.TRAIN_ROWS_PER_LABEL:
            taken[y] += 1
            learned.append((r["text"], y))
    share = np.mean([toxic[r["doc_id"]] for r in rows if bucket(r["doc_id"], 3) != 1])
    model = toxicity.fit([t for t, _ in learned], [y for _, y in learned], share)
    held = [r for r in rows if bucket(r["doc_id"], 3) == 1]
    out = next(toxicity._score(model, 0)(iter([pa.RecordBatch.from_arrays([pa.array([r["text"] for r in held])], ["text"])])))
    marked = np.array(out.column(1).to_pylist()) >= toxicity.THRESHOLD
    y = np.array([toxic[r["doc_id"]] for r in held])
    assert marked[y == 1].mean() >= recall
    assert marked[y == 0].mean() <= 0.01


def test_a_misspelling_scores_above_its_clean_neighbours():
    rng = np.random.default_rng(4)
    stems = ["har", "lin", "mo", "ten", "sa", "pel", "dur", "vi"]
    clean = lambda n: " ".join("".join(rng.choice(stems, 2)) for _ in range(n))
    texts = [clean(30) for _ in range(120)] + [clean(15) + " grubworm " + clean(15) for _ in range(120)]
    model = toxicity.fit(texts, [0] * 120 + [1] * 120)
    context = clean(20)
    batch = pa.RecordBatch.from_arrays([pa.array([context, context + " grubw0rm", context + " harlin", None, ""])], ["text"])
    plain, misspelt, known, null, nothing = next(toxicity._score(model, 0)(iter([batch]))).column(1).to_pylist()
    assert misspelt > plain and misspelt > known and null == nothing < 0.7


def test_labels_of_the_held_out_third_are_not_learned(spark):
    """Rows whose crc32 mod 3 is 1 take no part; null labels and rows neither; with one label alone all scores are low and equal."""
    docs = spark.createDataFrame([(i, f"word{i % 7} text") for i in range(60)] + [(None, "x"), (61, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(60)] + [(None, 1), (61, None), (999, 1)], "doc_id bigint, toxic int")
    sample, prior = toxicity.training_sample(docs, labels, 100)
    allowed = [i for i in range(60) if bucket(i, 3) != 1]
    assert len(sample) == len(allowed) and sorted(y for _, y in sample) == sorted(i % 2 for i in allowed)
    one = toxicity.apply(docs, toxicity.model(docs, labels.filter("toxic = 0")))
    assert one.select("score").distinct().count() == 1 and one.first().score < 0.7
