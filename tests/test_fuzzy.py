"""Fuzzy titles by bounds of many pairs at once, against every pair one by one."""

import random
from itertools import combinations

import numpy as np
import pytest

from biblioscope.functions import similarity
from biblioscope.operators import dedup


def titles(seed, letters):
    draw = random.Random(seed)
    out = []
    for size in (1, 2, 3, 4, 9, 30, 75, 240, 420):
        base = "".join(draw.choice(letters) for _ in range(size))
        out.append(base)
        for _ in range(4):
            own = list(base)
            for _ in range(draw.randint(1, max(1, size // 8))):
                p = draw.randrange(len(own))
                if draw.random() < 0.5:
                    own[p] = draw.choice(letters)
                else:
                    own.insert(p, draw.choice(letters))
            out.append("".join(own))
    return sorted(out, key=len)


@pytest.mark.parametrize("letters", ["ab", "abcdeé ", "abcdefghijklmnopqrstuvwxyz ü"])
@pytest.mark.parametrize("own", [192, 5])
def test_bounds_lose_no_pair(monkeypatch, letters, own):
    monkeypatch.setattr(similarity, "OWN", own)
    monkeypatch.setattr(similarity, "LETTERS", min(own, similarity.LETTERS))
    texts = titles(len(letters), letters)
    near = similarity.Titles(texts)
    i, j = np.tril_indices(len(texts), -1)
    common = np.minimum(near.counts[:, i], near.counts[:, j]).astype(int).sum(0)
    for threshold in (0.6, 0.8, 0.92):
        want = {(a, b): s for a, b in zip(i.tolist(), j.tolist(), strict=True) if (s := similarity.jaro_winkler_of(texts[a], texts[b])) >= threshold}
        assert {(a, b): s for a, b, s in zip(*(x.tolist() for x in near.near(i, j, common, threshold)), strict=True)} == want and want


def test_pairs_by_parts_and_stretches(spark, monkeypatch):
    monkeypatch.setattr(dedup, "ROWS", 7)
    monkeypatch.setattr(dedup, "STRETCH", 11)
    draw = random.Random(5)
    texts = [t for t in titles(5, "abcdefgh ") if t.strip()] * 2
    rows = [(k, t, draw.choice([2001, 2002, 2003, 2005, 2006, 2009, 2011]), k % 5) for k, t in enumerate(texts)]
    years = {r[2] for r in rows}
    want = {}
    for a, b in combinations(rows, 2):
        if any(abs(a[2] - y) <= 1 and abs(b[2] - y) <= 1 for y in years) and (s := similarity.jaro_winkler_of(a[1], b[1])) >= 0.92:
            want[a[0], b[0]] = s
    df = spark.createDataFrame(rows, "id int, titulo_norm string, ano int, citacoes int")
    pairs = dedup.fuzzy_pairs(df)
    found = [((r.a, r.b), r.similarity) for r in pairs.collect()]
    assert dict(found) == want and len(found) == len(want) > 40
    fuzzy = dedup.Fuzzy(df)
    assert fuzzy.n_pairs().first()[0] == len(want) and fuzzy.links().count() < len(want)
    assert [(r.a, r.b) for r in fuzzy.closest(20).collect()] == sorted(want, key=lambda p: (-want[p], p))[:20]
    assert sorted(dedup.duplicate_groups(df, fuzzy.links()).collect()) == sorted(dedup.duplicate_groups(df, pairs).collect())
    assert dedup.fuzzy_pairs(df.filter("ano < 0")).count() == 0
