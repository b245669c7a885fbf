"""Licence scans by a positional index: a file's highest-IDF licence words are looked up, template postings intersect by
relative position, mandatory key phrases are verified."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORDISH, chunks, lower_ascii, prefix_hash, small_batches, span_hash, table, utf8, words

#: Phrases that are found exactly, with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices as (label, text, mandatory key phrases). Public licence wordings.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("this permission notice shall be included",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("may not use this file except in compliance",)),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("without any express or implied warranty",)),
    ("boost", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd", "released under the bsd 3 clause license", ("bsd", "clause")),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    ("gpl", "licensed under the gnu general public license v3", ("general public license",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ("cc0",)),
    ("copyright", "copyright c the authors all rights reserved", ("copyright", "all rights reserved")),
)
#: A file's licence words of highest IDF that are looked up, beside the rarest word of each mandatory phrase.
RAREST = 16
#: Words by which a word or key phrase may be off the place that the votes give.
SLACK = 3
#: Least share of a template's weight that must stand at its place.
LEAST = 0.5


@dataclass
class Index:
    """Word ids by hash, and postings (template, position) of every template word."""

    vocabulary: list[str]
    hashes: np.ndarray  # sorted
    ids: np.ndarray  # vocabulary id of each sorted hash
    templates: list[tuple[str, list[int], list[tuple[int, list[int]]]]]  # label, word ids, key phrases as (position, ids)
    base: list[tuple[list[int], str]]
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    postings: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # word id -> (template, position)
    openers: frozenset[int] = frozenset()  # the rarest word of each template's first phrase

    def weigh(self, df: np.ndarray, n: int) -> None:
        """Inverse document frequencies from the whole corpus."""
        self.weight = np.log((n + 1) / (df + 0.5)).clip(0.01)
        self.openers = frozenset(max(phrases[0][1], key=lambda w: (self.weight[w], w)) for _, _, phrases in self.templates)
        self.postings = {}
        for t, (_, own, _) in enumerate(self.templates):
            for q, w in enumerate(own):
                self.postings.setdefault(w, []).append((t, q))


def _hash_words(found: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(found).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(w.encode()) for w in found])])
    return span_hash(prefix_hash(data), at[:-1], at[1:])


def build_index(templates=TEMPLATES, base=BASE) -> Index:
    vocabulary = sorted({w for _, text, _ in templates for w in text.split()} | {w for phrase, _ in base for w in phrase.split()})
    number = {w: i for i, w in enumerate(vocabulary)}
    hashes = _hash_words(vocabulary)
    order = np.argsort(hashes)
    made = []
    for label, text, keys in templates:
        own = text.split()
        phrases = []
        for key in keys:
            parts = key.split()
            place = next(i for i in range(len(own)) if own[i : i + len(parts)] == parts)
            phrases.append((place, [number[w] for w in parts]))
        made.append((label, [number[w] for w in own], phrases))
    return Index(vocabulary, hashes[order], order, made, [([number[w] for w in phrase.split()], label) for phrase, label in base])


def _word_ids(index: Index, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each stretch of documents i..j: ids of all their words (-1: no licence word), and where each document's begin."""
    data, at = utf8(column)
    for i, j in chunks(at):
        own, offsets = lower_ascii(data[at[i] : at[j]]), at[i : j + 1] - at[i]
        start, end, first = words(own, offsets, WORDISH)
        h = span_hash(prefix_hash(own), start, end)
        place = np.searchsorted(index.hashes, h)
        place[place == len(index.hashes)] = 0
        yield i, j, np.where(index.hashes[place] == h, index.ids[place], -1), first


def _frequencies(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(index.vocabulary) + 1, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for i, j, ids, first in _word_ids(index, batch.column(0)):
                hit = np.flatnonzero(ids >= 0)
                doc = np.searchsorted(first, hit, side="right") - 1
                seen = np.unique(doc * len(df) + ids[hit])
                df += np.bincount(seen % len(df), minlength=len(df))
        df[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df))), pa.array(df)], ["word", "n"])

    return run


def _places(ids: np.ndarray, first: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Where the phrase's words stand one after the other, inside one document."""
    n = len(ids) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    found = np.flatnonzero(ids[:n] == phrase[0])
    for k, w in enumerate(phrase[1:], 1):
        found = found[ids[found + k] == w]
    doc = np.searchsorted(first, found, side="right")
    return found[found + len(phrase) <= first[np.minimum(doc, len(first) - 1)]]


def candidates(index: Index, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """For each template the stretches (first, last) of starts for which the file's looked-up words vote.

    Those are its RAREST licence words of highest IDF and, as a template's phrase is mandatory, the rarest word of each
    phrase, so whatever words a file has besides, a place with the phrase gets a vote."""
    at = np.flatnonzero(ids >= 0)
    found = ids[at]
    present = np.unique(found)
    rare = set(present[np.lexsort((present, -index.weight[present]))][:RAREST].tolist()) | index.openers
    starts: dict[int, list[int]] = {}
    for p, w in zip(at.tolist(), found.tolist(), strict=True):
        if w in rare:
            for t, q in index.postings[w]:
                starts.setdefault(t, []).append(p - q)
    out = {}
    for t, own in starts.items():
        own.sort()
        cut = [k for k in range(1, len(own)) if own[k] - own[k - 1] > 2 * SLACK]
        out[t] = [(own[i], own[j - 1]) for i, j in zip([0, *cut], [*cut, len(own)], strict=True)]
    return out


def match(index: Index, ids: np.ndarray) -> tuple[set[str], float, list[tuple[str, int, float]]]:
    """Labels, best score and (label, start word, score) of the templates in one document's word ids.

    Stretches of starts come from candidates(). In them each place of the template's first key phrase is verified; of the
    starts up to SLACK words around, the one at which the document's licence words weigh most by IDF is the template's."""
    present = set(ids.tolist())
    ends = np.array([0, len(ids)])
    labels: set[str] = set()
    best, spans = 0.0, []
    for t, stretches in sorted(candidates(index, ids).items()):
        label, own, phrases = index.templates[t]
        if not all(present.issuperset(key) for _, key in phrases):
            continue
        weights, size = index.weight[own], len(own)
        q0, key0 = phrases[0]
        wide = np.concatenate([np.full(2 * SLACK + size, -1), ids, np.full(2 * SLACK + size, -1)])
        bases = _places(ids, ends, key0) - q0
        voted = np.searchsorted([lo for lo, _ in stretches], bases, side="right") - 1
        bases = [b for b, k in zip(bases.tolist(), voted.tolist(), strict=True) if k >= 0 and b <= stretches[k][1]]
        group: tuple[float, int, float] | None = None  # votes, -start, share
        last = None
        for base in [*bases, None]:
            if group is not None and (base is None or base - last > SLACK):  # key words that repeat nearby are one place
                labels.add(label)
                spans.append((label, max(0, -group[1]), group[2]))
                best, group = max(best, group[2]), None
            if base is None:
                break
            last = base
            # row d, column q: whether the template's word q stands at base + d - 2 * SLACK + q
            same = np.stack([wide[base + size + d : base + 2 * size + d] == own for d in range(4 * SLACK + 1)])
            for e in range(SLACK, 3 * SLACK + 1):
                near = same[e - SLACK : e + SLACK + 1]
                if not all(near[:, q : q + len(key)].all(1).any() for q, key in phrases):
                    continue
                there = near.any(0)
                share = float(weights[there].sum()) / float(weights.sum())
                if share >= LEAST and len({own[q] for q in np.flatnonzero(there).tolist()}) >= min(2, len(set(own))):
                    group = max(group or (-1.0, 0, 0.0), (round(float(weights[same[e]].sum()), 9), -(base + e - 2 * SLACK), share))
    return labels, min(1.0, best), spans


SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, templates array<struct<label: string, start_word: bigint, score: double>>"


def _scan(index: Index):
    openers = np.zeros(len(index.vocabulary) + 1, bool)  # the last stands for -1
    openers[list(index.openers)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            names = batch.column(0).to_pylist()
            for i, j, ids, first in _word_ids(index, batch.column(1)):
                base: dict[int, list[tuple[int, str]]] = {}
                for phrase, label in index.base:
                    for p in _places(ids, first, phrase).tolist():
                        base.setdefault(int(np.searchsorted(first, p, side="right")) - 1, []).append((p, label))
                some = set((np.searchsorted(first, np.flatnonzero(openers[ids]), side="right") - 1).tolist())
                for k in range(j - i):
                    lo, hi = int(first[k]), int(first[k + 1])
                    labels, score, spans = match(index, ids[lo:hi]) if k in some else (set(), 0.0, [])
                    own = base.get(k, [])
                    plain = {label for _, label in own}
                    rows.append((names[i + k], hi - lo, len(own), min(own)[0] - lo if own else None, max(own)[0] - lo if own else None, ",".join(sorted(plain)), ",".join(sorted(plain | labels)), 1.0 if own else score, [dict(zip(("label", "start_word", "score"), s, strict=True)) for s in sorted(spans)]))
            kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("score", pa.float64())]))]
            names_out = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "templates"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)], names_out)

    return run


def scan(docs: DataFrame, index: Index | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: base places and labels, and the labels, score and places of the templates.

    Document frequencies of the licence words come from all rows first; only those few numbers reach the driver. Null
    texts count as empty (0 words, empty labels, null places, score 0); repeated rows give a row each; an empty table
    gives none; other columns are ignored. Texts are scanned whole."""
    index = index or build_index()
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(_frequencies(index), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(index.vocabulary) + 1)
    for r in rows:
        df[r.word] = r.n
    index.weigh(df[:-1], int(df[-1]))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan(index), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents."""
    small_batches(spark)
    return scan(table(spark, sf_dir, "documents")).drop("templates")
