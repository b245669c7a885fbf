"""Hashed subword embeddings with a linear softmax, and per-word memos for scoring."""

from __future__ import annotations

import string
from collections import Counter
from dataclasses import dataclass

import numpy as np

from .common import mix

EDGES = string.punctuation + "¡¿«»„“”‘’…–—"


def grams(words: list[str], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all byte n-grams of <word>, grouped by word, and where each word's begin; a word has one at least.

    Words are lower-cased and lose punctuation at their edges. Whole words count as n-grams of their own length."""
    encoded = [f"<{w.lower().strip(EDGES)}>".encode("utf-8", "replace") for w in words]
    lengths = np.array([len(e) for e in encoded], np.int64)
    data = np.frombuffer(b"".join(encoded), np.uint8).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    inside = np.concatenate([[0], np.cumsum(lengths)])[owner + 1] - np.arange(len(data)) if len(data) else np.zeros(0, np.int64)
    ids, whose = [], []
    for n in sizes:
        start = np.flatnonzero(inside >= n)
        h = np.full(len(start), n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + data[start + j]
        ids.append((mix(h) % np.uint64(buckets)).astype(np.int32))
        whose.append(owner[start])
    ids.append(np.zeros(len(words), np.int32))  # a bias of each word, so that none is empty
    whose.append(np.arange(len(words), dtype=np.int32))
    ids_all, whose_all = np.concatenate(ids), np.concatenate(whose)
    order = np.argsort(whose_all, kind="stable")
    return ids_all[order], np.searchsorted(whose_all[order], np.arange(len(words) + 1))


def grams_in_parts(words: list[str], sizes: tuple[int, ...], buckets: int, part: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """grams() of many words, part by part, which bounds the memory besides the result."""
    ids, counts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for k in range(0, len(words), part):
        own, starts = grams(words[k : k + part], sizes, buckets)
        ids.append(own)
        counts.append(np.diff(starts))
    return np.concatenate(ids), np.cumsum(np.concatenate(counts))


@dataclass
class Bags:
    """Rows as bags of words, words as bags of hashed n-grams: both as flat ids with where each row or word begins."""

    grams: np.ndarray
    word_starts: np.ndarray
    words: np.ndarray
    counts: np.ndarray
    row_starts: np.ndarray


def bags(rows: list[list[str]], sizes: tuple[int, ...], buckets: int) -> Bags:
    """A row without words has one word, the empty one."""
    number: dict[str, int] = {}
    ids, counts, starts = [], [], [0]
    for words in rows:
        found = Counter(words or [""])
        ids += [number.setdefault(w, len(number)) for w in found]
        counts += found.values()
        starts.append(len(ids))
    own, word_starts = grams_in_parts(list(number), sizes, buckets)
    return Bags(own, word_starts, np.array(ids, np.int64), np.array(counts, np.float32), np.array(starts))


def _flat(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all members of the rows, and how many each has."""
    n = starts[rows + 1] - starts[rows]
    return np.repeat(starts[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum())), n


def _summed(where: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(where, values[:, k], n) for k in range(values.shape[1])], 1).astype(np.float32)


def train(bag: Bags, targets: np.ndarray, buckets: int, dim: int = 8, steps: int = 500, epochs: int = 4, batch: int = 256, rate: float = 0.3, scale: float = 1.0, decay: float = 1e-6, seed: int = 7) -> np.ndarray:
    """Averaged subword embeddings and a softmax layer, trained jointly by SGD with per-row step sizes (Adagrad).

    A word is the mean of its n-grams' embeddings, a row the mean of its words; targets are class weights by row (their
    sum is the row's weight). At least `steps` batches and `epochs` passes are made, so small tables are learned too.
    Returns a row of logits for each bucket (embedding times weights, plus the bias), such that the mean over a word's
    n-grams, and then over a row's words, is the row's logits."""
    rng = np.random.default_rng(seed)
    classes, rows_all = targets.shape[1], len(targets)
    used = np.flatnonzero(np.bincount(bag.grams, minlength=buckets))
    place = np.zeros(buckets, np.int32)
    place[used] = np.arange(len(used))
    ids = place[bag.grams]
    embed = (rng.standard_normal((len(used), dim)) * 0.1).astype(np.float32)
    out, bias = (rng.standard_normal((dim, classes)) * 0.1).astype(np.float32), np.zeros(classes, np.float32)
    g_embed, g_out, g_bias = np.full(len(used), 1e-6, np.float32), np.full((dim, classes), 1e-3, np.float32), np.full(classes, 1e-3, np.float32)
    weight = targets.sum(1, keepdims=True)
    done = epoch = 0
    while epoch < epochs or done < steps:
        order = rng.permutation(rows_all)
        epoch += 1
        for at in range(0, rows_all, batch):
            rows = order[at : at + batch]
            done += 1
            flat, n = _flat(bag.row_starts, rows)
            words, own = np.unique(bag.words[flat], return_inverse=True)
            row = np.repeat(np.arange(len(rows)), n)
            share = bag.counts[flat]
            share = share / np.bincount(row, share, len(rows))[row].astype(np.float32)
            members, many = _flat(bag.word_starts, words)
            local, where = np.unique(ids[members], return_inverse=True)
            begin = np.cumsum(many) - many
            word_vectors = np.add.reduceat(embed[local][where], begin, axis=0) / many[:, None].astype(np.float32)
            mean = scale * np.add.reduceat(word_vectors[own] * share[:, None], np.cumsum(n) - n, axis=0)
            logits = mean @ out + bias
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            error = ((weight[rows] * p - targets[rows]) / len(rows)).astype(np.float32)
            d_rows = scale * (error @ out.T)
            d_out = mean.T @ error + decay * out
            d_words = _summed(own, d_rows[row] * share[:, None], len(words)) / many[:, None].astype(np.float32)
            d_embed = _summed(where, np.repeat(d_words, many, axis=0), len(local)) + decay * embed[local]
            g_embed[local] += (d_embed**2).mean(1)
            embed[local] -= rate * d_embed / np.sqrt(g_embed[local])[:, None]
            g_out += d_out**2
            out -= rate * 0.2 * d_out / np.sqrt(g_out)
            g_bias += error.sum(0) ** 2
            bias -= rate * 0.2 * error.sum(0) / np.sqrt(g_bias)
    table = np.tile(bias, (buckets, 1))
    table[used] += scale * (embed @ out)
    return table


class WordLogits(dict):
    """word -> row; logits[row] is the mean of its subwords' logits. Bounded memory."""

    def __init__(self, table: np.ndarray, sizes: tuple[int, ...], most: int = 250_000) -> None:
        self.table, self.orders, self.most = table, sizes, most
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.logits = np.zeros((1024, self.table.shape[1]), np.float32)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.most and len(self):
            self.reset()
            new = list(words)
        for k in range(0, len(new), 20_000):
            own = new[k : k + 20_000]
            ids, starts = grams(own, self.orders, len(self.table))
            at = len(self)
            while at + len(own) > len(self.logits):
                self.logits = np.concatenate([self.logits, np.zeros_like(self.logits)])
            self.logits[at : at + len(own)] = np.add.reduceat(self.table[ids], starts[:-1], axis=0) / np.diff(starts)[:, None]
            self.update(zip(own, range(at, at + len(own)), strict=True))
