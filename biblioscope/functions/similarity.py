"""String similarity that Spark lacks."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Letters are counted in so many bins, and so many pairs are bounded at a time.
BINS, TOGETHER = 64, 1 << 15


def jaro(a: str, b: str) -> float:
    """Each letter of a takes the first free equal one of b within reach, found through queues of b's places by letter."""
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    places: dict[str, deque[int]] = {}
    for j, c in enumerate(b):
        places.setdefault(c, deque()).append(j)
    mine, theirs = [], []
    for i, c in enumerate(a):
        own = places.get(c)
        while own and own[0] < i - reach:  # the reach only moves on
            own.popleft()
        if own and own[0] <= i + reach:
            mine.append(c)
            theirs.append(own.popleft())
    matches = len(mine)
    if not matches:
        return 0.0
    swaps = sum(c != b[j] for c, j in zip(mine, sorted(theirs), strict=True)) // 2
    return (matches / len(a) + matches / len(b) + (matches - swaps) / matches) / 3


def jaro_winkler_of(a: str | None, b: str | None) -> float:
    """Winkler's prefix bonus (0.1 for each of up to four letters) above a Jaro similarity of 0.7; 0 for missing text."""
    if not a or not b:
        return 0.0
    score = jaro(a, b)
    if score <= 0.7:
        return score
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return score + 0.1 * prefix * (1 - score)


def highest(a: pd.Series, b: pd.Series) -> np.ndarray:
    """What the similarity of each pair can be at most: no more letters match than both have, and up to four are a common prefix."""
    codes, texts = pd.factorize(pd.concat([a, b], ignore_index=True).fillna(""))
    counts = np.zeros((len(texts), BINS), np.int32)
    for k, t in enumerate(texts):
        counts[k] = np.bincount(np.frombuffer(t.encode("utf-32-le"), "<u4") % BINS, minlength=BINS)
    sizes = counts.sum(1)
    heads = np.array([[ord(c) for c in t[:4].ljust(4, "\0")] for t in texts], np.int64).reshape(len(texts), 4)
    one, two = codes[: len(a)], codes[len(a) :]
    common = np.concatenate([np.zeros(0, np.int64), *(np.minimum(counts[one[k : k + TOGETHER]], counts[two[k : k + TOGETHER]]).sum(1) for k in range(0, len(a), TOGETHER))])
    prefix = np.cumprod((heads[one] == heads[two]) & (heads[one] > 0), axis=1).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(common > 0, (common / sizes[one] + common / sizes[two] + 1) / 3, 0.0)
    return np.where(score > 0.7, score + 0.1 * prefix * (1 - score), score)


def jaro_winkler_from(threshold: float, a: Column, b: Column) -> Column:
    """The similarity of pairs that reach the threshold, else null. Most pairs are told by their bound, in numpy."""

    @F.pandas_udf(DoubleType())
    def similarity(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.full(len(x), np.nan)
        for k in np.flatnonzero(highest(x, y) >= threshold - 1e-9):
            score = jaro_winkler_of(x.iloc[k], y.iloc[k])
            if score >= threshold:
                out[k] = score
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    return similarity(a, b)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


#: Letters with a bin of their own, those told apart by place, occurrences of each of these whose places are kept, first letters
#: compared, and cells of a table at a time.
OWN, LETTERS, RANKS, FIRST, CELLS = 192, 48, 32, (64, 192), 1 << 18
#: The place of a letter that does not occur, and the length from which places are not looked at.
NOWHERE, LONG = 32767, 60_000


def least_jaro(threshold: float) -> float:
    """The Jaro similarity below which no prefix bonus leads to the threshold."""
    return min(threshold, max(0.7, (threshold - 0.4) / 0.6))


class Titles:
    """Tables of texts, for bounds of the similarity of many pairs. Texts are given by length, shortest first."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        n = len(texts)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        letters = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        row = np.repeat(np.arange(n, dtype=np.int32), self.sizes)
        often = np.bincount(letters)
        known = np.argsort(-often, kind="stable")[: np.count_nonzero(often)]  # the most frequent letters come first
        # rare letters share bins, which only raises the bound
        bins = np.zeros(len(often), np.uint8)
        bins[known] = np.where(np.arange(len(known)) < OWN, np.arange(len(known)), OWN + np.arange(len(known)) % 16)
        code = self.letters = bins[letters]
        begin = self.begin = np.cumsum(self.sizes) - self.sizes
        most = FIRST[-1]
        self.counts = np.zeros((OWN + 16, n), np.uint16 if self.sizes.max(initial=0) < 1 << 16 else np.uint32)
        self.places = np.full((LETTERS * RANKS, n), NOWHERE, np.int16)
        self.code, self.slot = np.zeros((most, n), np.uint8), np.zeros((most, n), np.int16)
        self.clear = np.where(self.sizes < LONG, np.minimum(self.sizes, most), 0)  # first letters that are all told apart
        self.later = np.full((most, n), most, np.int16)  # the next place of the same letter
        self.last = {first: np.full((LETTERS, n), -1, np.int16) for first in FIRST}  # the last place of a letter among the first ones
        places = []
        for c in range(OWN + 16):
            where = np.flatnonzero(code == c)
            if not len(where):
                continue
            text = row[where]
            many = np.bincount(text, minlength=n)
            self.counts[c] = many
            at = where - begin[text]
            places.append(at.astype(np.int32))
            rank = np.arange(len(where)) - (np.cumsum(many) - many)[text]
            told = (rank < RANKS) & (c < LETTERS)
            self.places[c * RANKS + rank[told], text[told]] = np.minimum(at[told], NOWHERE)
            near = (at < most) & told
            self.code[at[near], text[near]] = c
            self.slot[at[near], text[near]] = c * RANKS + rank[near]
            if c < LETTERS:
                pair = np.flatnonzero((text[1:] == text[:-1]) & (at[1:] < most))
                self.later[at[pair], text[pair]] = at[pair + 1]
                for first, last in self.last.items():
                    last[c, text[at < first]] = at[at < first]  # places rise, so the last one stays
            np.minimum.at(self.clear, text[~told], at[~told])
        self.at = np.concatenate([np.zeros(0, np.int32), *places])  # places by letter, then text
        self.start = (np.cumsum(self.counts, dtype=np.int64) - self.counts.ravel()).reshape(self.counts.shape)
        numbers: dict[str, int] = {}
        self.heads = np.array([[numbers.setdefault(t[:k], len(numbers)) if len(t) >= k else -1 - i for i, t in enumerate(texts)] for k in range(1, 5)], np.int64).reshape(4, n)

    def common(self, rows: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Letters that each of the rows has in common with each text from lo on and before hi, as a bag."""
        out = np.zeros((len(rows), hi - lo), self.counts.dtype)
        for b in np.flatnonzero(self.counts[:, rows].any(1)):
            out += np.minimum(self.counts[b, rows][:, None], self.counts[b, lo:hi][None, :])
        return out

    def moved(self, i: np.ndarray, j: np.ndarray, first: int) -> np.ndarray:
        """Letters at least that stand at different places among the matched ones, of each pair (no j is longer than its i). Only
        the first letters of both are looked at, as far as their match is certain: within the reach from the start, the k-th of
        a letter can only meet the other text's k-th, until one of them is out of reach."""
        reach = (self.sizes[i] // 2 - 1).astype(np.int32)
        most = min(first, int(reach.max(initial=-1)) + 1)
        if most <= 0:
            return np.zeros(len(i), np.int64)
        col = np.arange(len(i))
        step = np.arange(most, dtype=np.int16)[:, None]
        end = np.minimum(most, reach + 1)

        def kept(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            place = self.places[self.slot[:most, own], other[None, :]]
            sure = step < np.minimum(self.clear[own], end)[None, :].astype(np.int16)
            meets = place <= step + np.minimum(reach, NOWHERE - 2 * most)[None, :].astype(np.int16)
            last = self.last[first][self.slot[:most, own] // RANKS, own[None, :]]
            doubt = sure & ~meets & (place <= last + reach[None, :])  # a later one of the same letter may yet meet it
            some = np.flatnonzero(doubt.any(0))
            if len(some):
                sure[:, some] &= step < np.where(doubt[:, some], self.later[:most, own[some]], most).min(0)[None, :]
            meets &= sure
            upto = np.cumsum(meets, axis=0, dtype=np.int16)
            out = np.zeros((most + 1, len(col)), np.uint8)
            out[np.where(meets, upto - 1, most), col[None, :]] = self.code[:most, own]
            return out[:most], upto[-1]

        (a, n), (b, m) = kept(i, j), kept(j, i)
        return ((a != b) & (step < np.minimum(n, m)[None, :])).sum(0)

    def near(self, i: np.ndarray, j: np.ndarray, common: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of the pairs (no j is longer than its i) whose similarity reaches the threshold, with it."""
        prefix = sum((self.heads[k, i] == self.heads[k, j]).astype(np.int8) for k in range(4))
        match = common / self.sizes[i] + common / self.sizes[j] + 1
        turned = np.zeros(len(i), np.int64)
        for first in (0, *FIRST):
            if first:
                step = max(1, CELLS // first)
                turned = np.concatenate([np.zeros(0, np.int64), *(self.moved(i[k : k + step], j[k : k + step], first) for k in range(0, len(i), step))]) // 2
            score = np.where(common > 0, (match - turned / np.maximum(common, 1)) / 3, 0.0)
            some = np.where(score > 0.7, score + 0.1 * prefix * (1 - score), score) >= threshold - 1e-9
            i, j, prefix, common, match, turned = (x[some] for x in (i, j, prefix, common, match, turned))
        step = max(1, 4 * CELLS // max(1, int(self.sizes[i].max(initial=1))))
        score = np.concatenate([np.zeros(0), *(self.jaro(i[k : k + step], j[k : k + step]) for k in range(0, len(i), step))])
        score = np.where(score > 0.7, score + 0.1 * prefix * (1 - score), score)
        some = score >= threshold
        return i[some], j[some], score[some]

    def jaro(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The Jaro similarity of each pair, as jaro() gives it. As long as no letter's k-th places are out of reach of each other,
        they are what matches; only letters for which some are go through their places one by one."""
        out = np.zeros(len(i))
        plain = self.counts[OWN:, i].any(0) & self.counts[OWN:, j].any(0) | (self.sizes[i] < 4)
        for p in np.flatnonzero(plain).tolist():
            out[p] = jaro(self.texts[i[p]], self.texts[j[p]])
        rest = np.flatnonzero(~plain)
        i, j = i[rest], j[rest]
        reach = np.maximum(self.sizes[i], self.sizes[j]) // 2 - 1
        few = np.minimum(self.counts[:OWN, i], self.counts[:OWN, j])
        letter, pair = np.nonzero(few)
        many = few[letter, pair].astype(np.int64)
        group = np.repeat(np.arange(len(many)), many)
        within = np.arange(len(group)) - np.repeat(np.cumsum(many) - many, many)
        a = self.at[self.start[letter, i[pair]][group] + within].astype(np.int64)
        b = self.at[self.start[letter, j[pair]][group] + within].astype(np.int64)
        far = np.zeros(len(many), bool)
        far[group[np.abs(a - b) > reach[pair[group]]]] = True
        mine, theirs = self.sizes[i], self.sizes[j]
        mine, theirs = np.cumsum(mine) - mine, np.cumsum(theirs) - theirs
        some = ~far[group]
        own = pair[group[some]]
        left, right = [mine[own] + a[some]], [theirs[own] + b[some]]
        for g in np.flatnonzero(far).tolist():
            c, p = int(letter[g]), int(pair[g])
            x, y = (self.at[self.start[c, k] : self.start[c, k] + int(self.counts[c, k])].tolist() for k in (i[p], j[p]))
            k, most, met = 0, int(reach[p]), []
            for place in x:
                while k < len(y) and y[k] < place - most:
                    k += 1
                if k < len(y) and y[k] <= place + most:
                    met.append((place, y[k]))
                    k += 1
            if met:
                met = np.array(met, np.int64)
                left.append(mine[p] + met[:, 0])
                right.append(theirs[p] + met[:, 1])

        def matched(places: list[np.ndarray], base: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            marks = np.zeros(int(self.sizes[text].sum()), bool)
            for x in places:
                marks[x] = True
            found = np.flatnonzero(marks)
            of = np.searchsorted(base, found, side="right") - 1
            return of, self.letters[self.begin[text[of]] + found - base[of]]

        (of, one), (_, other) = matched(left, mine, i), matched(right, theirs, j)
        m = np.bincount(of, minlength=len(i))
        swaps = np.bincount(of[one != other], minlength=len(i)) // 2
        with np.errstate(divide="ignore", invalid="ignore"):
            out[rest] = np.where(m > 0, (m / self.sizes[i] + m / self.sizes[j] + (m - swaps) / m) / 3, 0.0)
        return out
