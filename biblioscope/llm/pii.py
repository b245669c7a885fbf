"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes that adds spans.

The field is decoded over whole texts. Most tokens can't have another label than none, whatever labels stand around them;
chains are cut at those, which leaves the best path as it is, and what remains is decoded by Viterbi in batches."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remembered, small_batches, table
from .pii_examples import SENTENCES, TIMES

BASE_KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", "email", "ip", "card", "phone", "secret", "ssn")
#: Kinds in the order in which spans are listed.
KINDS = (*BASE_KINDS, "secret", "ssn")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT_OR_AT = re.compile("[0-9@]")  # without these there is no base span
#: Tokens: runs without white space, cut around the marks that join names and values.
_TOKEN = re.compile(r'[^\s=:;,{}"]+|[=:;,{}"]+')


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind, by kind and start; matches that fail their check are dropped."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        after, m = at + 1, _DOMAIN.match(text, at + 1)
        if m:
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append(("email", start, m.end()))
                after = last = m.end()
        at = text.find("@", after)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


CUES = frozenset("token key secret password passwd pwd api_key apikey api phone call tel mobile fax card visa ssn social ip host address mail email contact login".split())
_EDGES = "'.()[]!?*#$%&<>"


def _class(c: str) -> str:
    return "d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c


def _bucket(n: int) -> int:
    return n if n < 5 else 3 + n.bit_length()


def word_features(token: str) -> tuple[str, ...]:
    """Shape, size and cue-word features of one token, all of it."""
    bare = token.strip(_EDGES)
    size = f"size={min(len(bare).bit_length(), 8)}"
    low = bare.lower()
    cue = (f"cue={low}",) if low in CUES else ()
    if bare.isalpha():
        case = "x" if bare.islower() else "X" if bare.isupper() else "Xx" if bare[1:].islower() else "mixed"
        return ("letters", f"shape={case}", size, *cue)
    runs = [(k, sum(1 for _ in own)) for k, own in itertools.groupby(map(_class, bare))]
    kinds = "".join(sorted({k for k, _ in runs if k in "dxX"}))
    if len(runs) <= 8:
        shape = "".join(f"{k}{min(n, 5)}" if k == "d" else k for k, n in runs)
    else:
        shape = "long-" + "".join(sorted({k for k, _ in runs}))
    digits = sum(n for k, n in runs if k == "d")
    out = [f"shape={shape}", size, f"kinds={kinds}", f"digits={_bucket(digits)}", f"runs={_bucket(len(runs))}"]
    if not kinds:
        out.append(f"mark={bare or token}")
    return (*out, f"first={runs[0][0]}" if runs else "first=", f"last={runs[-1][0]}" if runs else "last=", *cue)


@dataclass
class Field:
    """Weights of the chain: features by (which neighbour, feature) -> labels, and label transitions."""

    features: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray


def labelled_table(seed: int = 11) -> list[list[tuple[str, str]]]:
    """The training sentences as (token, label) pairs; the digits of their values, and the letters of secrets, are drawn anew."""
    rng = np.random.default_rng(seed)
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def drawn(value: str, kind: str) -> str:
        letters = {c for c in value.lower() if c.isalpha()}
        small = "abcdef" if letters <= set("abcdef") and any(c.isdigit() for c in value) else lower
        out = []
        for c in value:
            if c.isdigit() and kind != "ip":
                c = str(rng.integers(0, 10))
            elif kind == "secret" and c.isalpha():
                c = str(rng.choice(list(upper if c.isupper() else small)))
                if small == "abcdef" and rng.random() < 0.3:
                    c = str(rng.integers(0, 10))
            elif kind == "secret" and c.isdigit() and small == "abcdef" and rng.random() < 0.3:
                c = str(rng.choice(list(small)))
            out.append(c)
        return "".join(out)

    table_ = []
    for n in range(TIMES):
        for line in SENTENCES.strip().splitlines():
            own: list[tuple[str, str]] = []
            at = 0
            for m in re.finditer(r"\[(\w+) (.+?)\](?![^\[]*\]\S)", line):
                own += [(t, "none") for t in _TOKEN.findall(line[at : m.start()])]
                own += [(t, m[1]) for t in _TOKEN.findall(drawn(m[2], m[1]) if n else m[2])]
                at = m.end()
            own += [(t, "none") for t in _TOKEN.findall(line[at:])]
            table_.append(own)
    return table_


def is_mark(token: str) -> bool:
    """Whether the token joins a name to its value."""
    return token[0] in '=:;,{}"'


def _cue_of(features: tuple[str, ...]) -> list[str]:
    """What a cue word tells of the token behind the marks that follow it."""
    return [f"<<{f}" for f in features if f.startswith("cue=")] + ["<<cue"] * any(f.startswith("cue=") for f in features)


def _chain_features(tokens: list[str]) -> list[list[str]]:
    """A token's own features, those of its neighbours, and a cue word before the one or two marks in front of it."""
    own = [word_features(t) for t in tokens]
    out = []
    for i in range(len(own)):
        found = [*own[i], *(f"<{f}" for f in (own[i - 1] if i else ["edge"])), *(f">{f}" for f in (own[i + 1] if i + 1 < len(own) else ["edge"]))]
        if i > 1 and is_mark(tokens[i - 1]):
            j = i - 2 if not is_mark(tokens[i - 2]) else i - 3
            found += _cue_of(own[j]) if j >= 0 else []
        out.append(found)
    return out


def fit(sentences: list[list[tuple[str, str]]], steps: int = 200, decay: float = 3e-4) -> Field:
    """Maximum likelihood by forward-backward over padded batches, Adam steps."""
    chains = [_chain_features([t for t, _ in s]) for s in sentences]
    names = sorted({f for c in chains for own in c for f in own})
    number = {f: i for i, f in enumerate(names)}
    n, most, k = len(chains), max(map(len, chains)), len(LABELS)
    rows = np.array([(i, t, number[f]) for i, c in enumerate(chains) for t, own in enumerate(c) for f in own])
    mask = np.zeros((n, most), bool)
    gold = np.zeros((n, most), np.int64)
    for i, s in enumerate(sentences):
        mask[i, : len(s)] = True
        gold[i, : len(s)] = [LABELS.index(y) for _, y in s]
    cell = rows[:, 0] * most + rows[:, 1]
    params = [np.zeros((len(names), k)), np.zeros((k, k)), np.zeros(k)]
    first_m, second_m = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    one = np.eye(k)
    log_sum = lambda x, axis: (m := x.max(axis, keepdims=True), np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis)))[1]
    for step in range(1, steps + 1):
        weights, moves, begin = params
        scores = np.stack([np.bincount(cell, weights[rows[:, 2], y], n * most) for y in range(k)], 1).reshape(n, most, k)
        forward = np.zeros((n, most, k))
        forward[:, 0] = scores[:, 0] + begin
        for t in range(1, most):
            forward[:, t] = np.where(mask[:, t, None], log_sum(forward[:, t - 1, :, None] + moves, 1) + scores[:, t], forward[:, t - 1])
        total = log_sum(forward[:, -1], 1)
        backward = np.zeros((n, most, k))
        expected_moves = np.zeros((k, k))
        for t in range(most - 1, 0, -1):
            tail = scores[:, t] + backward[:, t]
            backward[:, t - 1] = np.where(mask[:, t, None], log_sum(moves + tail[:, None, :], 2), 0)
            pair = np.exp(forward[:, t - 1, :, None] + moves + tail[:, None, :] - total[:, None, None])
            expected_moves += (pair * mask[:, t, None, None]).sum(0)
        p = np.exp(forward + backward - total[:, None, None]) * mask[..., None]
        wanted = one[gold] * mask[..., None]
        error = (wanted - p).reshape(-1, k)
        seen_moves = np.einsum("nta,ntb->ab", wanted[:, :-1] * mask[:, 1:, None], wanted[:, 1:])
        grads = [np.stack([np.bincount(rows[:, 2], error[cell, y], len(names)) for y in range(k)], 1), seen_moves - expected_moves, (wanted[:, 0] - p[:, 0]).sum(0)]
        for j, g in enumerate(grads):
            g = g / n - decay * params[j]
            first_m[j] = 0.9 * first_m[j] + 0.1 * g
            second_m[j] = 0.99 * second_m[j] + 0.01 * g * g
            params[j] = params[j] + 0.1 * (first_m[j] / (1 - 0.9**step)) / (np.sqrt(second_m[j] / (1 - 0.99**step)) + 1e-8)
    return Field(number, *params)


class Tagger:
    """Decodes texts; a token's scores are remembered, tokens of equal features share theirs. Bounded memory."""

    def __init__(self, field: Field, most: int = 250_000) -> None:
        self.field, self.most = field, most
        self.edges = [self._sum(["<edge"]), self._sum([">edge"])]
        moves, first = field.moves, field.first
        # the most that a label other than none can gain by the moves into and out of it, whatever stands around
        into = np.concatenate([moves - moves[:, :1], (first - first[0])[None, :]]).max(0)
        out = np.concatenate([moves - moves[:1, :], np.zeros((len(LABELS), 1))], 1).max(1)
        self.gain = float((into + out)[1:].max())
        self.reset()

    def reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.classes: dict[tuple, int] = {}
        self.scores = np.zeros((1024, 4, len(LABELS)))  # as itself, as the one before, as the one after, as the cue before marks
        self.marks = np.zeros(1024, bool)

    def _sum(self, names) -> np.ndarray:
        own = [self.field.features[f] for f in names if f in self.field.features]
        return self.field.weights[own].sum(0)

    def learn(self, tokens: set[str]) -> None:
        new = [t for t in tokens if t not in self.rows]
        if len(self.rows) + len(new) > self.most and self.rows:
            self.reset()
            new = list(tokens)
        for token in new:
            own, mark = word_features(token), is_mark(token)
            row = self.classes.get((own, mark))
            if row is None:
                row = self.classes[own, mark] = len(self.classes)
                if row == len(self.scores):
                    self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                    self.marks = np.concatenate([self.marks, np.zeros_like(self.marks)])
                self.scores[row] = [self._sum(own), self._sum([f"<{f}" for f in own]), self._sum([f">{f}" for f in own]), self._sum(_cue_of(own))]
                self.marks[row] = mark
            self.rows[token] = row

    def emissions(self, chains: list[list[str]]) -> np.ndarray:
        """Scores by token and label of all chains, one after the other."""
        self.learn(set().union(*chains))
        n = np.array([len(c) for c in chains])
        rows = np.fromiter(map(self.rows.__getitem__, itertools.chain.from_iterable(chains)), np.int64, int(n.sum()))
        out = self.scores[rows, 0]
        ends = np.cumsum(n)
        starts = (ends - n)[n > 0]
        ends = ends[n > 0]
        inner = np.ones(len(rows), bool)
        inner[starts] = False
        out[inner] += self.scores[rows[np.flatnonzero(inner) - 1], 1]
        out[starts] += self.edges[0]
        place = np.arange(len(rows)) - np.repeat(starts, ends - starts)
        behind = np.flatnonzero(self.marks[rows][:-1] & inner[1:]) + 1  # tokens after a mark
        behind = behind[place[behind] > 1]
        cue = behind - 2 - self.marks[rows[behind - 2]]
        there = place[behind] >= behind - cue
        out[behind[there]] += self.scores[rows[cue[there]], 3]
        inner = np.ones(len(rows), bool)
        inner[ends - 1] = False
        out[inner] += self.scores[rows[np.flatnonzero(inner) + 1], 2]
        out[ends - 1] += self.edges[1]
        return out

    def decode(self, chains: list[list[str]]) -> dict[tuple[int, int], np.ndarray]:
        """Best labels: for each (chain, first token) of a stretch between tokens that are none for sure, its labels."""
        if not any(chains):
            return {}
        scores = self.emissions(chains)
        n = np.array([len(c) for c in chains])
        owner = np.repeat(np.arange(len(chains)), n)
        begin = np.cumsum(n) - n
        open_ = np.flatnonzero(scores[:, 0] - scores[:, 1:].max(1) <= self.gain)
        if not len(open_):
            return {}
        cut = np.flatnonzero((np.diff(open_) > 1) | (np.diff(owner[open_]) > 0)) + 1
        firsts, lasts = open_[np.concatenate([[0], cut])], open_[np.concatenate([cut, [len(open_)]]) - 1] + 1
        out: dict[tuple[int, int], np.ndarray] = {}
        sizes = lasts - firsts
        for size in np.unique(sizes).tolist():
            some = np.flatnonzero(sizes == size)
            for at in range(0, len(some), max(1, 65_536 // size)):
                first = firsts[some[at : at + max(1, 65_536 // size)]]
                own = scores[first[:, None] + np.arange(size)]
                whose = owner[first]
                opens = first == begin[whose]
                closes = first + size == begin[whose] + n[whose]
                path = self.viterbi(own, opens, closes)
                labelled = np.flatnonzero(path.any(1))
                out.update(((int(whose[k]), int(first[k] - begin[whose[k]])), path[k]) for k in labelled.tolist())
        return out

    def viterbi(self, scores: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """Best paths of stretches of one size; where a stretch doesn't open (close) its text, a token labelled none is before (after) it."""
        moves, many, size = self.field.moves, len(scores), scores.shape[1]
        best = scores[:, 0] + np.where(opens[:, None], self.field.first, moves[0])
        back = np.zeros((many, size, len(LABELS)), np.int8)
        for t in range(1, size):
            step = best[:, :, None] + moves
            back[:, t] = step.argmax(1)
            best = step.max(1) + scores[:, t]
        best = best + np.where(closes[:, None], 0, moves[:, 0])
        path = np.zeros((many, size), np.int8)
        path[:, -1] = best.argmax(1)
        for t in range(size - 1, 0, -1):
            path[:, t - 1] = back[np.arange(many), t, path[:, t]]
        return path


_TRIM = "\"'.,;:()[]{}<>=!?#*$%&|"


def added_spans(text: str, paths: dict[int, np.ndarray], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Runs of one label as spans, without punctuation at their edges and without those that touch a base span; paths are
    labels by the number of their first token."""
    out = []
    taken = sorted((s, e) for _, s, e in base)
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    for first, path in sorted(paths.items()):
        i = 0
        while i < len(path):
            j = i
            while j < len(path) and path[j] == path[i]:
                j += 1
            if path[i]:
                start, end = tokens[first + i][0], tokens[first + j - 1][1]
                while start < end and text[start] in _TRIM and not (text[start] == "(" and LABELS[path[i]] == "phone"):
                    start += 1
                while end > start and text[end - 1] in _TRIM:
                    end -= 1
                if start < end and not any(s < end and start < e for s, e in taken):
                    out.append((LABELS[path[i]], start, end))
            i = j
    return out


#: Characters of texts that are decoded together.
TOGETHER = 1 << 20


def find(texts: list[str], tagger: Tagger) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """For each text its base spans and the spans that the field adds."""
    out, at = [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= TOGETHER):
            size += len(texts[end])
            end += 1
        own = texts[at:end]
        paths: dict[int, dict[int, np.ndarray]] = {}
        for (i, first), path in tagger.decode([_TOKEN.findall(t) for t in own]).items():
            paths.setdefault(i, {})[first] = path
        for i, text in enumerate(own):
            base = base_spans(text) if _DIGIT_OR_AT.search(text) else []
            out.append((base, added_spans(text, paths[i], base) if i in paths else []))
        at = end
    return out


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def _tagger(field: Field) -> Tagger:
    return remembered(("tagger", hash(field.weights.tobytes())), lambda: Tagger(field))


def _scan(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger, nothing = _tagger(field), hashlib.sha256(b"").hexdigest()
        for batch in batches:
            n = batch.num_rows
            counts, shas, spans = np.zeros((4, n), np.int64), [nothing] * n, [""] * n
            found = find([t or "" for t in batch.column(1).to_pylist()], tagger)
            for i, (base, more) in enumerate(found):
                for kind, _, _ in base:
                    counts[BASE_KINDS.index(kind), i] += 1
                if base:
                    shas[i] = hashlib.sha256(listed(base).encode()).hexdigest()
                if base or more:
                    spans[i] = listed(base + more)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(shas), pa.array(spans, pa.string())], [x.split()[0] for x in SCHEMA.split(", ")])

    return run


def scan(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the counts of base spans, the digest of their list, and the list of all spans.

    Offsets are code points of the whole text, ends exclusive. Null and empty texts have no spans; repeated rows give a
    row each; an empty table gives none; other columns are ignored. Added spans never touch base spans."""
    field = field or fit(labelled_table())
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan(field), SCHEMA)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span's characters replaced by its kind; overlapping spans go as one, by the first's kind."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, field: Field | None = None, text_col: str = "text") -> DataFrame:
    """docs with all its columns, the spans of its texts replaced by [KIND]; null texts stay null."""
    field = field or fit(labelled_table())
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(field)
        for batch in batches:
            column = batch.column(place)
            texts = [t or "" for t in column.to_pylist()]
            new = {i: redacted(texts[i], base + more) for i, (base, more) in enumerate(find(texts, tagger)) if base or more}
            if new:
                mask = np.zeros(batch.num_rows, bool)
                mask[list(new)] = True
                column = pc.replace_with_mask(column, pa.array(mask), pa.array(list(new.values()), column.type))
            yield pa.RecordBatch.from_arrays([column if k == place else batch.column(k) for k in range(batch.num_columns)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all documents."""
    small_batches(spark)
    return scan(table(spark, sf_dir, "documents"))
