"""Toxicity: a support vector machine over a subsequence string kernel, with Nyström landmarks.

Kernel: a word's features are its subsequences of ``LENGTHS`` characters that lie
within ``SPREAD`` more places, each weighing ``DECAY`` to the number of characters
skipped, so that inserted characters and gaps cost likeness and don't end it. Words have marks at
both ends. Features are hashed to 2**BITS and a word's norm is that of a word of its length with
all features distinct; both keep the kernel positive. What a text is judged by are
its units: words between white space, and runs of three single characters or more with the
white space left out ("i d i o t"); units over ``LONGEST`` characters are taken in
overlapping windows.

Nyström: of the training units, pivots of a partial Cholesky factorisation are landmarks,
and a unit's features are its kernel with them times the inverse root of their Gram
matrix. A linear model is fitted to these under hinge loss by dual coordinate descent. As
the kernel's features are explicit, the fitted model is one weight for each of them (landmarks
times coefficients), which scores new units at the same values.

Labels belong to whole documents, whose sentences are mostly harmless: the fit is a
multiple-instance one. Every unit of a clean document is clean; of a toxic document, the unit
that the last model scores highest stands for its toxic sentence (first: the unit whose share among
toxic documents is largest against that among clean ones). Units that clean documents hold as
often don't stand for toxic ones, the highest units of clean documents are added to the clean side
each round, and in the last round variants with characters put in join the toxic units that stand for several documents. After ``ROUNDS`` rounds a
logistic curve, fitted on sampled documents that no round has seen, turns a document's highest
margin into its score.

The fit uses at most ``SAMPLE`` labelled documents of each class, those with the smallest digest of
doc_id; the driver gets ``HARDEST`` units of each a round at most. Everything else reads all rows.

Defined cases: null and empty texts, and those without words, have the margin -1; without
labelled rows of both classes every score is the share of label 1, or 0.5; of several labels
for one doc_id the lowest counts; repeated rows get equal scores; extra columns stay, those named like
an added one as input_NAME; a doc_id of any type is compared with the labels' as text.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, cut, mix64, renames, slices, texts_of, trim
from .quality import logistic

LENGTHS, SPREAD, DECAY = (3, 4), 3, 0.7
BITS, LANDMARKS, LONGEST = 17, 128, 32
SAMPLE, ROUNDS, COMMON, VARIED, TOLD, HARDEST = 4000, 4, 2000, 300, 5, 3
THRESHOLD = 0.5
ADDED = ("score", "predicted", "held_out", "unit")
#: Units whose margins a worker keeps.
CACHE = 400_000
_SPELLED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: (offsets of the characters, weight) of each shape that a subsequence has.
SHAPES = [((0, *inner, last), DECAY ** (last + 1 - n)) for n in LENGTHS for last in range(n - 1, n + SPREAD) for inner in itertools.combinations(range(1, last), n - 2)]


def units(text: str) -> set[str]:
    """The units of a text: words, and spelled-out runs of single characters."""
    words = text.lower().split()
    found = set(words)
    if sum(len(w) == 1 for w in found) >= 3:
        found.update("".join(m[0].split()) for m in _SPELLED.finditer(" ".join(words)))
    return found


def norms(n: np.ndarray) -> np.ndarray:
    """Norms of words of n symbols, marks included."""
    total = sum(w * w * np.maximum(0, n - at[-1]) for at, w in SHAPES)
    return np.sqrt(np.maximum(total, 1e-12))


def pieces(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all words with their marks, in a row; where each window starts and ends; each window's word."""
    marked = [f"\x02{w}\x03" for w in words]
    lens = np.fromiter(map(len, marked), np.int64, len(marked))
    symbols = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    end = np.cumsum(lens)
    start = end - lens
    if (long := np.flatnonzero(lens > LONGEST)).size:
        a, z, of = [start[lens <= LONGEST]], [end[lens <= LONGEST]], [np.flatnonzero(lens <= LONGEST)]
        for k in long.tolist():
            at = np.arange(0, lens[k] - LONGEST // 2, LONGEST // 2)
            a.append(start[k] + at)
            z.append(np.minimum(start[k] + at + LONGEST, end[k]))
            of.append(np.full(len(at), k))
        return symbols, np.column_stack([np.concatenate(a), np.concatenate(z)]), np.concatenate(of)
    return symbols, np.column_stack([start, end]), np.arange(len(words))


def features(symbols: np.ndarray, spans: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(window, feature, weight) of all subsequences of each shape."""
    lens = spans[:, 1] - spans[:, 0]
    window = np.repeat(np.arange(len(spans)), lens)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(lens.sum())
    at = np.repeat(spans[:, 1], lens) - left
    grown = [symbols * _ODD ** np.uint64(k + 1) for k in range(max(LENGTHS))]
    for offsets, weight in SHAPES:
        fits = left > offsets[-1]
        place = at[fits]
        name = np.full(len(place), np.uint64(len(offsets)))
        for k, o in enumerate(offsets):
            name += grown[k][place + o]
        yield window[fits], (mix64(name) >> np.uint64(64 - BITS)).astype(np.int64), weight


class Model(NamedTuple):
    """Weights of the hashed subsequences, offset of the margin, and the logistic curve."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, words: list[str]) -> np.ndarray:
        """The margin of each word: that of its best window."""
        if not words:
            return np.zeros(0)
        symbols, spans, of = pieces(words)
        total = np.zeros(len(spans))
        for window, feature, weight in features(symbols, spans):
            total += weight * np.bincount(window, self.weights[feature], len(spans))
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, of, total / norms(spans[:, 1] - spans[:, 0]) + self.bias)
        return out

    def score(self, margin: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * margin + self.offset))))


def gram(words: list[str], landmarks: np.ndarray) -> np.ndarray:
    """Kernel of words (their first windows) with landmarks, given as rows of feature weights by landmark."""
    out = []
    for a in range(0, len(words), 512):
        some = words[a : a + 512]
        symbols, spans, of = pieces(some)
        first = np.unique(of, return_index=True)[1]
        spans = spans[first]
        total = np.zeros((len(some), landmarks.shape[1]), np.float32)
        for window, feature, weight in features(symbols, spans):
            if len(window):
                start = np.flatnonzero(np.diff(window, prepend=-1))
                total[window[start]] += weight * np.add.reduceat(landmarks[feature], start, axis=0)
        out.append(total / norms(spans[:, 1] - spans[:, 0])[:, None])
    return np.concatenate(out) if out else np.zeros((0, landmarks.shape[1]), np.float32)


def embedded(words: list[str]) -> np.ndarray:
    """Feature weights of words' first windows, a column each, of norm 1 at most."""
    symbols, spans, of = pieces(words)
    spans = spans[np.unique(of, return_index=True)[1]]
    out = np.zeros((1 << BITS, len(words)), np.float32)
    for window, feature, weight in features(symbols, spans):
        np.add.at(out, (feature, window), np.float32(weight))
    return out / norms(spans[:, 1] - spans[:, 0])


def pivots(words: list[str], most: int) -> list[str]:
    """Landmarks: greedy pivots of a partial Cholesky factorisation of the words' Gram matrix, each the word that those before explain least."""
    if not words:
        return []
    k = np.concatenate([gram(words, embedded(words[a : a + 64])) for a in range(0, len(words), 64)], axis=1).astype(np.float64)
    rest, chosen = np.diag(k).copy(), []
    rows = np.zeros((min(most, len(words)), len(words)))
    for i in range(len(rows)):
        best = int(np.argmax(rest))
        if rest[best] < 1e-3:
            break
        rows[i] = (k[best] - rows[:i, best] @ rows[:i]) / math.sqrt(rest[best])
        rest = np.maximum(rest - rows[i] ** 2, 0)
        rest[best] = 0
        chosen.append(best)
    return [words[i] for i in chosen]


def varied(word: str) -> list[str]:
    """The word as it looks with marks between its letters, and with one character put in."""
    half = len(word) // 2
    return [*(mark.join(word) for mark in "-.*_"), *(word[:half] + x + word[half:] for x in (".", "x", word[half - 1 : half]))]


def descend(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Dual coordinate descent for hinge loss, with a cost for each row."""
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    square = (x * x).sum(1) + 1e-12
    rng = np.random.default_rng(11)
    for _ in range(rounds):
        moved = 0.0
        for k in rng.permutation(len(x)):
            new = min(max(alpha[k] - (y[k] * float(w @ x[k]) - 1) / square[k], 0.0), cost[k])
            if step := new - alpha[k]:
                alpha[k] = new
                w += step * y[k] * x[k]
                moved = max(moved, abs(step) / cost[k])
        if moved < 1e-2:
            break
    return w


def fit(toxic: dict[str, float], clean: dict[str, float], vary: bool = False) -> Model:
    """Model of units and how many documents each stands for.

    With ``vary``, toxic units of several documents count as seen in all their variants too, unless
    these are clean. The most frequent units of each side are the candidates for landmarks.
    """
    often = lambda d, n: sorted(d, key=lambda w: (-d[w], w))[:n]
    extra: dict[str, float] = {}
    for u in [u for u in often(toxic, VARIED) if vary and toxic[u] >= TOLD]:
        for v in varied(u):
            if v not in clean and v not in toxic:
                extra[v] = 0.2 * toxic[u]
    toxic = toxic | extra
    words = [*toxic, *clean]
    landmarks = pivots(often(toxic, 800), LANDMARKS * 3 // 4) + pivots(often(clean, 400), LANDMARKS // 4)
    base = embedded(landmarks)
    k = gram(landmarks, base).astype(np.float64)
    value, vector = np.linalg.eigh((k + k.T) / 2)
    root = vector @ np.diag(np.where(value > 1e-4, 1 / np.sqrt(np.maximum(value, 1e-4)), 0)) @ vector.T
    x = np.column_stack([gram(words, base) @ root, np.ones(len(words))])
    y = np.repeat([1.0, -1.0], [len(toxic), len(clean)])
    share = np.sqrt(np.array([*toxic.values(), *clean.values()], float))
    for side in (y > 0, y < 0):
        share[side] *= 10 * len(words) / 2 / share[side].sum()
    w = descend(x, y, share)
    return Model(base @ (root @ w[:-1]).astype(np.float32), float(w[-1]), 1.0, 0.0)


def _constant(n1: int, n0: int) -> Model:
    share = n1 / (n1 + n0) if n1 + n0 else 0.5
    return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, math.log(max(share, 1e-9) / max(1 - share, 1e-9)))


def _best(held: DataFrame, model: Model | dict[str, float]) -> list[tuple]:
    """(toxic, seen, best units, highest margin) of each sampled document: one unit of a toxic one, HARDEST of a clean one."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rows, toxic = batch.column("units").to_pylist(), batch.column("toxic").to_pylist()
            names = list({u for r in rows for u in r})
            margin = {u: m.get(u, -math.inf) for u in names} if isinstance(m, dict) else dict(zip(names, m.margins(names).tolist(), strict=True))
            best = [sorted(r, key=lambda u: (-margin[u], u))[: 1 if t else HARDEST] for r, t in zip(rows, toxic, strict=True)]
            cols = [pa.array(best, pa.list_(pa.string())), pa.array([margin[u[0]] if u else -1.0 for u in best], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("seen"), *cols], names=["toxic", "seen", "units", "margin"])

    found = held.mapInArrow(run, "toxic int, seen boolean, units array<string>, margin double").toArrow()
    return sorted(zip(*(c.to_pylist() for c in found.columns), strict=True))


def _add(counts: dict[str, float], names: list[str]) -> None:
    for u in names:
        counts[u] = counts.get(u, 0) + 1


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` documents of each class, of those whose crc32(doc_id) mod 5 is not 0."""
    known = (
        labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "toxic")
        .where(F.crc32("doc_id") % 5 != 0)
        .groupBy("doc_id").agg((F.min("toxic") > 0).cast("int").alias("toxic"))
    )
    first = lambda c: known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = first(1).unionByName(first(0))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("seen"), pa.array([sorted(units(t)) for t in texts_of(batch)], pa.list_(pa.string()))], names=["toxic", "seen", "units"])

    seen = (F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(5)) != 0).alias("seen")
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("toxic", seen, "text")
    held = cut(rows.mapInArrow(split, "toxic int, seen boolean, units array<string>").withColumn("no", F.monotonically_increasing_id()))
    sizes = {(r.toxic, r.seen): r.n for r in held.groupBy("toxic", "seen").agg(F.count("*").alias("n")).collect()}
    if not sizes.get((1, True)) or not sizes.get((0, True)):
        return _constant(sum(n for (t, _), n in sizes.items() if t), sum(n for (t, _), n in sizes.items() if not t))

    a, b = F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))
    odds = F.log((F.col("a") + 0.5) / F.lit(sizes[1, True] + 1)) - F.log((F.col("b") + 0.5) / F.lit(sizes[0, True] + 1))
    counts = cut(held.where("seen").select("toxic", F.explode("units").alias("unit")).groupBy("unit").agg(a.alias("a"), b.alias("b")).withColumn("odds", odds))
    telling = {r.unit: r.odds for r in counts.where("odds > 1").orderBy(F.desc("odds"), "unit").limit(COMMON).collect()}
    clean = {r.unit: float(r.b) for r in counts.where("b > 0").orderBy(F.desc("b"), "unit").limit(COMMON).collect()}
    # A unit that clean documents hold as often doesn't stand for a toxic one.
    apart = held.where("seen and toxic = 1").select("no", F.explode("units").alias("unit")).join(counts.where("odds > 0").select("unit"), "unit")
    open_ = apart.groupBy("no").agg(F.collect_list("unit").alias("units")).select(F.lit(1).alias("toxic"), F.lit(True).alias("seen"), "units")
    tried = cut(held.where("not seen or toxic = 0").select("toxic", "seen", "units").union(open_))
    toxic: dict[str, float] = {}
    for r in _best(tried, telling):
        if r[0] and r[1] and r[3] > 0:
            _add(toxic, r[2])
    if not toxic:
        return _constant(sizes[1, True], sizes[0, True])
    for k in range(ROUNDS):
        model = fit({u: n for u, n in toxic.items() if u not in clean} or toxic, clean, k == ROUNDS - 1)
        best, toxic = _best(tried, model), {}
        for label, own, found, _ in best:
            if own:
                _add(toxic if label else clean, found)
    unseen = [r for r in best if not r[1]]
    unseen = unseen if len({r[0] for r in unseen}) == 2 else best
    del clean, toxic, counts
    trim()
    slope, offset = logistic(np.array([r[3] for r in unseen]), np.array([r[0] for r in unseen], float))
    return model._replace(slope=slope, offset=offset)


class Scorer:
    """Best units of texts; margins of units met before are kept, CACHE of them at most."""

    def __init__(self, model: Model) -> None:
        self.model, self.cache = model, {}

    def best(self, texts: list[str]) -> list[tuple[float, str | None]]:
        sets = [units(t) for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        fresh = set().union(*sets) - self.cache.keys()
        names = list(fresh)
        for a in range(0, len(names), 1 << 14):
            some = names[a : a + (1 << 14)]
            self.cache.update(zip(some, self.model.margins(some).tolist(), strict=True))
        known, out = self.cache.__getitem__, []
        for s in sets:
            top = max(map(known, s), default=-1.0)
            out.append((top, min(u for u in s if known(u) == top) if s and self.model.score(top) >= THRESHOLD else None))
        return out


def classify(docs: DataFrame, model: Model, text: str = "text", drop_text: bool = True) -> DataFrame:
    """Adds held_out, score, predicted and unit (the unit that decides, where predicted is 1) to all documents."""
    added = T._parse_datatype_string("score double, predicted int, unit string")
    clash = renames(docs.columns, ADDED)
    docs, text = apart(docs, ADDED), clash.get(text, text)
    kept = [c for c in docs.columns if not (drop_text and c == text)]
    schema = T.StructType([*[docs.schema[c] for c in kept], *added])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches, text, 4 << 20):
            found = scorer.best(texts_of(batch, text))
            scores = [shared.value.score(m) for m, _ in found]
            cols = [pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array([u for _, u in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *cols], names=[*kept, "score", "predicted", "unit"])

    names = list(dict.fromkeys([*kept, text]))
    out = docs.select(*names).mapInArrow(run, schema)
    return out.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)))
