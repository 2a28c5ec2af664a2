"""Quality classifier: naive Bayes support vectors on n-gram indicators.

The indicators are hashed n-grams of the whole text: of lower-cased characters (1 to
4), of lower-cased words (1 to 2), and of shape classes (1 to 4; letters by case,
digits, white space, each ASCII mark its own), plus indicators for how much of a text
repeats its own lines and words. Indicators are scaled by the log ratio of their class frequencies and by
the text's norm, and a linear model is fitted to them under hinge loss by dual
coordinate descent. A logistic curve, fitted on training rows that the model did
not see, turns margins into scores.

The fit uses at most ``SAMPLE`` labelled rows, those with the smallest digest of
doc_id; that bound is what the driver holds (at most 2**16 features of two bytes a row).
Everything else reads all rows.

Defined cases: null and empty texts are scored like any other, by the few
indicators they have; without labelled rows of both classes every score is the
share of label 1, or 0.5; of several labels for one doc_id the lowest counts;
repeated rows get equal scores; extra columns stay, those named like an added one as
input_NAME; a doc_id of any type is compared with the labels' as text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, mix64, renames, slices, texts_of, trim, word_names

#: Longest n-grams of shapes, characters and words, and bits of their hashes.
SHAPES, CHARS, WORDS = 4, 4, 2
SHAPE_BITS, CHAR_BITS, WORD_BITS = 14, 14, 14
KINDS = ("shapes", "chars", "words")
SAMPLE = 8000
THRESHOLD = 0.3
ADDED = ("score", "predicted", "held_out")
_EXTRA = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _classes() -> np.ndarray:
    """Shape class of each code point below 0x3000; letters beyond count as lower case."""
    table = np.full(0x3000, 1, np.uint32)
    for i in range(0x3000):
        c = chr(i)
        if c.isupper():
            table[i] = 2
        elif c.isdigit():
            table[i] = 3
        elif c == "\n":
            table[i] = 4
        elif c.isspace():
            table[i] = 5
        elif i < 128 and not c.isalpha():
            table[i] = 6 + i
        elif not c.isalpha():
            table[i] = 140
    return table


def _bucket(names: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(names) >> np.uint64(64 - bits)).astype(np.int64)


class Features:
    """Indicator features of texts, as one flag array that is used again for each text.

    ``kinds`` says which n-grams count: of shapes, of lower-cased characters, of
    lower-cased words between white space. The others' flags stay unset.
    """

    #: Below 2**16, so that an index takes two bytes.
    size = (1 << SHAPE_BITS) + (1 << CHAR_BITS) + (1 << WORD_BITS) + _EXTRA

    def __init__(self, kinds: tuple[str, ...] = KINDS) -> None:
        self.kinds = kinds
        self.table = _classes()
        self.mixed = mix64(np.arange(1, 0x3001).astype(np.uint64))
        self.flags = np.zeros(self.size, bool)

    def grams(self, x: np.ndarray, longest: int, base: int, bits: int) -> None:
        """Set the flags of the n-grams of a row of symbols, n up to longest."""
        h = np.zeros(len(x) + 1, np.uint64)
        for n in range(1, min(longest, len(x)) + 1):
            h = h[: len(x) - n + 1] * _ODD + x[n - 1 :] + np.uint64(n)
            self.flags[base + _bucket(h, bits)] = True

    def of(self, text: str) -> np.ndarray:
        flags = self.flags
        flags[:] = False
        base = 0
        if "shapes" in self.kinds:
            points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
            self.grams(self.table[np.minimum(points, 0x2FFF)].astype(np.uint64), SHAPES, base, SHAPE_BITS)
        base += 1 << SHAPE_BITS
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        if "chars" in self.kinds:
            self.grams(points.astype(np.uint64), CHARS, base, CHAR_BITS)
        base += 1 << CHAR_BITS
        if "words" in self.kinds:
            inside = (self.table[np.minimum(points, 0x2FFF)] & ~np.uint32(1)) != 4
            edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
            start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            mixed = self.mixed[points] if points.max(initial=0) < len(self.mixed) else mix64(points.astype(np.uint64) + np.uint64(1))
            self.grams(word_names(mixed, start, end), WORDS, base, WORD_BITS)
        base += 1 << WORD_BITS
        lines = [s for s in text.split("\n") if s]
        words = text.split()
        flags[base + min(15, int(16 * (1 - len(set(lines)) / max(1, len(lines)))))] = True
        flags[base + 16 + min(15, int(16 * len(set(words)) / max(1, len(words))))] = True
        flags[base + 32 + min(15, len(words).bit_length())] = True
        flags[base + 48 + min(15, int(sum(map(len, words)) / max(1, len(words))))] = True
        return flags


class Model(NamedTuple):
    weights: np.ndarray
    slope: float
    offset: float

    def score(self, flags: np.ndarray) -> float:
        z = self.slope * float(self.weights[flags].sum()) / math.sqrt(max(1, int(np.count_nonzero(flags)))) + self.offset
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Dual coordinate descent for hinge loss; returns weights over raw indicators, ratio included."""
    w = np.zeros(len(ratio))
    alpha = np.zeros(len(rows))
    # A row's values are made when it is visited, so that memory holds its indexes alone.
    value = lambda k: ratio[rows[k]] / math.sqrt(len(rows[k]))
    square = np.array([float(v @ v) for v in map(value, range(len(rows)))]) + 1e-12
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for k in rng.permutation(len(rows)):
            v = value(k)
            gradient = y[k] * float(w[rows[k]] @ v) - 1
            new = min(max(alpha[k] - gradient / square[k], 0.0), cost)
            if (step := new - alpha[k]) != 0.0:
                alpha[k] = new
                w[rows[k]] += step * y[k] * v
                moved = max(moved, abs(step))
        if moved < 1e-3 * cost:
            break
    return w * ratio


def logistic(margins: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(1) over margins, by Newton steps with a small ridge and smoothed labels."""
    n1, n0 = label.sum(), (1 - label).sum()
    t = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (t - p) - 1e-6 * b)
        b = b + np.clip(step, -5, 5)
        if abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def fit(rows: list[np.ndarray], label: np.ndarray) -> Model:
    """Model from index arrays of set indicators and 0/1 labels."""
    size = Features.size
    share = float(label.mean()) if len(label) else 0.5
    if len(set(label.tolist())) < 2:
        return Model(np.zeros(size), 1.0, math.log(max(share, 1e-9) / max(1 - share, 1e-9)) if len(label) else 0.0)
    held = np.arange(len(rows)) % 5 == 4
    counts = np.ones((2, size))
    for k in np.flatnonzero(~held):
        counts[int(label[k]), rows[k]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    own = np.flatnonzero(~held)
    if len(set(label[own].tolist())) < 2:
        own = np.arange(len(rows))
    w = descend([rows[k] for k in own], 2.0 * label[own] - 1, ratio)
    seen = np.flatnonzero(held) if len(set(label[held].tolist())) == 2 else np.arange(len(rows))
    margins = np.array([w[rows[k]].sum() / math.sqrt(len(rows[k])) for k in seen])
    return Model(w, *logistic(margins, label[seen].astype(float)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents whose crc32(doc_id) mod 5 is not 0."""
    chosen = (
        labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "quality")
        .where(F.crc32("doc_id") % 5 != 0)
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )

    def indexes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in slices(batches, "text"):
            sets = [np.flatnonzero(features.of(t)).astype(np.uint16).tobytes() for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(sets, pa.binary())], names=["doc_id", "quality", "f"])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").mapInArrow(indexes, "doc_id string, quality int, f binary")
    held = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "f").limit(sample).select("quality", "f").toArrow()
    index = [np.frombuffer(x.as_buffer(), np.uint16) for x in held.column("f")]
    model = fit(index, np.array(held.column("quality").to_pylist(), np.int64))
    del held, index
    trim()
    return model


def classify(docs: DataFrame, model: Model, text: str = "text", drop_text: bool = True) -> DataFrame:
    """Adds held_out, score and predicted to all documents."""
    added = T._parse_datatype_string("score double, predicted int")
    clash = renames(docs.columns, ADDED)
    docs, text = apart(docs, ADDED), clash.get(text, text)
    kept = [c for c in docs.columns if not (drop_text and c == text)]
    schema = T.StructType([*[docs.schema[c] for c in kept], *added])
    weights = docs.sparkSession.sparkContext.broadcast(model._replace(weights=model.weights.astype(np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, m = Features(), weights.value
        for batch in slices(batches, text):
            scores = [m.score(features.of(t)) for t in texts_of(batch, text)]
            cols = [pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *cols], names=[*kept, "score", "predicted"])

    names = list(dict.fromkeys([*kept, text]))
    out = docs.select(*names).mapInArrow(run, schema)
    return out.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)))
