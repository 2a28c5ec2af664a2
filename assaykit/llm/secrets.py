"""Secret scans: base patterns plus a randomness test battery.

Base spans are leftmost, non-overlapping matches per kind. The battery looks at
runs of token characters outside base spans: what a base span leaves of a run is
tested on its own, and so are a run's parts between marks, beside the whole run.
For each run an encoding is inferred (the smallest alphabet that holds it), and three
tests compare it with a uniform source: chi-squared distance from the alphabet, runs
of one class of characters, and serial correlation of alphabet indexes. Each yields a
probability that ordinary text of this alphabet and length (``secret_nulls``) looks
this uniform; they are combined by Stouffer's rule and pass a false-discovery control
(weighted Benjamini-Hochberg) in which longer runs weigh more, as the tests have more
power there. The control runs over the candidates of one document, so it needs no
shuffle; a borderline run can be missed among many candidates that it passes alone.
Digits alone are no candidates: ordinary numbers are as uniform as random ones.

Defined cases: null and empty texts have no spans; repeated rows are scanned
each; ties at one start sort by kind as listed; extra columns stay, those named like
an added one as input_NAME.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import apart, renames, slices, texts_of
from .secret_nulls import null_of

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Alphabets by name, smallest first.
ALPHABETS = {
    "digits": "0123456789",
    "lower26": "abcdefghijklmnopqrstuvwxyz",
    "upper26": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "hex_lower": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters52": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_SETS = {k: frozenset(v) for k, v in ALPHABETS.items()}
_AT = {k: {c: i for i, c in enumerate(v)} for k, v in ALPHABETS.items()}
_SINGLE = ("digits", "lower26", "upper26")
#: Rate of class changes a step in uniform runs, and its deviation a root of a step.
CHANGES: dict[str, tuple[float, float]] = {"digits": (0.5, 0.498), "lower26": (0.312, 0.574), "upper26": (0.31, 0.587), "hex_lower": (0.468, 0.535), "hex_upper": (0.47, 0.53), "base32": (0.306, 0.575), "lower36": (0.4, 0.563), "upper36": (0.4, 0.569), "letters52": (0.25, 0.435), "base62": (0.446, 0.542), "base64": (0.433, 0.541), "base64url": (0.433, 0.538)}
WEIGHTS = (1.0, 1.5, 0.5)
RATE, SHORTEST, MARKS = 0.01, 20, "+/_-"


def _below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def encoding_of(s: str) -> str | None:
    """Smallest alphabet that holds a run; None for marks of both base64 kinds."""
    have = set(s.rstrip("="))
    return next((k for k, v in _SETS.items() if have <= v), None)


def class_changes(s: str, name: str) -> int:
    """How often the class of character changes: upper, lower, digit; vowel and consonant where the alphabet has one class.

    Marks are skipped, and a capital that opens a word is no change: "ByName" is one class.
    """
    s = re.sub(r"[+/_-]", "", s)
    if name in _SINGLE:
        c = re.sub(r"[^aeiou]", "b", re.sub(r"[aeiou]", "a", s.lower())) if name != "digits" else re.sub(r"[5-9]", "5", re.sub(r"[0-4]", "0", s))
    else:
        c = re.sub(r"(?<![A-Z])[A-Z](?=[a-z])", "a", s)
        c = re.sub(r"[0-9]", "0", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", c)))
    return sum(x != y for x, y in zip(c, c[1:], strict=False))


def battery(s: str, name: str) -> tuple[float, float, float]:
    """Scores of a run against a uniform source: chi-squared, runs of a class, serial correlation; near 0 for random."""
    s = s.rstrip("=")
    x = np.array([_AT[name][c] for c in s])
    n, k = len(x), len(ALPHABETS[name])
    counts = np.bincount(x, minlength=k)
    chi = float(((counts - n / k) ** 2).sum() * k / n)
    # Wilson and Hilferty: the cube root of chi-squared over its degrees is near normal.
    dof = k - 1
    z_chi = ((chi / dof) ** (1 / 3) - (1 - 2 / (9 * dof))) / math.sqrt(2 / (9 * dof))
    rate, spread = CHANGES[name]
    z_runs = (class_changes(s, name) - rate * (n - 1)) / (spread * math.sqrt(n - 1))
    y = x - x.mean()
    r = float((y[1:] * y[:-1]).sum() / max(float((y * y).sum()), 1e-9))
    return z_chi, abs(z_runs), abs(r) * math.sqrt(n)


def chance(s: str, name: str) -> float:
    """Probability that ordinary text of this alphabet and length would look as uniform as this run.

    Each score has a probability from its null distribution in ``secret_nulls``;
    Stouffer's rule adds their normal scores, over the deviation of that sum in
    ordinary text, as the three are not independent.
    """
    *null, spread = null_of(name, len(s.rstrip("=")))
    z = sum(w * (x - m) / d for w, x, m, d in zip(WEIGHTS, battery(s, name), null[::2], null[1::2], strict=True))
    return _below(z / spread)


def discoveries(p: list[float], lengths: list[int], rate: float = RATE) -> list[bool]:
    """Weighted Benjamini-Hochberg: a run's weight is its length over the mean length of all."""
    mean = sum(lengths) / max(len(lengths), 1)
    q = [x * mean / n for x, n in zip(p, lengths, strict=True)]
    order = sorted(range(len(p)), key=q.__getitem__)
    last = max((r for r, i in enumerate(order, 1) if q[i] <= rate * r / len(p)), default=0)
    kept = set(order[:last])
    return [i in kept for i in range(len(p))]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, alphabet) of the runs to test: runs outside base spans, and their parts between marks."""
    found = []
    covered: list[list[int]] = []
    for s, _, e in base:
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    # Runs and covered stretches are both in order and apart, so one pass over both is enough.
    k = 0
    for m in CANDIDATE.finditer(text):
        at, gaps = m.start(), []
        while k < len(covered) and covered[k][1] <= at:
            k += 1
        n = k
        while n < len(covered) and covered[n][0] < m.end():
            gaps.append((at, covered[n][0]))
            at = covered[n][1]
            n += 1
        for a, b in [*gaps, (at, m.end())]:
            if b - a >= SHORTEST:
                cuts = [a, *(i + 1 for i in range(a, b) if text[i] in MARKS), b + 1]
                ends = {(a, b), *((x, y - 1) for x, y in zip(cuts, cuts[1:], strict=False))}
                found += [(x, y, name) for x, y in sorted(ends) if len(text[x:y].rstrip("=")) >= SHORTEST and (name := encoding_of(text[x:y]))]
    return [(a, b, name) for a, b, name in found if name != "digits"]


def random_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that the battery adds outside base spans; of a run and its parts, the longest that is found."""
    runs = candidates(text, base)
    hits = discoveries([chance(text[a:b], name) for a, b, name in runs], [b - a for a, b, _ in runs])
    spans: list[tuple[int, int, int]] = []
    for a, b in sorted(((a, b) for (a, b, _), hit in zip(runs, hits, strict=True) if hit), key=lambda x: (x[0], -x[1])):
        if not spans or b > spans[-1][2]:
            spans.append((a, 3, b))
    return spans


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of covered characters replaced by [SECRET]."""
    out, at = [], 0
    for s, _, e in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = e
    return "".join([*out, text[at:]])


FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string"


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns of FOUND; redacted is null for a null text."""
    added = T._parse_datatype_string(FOUND)
    clash = renames(df.columns, added.names)
    df, text = apart(df, added.names), clash.get(text, text)
    kept = df.columns
    schema = T.StructType([*[df.schema[c] for c in kept], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            cols: list[list] = [[] for _ in added]
            for t, raw in zip(texts_of(batch, text), batch.column(text).is_null().to_pylist(), strict=True):
                base = base_spans(t)
                spans = sorted(base + random_spans(t, base))
                row = [sum(k == i for _, k, _ in base) for i in range(3)]
                row += [hashlib.sha256(written(base).encode()).hexdigest(), written(spans), None if raw else redacted(t, spans)]
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            types = [pa.int64()] * 3 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=[*kept, *added.names])

    return df.select(*kept).mapInArrow(run, schema)
