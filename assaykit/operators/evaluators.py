"""Deterministic evaluators as column expressions over (case, output).

An evaluator has a name, a threshold, a score column and a column that says when
its prerequisites are missing: then it skips, with score 1 and passed. ``score``
packs all evaluators into one projection, an array of results that one generator
turns into rows, so any number of evaluators costs one scan. Evaluators whose
algorithm is a sequential programme over tokens run as Arrow UDFs in that projection.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pii, text
from ..functions.schema import compiled
from ..functions.schema import errors as schema_errors

RESULT = "struct<evaluator:string,evaluator_ord:int,score:double,passed:boolean,skipped:boolean,reason:string>"
#: Words that keyword overlap ignores.
STOP_WORDS = ("the", "a", "an", "is", "are", "was", "were", "in", "on", "at", "of", "to", "and", "or", "for")


_TYPES = {str: "string", int: "long", float: "double", bool: "boolean", list: "array<string>"}


@dataclass(frozen=True)
class Evaluator:
    name: str
    threshold: float
    score: Column
    skip: Column | None = None
    reason: Column | None = None

    def evaluate(self, spark: SparkSession, **fields: Any) -> Any:
        """The result of one case, given as fields (output, expected_output, ...); for tables use ``score``."""
        one = spark.createDataFrame([fields], ", ".join(f"{k} {_TYPES[type(v)] if v is not None else 'string'}" for k, v in fields.items()))
        return score(one, [self], []).first()


def output(c: str = "output") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def not_empty(threshold: float = 0.5, out: str = "output") -> Evaluator:
    return Evaluator("not_empty", threshold, _flag(F.length(text.strip(output(out))) > 0))


def exact_match(case_sensitive: bool = False, threshold: float = 1.0, out: str = "output", expected: str = "expected_output") -> Evaluator:
    same = (lambda c: c) if case_sensitive else F.lower
    a, b = (same(text.strip(x)) for x in (output(out), F.col(expected)))
    return Evaluator("exact_match", threshold, _flag(F.coalesce(a == b, F.lit(False))), F.col(expected).isNull())


def contains(substrings: list[str], case_sensitive: bool = False, match_any: bool = False, threshold: float = 1.0, out: str = "output") -> Evaluator:
    if not substrings:
        return Evaluator("contains", threshold, F.lit(1.0))
    same = (lambda c: c) if case_sensitive else F.lower
    hits = sum((F.contains(same(output(out)), same(F.lit(s))).cast("int") for s in substrings), F.lit(0))
    return Evaluator("contains", threshold, _flag(hits > 0) if match_any else hits / F.lit(float(len(substrings))))


def regex_match(pattern: str, ignore_case: bool = True, threshold: float = 1.0, out: str = "output") -> Evaluator:
    return Evaluator("regex_match", threshold, _flag(output(out).rlike(("(?iU)" if ignore_case else "(?U)") + pattern)))


def word_count(least: int = 0, most: int = 10_000, threshold: float = 1.0, out: str = "output") -> Evaluator:
    n = F.size(text.words(output(out)))
    return Evaluator("word_count", threshold, _flag(n.between(least, most)), reason=F.concat(n.cast("string"), F.lit(" words")))


def latency(most: float, threshold: float = 1.0, ms: str = "latency_ms", name: str = "latency") -> Evaluator:
    over = F.coalesce(F.col(ms), F.lit(0.0))
    return Evaluator(name, threshold, F.when(over <= most, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (over - most) / most)))


def starts_with(prefix: str, case_sensitive: bool = False, threshold: float = 1.0, out: str = "output") -> Evaluator:
    same = (lambda c: c) if case_sensitive else F.lower
    return Evaluator("starts_with", threshold, _flag(F.startswith(same(text.strip(output(out))), same(F.lit(prefix)))))


def levenshtein(case_sensitive: bool = False, threshold: float = 0.8, out: str = "output", expected: str = "expected_output") -> Evaluator:
    same = (lambda c: c) if case_sensitive else F.lower
    a, b = same(output(out)), same(F.coalesce(F.col(expected), F.lit("")))
    longest = F.greatest(F.length(a), F.length(b))
    return Evaluator("levenshtein", threshold, F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest), F.col(expected).isNull())


def keyword_overlap(threshold: float = 0.5, novel: float = 0.4, out: str = "output", context: str = "context") -> Evaluator:
    """Passes when few of the output's words, stop words aside, are new to the context."""
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])
    own = F.array_except(text.words(F.lower(output(out))), stops)
    new = F.array_except(own, text.words(F.lower(F.coalesce(F.col(context), F.lit("")))))
    return Evaluator("keyword_overlap", threshold, F.when(F.size(own) == 0, 1.0).otherwise(_flag(F.size(new) / F.size(own) < novel)))


def pii_detection(jurisdiction: str = "all", strict: bool = True, extra: dict[str, str] | None = None, threshold: float = 1.0, out: str = "output", reasons: str = "names", ascii_words: bool = False) -> Evaluator:
    """``reasons`` says how a finding is told: by the patterns' names, or a line for each with two examples and the count, redacted or shown."""
    if reasons not in ("names", "redacted", "shown"):
        raise ValueError(f"reasons are names, redacted or shown, not {reasons!r}")
    if reasons == "shown":
        held = pii.examples(output(out), jurisdiction, strict, extra, ascii_words)
        line = lambda n, x: F.concat(F.lit("  "), n, F.lit(": "), F.array_join(F.transform(F.slice(x["some"], 1, 2), lambda e: F.concat(F.lit('"'), e, F.lit('"'))), ", "), F.lit(" ("), x["n"].cast("string"), F.lit(" match)"))
        return Evaluator("pii_detection", threshold, _flag(F.size(held) == 0), reason=_lines(held, line))
    hits = pii.counts(output(out), jurisdiction, strict, extra, ascii_words=ascii_words)
    mark = lambda n: F.concat(F.lit('"[REDACTED-'), F.upper(n), F.lit(']"'))
    line = lambda n, k: F.concat(F.lit("  "), n, F.lit(": "), F.array_join(F.array_repeat(mark(n), F.least(k, F.lit(2))), ", "), F.lit(" ("), k.cast("string"), F.lit(" match)"))
    return Evaluator("pii_detection", threshold, _flag(F.size(hits) == 0), reason=F.array_join(F.map_keys(hits), ",") if reasons == "names" else _lines(hits, line))


def _lines(found: Column, line: Callable[[Column, Column], Column]) -> Column:
    entries = F.array_sort(F.transform(F.map_entries(found), lambda e: line(e["key"], e["value"])))
    return F.array_join(entries, "\n")


def called_tools(trace: str = "agent_trace") -> Column:
    return F.flatten(F.transform(F.col(trace), lambda s: F.coalesce(F.transform(s["tool_calls"], lambda t: t["name"]), F.array().cast("array<string>"))))


def tool_call_accuracy(ordered: bool = False, strict: bool = False, threshold: float = 0.7, calls: Column | None = None, expected: str = "expected_tool_calls") -> Evaluator:
    """Null expectation or no trace skips; an empty expectation asserts that nothing was called."""
    calls = called_tools() if calls is None else calls
    want = F.col(expected)
    if ordered:
        pairs = F.zip_with(want, F.slice(calls, 1, F.greatest(F.size(want), F.lit(1))), lambda w, c: F.when(w == c, 1).otherwise(0))
        score = F.aggregate(pairs, F.lit(0), lambda a, x: a + x) / F.size(want)
    else:
        met = F.size(F.array_intersect(want, calls))
        stray = F.size(F.array_except(calls, want)) > 0
        size = F.when(stray, F.size(F.array_union(want, calls))).otherwise(F.size(F.array_distinct(want))) if strict else F.size(F.array_distinct(want))
        score = met / size
    return Evaluator("tool_call_accuracy", threshold, F.when(F.size(want) == 0, _flag(F.size(calls) == 0)).otherwise(F.least(F.lit(1.0), score)), want.isNull() | calls.isNull())


def bleu_score(hypothesis: str, reference: str, n: int = 4) -> float:
    """Unsmoothed BLEU with orders capped by both lengths."""
    hyp, ref = hypothesis.lower().split(), reference.lower().split()
    n = min(n, len(hyp), len(ref))
    if not n:
        return 0.0
    logs = 0.0
    for k in range(1, n + 1):
        grams = [Counter(zip(*(words[i:] for i in range(k)), strict=False)) for words in (hyp, ref)]
        met = sum((grams[0] & grams[1]).values())
        if not met:
            return 0.0
        logs += math.log(met / (len(hyp) - k + 1))
    brevity = min(0.0, 1 - len(ref) / len(hyp))
    return round(math.exp(brevity + logs / n), 4)


def rouge_l_score(hypothesis: str, reference: str) -> float:
    """F1 of the longest common subsequence of words, by bit-parallel rows."""
    hyp, ref = hypothesis.lower().split(), reference.lower().split()
    if not hyp or not ref:
        return 0.0
    places: dict[str, int] = {}
    for i, w in enumerate(ref):
        places[w] = places.get(w, 0) | 1 << i
    full = row = (1 << len(ref)) - 1
    for w in hyp:
        met = row & places.get(w, 0)
        row = ((row + met) | (row - met)) & full
    common = len(ref) - row.bit_count()
    return round(2 * common / (len(hyp) + len(ref)), 4)


def chrf_score(hypothesis: str, reference: str, n: int = 6, beta: float = 2.0, case_sensitive: bool = False, white_space: bool = False) -> float:
    """F-beta of character n-gram precision and recall, averaged over the orders that both texts have."""
    a, b = (s if case_sensitive else s.lower() for s in (hypothesis, reference))
    if not white_space:
        a, b = ("".join(s.split()) for s in (a, b))
    if a == b:
        return 1.0
    rates = []
    for k in range(1, min(n, len(a), len(b)) + 1):
        x, y = (Counter(s[i : i + k] for i in range(len(s) - k + 1)) for s in (a, b))
        met = sum((x & y).values())
        rates.append((met / x.total(), met / y.total()))
    if not rates:
        return 0.0
    p, r = (sum(v) / len(rates) for v in zip(*rates, strict=True))
    return round((1 + beta**2) * p * r / (beta**2 * p + r), 4) if p + r else 0.0


def _paired(name: str, f: Callable[[str, str], float], threshold: float, out: str, expected: str) -> Evaluator:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)

    return Evaluator(name, threshold, run(F.col(out), F.col(expected)), F.col(expected).isNull())


def bleu(n: int = 4, threshold: float = 0.5, out: str = "output", expected: str = "expected_output") -> Evaluator:
    return _paired("bleu", lambda a, b: bleu_score(a, b, n), threshold, out, expected)


def rouge_l(threshold: float = 0.5, out: str = "output", expected: str = "expected_output") -> Evaluator:
    return _paired("rouge_l", rouge_l_score, threshold, out, expected)


def chrf(n: int = 6, beta: float = 2.0, threshold: float = 0.5, case_sensitive: bool = False, white_space: bool = False, out: str = "output", expected: str = "expected_output") -> Evaluator:
    return _paired("chrf", lambda a, b: chrf_score(a, b, n, beta, case_sensitive, white_space), threshold, out, expected)


def _json_udf(schema: Any, fenced: bool, graded: bool, formats: bool) -> Callable[[Column], Column]:
    compiled(schema, formats)  # a schema that can't be used fails here, not in a task

    @F.pandas_udf("double")
    def run(c: pd.Series) -> pd.Series:
        def one(raw: str | None) -> float:
            s = (raw or "").strip()
            if fenced and s.startswith("```"):
                s = s.partition("\n")[2].rpartition("```")[0].strip()
            try:
                errors = schema_errors(json.loads(s), schema, formats)
            except (ValueError, RecursionError):  # no JSON, or nested deeper than the parser goes
                return 0.0
            return max(0.0, 1 - len(errors) / 10) if graded else float(not errors)

        return c.map(one).astype(float)

    return run


def json_schema(schema: Any, threshold: float = 1.0, out: str = "output", formats: bool = False) -> Evaluator:
    return Evaluator("json_schema", threshold, _json_udf(schema, False, False, formats)(F.col(out)))


def schema_compliance(schema: Any, threshold: float = 1.0, out: str = "output", formats: bool = False) -> Evaluator:
    """Code fences go; a tenth is taken off for each violation."""
    return Evaluator("schema_compliance", threshold, _json_udf(schema, True, True, formats)(F.col(out)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two embeddings, 0 without length: the stand-in for model-based similarity."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0)), F.lit(0.0))


def score(df: DataFrame, evaluators: list[Evaluator], keep: list[str], model_error: str | None = None) -> DataFrame:
    """Long results: the kept columns and the fields of RESULT, a row for each (row, evaluator).

    Rows whose model failed get no results, latency evaluators aside.
    """
    packed = []
    for i, e in enumerate(evaluators):
        skip = F.coalesce(e.skip, F.lit(False)) if e.skip is not None else F.lit(False)
        value = F.when(skip, 1.0).otherwise(e.score.cast("double"))
        reason = e.reason.cast("string") if e.reason is not None else F.lit("")
        packed.append(F.struct(F.lit(e.name).alias("evaluator"), F.lit(i).alias("evaluator_ord"), value.alias("score"), (skip | (value >= e.threshold)).alias("passed"), skip.alias("skipped"), reason.alias("reason")))
    results = F.array(*packed)
    if model_error:
        results = F.when(F.col(model_error).isNull(), results).otherwise(F.filter(results, lambda r: r["evaluator"].isin("latency", "max_latency")))
    return df.select(*keep, F.inline(results))
