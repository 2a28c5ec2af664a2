"""Input gates: well-formed cases, exact and near duplicates, trace facts and quality signals."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import text
from ..storage import cut
from .graphs import first_independent

#: Metadata fields that can hold an expected behaviour.
BEHAVIOUR_KEYS = ("expected_behavior", "expected_behaviour", "expected_response", "expected")
JACCARD = 0.85
#: Hash buckets of token counts; their number decides order and cost, never results.
BUCKETS = 1 << 21
#: Words of 64 bits in a sketch of a set: they decide how many pairs are compared in whole, never results.
WORDS = 4
#: Rows in a block of a large group of rows that met: it decides how often a set travels and what a task holds, never results.
BLOCK = 500
#: Words of 64 bits in a wide sketch of a set that met another, with the same effect.
WIDE = 32


def _filled(c: Column) -> Column:
    return F.coalesce(F.length(text.strip(c)) > 0, F.lit(False))


def well_formed(inp: str = "input", expected: str = "expected_output", metadata: str | None = "metadata") -> Column:
    """An input, and an expected output or behaviour."""
    has = _filled(F.col(expected))
    for k in BEHAVIOUR_KEYS if metadata else ():
        has = has | _filled(F.get_json_object(F.col(metadata), f"$.{k}"))
    return _filled(F.col(inp)) & has


def exact_duplicates(df: DataFrame, inp: str, order: str) -> DataFrame:
    """order, duplicate_of: the first row with the same loosely normalised text, null for that row itself. Digests travel, not texts."""
    marked = df.select(order, F.sha2(text.loose(F.coalesce(F.col(inp), F.lit(""))), 256).alias("_h"))
    first = marked.groupBy("_h").agg(F.min(order).alias("_first"))
    return marked.join(first, "_h").select(order, F.when(F.col("_first") != F.col(order), F.col("_first")).alias("duplicate_of"))


def near_pairs(df: DataFrame, key: str, tokens: str, threshold: float = JACCARD) -> DataFrame:
    """(a, b, similarity) with a < b of rows whose token arrays, as sets, are alike enough.

    Rows with equal sets are one class, paired through their first row alone: links
    between copies follow from class members. Tokens sort rarest first, by counts in
    BUCKETS hash buckets (on the driver, whatever the input), so that each row orders its
    own set and no token but those of prefixes is shuffled; pairs meet on a token of both prefixes only, by its hash. Each
    prefix row carries a sketch of its set, the parities of its tokens by hash: sketches differ in no more
    places than their sets have tokens apart, so pairs too far apart end where they meet. Whole sets decide on the
    rest. Empty sets are alike and form one class.
    """
    sets = df.select(F.col(key).alias("k"), F.sort_array(F.array_distinct(tokens)).alias("s"))
    # Tokens are taken apart once; classes are found from digests alone.
    sets = cut(sets.withColumn("h", F.sha2(F.to_json("s"), 256)))
    first = sets.groupBy("h").agg(F.min("k").alias("a"))
    copies = sets.select(F.col("k").alias("b"), "h").join(first, "h").where("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    # A key that is repeated with different sets stands for one of them.
    own = cut(first.groupBy(F.col("a").alias("k")).agg(F.min("h").alias("h")))
    named = sets.where(F.size("s") > 0).select("k", "h", F.transform("s", lambda t: F.xxhash64(t)).alias("x"))
    counts = np.zeros(BUCKETS, np.int32)
    found = named.select(F.explode("x").alias("t")).groupBy(F.pmod("t", F.lit(BUCKETS)).alias("b")).agg(F.count("*").alias("c")).toArrow()
    counts[found.column("b").to_numpy()] = found.column("c").to_numpy()
    sketch = df.sparkSession.sparkContext.broadcast(counts)

    @F.pandas_udf("struct<p:array<int>,t:array<bigint>,w:array<bigint>>")
    def prefix(h: pd.Series) -> pd.DataFrame:
        rows = []
        for t in h:
            c = sketch.value[t % BUCKETS]
            order = np.lexsort((t, c))[: len(t) - math.ceil(len(t) * threshold - 1e-9) + 1]
            # A token that is alone in its bucket is in one set.
            place = np.flatnonzero(c[order] > 1)
            odd = np.bincount((t >> 32) % (64 * WORDS), minlength=64 * WORDS) % 2 == 1
            rows.append((place + 1, t[order[place]], np.packbits(odd).view(np.int64)))
        return pd.DataFrame(rows, columns=["p", "t", "w"])

    words = [f"w{i}" for i in range(WORDS)]
    # A row's prefix travels as one row to where it is told whether the row stands for its class.
    short = named.select("k", "h", F.size("x").alias("n"), prefix("x").alias("x")).join(own, ["k", "h"], "left_semi").groupBy("k", "h").agg(F.first("n").alias("n"), F.first("x").alias("x"))
    short = short.select("k", "n", *[F.col("x.w")[i].alias(w) for i, w in enumerate(words)], F.explode(F.arrays_zip("x.p", "x.t")).alias("x"))
    short = cut(short.select("k", "n", *words, "x.p", "x.t"))
    x, y = (short.select("t", *[F.col(c).alias(f"{c}{i}") for c in ("k", "n", "p", *words)]) for i in "xy")
    apart = sum((F.bit_count(F.col(f"{w}x").bitwiseXOR(F.col(f"{w}y"))) for w in words), F.lit(0))
    near = apart <= (F.col("nx") + F.col("ny")) * (1 - threshold) / (1 + threshold) + 1e-9
    fits = (F.least("nx", "ny") >= F.greatest("nx", "ny") * threshold - 1e-9) & (F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) + 1 >= (F.col("nx") + F.col("ny")) * threshold / (1 + threshold) - 1e-9)
    met = cut(x.join(y, "t").where((F.col("kx") < F.col("ky")) & fits & near).select(F.col("kx").alias("a"), F.col("ky").alias("b")).distinct())
    # Whole sets travel as text, which is a third of their size as arrays, and only those whose keys share a bucket with a key that met another.
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
    marks = np.zeros(BUCKETS, bool)
    marks[met.select(F.explode(F.array("a", "b")).alias("k")).select(bucket("k").alias("b")).distinct().toArrow().column("b").to_numpy()] = True
    marked = df.sparkSession.sparkContext.broadcast(np.packbits(marks))

    @F.pandas_udf("boolean")
    def asked(b: pd.Series) -> pd.Series:
        return pd.Series(marked.value[b // 8] >> (7 - b % 8) & 1 == 1)

    whole = sets.where(asked(bucket("k"))).select("k", "h", F.to_json("s").alias("s")).join(own, ["k", "h"], "left_semi").groupBy("k").agg(F.first("s").alias("s"))
    # Long sets that have little in common differ in half the places of a short sketch: a wide one, still far smaller than its set, ends them first.
    wide = sets.where(asked(bucket("k"))).select("k", "h", F.size("s").alias("n"), _wide(F.transform("s", lambda t: F.xxhash64(t))).alias("w")).join(own, ["k", "h"], "left_semi").groupBy("k").agg(F.first("n").alias("n"), F.first("w").alias("w"))
    kind = met.schema["a"].dataType.simpleString()

    def close(pairs: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        at, n, w = pd.Index(held["k"]), held["n"].to_numpy(), np.frombuffer(b"".join(held["w"]), np.uint64).reshape(len(held), WIDE)
        a, b = at.get_indexer(pairs["a"]), at.get_indexer(pairs["b"])
        apart = np.zeros(len(a), np.int64)
        for c in range(WIDE):
            apart += np.bitwise_count(w[a, c] ^ w[b, c])
        return pairs.loc[apart <= (n[a] + n[b]) * (1 - threshold) / (1 + threshold) + 1e-9, ["a", "b"]]

    def compare(pairs: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        tokens = [json.loads(s) for s in held["s"]]
        size = np.array([len(t) for t in tokens], np.int64)
        codes = np.split(pd.factorize(np.array([x for t in tokens for x in t], object))[0], np.cumsum(size)[:-1])
        at, keys = pd.Index(held["k"]), pairs.sort_values("a")
        a, b = at.get_indexer(keys["a"]), at.get_indexer(keys["b"])
        mark, common = np.zeros(1 + max(c.max() for c in codes), bool), np.zeros(len(a), np.int64)
        starts = np.flatnonzero(np.diff(a, prepend=-1))
        for x, y in zip(starts, [*starts[1:], len(a)], strict=True):
            mark[codes[a[x]]] = True
            common[x:y] = np.add.reduceat(mark[np.concatenate([codes[r] for r in b[x:y]])], np.cumsum(size[b[x:y]]) - size[b[x:y]], dtype=np.int64)
            mark[codes[a[x]]] = False
        out = pd.DataFrame({"a": keys["a"].to_numpy(), "b": keys["b"].to_numpy(), "similarity": common / (size[a] + size[b] - common)})
        return out[out["similarity"] >= threshold]

    left = cut(_by_cell(met, wide, close, f"a {kind}, b {kind}"))
    return _by_cell(left, whole, compare, f"a {kind}, b {kind}, similarity double").unionByName(copies)


@F.pandas_udf(BinaryType())
def _wide(x: pd.Series) -> pd.Series:
    """Parities of a set's tokens by hash, in 64 * WIDE places."""
    return pd.Series([np.packbits(np.bincount((t >> 32) % (64 * WIDE), minlength=64 * WIDE) % 2 == 1).tobytes() for t in x])


def _by_cell(pairs: DataFrame, rows: DataFrame, f: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What f makes of pairs (a, b) and what their rows (k and more) hold, cell by cell.

    A pair belongs to the smallest row that its first row met, so near copies of one another share a
    group; a group of many rows is dealt into blocks of about BLOCK, by hash, and its pairs to cells of two
    blocks. A row travels once a cell, not once a pair, and a task holds one cell's rows.
    """
    low = pairs.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("g"))
    grouped = cut(pairs.join(low, "a", "left").select("a", "b", F.coalesce("g", "a").alias("g")))
    members = lambda df, *by: df.select(*by, F.explode(F.array("a", "b")).alias("k")).distinct()
    # No more groups than one in BLOCK members are large.
    large = members(grouped, "g").groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("g", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    i, j = (F.pmod(F.xxhash64(c), F.coalesce("blocks", F.lit(1))) for c in "ab")
    cells = cut(grouped.join(F.broadcast(large), "g", "left").select("g", F.least(i, j).alias("i"), F.greatest(i, j).alias("j"), "a", "b"))
    by = ["g", "i", "j"]
    held = members(cells, *by).join(rows, "k").withColumnsRenamed({c: f"of_{c}" for c in by})
    held = held.select(*[F.col(c).alias(c) for c in held.columns])
    return cells.groupBy(*by).cogroup(held.groupBy(*[f"of_{c}" for c in by])).applyInPandas(f, schema)


def accepted(df: DataFrame, key: str, tokens: str, threshold: float = JACCARD) -> DataFrame:
    """Adds kept: greedy acceptance in key order, each row against the rows kept before it.

    A row is kept if none of the kept rows before it is alike: the rows kept are the first
    independent set of the links, whose chains halve in each round. Rows with equal sets all
    follow their first row.
    """
    sets = df.select(F.col(key).alias("k"), F.sha2(F.to_json(F.array_sort(F.array_distinct(tokens))), 256).alias("s"))
    first = sets.groupBy("s").agg(F.min("k").alias("rep"))
    member = cut(sets.join(first, "s").select("k", "rep"))
    own = member.where("k = rep")
    pairs = near_pairs(df, key, tokens, threshold).select("a", "b").join(own.select(F.col("k").alias("a")), "a", "left_semi").join(own.select(F.col("k").alias("b")), "b", "left_semi")
    state = first_independent(pairs)
    out = member.join(state, member["rep"] == state["k"], "left").select(member["k"], (F.col("rep") == member["k"]).alias("_own"), F.coalesce("kept", F.lit(True)).alias("_kept"))
    return df.join(out.select(F.col("k").alias(key), (F.col("_own") & F.col("_kept")).alias("kept")), key)


def presence(traces: DataFrame, fields: list[str]) -> DataFrame:
    """Share of rows in which each field is there and not blank."""
    return traces.agg(F.count("*").alias("n"), *[F.coalesce(F.avg(_filled(F.col(f).cast("string")).cast("double")), F.lit(0.0)).alias(f) for f in fields])


def trace_summary(t: DataFrame) -> DataFrame:
    """Presence percentages and mean lengths (whole numbers) of traces with input, output, context, expected_output, expected_tool_calls, conversation, metadata."""
    share = lambda c: 100.0 * F.count_if(c) / F.count("*")
    has = lambda c: F.coalesce(F.length(F.col(c)) > 0, F.lit(False))
    some = lambda c: F.coalesce(F.size(F.col(c)) > 0, F.lit(False))
    meta = lambda *ks: F.coalesce(*[F.get_json_object("metadata", f"$.{k}") for k in ks]).isNotNull()
    return t.agg(
        F.count("*").alias("count"),
        *[share(has(c)).alias(f"has_{c}_pct") for c in ("input", "output", "context", "expected_output")],
        share(some("expected_tool_calls")).alias("has_expected_tool_calls_pct"), share(some("conversation")).alias("has_conversation_pct"),
        share(meta("image_url", "images")).alias("has_images_pct"), share(meta("schema")).alias("has_schema_pct"),
        F.expr("coalesce(sum(length(input)), 0) div count(*)").alias("avg_input_chars"), F.expr("coalesce(sum(length(output)), 0) div count(*)").alias("avg_output_chars"),
    )


def shape(summary: DataFrame) -> DataFrame:
    """Adds the product shape: the most specific one whose share is above its bound."""
    rules = (("has_conversation_pct", 30, "conversation"), ("has_expected_tool_calls_pct", 20, "agent"), ("has_images_pct", 20, "multimodal"), ("has_schema_pct", 20, "structured_output"), ("has_context_pct", 40, "rag"), ("has_expected_output_pct", 30, "qa"), ("has_input_pct", 0, "qa"))
    out = F.lit("bare")
    for c, least, name in reversed(rules):
        out = F.when(F.col(c) > least, name).otherwise(out)
    return summary.withColumn("shape", out)


#: Evaluators that fit each shape, most telling first.
BY_SHAPE = {
    "conversation": ("conversation_relevance", "knowledge_retention", "conversation_completeness"),
    "agent": ("tool_call_accuracy", "task_completion", "trajectory_efficiency"),
    "multimodal": ("vqa_faithfulness", "document_grounding"),
    "structured_output": ("schema_compliance", "json_schema"),
    "rag": ("faithfulness", "hallucination", "context_precision"),
    "qa": ("answer_accuracy", "relevance"),
    "bare": ("relevance", "not_empty"),
}


def recommendations(shaped: DataFrame, most: int = 6) -> DataFrame:
    """shape, rank, evaluator: a row for each evaluator that fits, not_empty last."""
    table = F.create_map(*[x for k, v in BY_SHAPE.items() for x in (F.lit(k), F.array(*[F.lit(e) for e in dict.fromkeys([*v, "not_empty"])]))])
    return shaped.select("shape", F.posexplode(F.slice(table[F.col("shape")], 1, most)).alias("rank", "evaluator"))


def signals(t: DataFrame, least_rows: int = 5) -> DataFrame:
    """signal, measured, state of a trace table: row count, field completeness and distinct share."""
    g = t.agg(
        F.count("*").cast("double").alias("n"),
        F.avg(_filled(F.col("output")).cast("double")).alias("out"), F.avg(_filled(F.col("context")).cast("double")).alias("ctx"),
        (F.count_distinct(text.loose(text.folded(F.col("input")))) / F.count("*")).alias("unique"), F.count_if(F.col("context").isNotNull()).alias("with_ctx"),
    )
    ok = lambda c: F.when(F.coalesce(c, F.lit(False)), "ok").otherwise("warn")
    rows = F.array(
        F.struct(F.lit("trace_count").alias("signal"), F.col("n").alias("measured"), ok(F.col("n") >= least_rows).alias("state")),
        F.struct(F.lit("output_present").alias("signal"), F.round("out", 4).alias("measured"), ok(F.col("out") >= 0.8).alias("state")),
        F.struct(F.lit("context_present").alias("signal"), F.round("ctx", 4).alias("measured"), ok((F.col("with_ctx") == 0) | (F.col("ctx") >= 0.5)).alias("state")),
        F.struct(F.lit("unique_fraction").alias("signal"), F.round("unique", 4).alias("measured"), ok(F.col("unique") >= 0.7).alias("state")),
    )
    return g.select(F.inline(rows))


def document_length(c: Column, least: int = 200) -> Column:
    n = F.length(text.strip(F.coalesce(c, F.lit(""))))
    return F.when(n == 0, "empty").when(n < least, "short").otherwise("ok")


def hardness(shots: DataFrame, low: float = 0.5, high: float = 1.0) -> DataFrame:
    """Failure rate of each case's baseline shots and whether it lies in the band.

    A crashed baseline counts as a failure; an evaluator crash leaves the case out.
    """
    g = shots.groupBy("case_id").agg(F.count("*").alias("shots"), F.count_if(~F.coalesce("passed", F.lit(False)) | F.col("model_error").isNotNull()).alias("failed"), F.bool_or(F.col("evaluator_error").isNotNull()).alias("broken"))
    rate = F.col("failed") / F.col("shots")
    return g.where("not broken").select("case_id", "shots", rate.alias("failure_rate"), rate.between(low, high).alias("in_band"))


def accounting(rows: DataFrame, bucket: str = "bucket") -> DataFrame:
    """generated, accepted and dropped counts; accepted and the dropped add up to generated."""
    return rows.agg(F.count("*").alias("generated"), F.count_if(F.col(bucket) == "accepted").alias("accepted"), F.count_if(F.col(bucket) == "malformed").alias("dropped_malformed"), F.count_if(F.col(bucket) == "duplicate").alias("dropped_duplicate"))


#: Signals of each kind of input, in order; a signal of another kind is never reported as fine.
SIGNALS = {
    "bootstrap": ("trace_count", "field_completeness", "near_duplicate_ratio", "pii_secret_density"),
    "generate": ("document_length", "near_duplicate_ratio", "pii_secret_density"),
    "cases": ("case_count", "well_formed_rate"),
}
#: Bounds below which a signal warns.
LEAST = {"trace_count": 20, "output": 0.8, "context": 0.5, "near_duplicate_ratio": 0.7, "document_length": 200, "case_count": 1, "well_formed_rate": 0.8}


def unique_fraction(rows: DataFrame, key: str, c: str) -> DataFrame:
    """n and fraction: the share of texts that greedy acceptance in key order keeps, by words between white space; 1 for no rows."""
    words = rows.select(F.col(key).alias("k"), text.words(text.folded(F.coalesce(F.col(c), F.lit("")))).alias("w"))
    return accepted(words, "k", "w").agg(F.count("*").alias("n"), F.coalesce(F.avg(F.col("kept").cast("double")), F.lit(1.0)).alias("fraction"))


def assess(rows: DataFrame, kind: str, key: str) -> DataFrame:
    """signal, measured, tier (ok or warn) of a table of traces, of a source document's paragraphs, or of cases.

    bootstrap takes rows of key, input, output and context; generate takes rows of key
    (the paragraphs' order) and text, all of one document; cases takes rows of key,
    input, expected_output and metadata. Near duplicates are counted over all rows, not
    over a sample. Detections of personal data and keys are a fact to look at, so any
    makes a warning. ``verdict`` sums the signals up.
    """
    from ..functions import pii

    if kind not in SIGNALS:
        raise ValueError(f"unknown kind {kind!r}, expected one of {sorted(SIGNALS)}")
    value = lambda name, measured, ok: F.struct(F.lit(name).alias("signal"), measured.cast("double").alias("measured"), F.when(F.coalesce(ok, F.lit(False)), "ok").otherwise("warn").alias("tier"))
    least = lambda name, measured: value(name, measured, measured >= LEAST[name])
    if kind == "cases":
        g = rows.agg(F.count("*").alias("n"), F.avg(well_formed().cast("double")).alias("rate"))
        return g.select(F.inline(F.array(least("case_count", F.col("n")), least("well_formed_rate", F.coalesce("rate", F.lit(0.0))))))
    said = F.concat_ws(" ", "input", "output", "context") if kind == "bootstrap" else F.col("text")
    alike = unique_fraction(rows, key, "input" if kind == "bootstrap" else "text").withColumnRenamed("n", "compared")
    share = lambda c: F.coalesce(F.avg(_filled(F.col(c)).cast("double")), F.lit(0.0))
    found = F.size(pii.scan(F.coalesce(said, F.lit(""))))
    if kind == "bootstrap":
        g = rows.withColumn("_found", found).agg(F.count("*").alias("n"), share("output").alias("out"), share("context").alias("ctx"), F.count("context").alias("with_ctx"), F.coalesce(F.avg("_found"), F.lit(0.0)).alias("density"))
        full = (F.col("out") >= LEAST["output"]) & ((F.col("with_ctx") == 0) | (F.col("ctx") >= LEAST["context"]))
        first = [least("trace_count", F.col("n")), value("field_completeness", F.col("out"), full)]
    else:
        # Paragraphs are joined by a blank line again when the document's length is taken.
        g = rows.withColumn("_found", found).agg(F.count("*").alias("n"), (F.coalesce(F.sum(F.length("text")), F.lit(0)) + 2 * F.greatest(F.count("*") - 1, F.lit(0))).alias("chars"), F.coalesce(F.sum("_found"), F.lit(0)).alias("density"))
        first = [least("document_length", F.col("chars"))]
    both = g.join(F.broadcast(alike))
    return both.select(F.inline(F.array(*first, least("near_duplicate_ratio", F.col("fraction")), value("pii_secret_density", F.col("density"), F.col("density") == 0))))


def verdict(findings: DataFrame) -> DataFrame:
    """verdict (PROCEED or WARN), flagged and measured: how many signals warn, of how many."""
    g = findings.agg(F.count_if(F.col("tier") == "warn").alias("flagged"), F.count("*").alias("measured"))
    return g.select(F.when(F.col("flagged") > 0, "WARN").otherwise("PROCEED").alias("verdict"), "flagged", "measured")
