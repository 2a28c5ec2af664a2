"""Queries over evaluators, folds, reports and reliability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import evaluators as ev
from ..operators import report
from .base import CASES, PAIRS, RUNS, rounded, runs, sql_wilson, table, turn_pairs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _scored(spark: SparkSession, sf_dir: str, *evaluators: ev.Evaluator) -> DataFrame:
    return ev.score(turn_pairs(spark, sf_dir), list(evaluators), ["case_id"]).select("case_id", F.round("score", 6).alias("score"), "passed")


_ONE = "WITH " + PAIRS + " SELECT case_id, {s} AS score, ({s}) >= {t} AS passed FROM pairs"


def _simple(score: str, threshold: float) -> str:
    return _ONE.format(s=f"round(({score})::DOUBLE, 6)", t=threshold)


_WORDS = r"len(list_filter(regexp_split_to_array(output, '\s+'), lambda x: x <> ''))"
_FREE_SQL = f"""long AS (SELECT case_id, turn, tags, unnest([
        {{'evaluator': 'not_empty', 'score': CASE WHEN trim(output, ' \n') <> '' THEN 1.0 ELSE 0.0 END}},
        {{'evaluator': 'word_count', 'score': CASE WHEN {_WORDS} BETWEEN 1 AND 200 THEN 1.0 ELSE 0.0 END}},
        {{'evaluator': 'contains', 'score': CASE WHEN contains(lower(output), 'the') OR contains(lower(output), 'que') OR contains(lower(output), 'und') OR contains(lower(output), 'de') THEN 1.0 ELSE 0.0 END}},
        {{'evaluator': 'starts_with', 'score': CASE WHEN starts_with(lower(trim(output, ' \n')), 'the') THEN 1.0 ELSE 0.0 END}}], recursive := true) FROM pairs)"""


def _free(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return ev.score(turn_pairs(spark, sf_dir), [ev.not_empty(), ev.word_count(1, 200), ev.contains(["the", "que", "und", "de"], match_any=True), ev.starts_with("the")], ["case_id", *keep])


_LOW, _HIGH = sql_wilson("passed", "n")


@query(f"""WITH {PAIRS}, {_FREE_SQL}, c AS (SELECT case_id, turn, bool_and(score >= 0.5) AS ok FROM long WHERE evaluator <> 'starts_with' GROUP BY ALL),
    g AS (SELECT turn, count(*) AS n, count(*) FILTER (ok) AS passed FROM c GROUP BY turn)
    SELECT turn, n, passed, round({_LOW}, 6) AS low, round({_HIGH}, 6) AS high FROM g""")
def flagship(spark, sf_dir):
    long = _free(spark, sf_dir, "turn").where("evaluator <> 'starts_with'")
    cases = long.groupBy("case_id", "turn").agg(F.bool_and(F.col("score") >= 0.5).alias("ok"))
    g = cases.groupBy("turn").agg(F.count("*").alias("n"), F.count_if("ok").alias("passed"))
    low, high = stats.wilson(F.col("passed"), F.col("n"))
    return rounded(g.withColumn("low", low).withColumn("high", high), "low", "high")


@query(_simple("CASE WHEN trim(output, ' \n') <> '' THEN 1.0 ELSE 0.0 END", 0.5))
def ev_not_empty(spark, sf_dir):
    return _scored(spark, sf_dir, ev.not_empty())


@query(_simple(f"CASE WHEN {_WORDS} BETWEEN 20 AND 150 THEN 1.0 ELSE 0.0 END", 1.0))
def ev_word_count(spark, sf_dir):
    return _scored(spark, sf_dir, ev.word_count(20, 150))


@query(_simple("(contains(lower(output), 'the')::INT + contains(lower(output), 'que')::INT + contains(lower(output), 'en')::INT) / 3.0", 1.0))
def ev_contains_all(spark, sf_dir):
    return _scored(spark, sf_dir, ev.contains(["the", "QUE", "en"]))


@query(_simple("CASE WHEN contains(output, 'The') OR contains(output, 'Que') THEN 1.0 ELSE 0.0 END", 1.0))
def ev_contains_any(spark, sf_dir):
    return _scored(spark, sf_dir, ev.contains(["The", "Que"], case_sensitive=True, match_any=True))


@query(_simple("CASE WHEN starts_with(lower(trim(output, ' \n')), 'th') THEN 1.0 ELSE 0.0 END", 1.0))
def ev_starts_with(spark, sf_dir):
    return _scored(spark, sf_dir, ev.starts_with("Th"))


@query(f"""WITH {PAIRS}, e AS (SELECT *, CASE WHEN turn % 3 = 0 THEN NULL WHEN turn % 3 = 1 THEN ' ' || output || chr(10) ELSE input END AS expected_output FROM pairs)
    SELECT case_id, CASE WHEN expected_output IS NULL OR lower(trim(output, ' \n')) = lower(trim(expected_output, ' \n')) THEN 1.0 ELSE 0.0 END::DOUBLE AS score, expected_output IS NULL AS skipped FROM e""")
def ev_exact_match(spark, sf_dir):
    p = turn_pairs(spark, sf_dir)
    p = p.withColumn("expected_output", F.when(F.col("turn") % 3 == 1, F.concat(F.lit(" "), F.col("output"), F.lit("\n"))).when(F.col("turn") % 3 == 2, F.col("input")))
    return ev.score(p, [ev.exact_match()], ["case_id"]).select("case_id", "score", "skipped")


@query(_simple("CASE WHEN regexp_matches(output, '(?i)th[aeo]+[nr]') THEN 1.0 ELSE 0.0 END", 1.0))
def ev_regex_match(spark, sf_dir):
    return _scored(spark, sf_dir, ev.regex_match("th[aeo]+[nr]"))


_DECAY = "CASE WHEN value <= {m} THEN 1.0 ELSE greatest(0.0, 1.0 - (value - {m}) / {m}) END"


def _timed(spark, sf_dir, e):
    events = table(spark, sf_dir, "events").withColumnRenamed("value", "latency_ms")
    return ev.score(events, [e], ["event_id"]).select("event_id", F.round("score", 6).alias("score"), "passed")


@query(f"SELECT event_id, round({_DECAY.format(m='50.0::DOUBLE')}, 6) AS score, value <= 50 AS passed FROM events")
def ev_latency(spark, sf_dir):
    return _timed(spark, sf_dir, ev.latency(50.0))


@query(f"SELECT event_id, round({_DECAY.format(m='30.0::DOUBLE')}, 6) AS score, ({_DECAY.format(m='30.0::DOUBLE')}) >= 0.5 AS passed FROM events")
def ev_max_latency(spark, sf_dir):
    return _timed(spark, sf_dir, ev.latency(30.0, threshold=0.5, name="max_latency"))


@query("""SELECT p_partkey, round(1.0 - levenshtein(lower(p_name), lower(p_type))::DOUBLE / greatest(length(p_name), length(p_type)), 6) AS score FROM part""")
def ev_levenshtein(spark, sf_dir):
    e = ev.levenshtein(out="p_name", expected="p_type")
    return ev.score(table(spark, sf_dir, "part"), [e], ["p_partkey"]).select("p_partkey", F.round("score", 6).alias("score"))


def _tools(spark, sf_dir):
    """A user-day's event types, in order, as called tools; expectations differ by user."""
    e = table(spark, sf_dir, "events")
    g = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("x"))
    want = F.when(F.col("user_id") % 5 == 0, F.array().cast("array<string>")).when(F.col("user_id") % 5 != 1, F.array(F.lit("click"), F.lit("view"), F.lit("click")))
    return g.select("user_id", "day", F.transform("x", lambda s: s["event_type"]).alias("calls"), want.alias("expected_tool_calls"))


_TOOLS = """t AS (SELECT user_id, ts::DATE AS day, list(event_type ORDER BY ts, event_id) AS calls,
        CASE WHEN user_id % 5 = 0 THEN []::VARCHAR[] WHEN user_id % 5 <> 1 THEN ['click', 'view', 'click'] END AS want FROM events GROUP BY user_id, ts::DATE),
    u AS (SELECT *, len(list_distinct(list_filter(want, lambda x: list_contains(calls, x)))) AS met, len(list_distinct(list_filter(calls, lambda x: NOT list_contains(want, x)))) AS stray, len(list_distinct(want)) AS size FROM t)"""
_TOOL_SQL = "WITH " + _TOOLS + " SELECT user_id, day, round(CASE WHEN want IS NULL THEN 1.0 WHEN len(want) = 0 THEN 0.0 ELSE {s} END::DOUBLE, 6) AS score, want IS NULL AS skipped FROM u"


def _tooled(spark, sf_dir, **kw):
    e = ev.tool_call_accuracy(calls=F.col("calls"), **kw)
    return ev.score(_tools(spark, sf_dir), [e], ["user_id", "day"]).select("user_id", "day", F.round("score", 6).alias("score"), "skipped")


@query(_TOOL_SQL.format(s="met::DOUBLE / size"))
def ev_tool_call_unordered(spark, sf_dir):
    return _tooled(spark, sf_dir)


@query(_TOOL_SQL.format(s="(coalesce(calls[1] = 'click', false)::INT + coalesce(calls[2] = 'view', false)::INT + coalesce(calls[3] = 'click', false)::INT) / 3.0"))
def ev_tool_call_ordered(spark, sf_dir):
    return _tooled(spark, sf_dir, ordered=True)


@query(_TOOL_SQL.format(s="met::DOUBLE / (size + stray)"))
def ev_tool_call_strict(spark, sf_dir):
    return _tooled(spark, sf_dir, strict=True)


_STOPS = "['the', 'a', 'an', 'is', 'are', 'was', 'were', 'in', 'on', 'at', 'of', 'to', 'and', 'or', 'for']"


@query(f"""WITH {PAIRS}, w AS (SELECT case_id, list_distinct(list_filter(regexp_split_to_array(lower(output), '\\s+'), lambda x: x <> '' AND NOT list_contains({_STOPS}, x))) AS own,
        regexp_split_to_array(lower(input), '\\s+') AS ctx FROM pairs)
    SELECT case_id, CASE WHEN len(own) = 0 OR len(list_filter(own, lambda x: NOT list_contains(ctx, x)))::DOUBLE / len(own) < 0.9 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM w""")
def ev_keyword_overlap(spark, sf_dir):
    return _scored(spark, sf_dir, ev.keyword_overlap(novel=0.9, context="input")).select("case_id", "score")


def _referenced(spark, sf_dir):
    return turn_pairs(spark, sf_dir).withColumn("expected_output", F.col("input"))


@query(f"""WITH {PAIRS}, w AS (SELECT case_id, list_filter(regexp_split_to_array(lower(output), '\\s+'), lambda x: x <> '') AS h, list_filter(regexp_split_to_array(lower(input), '\\s+'), lambda x: x <> '') AS r FROM pairs),
    m AS (SELECT case_id, sum(least(c, d)) AS met FROM (SELECT case_id, x, count(*) AS c FROM (SELECT case_id, unnest(h) AS x FROM w) GROUP BY ALL)
        JOIN (SELECT case_id, x, count(*) AS d FROM (SELECT case_id, unnest(r) AS x FROM w) GROUP BY ALL) USING (case_id, x) GROUP BY case_id)
    SELECT w.case_id, CASE WHEN len(h) = 0 OR len(r) = 0 OR met IS NULL THEN 0.0 ELSE round_even(exp(least(0.0, 1 - len(r)::DOUBLE / len(h))) * met / len(h), 4) END::DOUBLE AS score FROM w LEFT JOIN m USING (case_id)""")
def ev_bleu1(spark, sf_dir):
    return ev.score(_referenced(spark, sf_dir), [ev.bleu(1)], ["case_id"]).select("case_id", "score")


@query()
def ev_text_overlap(spark, sf_dir):
    """BLEU, ROUGE-L and chrF of every logged reply against its request."""
    return ev.score(_referenced(spark, sf_dir), [ev.bleu(), ev.rouge_l(), ev.chrf()], ["case_id"]).select("case_id", "evaluator", "score", "passed")


@query("""SELECT event_id, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) <= 50 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM events""")
def ev_json_schema(spark, sf_dir):
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 50}}}
    return ev.score(table(spark, sf_dir, "events"), [ev.json_schema(schema, out="props")], ["event_id"]).select("event_id", "score")


#: References to itself, names by pattern, items by place, conditions, dependencies and formats.
_RULES = {
    "definitions": {"node": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 80}, "next": {"$ref": "#/definitions/node"}}}},
    "allOf": [{"$ref": "#/definitions/node"}],
    "properties": {"kind": {"enum": ["click", "error", "purchase", "view"]}, "day": {"format": "date"}, "path": {"items": [{"type": "integer"}, {"const": "view"}], "additionalItems": False}},
    "patternProperties": {"^n_": {"minimum": 10}},
    "if": {"properties": {"kind": {"const": "error"}}},
    "then": {"required": ["why"]},
    "dependencies": {"why": ["code"]},
}


@query("""WITH e AS (SELECT event_id, user_id, event_type AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value, event_id % 3 = 0 AS why, event_id % 2 = 0 AS code FROM events),
    v AS (SELECT event_id, (k > 80)::INT + (user_id % 100 > 80)::INT + (kind = 'signup')::INT + (event_id % 5 = 0)::INT + (kind <> 'view')::INT + (event_id % 7 = 0)::INT + (value < 10)::INT + (kind = 'error' AND NOT why)::INT + (why AND NOT code)::INT AS n FROM e)
    SELECT event_id, n AS violations, round(1 - n / 10.0, 6)::DOUBLE AS score FROM v""")
def ev_json_schema_rules(spark, sf_dir):
    """A schema that refers to itself and puts conditions, over objects made of all events."""
    i, given = F.col("event_id"), lambda c, x: F.when(c, x)
    k = F.get_json_object("props", "$.k").cast("long")
    path = F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit(', "'), F.col("event_type"), F.lit('"'), F.when(i % 7 == 0, ", 0").otherwise(""), F.lit("]"))
    day = F.when(i % 5 == 0, "2024-02-30").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    said = F.to_json(F.struct(k.alias("k"), F.struct((F.col("user_id") % 100).alias("k")).alias("next"), F.col("event_type").alias("kind"), day.alias("day"), F.col("value").alias("n_value"), given(i % 3 == 0, F.lit("slow")).alias("why"), given(i % 2 == 0, F.lit(1)).alias("code")))
    said = F.concat(F.lit('{"path":'), path, F.lit(","), F.substring(said, 2, 1 << 20))
    scored = ev.score(table(spark, sf_dir, "events").withColumn("output", said), [ev.schema_compliance(_RULES, formats=True)], ["event_id"])
    return scored.select("event_id", F.round((1 - F.col("score")) * 10).cast("int").alias("violations"), F.round("score", 6).alias("score"))


@query("""WITH c AS (SELECT label, list_transform(range(1, len(any_value(embedding)) + 1), lambda i: 0) AS z, any_value(embedding) FROM embeddings GROUP BY label),
    r AS (SELECT label, arg_min(embedding, vec_id) AS ref FROM embeddings GROUP BY label)
    SELECT vec_id, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * ref[i]::DOUBLE)) /
        sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(ref, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS score
    FROM embeddings JOIN r USING (label)""")
def ev_embedding_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    refs = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("ref"))
    return e.join(refs, "label").select("vec_id", F.round(ev.cosine(F.col("embedding"), F.col("ref")), 5).alias("score"))


@query(f"""WITH {CASES} SELECT case_id, runs, pass_count, round(score, 6) AS score, round(score_std, 6) AS score_std, round(latency_ms, 6) AS latency_ms, output, status, is_flaky FROM cases""")
def fold_runs(spark, sf_dir):
    return rounded(report.fold_runs(runs(spark, sf_dir)).select("case_id", "runs", "pass_count", "score", "score_std", "latency_ms", "output", "status", "is_flaky"), "score", "score_std", "latency_ms")


@query(f"WITH {CASES} SELECT status, count(*) AS n FROM cases GROUP BY status")
def case_status(spark, sf_dir):
    return report.fold_runs(runs(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {CASES} SELECT case_id, runs, pass_count, round(pass_count::DOUBLE / runs, 6) AS run_pass_rate FROM cases WHERE is_flaky")
def flaky_cases(spark, sf_dir):
    return rounded(report.fold_runs(runs(spark, sf_dir)).where("is_flaky").select("case_id", "runs", "pass_count", "run_pass_rate"), "run_pass_rate")


@query("WITH " + CASES.replace("value <= 100", "value <= 8") + " SELECT case_id, runs FROM cases WHERE status IN ('passed', 'failed_quality') AND runs > 1 AND pass_count = 0")
def zero_pass(spark, sf_dir):
    """Under a strict bound many cases never pass."""
    strict = runs(spark, sf_dir).withColumn("passed", F.col("passed") & (F.col("latency_ms") <= 8))
    return report.zero_pass(report.fold_runs(strict)).select("case_id", "runs")


@query(f"WITH {CASES} SELECT count(*) AS total, count(*) FILTER (is_flaky) AS flaky_count, round(1 - count(*) FILTER (is_flaky)::DOUBLE / count(*), 6) AS stability FROM cases")
def stability(spark, sf_dir):
    return rounded(report.summary(report.fold_runs(runs(spark, sf_dir))).select("total", "flaky_count", "stability"), "stability")


_SLOW, _SHIGH = sql_wilson("passed", "evaluated")


@query(f"""WITH {CASES}, g AS (SELECT count(*) AS total, count(*) FILTER (status IN ('passed', 'failed_quality')) AS evaluated, count(*) FILTER (status = 'passed') AS passed,
        count(*) FILTER (status = 'failed_quality') AS failed, count(*) FILTER (status IN ('model_error', 'judge_error')) AS errors, count(*) FILTER (status = 'skipped') AS skipped,
        avg(score) FILTER (status IN ('passed', 'failed_quality')) AS avg_score, max(runs) AS runs_per_case FROM cases)
    SELECT total, evaluated, passed, failed, errors, skipped, round(avg_score, 6) AS avg_score, runs_per_case, round(passed::DOUBLE / evaluated, 6) AS pass_rate,
        round(errors::DOUBLE / total, 6) AS error_rate, passed = evaluated AS saturated, round({_SLOW}, 6) AS pass_rate_low, round({_SHIGH}, 6) AS pass_rate_high,
        round(sqrt(7.848879734349089 * 2 * greatest(0.5, least(0.95, passed::DOUBLE / evaluated)) * (1 - greatest(0.5, least(0.95, passed::DOUBLE / evaluated))) / evaluated), 4) AS min_detectable_regression FROM g""")
def report_summary(spark, sf_dir):
    s = report.summary(report.fold_runs(runs(spark, sf_dir))).drop("flaky_count", "stability")
    return rounded(s, "avg_score", "pass_rate", "error_rate", "pass_rate_low", "pass_rate_high")


@query(f"WITH {CASES} SELECT status, count(*) AS n FROM cases WHERE status IN ('model_error', 'judge_error', 'evaluator_error', 'timeout') GROUP BY status")
def errors_by_kind(spark, sf_dir):
    return report.errors_by_kind(report.fold_runs(runs(spark, sf_dir)))


@query("""WITH v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events)
    SELECT 'max_p95_latency_ms' AS name, round(max(value) FILTER (i = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)), 6) AS measured, 150.0::DOUBLE AS "limit", max(value) FILTER (i = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)) <= 150 AS ok FROM v
    UNION ALL SELECT 'max_avg_latency_ms', round(avg(value), 6), 40.0, avg(value) <= 40 FROM v""")
def budget_gates(spark, sf_dir):
    trials = table(spark, sf_dir, "events").select(F.col("value").alias("latency_ms"))
    return rounded(report.budget(trials, max_p95_latency_ms=150, max_avg_latency_ms=40), "measured")


@query(f"""WITH {CASES} SELECT unnest([10, 25, 50, 75, 90]) AS percentile, round(unnest(quantile_cont(score, [0.1, 0.25, 0.5, 0.75, 0.9])), 4) AS score FROM cases""")
def score_percentiles(spark, sf_dir):
    return report.percentiles(report.fold_runs(runs(spark, sf_dir)))


def _cased(spark, sf_dir):
    long = _free(spark, sf_dir, "tags")
    return long.groupBy("case_id", "tags").agg(F.avg("score").alias("score"), F.when(F.bool_and("passed"), "passed").otherwise("failed_quality").alias("status"))


@query(f"""WITH {PAIRS}, {_FREE_SQL}, c AS (SELECT case_id, tags, avg(score) AS score, bool_and(score >= CASE evaluator WHEN 'not_empty' THEN 0.5 ELSE 1.0 END) AS ok FROM long GROUP BY ALL)
    SELECT tag, count(*) AS n, round(avg(score), 6) AS avg_score, round(avg(ok::INT), 6) AS pass_rate FROM (SELECT unnest(tags) AS tag, score, ok FROM c) GROUP BY tag""")
def by_tag(spark, sf_dir):
    return rounded(report.by_tag(_cased(spark, sf_dir)), "avg_score", "pass_rate")


@query(f"""WITH {PAIRS}, {_FREE_SQL} SELECT evaluator, count(*) AS n, round(avg(score::DOUBLE), 6) AS avg_score, round(avg((score >= 0.5)::INT), 6) AS pass_rate FROM long GROUP BY evaluator""")
def by_evaluator(spark, sf_dir):
    return rounded(report.by_evaluator(_free(spark, sf_dir)), "avg_score", "pass_rate")


@query(f"""WITH {RUNS}, g AS (SELECT event_type, count(*) AS n, count(*) FILTER (passed) AS passed FROM runs GROUP BY event_type)
    SELECT event_type, n, passed, round({_LOW}, 6) AS low, round({_HIGH}, 6) AS high FROM g""")
def wilson_ci(spark, sf_dir):
    g = runs(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))
    low, high = stats.wilson(F.col("passed"), F.col("n"))
    return rounded(g.withColumn("low", low).withColumn("high", high), "low", "high")


_TYPED = "g AS (SELECT event_type, count(*) AS n, count(*) FILTER (passed)::DOUBLE / count(*) AS p FROM runs GROUP BY event_type)"


def _typed(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), (F.count_if("passed") / F.count("*")).alias("p"))


@query(f"WITH {RUNS}, {_TYPED} SELECT event_type, round(least(1.0, sqrt(7.848879734349089 * 2 * p * (1 - p) / n)), 4) AS mde FROM g")
def mde(spark, sf_dir):
    return _typed(spark, sf_dir).select("event_type", stats.detectable(F.col("n"), F.col("p")).alias("mde"))


@query(f"WITH {RUNS}, {_TYPED} SELECT event_type, CAST(ceil(7.848879734349089 * (p * (1 - p) + least(1.0, p + 0.05) * (1 - least(1.0, p + 0.05))) / 0.0025) AS BIGINT) AS n_needed FROM g")
def runs_needed(spark, sf_dir):
    return _typed(spark, sf_dir).select("event_type", stats.sample_size(F.lit(0.05), F.col("p")).cast("long").alias("n_needed"))


@query(f"WITH {RUNS}, {_TYPED} SELECT event_type, round(2 * asin(sqrt(p)) - 2 * asin(sqrt(0.9)), 4) AS h, CASE WHEN abs(round(2 * asin(sqrt(p)) - 2 * asin(sqrt(0.9)), 4)) < 0.2 THEN 'small' WHEN abs(round(2 * asin(sqrt(p)) - 2 * asin(sqrt(0.9)), 4)) < 0.5 THEN 'medium' ELSE 'large' END AS label FROM g")
def cohens_h(spark, sf_dir):
    h = stats.effect_h(F.lit(0.9), F.col("p"))
    return _typed(spark, sf_dir).select("event_type", h.alias("h"), stats.effect_label(h).alias("label"))


_K = """k AS (SELECT case_id, status, runs, pass_count, 1 - list_product(list_transform(range(3), lambda i: greatest(runs - pass_count - i, 0)::DOUBLE / greatest(runs - i, 1))) AS a,
        list_product(list_transform(range(3), lambda i: greatest(pass_count - i, 0)::DOUBLE / greatest(runs - i, 1))) AS h FROM cases WHERE status IN ('passed', 'failed_quality'))"""


@query(f"WITH {CASES}, {_K} SELECT case_id, CASE WHEN runs >= 3 THEN round(a, 6) END AS pass_at_k, CASE WHEN runs >= 3 THEN round(h, 6) END AS pass_hat_k FROM k")
def pass_at_k(spark, sf_dir):
    cases = report.fold_runs(runs(spark, sf_dir)).where(F.col("status").isin(*report.EVALUATED))
    n, c = F.col("runs"), F.col("pass_count")
    return cases.select("case_id", F.round(stats.any_of_k(n, c, 3), 6).alias("pass_at_k"), F.round(stats.all_of_k(n, c, 3), 6).alias("pass_hat_k"))


@query(f"""WITH {CASES}, {_K} SELECT 3 AS k, count(*) AS n_cases, min(runs) AS runs, CASE WHEN min(runs) >= 3 THEN round(avg(a), 6) END AS pass_at_k, CASE WHEN min(runs) >= 3 THEN round(avg(h), 6) END AS pass_hat_k,
    CASE WHEN count(*) = 0 THEN 'no evaluated case' WHEN min(runs) < 3 THEN 'k exceeds the recorded runs' END AS unknown_reason FROM k""")
def suite_pass_k(spark, sf_dir):
    return rounded(report.pass_k(report.fold_runs(runs(spark, sf_dir)), 3), "pass_at_k", "pass_hat_k")


@query(f"WITH {CASES}, {_K} SELECT case_id, round(a - h, 6) AS gap FROM k WHERE runs >= 3 AND a - h > 0")
def lottery_cases(spark, sf_dir):
    return rounded(report.lottery(report.fold_runs(runs(spark, sf_dir)), 3).select("case_id", "gap"), "gap")


@query(f"""WITH {RUNS}, s AS (SELECT case_id, count(*) OVER w AS n, sum(passed::INT) OVER w AS p FROM runs WINDOW w AS (PARTITION BY case_id ORDER BY run_no))
    SELECT case_id, min(n) FILTER (n >= 2 AND (pow(1.6, p) * pow(0.4, n - p) >= 16 OR pow(0.4, p) * pow(1.6, n - p) >= 16)) AS stop_at FROM s GROUP BY case_id""")
def sprt_stop(spark, sf_dir):
    return report.sprt(runs(spark, sf_dir))


def _resampled(spark, sf_dir, f):
    """One interval a type over the mean scores of all its cases, in the four places that reports keep: a task gets at most 10,001 distinct scores."""
    scores = runs(spark, sf_dir).groupBy("event_type", "case_id").agg(F.round(F.avg("score"), 4).alias("score"))
    counts = scores.groupBy("event_type", "score").agg(F.count("*").alias("n"))

    def one(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("score")
        low, high = f(list(zip(pdf["score"].tolist(), pdf["n"].tolist(), strict=True)))
        return pd.DataFrame([(key[0], int(pdf["n"].sum()), low, high)], columns=["event_type", "n", "low", "high"])

    return counts.groupBy("event_type").applyInPandas(one, "event_type string, n long, low double, high double")


@query()
def bootstrap_ci(spark, sf_dir):
    return _resampled(spark, sf_dir, stats.bootstrap_mean_counts)


@query()
def pass_k_ci(spark, sf_dir):
    return _resampled(spark, sf_dir, stats.cluster_bootstrap_counts)
