"""Folding runs to cases and cases to reports.

Three denominators stay apart: evaluated cases for rates and mean scores, all cases
for error rate and stability, and all cases for percentiles and tags. Results are
folded by evaluator name, so two evaluators of one name merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from .ranks import at_rank, counted

EVALUATED = ("passed", "failed_quality")
ERRORS = ("model_error", "judge_error", "evaluator_error", "timeout")


def status(skipped: Column, model: Column, judge: Column, evaluator: Column, passed: Column) -> Column:
    """Skipped before model, judge and evaluator errors before quality."""
    return (
        F.when(skipped, "skipped").when(model.isNotNull(), "model_error").when(judge.isNotNull(), "judge_error")
        .when(evaluator.isNotNull(), "evaluator_error").when(F.coalesce(passed, F.lit(False)), "passed").otherwise("failed_quality")
    )


def _first_error(c: str) -> Column:
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("run_no")))


def run_verdicts(runs: DataFrame, results: DataFrame) -> DataFrame:
    """One row a (case, run): its score and whether it passed, from long results; a run without results fails."""
    by = results.groupBy("case_id", "run_no").agg(F.avg("score").alias("score"), F.bool_and("passed").alias("all_passed"))
    joined = runs.join(by, ["case_id", "run_no"], "left")
    state = status(F.col("skipped"), F.col("model_error"), F.col("judge_error"), F.col("evaluator_error"), F.col("all_passed"))
    return joined.withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("passed", state == "passed").drop("all_passed")


def fold_runs(runs: DataFrame) -> DataFrame:
    """Cases from runs (case_id, run_no, score, passed, latency_ms, output, skipped and the three errors).

    Scores and latencies are means, the output is the last run's, errors are the
    first of their kind, and a case of several runs passes if all of them do.
    """
    g = runs.groupBy("case_id").agg(
        F.count("*").alias("runs"),
        F.avg("score").alias("score"),
        F.stddev_pop("score").alias("score_std"),
        F.count_if("passed").alias("pass_count"),
        F.avg("latency_ms").alias("latency_ms"),
        F.max_by("output", "run_no").alias("output"),
        F.bool_or("skipped").alias("skipped"),
        *[_first_error(c).alias(c) for c in ("model_error", "judge_error", "evaluator_error")],
    )
    passed = F.col("pass_count") == F.col("runs")
    g = g.withColumn("status", status(F.col("skipped"), F.col("model_error"), F.col("judge_error"), F.col("evaluator_error"), passed))
    return g.withColumn("run_pass_rate", F.col("pass_count") / F.col("runs")).withColumn("is_flaky", (F.col("pass_count") > 0) & (F.col("pass_count") < F.col("runs")))


def fold_results(results: DataFrame) -> DataFrame:
    """One row a (case, evaluator): mean score, and passed by a majority of runs."""
    g = results.groupBy("case_id", "evaluator").agg(F.avg("score").alias("score"), F.count("*").alias("n"), F.count_if("passed").alias("votes"))
    return g.select("case_id", "evaluator", "score", (F.col("votes") * 2 > F.col("n")).alias("passed"))


def _rate(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def summary(cases: DataFrame) -> DataFrame:
    """The one-row report of folded cases."""
    done = F.col("status").isin(*EVALUATED)
    g = cases.agg(
        F.count("*").alias("total"),
        F.count_if(done).alias("evaluated"),
        F.count_if(F.col("status") == "passed").alias("passed"),
        F.count_if(F.col("status") == "failed_quality").alias("failed"),
        F.count_if(F.col("status").isin(*ERRORS)).alias("errors"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.coalesce(F.avg(F.when(done, F.col("score"))), F.lit(0.0)).alias("avg_score"),
        F.count_if("is_flaky").alias("flaky_count"),
        F.coalesce(F.max("runs"), F.lit(1)).cast("long").alias("runs_per_case"),
    )
    low, high = stats.wilson(F.col("passed"), F.col("evaluated"))
    rate = _rate(F.col("passed"), F.col("evaluated"))
    g = g.withColumn("pass_rate", rate).withColumn("error_rate", _rate(F.col("errors"), F.col("total")))
    g = g.withColumn("stability", F.when(F.col("total") > 0, 1 - _rate(F.col("flaky_count"), F.col("total"))).otherwise(1.0))
    g = g.withColumn("saturated", (F.col("evaluated") > 0) & (F.col("passed") == F.col("evaluated")))
    g = g.withColumn("pass_rate_low", low).withColumn("pass_rate_high", high)
    return g.withColumn("min_detectable_regression", stats.detectable(F.col("evaluated"), F.greatest(F.lit(0.5), F.least(F.col("pass_rate"), F.lit(0.95)))))


def errors_by_kind(cases: DataFrame) -> DataFrame:
    return cases.where(F.col("status").isin(*ERRORS)).groupBy("status").agg(F.count("*").alias("n"))


def percentiles(cases: DataFrame, points: tuple[int, ...] = (10, 25, 50, 75, 90)) -> DataFrame:
    """Interpolated score percentiles over all cases, as rows."""
    at = lambda p: F.lit(p / 100) * (F.col("size") - 1)
    value = lambda rank: F.max(F.when(at_rank(rank), F.col("score")))
    found = counted(cases, "score").agg(*[f for p in points for f in (value(F.floor(at(p))).alias(f"low{p}"), value(F.ceil(at(p))).alias(f"high{p}"), F.max(at(p) - F.floor(at(p))).alias(f"rest{p}"))])
    row = lambda p: F.struct(F.lit(p).alias("percentile"), F.round(F.col(f"low{p}") + (F.col(f"high{p}") - F.col(f"low{p}")) * F.col(f"rest{p}"), 4).alias("score"))
    return found.select(F.inline(F.array(*[row(p) for p in points])))


def nearest_rank(df: DataFrame, value: str, share: float) -> DataFrame:
    """The order statistic at index round_half_even(share * (n - 1)), without interpolation; null for no rows."""
    return counted(df, value).agg(F.max(F.when(at_rank(F.bround(F.lit(share) * (F.col("size") - 1))), F.col(value))).alias(value))


def lower_order_statistic(groups: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """key, n and the value at index floor(share * (n - 1)) of each group."""
    return counted(groups, value, (key,)).where(at_rank(F.floor(F.lit(share) * (F.col("size") - 1)))).select(key, F.col("size").alias("n"), value)


def index(cases: DataFrame, by: str = "path") -> DataFrame:
    """A row a report: total, evaluated, passed, errors, pass_rate and its interval (low, high), of the cases of many reports."""
    g = cases.groupBy(by).agg(
        F.count("*").alias("total"), F.count_if(F.col("status").isin(*EVALUATED)).alias("evaluated"),
        F.count_if(F.col("status") == "passed").alias("passed"), F.count_if(F.col("status").isin(*ERRORS)).alias("errors"),
    )
    low, high = stats.wilson(F.col("passed"), F.col("evaluated"))
    return g.withColumns({"pass_rate": _rate(F.col("passed"), F.col("evaluated")), "low": low, "high": high})


def failing(cases: DataFrame, results: DataFrame, evaluator: str) -> DataFrame:
    """Cases that a named evaluator failed."""
    return cases.join(results.where((F.col("evaluator") == evaluator) & ~F.col("passed")).select("case_id"), "case_id", "left_semi")


def rendered(summary: DataFrame, evaluators: DataFrame | None = None) -> str:
    """A report for a terminal: the summary's line, then one for each evaluator (evaluator, n, avg_score, pass_rate), worst first."""
    s = summary.first()
    lines = [f"{s['passed']} of {s['evaluated']} passed ({s['pass_rate']:.1%}, {s['pass_rate_low']:.1%} to {s['pass_rate_high']:.1%}), {s['errors']} errors, {s['skipped']} skipped, mean score {s['avg_score']:.3f}"]
    if s["runs_per_case"] > 1:
        lines.append(f"{s['flaky_count']} flaky, stability {s['stability']:.1%} over {s['runs_per_case']} runs")
    for r in evaluators.orderBy("pass_rate", "evaluator").collect() if evaluators is not None else ():
        bar = "#" * round(20 * r["pass_rate"])
        lines.append(f"{r['evaluator']:<28} {bar:<20} {r['pass_rate']:6.1%}  score {r['avg_score']:.3f}  n {r['n']}")
    return "\n".join(lines) + "\n"


def failed(cases: DataFrame) -> DataFrame:
    """Evaluated cases that did not pass."""
    return cases.where("status = 'failed_quality'")


def passed(cases: DataFrame) -> DataFrame:
    return cases.where("status = 'passed'")


def sampled(cases: DataFrame, n: int, seed: int = 0, key: str = "case_id") -> DataFrame:
    """n cases chosen by a seeded hash of their key, the same ones whatever the partitions."""
    return cases.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256), key).limit(n)


def by_tag(cases: DataFrame) -> DataFrame:
    """Mean score, pass share and count of every tag; a tag that a case has twice counts twice."""
    tagged = cases.select(F.explode("tags").alias("tag"), "score", (F.col("status") == "passed").alias("ok"))
    return tagged.groupBy("tag").agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"), F.avg(F.col("ok").cast("double")).alias("pass_rate"))


def by_evaluator(results: DataFrame) -> DataFrame:
    """Skipped and failed results are in: they count as their scores say."""
    return results.groupBy("evaluator").agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"), F.avg(F.col("passed").cast("double")).alias("pass_rate"))


def zero_pass(cases: DataFrame) -> DataFrame:
    """Suspects of a broken task: evaluated cases of several runs that never passed, or all, when single runs all failed."""
    done = cases.where(F.col("status").isin(*EVALUATED))
    facts = done.agg(F.max("runs").alias("most"), F.count_if(F.col("status") == "passed").alias("ok"))
    suspect = F.when(F.col("most") > 1, (F.col("runs") > 1) & (F.col("pass_count") == 0)).otherwise(F.col("ok") == 0)
    return done.join(F.broadcast(facts)).where(suspect).drop("most", "ok")


def pass_k(cases: DataFrame, k: int) -> DataFrame:
    """Suite means of any-of-k and all-of-k over evaluated cases; null, with a reason, where a case has fewer runs."""
    done = cases.where(F.col("status").isin(*EVALUATED)).withColumn("n", F.col("runs")).withColumn("c", F.col("pass_count"))
    g = done.agg(F.count("*").alias("n_cases"), F.min("n").alias("runs"), F.avg(stats.any_of_k(F.col("n"), F.col("c"), k)).alias("a"), F.avg(stats.all_of_k(F.col("n"), F.col("c"), k)).alias("h"))
    known = F.coalesce(F.col("runs") >= k, F.lit(False))
    why = F.when(~known, F.when(F.col("n_cases") == 0, "no evaluated case").otherwise("k exceeds the recorded runs"))
    return g.select(F.lit(k).alias("k"), "n_cases", "runs", F.when(known, F.col("a")).alias("pass_at_k"), F.when(known, F.col("h")).alias("pass_hat_k"), why.alias("unknown_reason"))


def lottery(cases: DataFrame, k: int) -> DataFrame:
    """Evaluated cases that pass sometimes, by the gap of any-of-k over all-of-k."""
    n, c = F.col("runs"), F.col("pass_count")
    gap = stats.any_of_k(n, c, k) - stats.all_of_k(n, c, k)
    return cases.where(F.col("status").isin(*EVALUATED)).withColumn("gap", gap).where("gap > 0").orderBy(F.desc("gap"), "case_id")


def decided(passes: Column, n: Column, bound: float = 16.0) -> Column:
    """Whether a sequential test at 0.8 or 0.2 against 0.5 stops after so many passes of n runs."""
    up = F.pow(F.lit(1.6), passes) * F.pow(F.lit(0.4), n - passes)
    down = F.pow(F.lit(0.4), passes) * F.pow(F.lit(1.6), n - passes)
    return (n >= 2) & ((up >= bound) | (down >= bound))


def sprt(runs: DataFrame, bound: float = 16.0) -> DataFrame:
    """case_id, stop_at: the run after which a sequential test at 0.8 or 0.2 against 0.5 could stop, null if it never could."""
    seen = Window.partitionBy("case_id").orderBy("run_no").rowsBetween(Window.unboundedPreceding, 0)
    p, n = F.sum(F.col("passed").cast("int")).over(seen), F.count("*").over(seen)
    met = runs.withColumn("n", n).withColumn("stop", decided(p, n, bound))
    return met.groupBy("case_id").agg(F.min(F.when(F.col("stop"), F.col("n"))).alias("stop_at"))


def budget(cases: DataFrame, costs: DataFrame | None = None, **limits: float) -> DataFrame:
    """name, measured, limit, ok for each of max_p95_latency_ms, max_avg_latency_ms, max_total_cost_usd, max_avg_cost_per_case_usd, max_total_tokens.

    An unknown measure (an unpriced model) never passes.
    """
    n = cases.count()
    p95 = nearest_rank(cases, "latency_ms", 0.95).select(F.lit("max_p95_latency_ms").alias("name"), F.col("latency_ms").cast("double").alias("measured"))
    mean = cases.agg(F.avg("latency_ms").alias("m")).select(F.lit("max_avg_latency_ms"), "m")
    rows = p95.union(mean)
    if costs is not None:
        rows = rows.union(costs.select(F.lit("max_total_cost_usd"), "cost_usd")).union(costs.select(F.lit("max_avg_cost_per_case_usd"), F.col("cost_usd") / max(n, 1))).union(costs.select(F.lit("max_total_tokens"), F.col("tokens").cast("double")))
    wanted = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(float(v)))])
    return rows.withColumn("limit", wanted[F.col("name")]).where(F.col("limit").isNotNull()).withColumn("ok", F.coalesce(F.col("measured") <= F.col("limit"), F.lit(False)))
