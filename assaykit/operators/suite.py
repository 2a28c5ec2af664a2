"""Suites: running models over cases, scoring logged outputs, gates, validation, experiments.

A model is a function from a batch of inputs to outputs, or a table of logged
outputs. Model calls are written to the shared folder before they are scored: they
cost money and may not repeat, so no later step may compute them again.
"""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import GateFailure
from ..functions import stats, text
from ..storage import cut, exists
from . import compare, evaluators, judge, report
from .ranks import numbered
from .evaluators import Evaluator

Model = Callable[[list[str]], list[str]]


@dataclass
class CaseModel:
    """A model that wants to know which case and run it is asked for: a function from rows (case_id, run_no, input) to outputs."""

    ask: Callable[[list[dict[str, Any]]], list[str]]



@dataclass
class Suite:
    name: str
    evaluators: list[Evaluator] = field(default_factory=list)
    questions: list[str] = field(default_factory=list)
    judge: judge.Judge | None = None
    purpose: str = ""

    def outputs(self, cases: DataFrame, model: Model | CaseModel, runs: int = 1, span: Column | None = None) -> DataFrame:
        """case_id, run_no, output, latency_ms, model_error: each case asked in its span of run numbers, 1 to ``runs`` if none is given.

        A batch is one call, and its cases share its time; a failing batch is asked case by case.
        """
        rows_model = isinstance(model, CaseModel)
        ask = model.ask if rows_model else model

        def timed(inputs: list[Any]) -> tuple[list[str] | None, float, str | None]:
            began, out, error = time.perf_counter(), None, None
            try:
                out = list(ask(inputs))
                error = None if len(out) == len(inputs) else "an output is missing"
            except Exception as e:  # noqa: BLE001
                error = f"{type(e).__name__}: {e}"
            return out if error is None else None, (time.perf_counter() - began) * 1000, error

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                inputs = pdf.to_dict("records") if rows_model else pdf["input"].tolist()
                out, ms, error = timed(inputs)
                if out is not None or len(inputs) == 1:
                    rows = [(o, ms / len(inputs), error) for o in out or [""]]
                else:
                    rows = [(o[0] if o else "", ms, e) for o, ms, e in (timed([x]) for x in inputs)]
                yield pd.DataFrame({"case_id": pdf["case_id"], "run_no": pdf["run_no"], "output": [r[0] for r in rows], "latency_ms": [r[1] for r in rows], "model_error": [r[2] for r in rows]})

        asked = cases.select("case_id", "input", F.explode((F.sequence(F.lit(1), F.lit(runs)) if span is None else span).cast("array<int>")).alias("run_no"))
        return cut(asked.mapInPandas(run, "case_id long, run_no int, output string, latency_ms double, model_error string"))

    def score(self, cases: DataFrame, outputs: DataFrame, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(runs, long results): free evaluators in one projection, judged ones by distinct calls."""
        for c in ("latency_ms", "model_error"):
            if c not in outputs.columns:
                outputs = outputs.withColumn(c, F.lit(None).cast("double" if c == "latency_ms" else "string"))
        both = cases.join(outputs, "case_id")
        long = evaluators.score(both, self.evaluators, ["case_id", "run_no"], "model_error") if self.evaluators else both.sparkSession.createDataFrame([], f"case_id long, run_no int, {evaluators.RESULT[7:-1]}")
        long = long.select("case_id", "run_no", "evaluator", "score", "passed", "skipped", "reason")
        errors = None
        if self.questions and self.judge:
            open_ = both.where("model_error is null")
            answered, _ = judge.ask_questions(open_, self.questions, self.judge) if cache is None else judge.ask(judge.requests(open_, self.questions), self.judge, cache)
            said = cut(judge.verdicts(answered))
            good = said.where("judge_error is null").select("case_id", "run_no", "evaluator", "score", "passed", F.lit(False).alias("skipped"), F.lit("").alias("reason"))
            bad = said.where("judge_error is not null").select("case_id", "run_no", "evaluator", F.lit(0.0).alias("score"), F.lit(False).alias("passed"), F.lit(False).alias("skipped"), F.col("judge_error").alias("reason"))
            long = long.unionByName(good).unionByName(bad)
            errors = said.groupBy("case_id", "run_no").agg(F.first("judge_error", ignorenulls=True).alias("judge_error"))
        rows = outputs.join(cases.select("case_id"), "case_id", "left_semi")
        rows = rows.join(errors, ["case_id", "run_no"], "left") if errors is not None else rows.withColumn("judge_error", F.lit(None).cast("string"))
        rows = rows.withColumn("evaluator_error", F.lit(None).cast("string")).withColumn("skipped", F.lit(False)).withColumn("latency_ms", F.coalesce("latency_ms", F.lit(0.0)))
        return report.run_verdicts(rows, long), long

    def run(self, cases: DataFrame, model: Model | CaseModel, runs: int = 1, early_stop: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(cases, results by case and evaluator, one-row summary)."""
        if early_stop and runs > 2:
            return self.report(*self.stopped_early(cases, model, runs))
        return self.report(*self.score(cases, self.outputs(cases, model, runs)))

    def stopped_early(self, cases: DataFrame, model: Model | CaseModel, runs: int, bound: float = 16.0) -> tuple[DataFrame, DataFrame]:
        """(runs, long results) of rounds that ask open cases alone.

        A case is open until its sequential test stops, as it would in a loop over its runs. A round
        asks an open case as many runs as its test needs at least to stop, so none is asked in vain and
        rounds are few. A round's runs and results are written before the next begins, and each case's
        passes and trials are kept between rounds, so no run is asked or scored again.
        """
        seen, found, state, open_ = [], [], None, cases.withColumns({"_n": F.lit(0), "_p": F.lit(0)})
        while True:
            k = F.sequence(F.lit(1), F.lit(runs) - F.col("_n"))
            stops = F.filter(k, lambda k: report.decided(F.col("_p") + k, F.col("_n") + k, bound) | report.decided(F.col("_p"), F.col("_n") + k, bound))
            span = F.sequence(F.col("_n") + 1, F.col("_n") + F.coalesce(F.array_min(stops), F.lit(runs) - F.col("_n")))
            rows, long = (cut(x) for x in self.score(cases, self.outputs(open_, model, span=span)))
            seen.append(rows)
            found.append(long)
            tally = rows.groupBy("case_id").agg(F.count("*").alias("_n"), F.count_if("passed").alias("_p"))
            if state is not None:
                tally = tally.unionByName(state).groupBy("case_id").agg(F.sum("_n").alias("_n"), F.sum("_p").alias("_p"))
            state = cut(tally.where(~report.decided(F.col("_p"), F.col("_n"), bound) & (F.col("_n") < runs)))
            if state.isEmpty():
                break
            open_ = cases.join(state, "case_id")
        return functools.reduce(DataFrame.unionByName, seen), functools.reduce(DataFrame.unionByName, found)

    def run_on_outputs(self, cases: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.report(*self.score(cases, outputs))

    @staticmethod
    def report(runs: DataFrame, long: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        folded = cut(report.fold_runs(runs))
        return folded, report.fold_results(long), report.summary(folded)


def replayed(cases: DataFrame, logged: DataFrame, case_order: str = "case_id", log_order: str = "seq") -> DataFrame:
    """case_id, run_no, output: the n-th logged output for the n-th case, both in their own order; cases beyond the log have a null output."""
    x = numbered(cases.select("case_id", case_order) if case_order != "case_id" else cases.select("case_id"), case_order, name="nth")
    y = numbered(logged.select(log_order, "output"), log_order, name="nth").select("nth", "output")
    return x.join(y, "nth", "left").select("case_id", F.lit(1).alias("run_no"), "output")


def enforce(summary: DataFrame, fail_threshold: float | None = None, max_error_rate: float | None = None) -> None:
    """Raises for a report of errors alone, then for its error rate, then for its pass rate. Write reports before."""
    s = summary.first()
    if s["total"] and s["errors"] == s["total"]:
        raise GateFailure("every case ended in an error")
    if max_error_rate is not None and s["error_rate"] > max_error_rate:
        raise GateFailure(f"error rate {s['error_rate']:.4f} is above {max_error_rate}")
    if fail_threshold is not None and s["pass_rate"] < fail_threshold:
        raise GateFailure(f"pass rate {s['pass_rate']:.4f} is below {fail_threshold}")


def head_to_head(cases: DataFrame, a: DataFrame, b: DataFrame, ask: judge.Judge, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(replies, wins and ties) of two sets of outputs put to a judge; a failed call is a tie."""
    x = cases.join(a.select("case_id", F.col("output").alias("a")), "case_id").join(b.select("case_id", F.col("output").alias("b")), "case_id")
    prompt = F.concat(F.lit("Input: "), "input", F.lit("\nA: "), "a", F.lit("\nB: "), "b", F.lit("\nWhich is better? Answer A, B or Tie."))
    rows = x.select("case_id", prompt.alias("prompt")).withColumn("prompt_key", judge.call_hash(F.col("prompt"), judge.Config()))
    answered, _ = judge.ask(rows, ask)
    replies = answered.select("case_id", F.coalesce("reply", F.lit("Tie")).alias("reply"))
    return replies, compare.pairwise(replies, strict=strict)


def self_agreement(rows: DataFrame, ask: judge.Judge, share: float = 0.1, seed: int = 0) -> DataFrame:
    """Agreement of a judge with itself on a seeded share of requests, asked twice."""
    picked = rows.where(F.pmod(F.xxhash64("prompt_key", F.lit(seed)), F.lit(10_000)) < share * 10_000).select("prompt_key", "prompt").dropDuplicates(["prompt_key"])
    x, y = (cut(judge.called(picked, ask)).select("prompt_key", text.verdict(F.col("reply")).alias(n)) for n in "ab")
    return x.join(y, "prompt_key").agg(F.count("*").alias("n"), F.avg(F.col("a").eqNullSafe(F.col("b")).cast("double")).alias("agreement"))


def with_references(cases: DataFrame, make: Model | CaseModel) -> DataFrame:
    """Cases with reference_output and reference_error from a function that makes references.

    Batches are made once and stored. A case without a made reference takes its
    expected_output; a case whose reference could not be made keeps the error and has none.
    """
    made = Suite("references").outputs(cases, make).select("case_id", F.col("output").alias("_made"), F.col("model_error").alias("reference_error"))
    both = cases.drop("reference_output", "reference_error").join(made, "case_id")
    given = F.col("expected_output") if "expected_output" in cases.columns else F.lit(None).cast("string")
    return both.withColumn("reference_output", F.when(F.col("reference_error").isNull(), F.coalesce("_made", given))).drop("_made")


def validate(cases: DataFrame, graders: list[Evaluator], contrast: bool = True) -> DataFrame:
    """case_id, status of each case's reference_output under the suite's graders.

    broken: the reference fails a grader, or could not be made (reference_error, where cases carry it). no_discrimination: a grader passes the
    reference and a known bad output of the case's pair. unvalidatable: no reference
    or no grader that applies. ok otherwise. Cases carry pair_id and bad_output.
    """
    refs = cases.where("reference_output is not null").withColumn("output", F.col("reference_output"))
    state = evaluators.score(refs, graders, ["case_id"]).groupBy("case_id").agg(F.count_if(~F.col("skipped")).alias("executed"), F.count_if(~F.col("skipped") & ~F.col("passed")).alias("failed"), F.collect_set(F.when(~F.col("skipped") & F.col("passed"), F.col("evaluator"))).alias("passing"))
    lenient = None
    if contrast and "pair_id" in cases.columns:
        twins = cases.where("bad_output is not null").select("pair_id", F.col("case_id").alias("twin"), "bad_output")
        bad = cases.drop("bad_output").join(twins, "pair_id").where("twin != case_id").groupBy("case_id").agg(F.min_by("bad_output", "twin").alias("output"))
        other = evaluators.score(cases.drop("output", "bad_output").join(bad, "case_id"), graders, ["case_id"])
        lenient = other.where("passed and not skipped").groupBy("case_id").agg(F.collect_set("evaluator").alias("lenient"))
    unmade = F.col("reference_error") if "reference_error" in cases.columns else F.lit(None).cast("string")
    x = cases.select("case_id", unmade.isNotNull().alias("unmade")).join(state, "case_id", "left")
    x = x.join(lenient, "case_id", "left") if lenient is not None else x.withColumn("lenient", F.lit(None).cast("array<string>"))
    blunt = F.coalesce(F.size(F.array_intersect("passing", "lenient")) > 0, F.lit(False))
    none = F.coalesce(F.col("executed"), F.lit(0)) == 0
    return x.select("case_id", F.when(F.col("unmade") | (F.col("failed") > 0), "broken").when(none, "unvalidatable").when(blunt, "no_discrimination").otherwise("ok").alias("status"))


def record_run(spark: SparkSession, path: str, experiment: str, run_id: str, summary: DataFrame, by_evaluator: DataFrame, tags: dict[str, str] | None = None) -> None:
    """Appends a run to an experiment's log; seq keeps the order of appends. A log that is there but can't be read is an error."""
    last = spark.read.parquet(path).where(F.col("experiment") == experiment).agg(F.max("seq")).first()[0] if exists(spark, path) else None
    seq = (last or 0) + 1
    scores = by_evaluator.agg(F.collect_list(F.struct("evaluator", "n", F.round(F.col("pass_rate") * F.col("n")).cast("long").alias("passed"), "avg_score")).alias("evaluators"))
    tag = F.from_json(F.lit("{%s}" % ", ".join(f'"{k}": "{v}"' for k, v in (tags or {}).items())), "map<string,string>")
    row = summary.select(F.lit(experiment).alias("experiment"), F.lit(run_id).alias("run_id"), F.lit(seq).cast("long").alias("seq"), F.current_timestamp().alias("at"), "total", "evaluated", "passed", "failed", "errors", "pass_rate", "avg_score", "flaky_count", "stability", "runs_per_case", tag.alias("tags"))
    row.join(F.broadcast(scores)).coalesce(1).write.mode("append").parquet(path)


def compare_recorded(log: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """(per evaluator, headline) of two recorded runs; the headline test takes evaluated cases."""
    pick = lambda r: log.where(F.col("run_id") == r)
    flat = lambda r: pick(r).select(F.inline("evaluators"))
    x, y = (pick(r).select(*[F.col(c).alias(f"{c}_{s}") for c in ("evaluated", "passed", "avg_score")]) for r, s in ((a, "a"), (b, "b")))
    p, q = (F.coalesce(F.try_divide(F.col(f"passed_{s}").cast("double"), F.col(f"evaluated_{s}").cast("double")), F.lit(0.0)) for s in "ab")
    p_value = stats.two_rates_p(p, F.col("evaluated_a"), q, F.col("evaluated_b"))
    head = x.join(F.broadcast(y)).select((q - p).alias("delta"), p_value.alias("p_value"), stats.effect_h(p, q).alias("h"), stats.significance(p_value).alias("significance"))
    return compare.compare_runs(flat(a), flat(b)), head


def experiments(log: DataFrame) -> DataFrame:
    return log.groupBy("experiment").agg(F.count("*").alias("runs"), F.max("at").alias("last_run"))


#: Presets: free evaluators and judged questions by product.
PRESETS: dict[str, dict[str, Any]] = {
    "rag": {"free": [evaluators.not_empty], "judged": ["hallucination", "relevance", "context_recall"]},
    "agents": {"free": [evaluators.tool_call_accuracy], "judged": ["plan_quality", "task_completion", "trajectory_efficiency"]},
    "support_bot": {"free": [evaluators.not_empty], "judged": ["relevance", "toxicity", "conversation_completeness"]},
    "summarization": {"free": [evaluators.not_empty], "judged": ["summarization", "hallucination", "coherence"]},
    "document_intelligence": {"free": [evaluators.not_empty, evaluators.pii_detection], "judged": ["hallucination", "answer_accuracy"]},
    "regulated": {"free": [evaluators.pii_detection], "judged": ["hallucination", "toxicity", "bias"]},
    "eu_ai_act_high_risk": {"free": [lambda: evaluators.pii_detection("gdpr")], "judged": ["hallucination", "toxicity", "bias", "coherence"]},
    "hipaa_safe_harbor": {"free": [lambda: evaluators.pii_detection("hipaa")], "judged": ["hallucination", "toxicity"]},
    "chatbot": {"free": [evaluators.not_empty], "judged": ["conversation_relevance", "knowledge_retention", "turn_consistency", "toxicity"]},
    "classification": {"free": [evaluators.exact_match], "judged": []},
    "coding": {"free": [evaluators.not_empty], "judged": ["answer_accuracy"]},
    "medical": {"free": [lambda: evaluators.pii_detection("hipaa")], "judged": ["hallucination", "bias", "toxicity"]},
    "legal": {"free": [evaluators.pii_detection], "judged": ["hallucination", "bias", "coherence"]},
    "financial": {"free": [evaluators.pii_detection], "judged": ["hallucination", "relevance", "bias"]},
}


def preset(kind: str, ask: judge.Judge | None = None) -> Suite:
    p = PRESETS[kind]
    return Suite(kind, [f() for f in p["free"]], list(p["judged"]), ask)


def mean_by_persona(results: DataFrame) -> DataFrame:
    """Goal completion and mean scores of simulated conversations; skipped results count as missing."""
    score = F.when(~F.col("skipped"), F.col("score"))
    return results.groupBy("persona").agg(F.count_distinct("conv_id").alias("conversations"), F.avg(F.col("goal_met").cast("double")).alias("goal_rate"), F.avg(score).alias("avg_score"))


def prior_calls(calls: DataFrame, order: str = "step") -> DataFrame:
    """Adds the names of the calls before each call of a case, as the necessity judge sees them."""
    w = Window.partitionBy("case_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("prior", F.collect_list("name").over(w))
