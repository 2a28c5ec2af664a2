"""Assertions over cases for test suites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import report
from .operators.suite import Model, Suite


def assert_evaluators(suite: Suite, cases: DataFrame, model: Model | None = None, outputs: DataFrame | None = None, runs: int = 1) -> None:
    """Fails unless every evaluator passes every case by a majority of runs; the message names the first ten that don't.

    Takes a model, asked ``runs`` times a case, or logged outputs (case_id, run_no, output).
    """
    made = outputs if outputs is not None else suite.outputs(cases, model, runs)
    done, long = suite.score(cases, made)
    broken = done.where(F.coalesce("model_error", "judge_error", "evaluator_error").isNotNull()).select("case_id", F.lit("error").alias("evaluator"))
    missed = report.fold_results(long).where("not passed").select("case_id", "evaluator").unionByName(broken).distinct()
    n = missed.count()
    if n:
        first = ", ".join(f"{r['case_id']}:{r['evaluator']}" for r in missed.orderBy("case_id", "evaluator").limit(10).collect())
        raise AssertionError(f"{n} results of {suite.name} failed: {first}")
