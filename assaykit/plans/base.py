"""Shared inputs of the query catalogue: driver tables read as cases, trials and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged assistant turns that follow a user turn, as scored cases."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("text").over(w))
    t = t.where("role = 'user' and next_role = 'assistant'")
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("case_id"), "conv_id", "turn", F.col("text").alias("input"), F.col("next_text").alias("output"), F.array(F.concat(F.lit("turn_"), F.col("turn").cast("string")), F.when(F.length("text") > 400, "long").otherwise("short")).alias("tags"))


PAIRS = """pairs AS (SELECT conv_id * 1000 + turn AS case_id, conv_id, turn, text AS input, next_text AS output,
        ['turn_' || turn::VARCHAR, CASE WHEN length(text) > 400 THEN 'long' ELSE 'short' END] AS tags
    FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    WHERE role = 'user' AND next_role = 'assistant')"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as repeated trials: a case is a user's events of one type."""
    e = table(spark, sf_dir, "events")
    kind = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("event_type")) - 1
    w = Window.partitionBy("case_id").orderBy("ts", "event_id")
    return (
        e.withColumn("case_id", F.col("user_id") * 10 + kind)
        .withColumn("run_no", F.row_number().over(w))
        .select(
            "case_id", "run_no", "event_type", "ts",
            F.greatest(F.lit(0.0), 1.0 - F.col("value") / 200.0).alias("score"),
            ((F.col("value") <= 100) & (F.col("value") >= 0.2)).alias("passed"),
            F.col("value").alias("latency_ms"), F.col("props").alias("output"), (F.col("value") < 0.2).alias("skipped"),
            F.when(F.col("value") > 300, "overload").alias("model_error"),
            F.when(F.col("value").between(290, 300), "no verdict").alias("judge_error"),
            F.lit(None).cast("string").alias("evaluator_error"),
        )
    )


RUNS = """runs AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts, event_id) AS run_no FROM (
        SELECT event_id, ts, user_id * 10 + list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS case_id, event_type,
               greatest(0.0::DOUBLE, 1.0::DOUBLE - value / 200.0::DOUBLE) AS score, value <= 100 AND value >= 0.2 AS passed, value AS latency_ms, props AS output, value < 0.2 AS skipped,
               CASE WHEN value > 300 THEN 'overload' END AS model_error, CASE WHEN value BETWEEN 290 AND 300 THEN 'no verdict' END AS judge_error
        FROM events))"""

CASES = RUNS + """, folded AS (SELECT case_id, count(*) AS runs, avg(score) AS score, stddev_pop(score) AS score_std, count(*) FILTER (passed) AS pass_count,
        avg(latency_ms) AS latency_ms, arg_max(output, run_no) AS output, bool_or(skipped) AS skipped,
        arg_min(model_error, run_no) FILTER (model_error IS NOT NULL) AS model_error, arg_min(judge_error, run_no) FILTER (judge_error IS NOT NULL) AS judge_error
    FROM runs GROUP BY case_id),
    cases AS (SELECT *, CASE WHEN skipped THEN 'skipped' WHEN model_error IS NOT NULL THEN 'model_error' WHEN judge_error IS NOT NULL THEN 'judge_error'
        WHEN pass_count = runs THEN 'passed' ELSE 'failed_quality' END AS status, pass_count > 0 AND pass_count < runs AS is_flaky FROM folded)"""


def sql_wilson(p: str, n: str, z: str = "1.959963984540054::DOUBLE") -> tuple[str, str]:
    mid = f"({p}::DOUBLE / {n} + {z} * {z} / (2 * {n}))"
    half = f"({z} * sqrt(({p}::DOUBLE / {n}) * (1 - {p}::DOUBLE / {n}) / {n} + {z} * {z} / (4.0::DOUBLE * {n} * {n})))"
    scale = f"(1 + {z} * {z} / {n})"
    return (f"CASE WHEN {n} > 0 THEN greatest(0.0, ({mid} - {half}) / {scale}) ELSE 0.0 END", f"CASE WHEN {n} > 0 THEN least(1.0, ({mid} + {half}) / {scale}) ELSE 1.0 END")


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})
