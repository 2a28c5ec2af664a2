"""Comparing two reports case by case, and two experiment runs evaluator by evaluator."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats


def paired(base: DataFrame, new: DataFrame, key: str = "case_input", order: str = "case_index") -> DataFrame:
    """Cases of two reports joined one to one: the n-th of an input with the n-th of the same input.

    presence says both, added or removed; direction says improved, regressed or
    unchanged for pairs. A case skipped on either side is unchanged.
    """
    w = Window.partitionBy(key).orderBy(order)
    side = lambda df, s: df.select(key, F.row_number().over(w).alias("occurrence"), F.col("status").alias(f"{s}_status"), F.col("score").alias(f"{s}_score"))
    x = side(base, "base").join(side(new, "new"), [key, "occurrence"], "full_outer")
    was, now = F.col("base_status") == "passed", F.col("new_status") == "passed"
    presence = F.when(F.col("base_status").isNull(), "added").when(F.col("new_status").isNull(), "removed").otherwise("both")
    skipped = (F.col("base_status") == "skipped") | (F.col("new_status") == "skipped")
    direction = F.when(skipped | (was == now), "unchanged").when(now, "improved").otherwise("regressed")
    return x.withColumn("presence", presence).withColumn("direction", F.when(F.col("presence") == "both", direction))


def diff_summary(pairs: DataFrame) -> DataFrame:
    """Counts, discordant pairs, the paired statistic and its p-value (null without comparable pairs)."""
    both = F.col("presence") == "both"
    live = both & (F.col("base_status") != "skipped") & (F.col("new_status") != "skipped")
    was, now = F.col("base_status") == "passed", F.col("new_status") == "passed"
    g = pairs.agg(
        F.count_if(both).alias("paired"),
        F.count_if(F.col("presence") == "added").alias("added"),
        F.count_if(F.col("presence") == "removed").alias("removed"),
        F.count_if(F.col("direction") == "improved").alias("improved"),
        F.count_if(F.col("direction") == "regressed").alias("regressed"),
        F.count_if(live).alias("comparable"),
        F.count_if(live & was & ~now).alias("lost"),
        F.count_if(live & ~was & now).alias("gained"),
    )
    some = F.col("comparable") > 0
    return g.withColumn("statistic", F.when(some, stats.discordance(F.col("lost"), F.col("gained")))).withColumn("p_value", F.when(some, stats.discordance_p(F.col("lost"), F.col("gained"))))


def adjusted(df: DataFrame, p: str = "p_value", within: list[str] | None = None) -> DataFrame:
    """Adds p_adjusted by the step-up false discovery rule; ties may take either rank, their adjusted values agree."""
    w = Window.partitionBy(*(within or []))
    df = df.withColumn("_r", F.row_number().over(w.orderBy(p))).withColumn("_n", F.count("*").over(w))
    raw = F.least(F.lit(1.0), F.col(p) * F.col("_n") / F.col("_r"))
    return df.withColumn("p_adjusted", F.min(raw).over(w.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0))).drop("_r", "_n")


def compare_runs(a: DataFrame, b: DataFrame, on: str = "evaluator") -> DataFrame:
    """Per evaluator (n, passed, avg_score of two runs): deltas, score intervals of both rates, two-rate test, adjusted p, effect and verdict."""
    side = lambda df, s: df.select(on, *[F.col(c).alias(f"{c}_{s}") for c in ("n", "passed", "avg_score")])
    x = side(a, "a").join(side(b, "b"), on)
    p, q = F.col("passed_a") / F.col("n_a"), F.col("passed_b") / F.col("n_b")
    x = x.withColumn("delta", q - p).withColumn("z", stats.two_rates_z(p, F.col("n_a"), q, F.col("n_b"))).withColumn("p_value", stats.two_rates_p(p, F.col("n_a"), q, F.col("n_b")))
    for s in "ab":
        low, high = stats.wilson(F.col(f"passed_{s}"), F.col(f"n_{s}"))
        x = x.withColumn(f"low_{s}", low).withColumn(f"high_{s}", high)
    x = adjusted(x.withColumn("h", stats.effect_h(p, q)))
    moved = F.col("p_adjusted") < 0.05
    return x.withColumn("verdict", F.when(moved & (F.col("delta") > 0), "improved").when(moved & (F.col("delta") < 0), "regressed").otherwise("no significant change"))


def exit_code(pairs: DataFrame) -> int:
    """1 if any paired case regressed, else 0."""
    return int(bool(pairs.where("direction = 'regressed'").limit(1).count()))


def pairwise(verdicts: DataFrame, reply: str = "reply", strict: bool = True) -> DataFrame:
    """Wins of A and B, ties and the sign-test p-value from replies.

    Strict parsing takes a whole first word A or B; the lenient form takes any first
    line that starts with the letter, so "All equal" would be a win for A.
    """
    line = F.upper(F.trim(F.regexp_extract(F.coalesce(F.col(reply), F.lit("")), r"^[ \t]*([^\n]*)", 1)))
    win = (lambda c: line.rlike(rf"^{c}\b")) if strict else (lambda c: F.startswith(line, F.lit(c)))
    g = verdicts.agg(F.count_if(win("A")).alias("wins_a"), F.count_if(win("B")).alias("wins_b"), F.count_if(~win("A") & ~win("B")).alias("ties"))
    return g.withColumn("p_value", stats.discordance_p(F.col("wins_a"), F.col("wins_b")))
