"""Calibration against human labels: confusion, thresholds, agreement, rank correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CalibrationMissing
from ..functions import stats
from .ranks import counted


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _rates(g: DataFrame) -> DataFrame:
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return g.withColumn("agreement", F.round(_ratio(F.col("tp") + F.col("tn"), n), 4)).withColumn("precision", F.round(p, 4)).withColumn("recall", F.round(r, 4)).withColumn("f1", F.round(_ratio(2 * p * r, p + r), 4))


def _cells(said: Column, truth: Column) -> list[Column]:
    return [F.count_if(said & truth).alias("tp"), F.count_if(said & ~truth).alias("fp"), F.count_if(~said & truth).alias("fn"), F.count_if(~said & ~truth).alias("tn")]


def confusion(rows: DataFrame, said: str = "passed", truth: str = "label") -> DataFrame:
    """tp, fp, fn, tn and rates for each evaluator, and overall with a null evaluator, in one pass."""
    g = rows.groupingSets([["evaluator"], []], "evaluator").agg(*_cells(F.col(said), F.col(truth)))
    return _rates(g)


#: Thresholds that a sweep tries unless told otherwise.
GRID = tuple(x / 100 for x in range(30, 95, 5))


def sweep(rows: DataFrame, thresholds: Sequence[float] = GRID, score: str = "score", truth: str = "label") -> DataFrame:
    """One row a threshold. Each row meets the thresholds below its score by an index, not by a join:
    counts per number of thresholds reached are summed from above."""
    reached = sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in thresholds), F.lit(0))
    by = rows.groupBy(reached.alias("reached")).agg(F.count_if(F.col(truth)).alias("pos"), F.count_if(~F.col(truth)).alias("neg"))
    every = by.select(F.explode(F.sequence(F.lit(1), F.lit(len(thresholds)))).alias("i"), "reached", "pos", "neg")
    over = F.col("reached") >= F.col("i")
    g = every.groupBy("i").agg(F.sum(F.when(over, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(over, F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(~over, F.col("pos")).otherwise(0)).alias("fn"), F.sum(F.when(~over, F.col("neg")).otherwise(0)).alias("tn"))
    return _rates(g.withColumn("threshold", F.element_at(F.array(*[F.lit(float(t)) for t in sorted(thresholds)]), F.col("i")))).drop("i")


def best_threshold(swept: DataFrame) -> DataFrame:
    """The least threshold with the highest F1."""
    return swept.orderBy(F.desc("f1"), "threshold").limit(1)


def kappa(pairs: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Chance-corrected agreement of two yes-no raters."""
    x, y = F.col(a), F.col(b)
    g = pairs.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg((x == y).cast("double")).alias("observed"), F.avg(x.cast("double")).alias("p"), F.avg(y.cast("double")).alias("q"))
    chance = F.col("p") * F.col("q") + (1 - F.col("p")) * (1 - F.col("q"))
    return g.withColumn("kappa", F.when(chance >= 1, 1.0).otherwise((F.col("observed") - chance) / F.nullif(1 - chance, F.lit(0.0)))).drop("p", "q")


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the rank of each value, ties sharing their mean rank; ranks come from counts per distinct value."""
    return df.join(counted(df, value).select(value, (F.col("before") + (F.col("n") + 1) / 2.0).alias(name)), value)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with mean ranks for ties: n, rho and its two-sided p-value, from the t statistic's normal approximation (good from 30 rows on)."""
    ranked = average_rank(average_rank(df.select(a, b), a, "_ra"), b, "_rb")
    g = ranked.agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("rho"))
    t = F.abs(F.col("rho")) * F.sqrt(F.col("n") - 2) / F.sqrt(1 - F.col("rho") * F.col("rho"))
    return g.withColumn("p_value", F.when(F.abs("rho") >= 1, 0.0).otherwise(stats.tail(t)))


def threshold_for(entries: DataFrame, wanted: DataFrame, fallback: float = 0.7) -> DataFrame:
    """Adds threshold to (evaluator, model) rows from a calibration table, where a model may be known by aliases.

    The table is a dimension of evaluators and judges; Spark broadcasts it if its size allows.
    """
    names = F.explode(F.concat(F.array("model"), F.coalesce("aliases", F.array().cast("array<string>"))))
    known = entries.select("evaluator", names.alias("model"), F.col("threshold").alias("_t")).dropDuplicates(["evaluator", "model"])
    return wanted.join(known, ["evaluator", "model"], "left").withColumn("calibrated", F.col("_t").isNotNull()).withColumn("threshold", F.coalesce("_t", F.lit(fallback))).drop("_t")


def recommended_thresholds(scores: DataFrame, floor: float = 0.5, least: int = 3, primary: tuple[str, ...] = ()) -> DataFrame:
    """Lower quartile of each evaluator's scores by order statistic; primary ones not below the floor; none from under three scores."""
    from .report import lower_order_statistic

    q = lower_order_statistic(scores, "evaluator", "score", 0.25).where(F.col("n") >= least)
    value = F.when(F.col("evaluator").isin(*primary), F.greatest(F.lit(floor), F.col("score"))).otherwise(F.col("score")) if primary else F.col("score")
    return q.select("evaluator", "n", F.round(value, 2).alias("threshold"))


POLICIES = ("silent", "warn", "strict")
#: Environment variables that pin the version and the policy of a run.
VERSION_VARIABLE, POLICY_VARIABLE = "ASSAYKIT_CALIBRATION_VERSION", "ASSAYKIT_CALIBRATION_POLICY"
ENTRY = "evaluator string, model string, aliases array<string>, threshold double, dataset string, n long, f1 double, measured_at string"


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """label and entries of the calibration files NAME.json under a folder, newest label first."""
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).text(folder)
    label = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.json)?(?:/part-[^/]*)?$", 1)
    return raw.select(label.alias("label"), F.from_json(F.get_json_object("value", "$.entries"), f"array<struct<{ENTRY.replace(' string', ':string').replace(' array', ':array').replace(' double', ':double').replace(' long', ':long')}>>").alias("entries")).orderBy(F.desc("label"))


def table_of(found: DataFrame, version: str | None = None) -> DataFrame:
    """Entries of one version of ``versions``: the asked one, else the environment's, else the newest."""
    import os

    version = os.environ.get(VERSION_VARIABLE) or None if version is None else version
    labels = sorted(r["label"] for r in found.select("label").collect())
    if version == "" or version is not None and version not in labels or not labels:
        raise FileNotFoundError(f"no calibration version {version!r}, only {labels}")
    return found.where(F.col("label") == (version or labels[-1])).select(F.inline("entries"))


def resolved(entries: DataFrame, wanted: DataFrame, policy: str | None = None, fallback: float = 0.7) -> DataFrame:
    """``threshold_for`` under a policy for pairs without an entry: silent takes the fallback, warn marks it (column warning), strict raises."""
    import os

    policy = policy or os.environ.get(POLICY_VARIABLE) or "warn"
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}, expected one of {POLICIES}")
    out = threshold_for(entries, wanted, fallback)
    if policy == "strict":
        missing = out.where("not calibrated").select("evaluator", "model").distinct().orderBy("evaluator", "model").limit(5).collect()
        if missing:
            raise CalibrationMissing(", ".join(f"{r['evaluator']} by {r['model']}" for r in missing))
    said = F.when(~F.col("calibrated"), F.concat(F.lit("no calibration of "), "evaluator", F.lit(" by "), "model")) if policy == "warn" else F.lit(None).cast("string")
    return out.withColumn("warning", said)
