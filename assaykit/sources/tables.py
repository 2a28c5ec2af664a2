"""Readers of cases, traces, reports, experiments, audit logs, recordings and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranks import numbered

CASE = "input string, expected_output string, context string, conversation array<struct<role:string,content:string>>, metadata string, tags array<string>"
#: Names that a trace's fields may have, first that is filled wins.
ALIASES = {
    "input": ("input", "query", "question", "prompt", "user_input", "user_message"),
    "output": ("output", "answer", "completion", "response", "assistant_message"),
    "context": ("context", "retrieved_context", "documents", "passages"),
}
#: Blocks of files whose numbers are sent to all executors at most; beyond, they are joined by a shuffle.
SMALL_SIDE = 100_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 0, in file order over sorted file names) and value of text files.

    Numbers come from the position within a partition and the partitions' sizes.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b")).withColumn("i", F.monotonically_increasing_id())
    sizes = raw.groupBy("f", "b").agg(F.count("*").alias("n"), F.min("i").alias("start"))
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sizes = sizes.select("f", "b", "start", "before")
    small = sizes.limit(SMALL_SIDE + 1).count() <= SMALL_SIDE
    return raw.join(F.broadcast(sizes) if small else sizes, ["f", "b"]).select((F.col("before") + F.col("i") - F.col("start")).alias("line_no"), "value")


def cases_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Cases, one JSON object a line; blank lines are skipped, a list context is joined by blank lines."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    field = lambda k: F.get_json_object("value", f"$.{k}")
    listed = F.from_json(field("context"), "array<string>")
    context = F.when(field("context").startswith("["), F.array_join(listed, "\n\n")).otherwise(field("context"))
    made = numbered(lines, "line_no", name="case_index").select(
        "case_index", field("input").alias("input"), field("expected_output").alias("expected_output"), context.alias("context"),
        F.coalesce(field("context").startswith("["), F.lit(False)).alias("context_is_list"), F.from_json(field("conversation"), "array<struct<role:string,content:string>>").alias("conversation"),
        field("metadata").alias("metadata"), F.coalesce(F.from_json(field("tags"), "array<string>"), F.array().cast("array<string>")).alias("tags"),
    )
    return made


def cases_csv(spark: SparkSession, path: str) -> DataFrame:
    """Cases from CSV with a header: empty fields are null, tags are split at commas. Fields in quotes keep line breaks of any kind."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("lineSep", "\n").csv(path)
    if (end := df.columns[-1]).endswith("\r"):
        # Lines of this file end with two characters, of which the last field has kept one.
        df = df.withColumn(end, F.nullif(F.regexp_replace(F.col(f"`{end}`"), "\r$", ""), F.lit(""))).withColumnRenamed(end, end[:-1])
    for c in ("expected_output", "context", "tags"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    tags = F.filter(F.transform(F.split(F.coalesce("tags", F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
    return df.select("input", F.nullif("expected_output", F.lit("")).alias("expected_output"), F.nullif("context", F.lit("")).alias("context"), tags.alias("tags"))


def cases(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".jsonl"):
        return cases_jsonl(spark, path)
    if path.endswith(".csv"):
        return cases_csv(spark, path)
    raise ValueError(f"cases are read from .jsonl and .csv, not {path}")


def traces(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """All traces that have an input, with aliases folded, in file order; with a cap the first so many.

    Lines that start with // or # are comments. A malformed last line is left out
    (a log may still be written); a malformed line before it is an error.
    """
    lines = numbered_lines(spark, path).where((F.trim("value") != "") & ~F.ltrim("value").rlike("^(//|#)"))
    parsed = lines.withColumn("ok", F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{"))
    facts = parsed.agg(F.max("line_no").alias("last"), F.min(F.when(~F.col("ok"), F.col("line_no"))).alias("bad")).first()
    if facts["bad"] is not None and facts["bad"] < facts["last"]:
        raise ValueError(f"line {facts['bad'] + 1} of {path} is not a JSON object")
    pick = lambda k: F.coalesce(*[F.nullif(F.get_json_object("value", f"$.{a}"), F.lit("")) for a in ALIASES[k]])
    t = parsed.where("ok").select(
        "line_no", *[pick(k).alias(k) for k in ALIASES], F.get_json_object("value", "$.expected_output").alias("expected_output"), F.from_json(F.get_json_object("value", "$.expected_tool_calls"), "array<string>").alias("expected_tool_calls"),
        F.from_json(F.get_json_object("value", "$.conversation"), "array<struct<role:string,content:string>>").alias("conversation"), F.get_json_object("value", "$.metadata").alias("metadata"),
    )
    t = t.where("input is not null").orderBy("line_no")
    return t if cap is None else t.limit(cap)


RESULT = "array<struct<name:string,score:double,passed:boolean,reason:string>>"
REPORT_CASE = f"struct<input:string,output:string,status:string,score:double,runs:int,run_pass_rate:double,all_scores:array<double>,latency_ms:double,tags:array<string>,model_error:string,judge_error:string,evaluator_error:string,skipped:boolean,passed:boolean,evaluators:{RESULT}>"


def is_report(value: Column) -> Column:
    """Whether a JSON text has the shape of a report: a pass rate, and a first case with an input and a verdict."""
    first = F.get_json_object(value, "$.cases[0]")
    verdict = F.coalesce(*[F.get_json_object(first, f"$.{k}") for k in ("status", "passed", "evaluators")])
    return F.coalesce(F.get_json_object(value, "$.summary.pass_rate").isNotNull() & F.get_json_object(first, "$.input").isNotNull() & verdict.isNotNull(), F.lit(False))


def report_files(spark: SparkSession, path: str) -> DataFrame:
    """path, file_index, value and valid of all JSON files under a folder; order by path."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    # Paths are numbered without the files' texts; each file is read again where it lies.
    order = numbered(raw.select("path"), "path", name="file_index")
    return raw.join(order, "path").select("path", "file_index", "value", is_report(F.col("value")).alias("valid"))


def report_cases(files: DataFrame) -> DataFrame:
    """Cases of valid reports; a repeated case's pass count comes from its pass rate, and old files' status from passed."""
    c = files.where("valid").select("path", F.posexplode(F.from_json(F.get_json_object("value", "$.cases"), f"array<{REPORT_CASE}>")).alias("case_index", "c")).select("path", F.col("case_index").cast("long").alias("case_index"), "c.*")
    status = F.coalesce("status", F.when(F.col("skipped"), "skipped").when(F.col("model_error").isNotNull(), "model_error").when(F.col("judge_error").isNotNull(), "judge_error").when(F.col("passed"), "passed").otherwise("failed_quality"))
    count = F.when(F.coalesce("runs", F.lit(1)) > 1, F.bround(F.col("run_pass_rate") * F.col("runs")).cast("int")).otherwise(-1)
    return c.withColumn("status", status).withColumn("pass_count", count).withColumnRenamed("input", "case_input")


def experiment_history(log: DataFrame, n: int = 20) -> DataFrame:
    """Last n runs, newest first, by append order."""
    return log.orderBy(F.desc("seq")).limit(n)


def experiments_jsonl(spark: SparkSession, path: str, n: int = 20) -> DataFrame:
    """The last n runs of a JSON Lines log, newest first by place in the file: line_no, run_id, experiment, pass_rate, total, passed; lines that are no objects go."""
    field = lambda k: F.get_json_object("value", f"$.{k}")
    good = numbered_lines(spark, path).where(F.try_parse_json("value").isNotNull() & F.startswith(F.ltrim("value"), F.lit("{")))
    return good.select("line_no", field("run_id").alias("run_id"), field("experiment").alias("experiment"), field("pass_rate").try_cast("double").alias("pass_rate"), field("total").try_cast("long").alias("total"), field("passed").try_cast("long").alias("passed")).orderBy(F.desc("line_no")).limit(n)


def recordings(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """Prompt recordings; malformed lines, those without an object anchor or fingerprint, and those of later versions go."""
    v = numbered_lines(spark, path)
    field = lambda k: F.get_json_object("value", f"$.{k}")
    good = v.where(F.try_parse_json("value").isNotNull() & field("anchor").startswith("{") & field("fingerprint").isNotNull() & (F.coalesce(field("schema_version").try_cast("int"), F.lit(1)) <= version))
    return good.select(
        field("anchor").alias("anchor"), F.coalesce(field("role"), F.lit("")).alias("role"), field("fingerprint").alias("fingerprint"), field("loose_fingerprint").alias("loose_fingerprint"),
        F.coalesce(field("count").try_cast("long"), F.lit(0)).alias("count"), field("first_seen").alias("first_seen"), field("last_seen").alias("last_seen"), F.coalesce(F.from_json(field("case_uids"), "array<string>"), F.array().cast("array<string>")).alias("case_uids"),
    )


def personas(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema("name string, background string, goal string, style string").json(path)
    return df.dropna(subset=["name", "background", "goal", "style"])
