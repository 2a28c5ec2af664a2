"""Queries over readers and writers: driver tables are written in a format and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import authoring, lineage, report, suite
from ..operators import generate
from ..sources import sinks, tables
from ..storage import new_path
from .base import CASES, PAIRS, rounded, runs, sql_wilson, table, turn_pairs
from .flows import AXES, template_axes

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _file(lines: DataFrame, order: str, ending: str) -> str:
    """Lines in order under a path with an ending. JSON Lines are files whose names sort like their lines, each sorted and written by its own task; others are one file of one task."""
    path, made = new_path(lines.sparkSession) + ending, lines.orderBy(order)
    (made if ending == ".jsonl" else made.coalesce(1)).select("value").write.text(path)
    return path


_KEEP = {"ignoreNullFields": "false"}


@query(f"""WITH {PAIRS} SELECT row_number() OVER (ORDER BY case_id) - 1 AS case_index, input, CASE WHEN turn % 2 = 0 THEN output END AS expected_output, CASE WHEN turn % 3 = 0 THEN input || chr(10) || chr(10) || output ELSE input END AS context,
    turn % 3 = 0 AS context_is_list, array_to_string(tags, ',') AS tags FROM pairs""")
def read_cases_jsonl(spark, sf_dir):
    """Blank lines between cases; contexts as texts and as lists."""
    p, t = turn_pairs(spark, sf_dir), F.col("turn")
    listed = F.to_json(F.struct("input", F.when(t % 2 == 0, F.col("output")).alias("expected_output"), F.array("input", "output").alias("context"), "tags"), _KEEP)
    plain = F.to_json(F.struct("input", F.when(t % 2 == 0, F.col("output")).alias("expected_output"), F.col("input").alias("context"), "tags"))
    lines = p.select("case_id", F.when(t % 3 == 0, listed).otherwise(plain).alias("value"))
    blanks = p.where("turn % 4 = 1").select("case_id", F.lit("  ").alias("value"))
    got = tables.cases(spark, _file(lines.union(blanks), "case_id", ".jsonl"))
    return got.select("case_index", "input", "expected_output", "context", "context_is_list", F.array_join("tags", ",").alias("tags"))


@query("""SELECT doc_id::VARCHAR AS input, CASE WHEN doc_id % 3 <> 0 THEN nullif(text || CASE WHEN doc_id % 5 = 0 THEN chr(13) || chr(10) || 'x' WHEN doc_id % 5 = 1 THEN chr(13) || 'y' ELSE '' END, '') END AS expected_output,
    CASE WHEN doc_id % 2 = 0 THEN source END AS context, lang || ',' || source AS tags FROM documents""")
def read_cases_csv(spark, sf_dir):
    """All texts, some with line breaks of two other kinds added, with quotes and commas; empty fields are null."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 5
    text = F.concat("text", F.when(k == 0, "\r\nx").when(k == 1, "\ry").otherwise(""))
    rows = d.select(F.col("doc_id").cast("string").alias("input"), F.when(F.col("doc_id") % 3 != 0, text).otherwise("").alias("expected_output"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("context"), F.concat("lang", F.lit(" , ,"), "source").alias("tags"))
    path = new_path(spark) + ".csv"
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)
    got = tables.cases(spark, path)
    return got.select("input", "expected_output", "context", F.array_join("tags", ",").alias("tags"))


@query(f"""WITH {PAIRS} SELECT input, nullif(output, '') AS output, CASE WHEN case_id % 3 = 2 THEN input END AS context FROM pairs WHERE case_id % 11 <> 5 AND input <> ''""")
def read_traces(spark, sf_dir):
    """Traces under three sets of field names, with comment lines; those without an input go."""
    p, k = turn_pairs(spark, sf_dir), F.col("case_id") % 3
    named = lambda a, b, *c: F.to_json(F.struct(F.col("input").alias(a), F.col("output").alias(b), *c))
    line = F.when(F.col("case_id") % 11 == 5, F.to_json(F.struct("output"))).when(k == 0, named("query", "answer")).when(k == 1, named("user_message", "completion")).otherwise(named("prompt", "response", F.col("input").alias("retrieved_context")))
    rows = p.select("case_id", line.alias("value")).union(p.where("case_id % 5 = 0").select("case_id", F.when(F.col("case_id") % 2 == 0, "// a note").otherwise("  # a note")))
    return tables.traces(spark, _file(rows, "case_id", ".jsonl"), cap=None).select("input", "output", "context")


def _report_files(spark, sf_dir) -> str:
    """A report a priority of orders, and files that are no reports, each a JSON file of its own."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderkey") % 7 == 0, F.lit(None).cast("string")).otherwise(F.when(F.col("o_orderstatus") == "F", "passed").otherwise("failed_quality"))
    case = F.struct(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("input"), F.lit("x").alias("output"), status.alias("status"), (F.col("o_totalprice") > 100000).alias("passed"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("runs"), F.lit(0.5).alias("run_pass_rate"))
    g = o.groupBy("o_orderpriority").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", case.alias("c")))).alias("x"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("rate"))
    good = g.select(F.struct(F.col("rate").alias("pass_rate")).alias("summary"), F.transform("x", lambda s: s["c"]).alias("cases"), F.substring("o_orderpriority", 1, 1).cast("int").alias("part"))
    bad = spark.range(3).select(F.when(F.col("id") > 0, F.struct(F.lit(0.5).alias("pass_rate"))).alias("summary"), F.when(F.col("id") == 0, F.array(F.struct(F.lit("q").alias("input")))).alias("cases"), (F.col("id") + 10).cast("int").alias("part"))
    path = new_path(spark)
    good.unionByName(bad.select("summary", F.lit(None).cast(good.schema["cases"].dataType).alias("cases"), "part")).repartitionById(16, F.col("part")).select("summary", "cases").write.json(path)
    return path


@query("""WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_totalprice > 100000 THEN 'passed' ELSE 'failed_quality' END WHEN o_orderstatus = 'F' THEN 'passed' ELSE 'failed_quality' END AS status, o_orderkey % 3 + 1 AS runs FROM orders)
    SELECT 'order ' || o_orderkey AS case_input, status, CASE WHEN runs > 1 THEN CAST(round_even(0.5 * runs, 0) AS INT) ELSE -1 END AS pass_count FROM c""")
def read_reports(spark, sf_dir):
    """Cases of all report files in a folder; old cases have no status, files of other shapes are left out."""
    files = tables.report_files(spark, _report_files(spark, sf_dir))
    return tables.report_cases(files).select("case_input", "status", "pass_count")


@query("""SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS nth, s_name AS anchor, CASE WHEN s_suppkey % 2 = 0 THEN 'system' ELSE '' END AS role, sha256(s_name) AS fingerprint, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_nationkey END::BIGINT AS "count", s_suppkey % 4 AS users FROM supplier WHERE s_suppkey % 10 NOT IN (7, 8, 9)""")
def read_recordings(spark, sf_dir):
    """Recordings among broken lines, lines without an anchor and lines of a later version."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    users = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat(F.lit("u"), i.cast("string")))
    rec = lambda *more: F.to_json(F.struct(F.when(k % 10 != 8, F.struct(F.col("s_name").alias("file_path"))).alias("anchor"), F.when(k % 2 == 0, "system").alias("role"), F.sha2("s_name", 256).alias("fingerprint"), F.when(k % 3 != 0, F.col("s_nationkey")).alias("count"), F.filter(users, lambda u: F.substring(u, 2, 1).cast("int") < k % 4).alias("case_uids"), *more))
    line = F.when(k % 10 == 7, F.lit('{"broken": ')).when(k % 10 == 9, rec(F.lit(2).alias("schema_version"))).otherwise(rec())
    path = _file(s.select("s_suppkey", line.alias("value")), "s_suppkey", ".jsonl")
    got = sinks.sequence(tables.recordings(spark, path), "anchor")
    return got.select((F.col("seq") - 1).alias("nth"), F.get_json_object("anchor", "$.file_path").alias("anchor"), "role", "fingerprint", "count", F.size("case_uids").cast("long").alias("users"))


@query("SELECT c_name AS name, c_mktsegment AS background, 'spend ' || c_custkey AS goal, 'plain' AS style FROM customer WHERE c_custkey % 5 <> 0")
def read_personas(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("background"), F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("spend "), F.col("c_custkey").cast("string"))).alias("goal"), F.lit("plain").alias("style"))
    path = new_path(spark)
    rows.write.json(path)
    return tables.personas(spark, path)


def _sites(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select(
        F.concat(F.lit("app/"), (F.col("page_id") % 7).cast("string"), F.lit(".py")).alias("file_path"), F.col("page_id").cast("int").alias("line"), F.lit("openai").alias("sdk"), F.lit("create").alias("call_site"), F.lit("user").alias("role"), F.lit(0).alias("role_position"),
        F.concat(F.lit("f"), F.col("page_id").cast("string")).alias("qualname"), F.sha2("url", 256).alias("fingerprint"), F.sha2(F.lower("url"), 256).alias("loose_fingerprint"), (F.col("page_id") % 9 == 0).alias("is_dynamic"),
    )


@query("SELECT row_number() OVER (ORDER BY 'app/' || (page_id % 7) || '.py', page_id) - 1 AS id, 'app/' || (page_id % 7) || '.py' AS file_path, page_id::INT AS line, sha256(url) AS fingerprint, page_id % 9 = 0 AS is_dynamic FROM pages")
def baseline_round_trip(spark, sf_dir):
    """A baseline written in one step and read back; writing it again replaces it."""
    path = new_path(spark)
    authoring.write_baseline(_sites(spark, sf_dir).limit(1), path)
    authoring.write_baseline(_sites(spark, sf_dir), path)
    return authoring.baseline(spark, path).select("id", "file_path", "line", "fingerprint", "is_dynamic")


@query("SELECT page_id AS line_no, '{\"input\": \"' || page_id || '\"' || CASE page_id % 3 WHEN 0 THEN ', \"metadata\": {\"provenance\": {\"by\":\"me\"}}}' WHEN 1 THEN ', \"metadata\": {\"provenance\": {\"by\":\"me\"}, \"k\":1}}' ELSE '}' END AS value FROM pages")
def stamped_lines(spark, sf_dir):
    """Provenance put into two of three lines; stamping again changes nothing."""
    p = table(spark, sf_dir, "pages")
    body = F.concat(F.lit('{"input": "'), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 1, F.lit('", "metadata": {"k":1}}')).otherwise(F.lit('"}')))
    lines, stamp = p.select(F.col("page_id").alias("line_no"), body.alias("value")), F.lit('{"by":"me"}')
    chosen = F.col("line_no") % 3 != 2
    return sinks.stamped(sinks.stamped(lines, chosen, stamp), chosen, stamp)


@query(f"""WITH {CASES} SELECT case_id AS seq, 'case' AS kind, round(score + 0.0000013::DOUBLE, 4) AS score, round(latency_ms, 1) AS latency_ms, status, model_error IS NULL AS has_null FROM cases
    UNION ALL SELECT -1, 'summary', round(avg(score + 0.0000013::DOUBLE) FILTER (status IN ('passed', 'failed_quality')), 4), NULL, NULL, false FROM cases""")
def report_json(spark, sf_dir):
    """The report as JSON, read back: rates in four places, latency in one, nulls kept. Scores are moved off the ties that engines round apart."""
    cases = report.fold_runs(runs(spark, sf_dir)).withColumn("score", F.col("score") + 0.0000013)
    # Mean latencies on a tie go up, as in SQL, also where a double lies just below it.
    cases = cases.withColumn("latency_ms", F.floor(F.col("latency_ms") * 10 + 0.5) / 10)
    rows = sinks.report_json(cases, report.summary(cases))
    field = lambda k, kind="double": F.get_json_object("json", f"$.{k}").cast(kind)
    return rows.select("seq", "kind", F.coalesce(field("score"), field("avg_score")).alias("score"), field("latency_ms").alias("latency_ms"), field("status", "string").alias("status"), F.contains("json", F.lit('"model_error":null')).alias("has_null"))


@query(f"""WITH {CASES}, g AS (SELECT count(*) AS total, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status IN ('passed', 'failed_quality')) AS evaluated FROM cases)
    SELECT unnest(['second', 'first']) AS run_id, unnest([2, 1])::BIGINT AS seq, total, passed, round(passed::DOUBLE / evaluated, 6) AS pass_rate FROM g""")
def experiment_log(spark, sf_dir):
    """Two runs appended to a log and read newest first."""
    path, cases = new_path(spark), report.fold_runs(runs(spark, sf_dir))
    summary, by = report.summary(cases), report.by_evaluator(cases.select(F.lit("all").alias("evaluator"), "score", (F.col("status") == "passed").alias("passed")))
    for name in ("first", "second"):
        suite.record_run(spark, path, "nightly", name, summary, by, {"by": "query"})
    log = tables.experiment_history(spark.read.parquet(path).where("experiment = 'nightly'"), 2)
    return rounded(log.select("run_id", "seq", "total", "passed", "pass_rate"), "pass_rate")


@query(f"""WITH {CASES} SELECT case_id, status FROM cases ORDER BY sha256('3:' || case_id), case_id LIMIT 50""")
def sampled_cases(spark, sf_dir):
    """Fifty cases by a seeded hash: a sample is the feature."""
    return report.sampled(report.fold_runs(runs(spark, sf_dir)), 50, 3).select("case_id", "status")


@query(f"""WITH {CASES} SELECT case_id, status FROM cases WHERE status IN ('passed', 'failed_quality')""")
def evaluated_cases(spark, sf_dir):
    cases = report.fold_runs(runs(spark, sf_dir))
    return report.passed(cases).union(report.failed(cases)).select("case_id", "status")


@query("""WITH d AS (SELECT doc_id, text, substring(text, 50, 30) AS quote FROM documents), s AS (SELECT *, instr(text, quote) AS pos FROM d WHERE quote <> '')
    SELECT doc_id, (100 + pos - 1)::BIGINT AS "start", (100 + pos - 1 + length(quote))::BIGINT AS "end", sha256(text) AS sha256_chunk FROM s""")
def span_places(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.substring("text", 50, 30).alias("quote")).where("quote != ''")
    s = d.select("doc_id", generate.span(F.col("text"), F.lit(100), F.col("quote")).alias("s")).select("doc_id", "s.*")
    return s.withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")})


@query(f"WITH {AXES} SELECT 'tone' AS a, 'lang' AS b, tone AS av, lang AS bv FROM a, b UNION ALL SELECT 'tone', 'topic', tone, topic FROM a, c UNION ALL SELECT 'lang', 'topic', lang, topic FROM b, c")
def template_pairs_covered(spark, sf_dir):
    """The pairs of values that a pairwise cover holds: all of them, in fewer rows than the product."""
    g = generate.grid(spark, template_axes(spark, sf_dir), "pairwise")
    pair = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("av"), F.col(b).alias("bv"))
    return g.select(F.inline(F.array(pair("tone", "lang"), pair("tone", "topic"), pair("lang", "topic")))).distinct()


_FRESH = "SELECT user_id % 30 AS a, user_id % 20 AS f, event_id, event_type FROM events WHERE event_id % 2 = {h}"


@query(f"""WITH x AS ({_FRESH.format(h=0)}), y AS ({_FRESH.format(h=1)}), p AS (SELECT a, list_sort(list(DISTINCT sha256(f::VARCHAR))) AS fs, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM x GROUP BY a), q AS (SELECT a, list_sort(list(DISTINCT sha256(f::VARCHAR))) AS fs, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM y GROUP BY a)
    SELECT coalesce(p.a, q.a)::VARCHAR AS anchor, array_to_string(list_sort(list_distinct(list_concat(coalesce(p.fs, []), coalesce(q.fs, [])))), ',') AS fingerprints, greatest(coalesce(p.n, 0), coalesce(q.n, 0)) AS observations FROM p FULL JOIN q ON p.a = q.a""")
def runtime_merge(spark, sf_dir):
    """Two sets of observations united; merging the second again changes nothing."""
    e = table(spark, sf_dir, "events")
    half = lambda h: lineage.runtime_records(e.where(F.col("event_id") % 2 == h).groupBy((F.col("user_id") % 30).cast("string").alias("anchor"), F.sha2((F.col("user_id") % 20).cast("string"), 256).alias("fingerprint")).agg(F.count("*").alias("count"), F.min("event_id").alias("first_seen"), F.max("event_id").alias("last_seen"), F.array(F.lit("u")).alias("case_uids")))
    m = lineage.merge_runtime(lineage.merge_runtime(half(0), half(1)), half(1))
    return m.select("anchor", F.array_join("fingerprints", ",").alias("fingerprints"), "observations")


@query("""SELECT page_id::VARCHAR AS call_site_id, CASE WHEN page_id % 11 = 0 THEN 'dynamic' WHEN page_id % 7 = 1 THEN 'removed' WHEN page_id % 5 = 2 THEN 'added' WHEN page_id % 3 = 0 THEN 'modified' END AS change FROM pages
    WHERE page_id % 11 = 0 OR page_id % 7 = 1 OR page_id % 5 = 2 OR page_id % 3 = 0""")
def site_changes(spark, sf_dir):
    p, k = table(spark, sf_dir, "pages"), F.col("page_id")
    side = lambda text: p.select(k.cast("string").alias("call_site_id"), F.sha2(text, 256).alias("fingerprint"), (k % 11 == 0).alias("is_dynamic"), k)
    base = side(F.col("url")).where((k % 11 == 0) | (k % 7 == 1) | (k % 5 != 2)).drop("page_id")
    head = side(F.when(k % 3 == 0, F.lit("new")).otherwise(F.col("url"))).where((k % 11 == 0) | (k % 7 != 1)).drop("page_id")
    return lineage.site_diff(base, head)


@query("""SELECT user_id::VARCHAR AS case_uid, event_type AS anchor, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, user_id % 20 AS f FROM events) GROUP BY ALL""")
def observed_bindings(spark, sf_dir):
    """Proposed bindings of cases to the renderings that they were seen to reach."""
    g = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("anchor"), F.sha2((F.col("user_id") % 20).cast("string"), 256).alias("fingerprint"))
    rec = g.agg(F.lit("").alias("loose_fingerprint"), F.count("*").alias("count"), F.array_sort(F.collect_set(F.col("user_id").cast("string"))).alias("case_uids"))
    return lineage.bindings(rec).groupBy("case_uid", "anchor").agg(F.count("*").alias("n"))


@query("SELECT 'f' || page_id AS qualname FROM pages WHERE page_id % 7 = 3 AND page_id = 10 UNION ALL SELECT 'f' || page_id FROM pages WHERE page_id % 7 = 4")
def named_targets(spark, sf_dir):
    s = _sites(spark, sf_dir)
    return authoring.site_targets(s, "app/3.py:10#f10").select("qualname").union(authoring.site_targets(s, "app/4.py").select("qualname"))


#: White space and line ends of Unicode.
_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


@query(rf"""WITH d AS (SELECT doc_id, text, list_transform(regexp_split_to_array(nfc_normalize(text), '{_BREAKS}'), lambda l: regexp_replace(l, '{_SPACES}$', '')) AS l,
        list_filter(regexp_split_to_array(nfc_normalize(text), '{_SPACES}'), lambda x: x <> '') AS w FROM documents)
    SELECT doc_id, CASE WHEN text IS NOT NULL THEN sha256(regexp_replace(array_to_string(l, chr(10)), '^{_SPACES}|{_SPACES}$', '', 'g')) END AS fingerprint,
        CASE WHEN text IS NOT NULL THEN sha256(array_to_string(w, ' ')) END AS loose_fingerprint FROM d""")
def prompt_fingerprints(spark, sf_dir):
    """Strict and loose fingerprints of all documents."""
    return table(spark, sf_dir, "documents").select("doc_id", lineage.fingerprints(F.col("text")).alias("f")).select("doc_id", "f.*")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS line_no, 'r' || o_orderkey AS run_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS pass_rate, o_custkey AS total FROM orders ORDER BY line_no DESC LIMIT 40")
def read_experiments_jsonl(spark, sf_dir):
    """The newest forty runs of a log with a run for each order, one with a missing field in three, after a broken line."""
    o = table(spark, sf_dir, "orders")
    line = F.to_json(F.struct(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("run_id"), F.lit("nightly").alias("experiment"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("pass_rate"), F.col("o_custkey").alias("total")))
    path = _file(o.select("o_orderkey", line.alias("value")), "o_orderkey", ".jsonl")
    return tables.experiments_jsonl(spark, path, 40).select("line_no", "run_id", "pass_rate", "total")


@query("""WITH p AS (SELECT DISTINCT user_id, event_type FROM events), g AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT user_id::VARCHAR AS case_uid, string_agg(a, ',' ORDER BY k, a) AS anchors FROM (SELECT DISTINCT user_id, 0 AS k, 'click' AS a FROM events UNION ALL SELECT user_id, 1, event_type FROM g WHERE n >= 2 AND event_type <> 'click') GROUP BY user_id""")
def bound_cases(spark, sf_dir):
    """Every case holds a target for clicks; renderings seen twice or more add theirs."""
    e = table(spark, sf_dir, "events")
    seen = e.groupBy(F.col("event_type").alias("anchor"), F.sha2(F.col("user_id").cast("string"), 256).alias("fingerprint")).agg(F.lit("").alias("loose_fingerprint"), F.count("*").alias("count"), F.collect_set(F.col("user_id").cast("string")).alias("case_uids"))
    cases = e.select(F.col("user_id").cast("string").alias("case_uid")).distinct().withColumn("targets", F.array(F.struct(F.lit("click").alias("anchor"), F.lit("own").alias("fingerprint"))))
    out = lineage.bound(cases, lineage.bindings(seen), 2)
    return out.select("case_uid", F.array_join(F.transform("targets", lambda t: t["anchor"]), ",").alias("anchors"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'write to [REDACTED:email] or call' ELSE 'nothing to hide ' || doc_id END AS text FROM documents""")
def sanitised_traces(spark, sf_dir):
    from ..functions import pii

    k = F.col("doc_id")
    said = F.when(k % 2 == 0, F.concat(F.lit("write to u"), k.cast("string"), F.lit("@mail.example or call"))).otherwise(F.concat(F.lit("nothing to hide "), k.cast("string")))
    d = table(spark, sf_dir, "documents").select("doc_id", said.alias("text"))
    return pii.sanitised(pii.sanitised(d, "text", "redact"), "text", "strict")


@query(f"""WITH {CASES}, g AS (SELECT count(*) AS total, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status IN ('passed', 'failed_quality')) AS evaluated, count(*) FILTER (status IN ('model_error', 'judge_error')) AS errors, count(*) FILTER (status = 'skipped') AS skipped FROM cases)
    SELECT row_number() OVER (ORDER BY case_id) AS seq, '<tr class="' || status || '"><td>' || case_id || '</td><td>' || status || '</td>' AS line FROM cases
    UNION ALL SELECT 0, '<!DOCTYPE html><meta charset=utf-8><title>a &lt; b</title><h1>a &lt; b</h1><p>' || passed || ' of ' || evaluated || ' passed, ' || errors || ' errors, ' || skipped || ' skipped</p><table>' FROM g UNION ALL SELECT total + 1, '</table>' FROM g""")
def html_report(spark, sf_dir):
    """The lines of a report's page, without the numbers that engines round apart."""
    cases = report.fold_runs(runs(spark, sf_dir))
    lines = sinks.html_lines(cases, report.summary(cases), "a < b")
    return lines.select("seq", F.regexp_replace("line", r"(?<=</td>)<td>[0-9,.]*</td><td>[0-9,.]*</td></tr>$", "").alias("line"))


@query("""WITH t AS (SELECT conv_id, count(*) FILTER (role = 'user' AND length(trim(text, ' \n')) > 0 AND turn = m) AS n FROM (SELECT *, min(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS m FROM conversations) GROUP BY conv_id)
    SELECT unnest(['cases', 'findings', 'thresholds']) AS part, unnest([CAST(sum(least(n, 1)) AS BIGINT), 4, 2]) AS lines FROM t""")
def bootstrap_files(spark, sf_dir):
    """A suite started from traces: as many cases as traces with an input, four findings, thresholds of two evaluators."""
    from .flows import _traces

    scores = table(spark, sf_dir, "events").where("event_type in ('click', 'view')").select(F.col("event_type").alias("evaluator"), (F.col("value") / 200).alias("score"))
    counts = authoring.bootstrap(_traces(spark, sf_dir), "conv_id", new_path(spark), scores)
    return spark.createDataFrame([(k, v) for k, v in counts.items() if k != "recommendations"], "part string, lines long")


@query("""SELECT 'orders' AS part, sha256('{"record_id":"o' || o_orderkey || '","cents":' || CAST(round(o_totalprice * 100) AS BIGINT) || '}') AS digest FROM orders
    UNION ALL SELECT 'events', sha256('{"record_id":"e' || event_id || '","user":' || coalesce(user_id::VARCHAR, 'null') || '}') FROM events""")
def evidence_package(spark, sf_dir):
    """A package of a record for every order and event, sealed, verified file by file and read back."""
    from ..operators import evidence

    o, e, path = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events"), new_path(spark)
    named = lambda mark, key: F.concat(F.lit(mark), F.col(key).cast("string")).alias("record_id")
    parts = {"orders": o.select(named("o", "o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")), "events": e.select(named("e", "event_id"), F.col("user_id").alias("user"))}
    evidence.write(spark, path, parts)
    read = [evidence.lines(spark, path, n).select(F.lit(n).alias("part"), F.sha2("value", 256).alias("digest")) for n in parts]
    return read[0].unionByName(read[1])


@query("""WITH c AS (SELECT o_orderpriority AS p, CASE WHEN o_orderkey %% 7 = 0 THEN CASE WHEN o_totalprice > 100000 THEN 'passed' ELSE 'failed_quality' END WHEN o_orderstatus = 'F' THEN 'passed' ELSE 'failed_quality' END AS status FROM orders),
    g AS (SELECT p, count(*) AS total, count(*) AS evaluated, count(*) FILTER (status = 'passed') AS passed FROM c GROUP BY p)
    SELECT total, evaluated, passed, 0::BIGINT AS errors, round(passed::DOUBLE / evaluated, 6) AS pass_rate, round(%s, 6) AS low, round(%s, 6) AS high FROM g""" % sql_wilson("passed", "evaluated"))
def report_index(spark, sf_dir):
    """A row for each report of a folder, which holds other files too."""
    files = tables.report_files(spark, _report_files(spark, sf_dir))
    return rounded(report.index(tables.report_cases(files)), "pass_rate", "low", "high").drop("path")


@query("""WITH m AS (SELECT DISTINCT r_name AS control_id, n_name AS evaluator FROM nation JOIN region ON n_regionkey = r_regionkey), u AS (SELECT DISTINCT n_name AS evaluator FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 0),
    c AS (SELECT r_name AS id, 'region ' || r_regionkey AS said, string_agg(u.evaluator, ', ' ORDER BY u.evaluator) AS used FROM region LEFT JOIN m ON r_name = control_id LEFT JOIN u USING (evaluator) GROUP BY ALL),
    p AS (SELECT DISTINCT o_orderpriority AS id FROM orders), x AS (SELECT evaluator FROM u EXCEPT SELECT evaluator FROM m),
    l AS (SELECT 0 AS place, '' AS key, '# nations: ' || count(used) || ' of ' || count(*) || ' measurable controls are exercised' AS line FROM c
        UNION ALL SELECT 1, id, CASE WHEN used IS NULL THEN '- [ ] **' || id || '** ' || said || ' (gap)' ELSE '- [x] **' || id || '** ' || said || ' (by ' || used || ')' END FROM c
        UNION ALL SELECT 2, '', '## Process controls, which no evaluator can satisfy' UNION ALL SELECT 3, id, '- **' || id || '** by hand' FROM p
        UNION ALL SELECT 4, '', '## Evaluators without a control' FROM x HAVING count(*) > 0 UNION ALL SELECT 5, evaluator, '- ' || evaluator FROM x)
    SELECT row_number() OVER (ORDER BY place, key) - 1 AS seq, line FROM l""")
def coverage_page(spark, sf_dir):
    """Regions as controls, nations of suppliers as evaluators, priorities of orders as controls of process."""
    from ..operators import audit

    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    mapping = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("control_id"), F.col("n_name").alias("evaluator"))
    used = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("evaluator"))
    measurable = audit.control_coverage(region.select(F.col("r_name").alias("control_id"), F.concat(F.lit("region "), F.col("r_regionkey").cast("string")).alias("description")), mapping, used)
    process = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("control_id"), F.lit("by hand").alias("description")).distinct()
    return sinks.coverage_lines(measurable.select("control_id", "description", "evaluators", "covered"), process, audit.unmapped(mapping, used), "nations")
