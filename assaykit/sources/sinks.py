"""Writers of reports, result rows, JUnit files and append-only logs."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import numbered

#: Characters that XML 1.0 doesn't allow.
NOT_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{D800}-\x{DFFF}\x{FFFE}\x{FFFF}]"


def report_json(cases: DataFrame, summary: DataFrame) -> DataFrame:
    """One JSON text a case and one for the summary: kind, seq, json; rates with 4 places, latency with 1, nulls kept."""
    keep = {"ignoreNullFields": "false"}
    shape = lambda df: df.select(*[F.round(c, 1 if c == "latency_ms" else 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    rows = shape(cases).select(F.lit("case").alias("kind"), F.col("case_id").alias("seq"), F.to_json(F.struct("*"), keep).alias("json"))
    return rows.unionByName(shape(summary).select(F.lit("summary").alias("kind"), F.lit(-1).cast("long").alias("seq"), F.to_json(F.struct("*"), keep).alias("json")))


def csv_rows(results: DataFrame) -> DataFrame:
    """One row a (case, evaluator) with shortened texts, ready for CSV."""
    return results.select("case_id", F.substring("input", 1, 200).alias("input"), F.substring("output", 1, 200).alias("output"), F.array_join("tags", ",").alias("tags"), "evaluator", F.round("score", 4).alias("score"), "passed", F.substring("reason", 1, 300).alias("reason"))


def junit_rows(cases: DataFrame) -> DataFrame:
    """One row a (case, evaluator), also for cases without results; the verb comes from the case's status."""
    r = cases.select("case_id", "status", F.explode_outer("results").alias("r"))
    verb = F.when(F.col("status") == "skipped", "skipped").when(F.col("status").isin("model_error", "judge_error", "evaluator_error", "timeout"), "error").when(~F.coalesce("r.passed", F.lit(True)), "failure").otherwise("pass")
    return r.select("case_id", F.coalesce("r.evaluator", F.lit("case")).alias("evaluator"), verb.alias("verb"), xml_text(F.coalesce("r.reason", F.lit(""))).alias("message"))


def xml_text(c: Column) -> Column:
    return F.regexp_replace(c, NOT_XML, "")


def junit_lines(rows: DataFrame, suite: str) -> DataFrame:
    """seq and line of a JUnit document: its head, an element for each row by (case_id, evaluator), its end."""
    quoted = lambda c: F.concat(F.lit('"'), _escaped(c, True), F.lit('"'))
    name = quoted(F.concat(F.col("case_id").cast("string"), F.lit(":"), F.col("evaluator")))
    head = F.concat(F.lit(f"  <testcase classname={quoteattr(suite)} name="), name)
    said = F.concat(head, F.lit("><"), "verb", F.lit(" message="), quoted(F.col("message")), F.lit(">"), _escaped(F.col("message")), F.lit("</"), "verb", F.lit("></testcase>"))
    body = numbered(rows.select("case_id", "evaluator", F.when(F.col("verb") == "pass", F.concat(head, F.lit("/>"))).otherwise(said).alias("line")), "case_id", "evaluator", name="seq", start=1)
    counts = rows.agg(F.count("*").alias("n"), *[F.count_if(F.col("verb") == v).alias(v) for v in ("failure", "error", "skipped")])
    top = F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<testsuite name={quoteattr(suite)} tests="'), "n", F.lit('" failures="'), "failure", F.lit('" errors="'), "error", F.lit('" skipped="'), "skipped", F.lit('">'))
    ends = counts.select(F.inline(F.array(F.struct(F.lit(0).cast("long").alias("seq"), top.alias("line")), F.struct((F.col("n") + 1).alias("seq"), F.lit("</testsuite>").alias("line")))))
    return body.select("seq", "line").unionByName(ends)


def _escaped(c: Column, attribute: bool = False) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;"), ("\r", "&#13;")] if attribute else [])):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def html_lines(cases: DataFrame, summary: DataFrame, title: str) -> DataFrame:
    """seq and line of an HTML page of a report: its numbers, then a table row a case (case_id, status, score, latency_ms), in order."""
    cell = lambda c: F.concat(F.lit("<td>"), _escaped(F.coalesce(c.cast("string"), F.lit(""))), F.lit("</td>"))
    row = F.concat(F.lit('<tr class="'), "status", F.lit('">'), cell(F.col("case_id")), cell(F.col("status")), cell(F.format_string("%.4f", "score")), cell(F.format_string("%.1f", "latency_ms")), F.lit("</tr>"))
    body = numbered(cases.select("case_id", row.alias("line")), "case_id", name="seq", start=1)
    said = F.format_string("%d of %d passed, %d errors, %d skipped", "passed", "evaluated", "errors", "skipped")
    top = F.concat(F.lit("<!DOCTYPE html><meta charset=utf-8><title>"), _escaped(F.lit(title)), F.lit("</title><h1>"), _escaped(F.lit(title)), F.lit("</h1><p>"), said, F.lit("</p><table>"))
    ends = summary.select(F.inline(F.array(F.struct(F.lit(0).cast("long").alias("seq"), top.alias("line")), F.struct((F.col("total") + 1).alias("seq"), F.lit("</table>").alias("line")))))
    return body.select("seq", "line").unionByName(ends)


def _page(body: DataFrame, order: list[str | Column], title: str, intro: DataFrame, heads: tuple[str, ...]) -> DataFrame:
    """seq and line of an HTML page: a heading, the intro's one text, and a table with a row for each line of the body, in order."""
    rows = numbered(body, *order, name="seq", start=1).select("seq", "line")
    top = F.concat(
        F.lit("<!DOCTYPE html><meta charset=utf-8><title>"), _escaped(F.lit(title)), F.lit("</title><h1>"), _escaped(F.lit(title)), F.lit("</h1><p>"),
        _escaped(F.col("said")), F.lit("</p><table><tr>" + "".join(f"<th>{h}</th>" for h in heads) + "</tr>"),
    )
    last = body.agg(F.count("*").alias("n")).select((F.col("n") + 1).alias("seq"), F.lit("</table>").alias("line"))
    return rows.unionByName(intro.select(F.lit(0).cast("long").alias("seq"), top.alias("line"))).unionByName(last)


def _row(mark: Column, *cells: Column) -> Column:
    cell = lambda c: F.concat(F.lit("<td>"), _escaped(F.coalesce(c.cast("string"), F.lit(""))), F.lit("</td>"))
    return F.concat(F.lit('<tr class="'), mark, F.lit('">'), *[cell(c) for c in cells], F.lit("</tr>"))


def diff_lines(pairs: DataFrame, summary: DataFrame, title: str, reasons: DataFrame | None = None) -> DataFrame:
    """seq and line of a page that compares two reports (``compare.paired`` and ``compare.diff_summary``).

    Regressed pairs come first, then improved ones, cases on one side alone and the rest, each by input
    and occurrence. ``reasons`` (case_input, reason) adds why a case of the new report failed.
    """
    kind = F.coalesce("direction", "presence")
    place = F.array_position(F.array(*[F.lit(k) for k in ("regressed", "improved", "removed", "added", "unchanged")]), kind)
    if reasons is not None:
        said = reasons.groupBy("case_input").agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reason"))
        pairs = pairs.join(said, "case_input", "left")
    why = [F.when(F.col("new_status") != "passed", F.col("reason"))] if reasons is not None else []
    line = _row(kind, F.col("case_input"), F.col("occurrence"), F.col("base_status"), F.col("new_status"), *why)
    said = F.concat_ws(", ", *[F.concat(F.col(c).cast("string"), F.lit(f" {c}")) for c in ("paired", "regressed", "improved", "added", "removed")])
    heads = ("input", "occurrence", "base", "new", *(("reason",) if why else ()))
    return _page(pairs.select(place.alias("place"), "case_input", "occurrence", line.alias("line")), ["place", "case_input", "occurrence"], title, summary.select(said.alias("said")), heads)


def directory_lines(index: DataFrame, files: DataFrame, title: str, by: str = "path", descending: bool = False) -> DataFrame:
    """seq and line of a page of the reports of a folder (``report.index``), in the order of one column and then by path; files that are no reports are counted."""
    first = F.desc(by) if descending else F.asc(by)
    percent = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    line = _row(F.lit("report"), F.col("path"), F.col("passed"), F.col("evaluated"), F.col("errors"), percent("pass_rate"), F.concat(percent("low"), F.lit(" to "), percent("high")))
    counts = files.agg(F.count_if("valid").alias("good"), F.count_if(~F.col("valid")).alias("bad"))
    said = F.concat(F.col("good").cast("string"), F.lit(" reports, "), F.col("bad").cast("string"), F.lit(" other files"))
    body = index.select(*dict.fromkeys((by, "path")), line.alias("line"))
    return _page(body, [first, F.asc("path")], title, counts.select(said.alias("said")), ("report", "passed", "evaluated", "errors", "pass rate", "interval"))


def coverage_lines(measurable: DataFrame, process: DataFrame, unmapped: DataFrame, title: str) -> DataFrame:
    """seq and line of a framework's coverage page in Markdown.

    Takes measurable controls (control_id, description, evaluators, covered), process controls
    (control_id, description) and evaluators without a control: three catalogues, small next to the logs they are about.
    """
    shown = F.concat(F.lit("**"), "control_id", F.lit("** "), "description")
    by = F.when(F.col("covered"), F.concat(F.lit(" (by "), F.array_join("evaluators", ", "), F.lit(")"))).otherwise(" (gap)")
    row = lambda df, place, line: df.select(F.lit(place).alias("place"), F.col(df.columns[0]).alias("key"), line.alias("line"))
    text = lambda df, place, line: df.select(F.lit(place).alias("place"), F.lit("").alias("key"), line.alias("line"))
    counts = measurable.agg(F.count("*").alias("n"), F.count_if("covered").alias("c"))
    head = F.concat(F.lit(f"# {title}: "), F.col("c").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" measurable controls are exercised"))
    some = lambda df, place, title: text(df.agg(F.count("*").alias("n")).where("n > 0"), place, F.lit(title))
    parts = [
        text(counts, 0, head), row(measurable, 1, F.concat(F.when(F.col("covered"), "- [x] ").otherwise("- [ ] "), shown, by)),
        some(process, 2, "## Process controls, which no evaluator can satisfy"), row(process, 3, F.concat(F.lit("- "), shown)),
        some(unmapped, 4, "## Evaluators without a control"), row(unmapped, 5, F.concat(F.lit("- "), F.col(unmapped.columns[0]))),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return numbered(every, "place", "key", name="seq").select("seq", "line")


def write_html(cases: DataFrame, summary: DataFrame, title: str, path: str) -> None:
    """The page as one text file in a folder, streamed by one task."""
    html_lines(cases, summary, title).orderBy("seq").select("line").coalesce(1).write.text(path)


def write_junit(rows: DataFrame, suite: str, path: str) -> None:
    """The document as one text file in a folder. Ranges are sorted apart; one task streams them, in order, into the file."""
    junit_lines(rows, suite).orderBy("seq").select("line").coalesce(1).write.text(path)


def junit_xml(rows: DataFrame, suite: str) -> str:
    """The document as a string, for reports that fit one; ``write_junit`` has no such bound."""
    return "\n".join([r["line"] for r in junit_lines(rows, suite).orderBy("seq").toLocalIterator()] + [""])


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def stamped(lines: DataFrame, chosen: Column, stamp: Column) -> DataFrame:
    """line_no and value, where chosen lines that aren't stamped yet get metadata.provenance; all others stay as they are."""
    done = F.get_json_object("value", "$.metadata.provenance").isNotNull()
    at = F.regexp_replace("value", r"\}\s*$", "")
    old = F.get_json_object("value", "$.metadata")
    with_meta = F.concat(at, F.when(F.trim(at) == "{", "").otherwise(", "), F.lit('"metadata": {"provenance": '), stamp, F.lit("}}"))
    merged = F.concat(F.lit('{"provenance": '), stamp, F.when(old == "{}", "}").otherwise(F.concat(F.lit(", "), F.substr(old, F.lit(2)))))
    compact = F.coalesce(old, F.lit(""))
    return lines.withColumn("value", F.when(~chosen | done, F.col("value")).when(old.isNull(), with_meta).when(F.instr("value", compact) > 0, F.replace(F.col("value"), compact, merged)).otherwise(F.col("value")))


def sequence(df: DataFrame, order: str) -> DataFrame:
    """Adds seq, from 1 on, in the given order."""
    return numbered(df, order, name="seq", start=1)
