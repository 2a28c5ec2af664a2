"""Evidence packages, pages of comparisons, folders and coverage, and references made by a function."""

import json

import pytest

from assaykit.errors import EvidenceError
from assaykit.operators import compare, evidence, report, suite
from assaykit.operators import evaluators as ev
from assaykit.sources import sinks


def page(df):
    rows = df.orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(len(rows)))
    return [r.line for r in rows]


@pytest.fixture
def packed(spark, tmp_path):
    path = str(tmp_path / "package")
    log = spark.range(25).selectExpr("id", "if(id % 2 = 0, concat('é ', id), null) as said").repartition(3, "id")
    return path, evidence.write(spark, path, {"log": log, "empty": log.where("false")}, {"suite": "s"}, rows_per_file=4)


def files(path):
    from pathlib import Path

    return sorted(p for p in Path(path, "data", "log").iterdir() if p.name.endswith(".json") and not p.name.startswith("."))


def test_packages_hold_what_was_written(spark, packed):
    path, record = packed
    assert record["suite"] == "s" and record["parts"] == ["empty", "log"] and record == evidence.record(spark, path)
    assert len(files(path)) >= 7 and {r.verdict for r in evidence.verify(spark, path).collect()} == {"ok"}
    got = sorted((json.loads(r.value) for r in evidence.lines(spark, path, "log").collect()), key=lambda r: r["id"])
    assert got == [{"id": i, "said": f"é {i}" if i % 2 == 0 else None} for i in range(25)]
    assert evidence.lines(spark, path, "empty").count() == 0
    with pytest.raises(EvidenceError, match="already"):
        evidence.write(spark, path, {})
    with pytest.raises(EvidenceError, match="no part"):
        evidence.lines(spark, path, "other")


def test_changed_missing_and_extra_files_are_named(spark, packed):
    path, _ = packed
    first, second, *_ = files(path)
    first.write_text(first.read_text().replace('"id"', '"ID"'))
    (first.parent / f".{first.name}.crc").unlink(missing_ok=True)
    second.rename(second.with_name("part-new.json"))
    seen = {r.verdict: r.file for r in evidence.verify(spark, path).where("verdict != 'ok'").collect()}
    assert seen == {"changed": first.name, "missing": second.name, "extra": "part-new.json"}
    with pytest.raises(EvidenceError, match="log/"):
        evidence.lines(spark, path, "log")
    assert evidence.lines(spark, path, "empty").count() == 0


def test_a_changed_manifest_and_a_package_without_a_record_are_errors(spark, packed, tmp_path):
    from pathlib import Path

    path, _ = packed
    for p in Path(path, "manifest").glob("*.json"):
        p.write_text(p.read_text().replace('"sha256":"', '"sha256":"0'))
        (p.parent / f".{p.name}.crc").unlink(missing_ok=True)
    with pytest.raises(EvidenceError, match="sealed"):
        evidence.verify(spark, path)
    Path(path, "package.json").unlink()
    with pytest.raises(EvidenceError, match="never finished"):
        evidence.record(spark, path)
    with pytest.raises(EvidenceError, match="name of a part"):
        evidence.write(spark, str(tmp_path / "other"), {"a/b": spark.range(1)})
    assert not (tmp_path / "other").exists()


def test_packages_without_rows_or_parts(spark, tmp_path):
    record = evidence.write(spark, str(tmp_path / "none"), {})
    assert record["files"] == 0 and record["bytes"] == 0
    assert evidence.verify(spark, str(tmp_path / "none")).count() == 0


def test_equal_files_have_one_hash_whatever_the_order_of_the_manifest(spark):
    rows = [("a", f"f{i:05d}", i, f"h{i}") for i in range(9000)]
    make = lambda r: evidence._sealed(spark.createDataFrame(r, evidence.MANIFEST))
    assert make(rows) == make(rows[::-1]) and make(rows)["manifest"] != make(rows[:-1])["manifest"]


def test_page_of_a_comparison_puts_regressions_first_and_says_why(spark):
    schema = "case_input string, case_index long, status string, score double"
    base = spark.createDataFrame([("a", 0, "passed", 1.0), ("b<", 1, "failed_quality", 0.0), ("c", 2, "passed", 1.0), ("d", 3, "passed", 1.0), ("a", 4, "passed", 1.0)], schema)
    new = spark.createDataFrame([("a", 0, "failed_quality", 0.0), ("b<", 1, "passed", 1.0), ("d", 3, "passed", 1.0), ("e", 5, "passed", 1.0), ("a", 6, "passed", 1.0)], schema)
    pairs = compare.paired(base, new)
    why = spark.createDataFrame([("a", "too short"), ("a", "no & and"), ("a", "too short"), ("b<", "old")], "case_input string, reason string")
    lines = page(sinks.diff_lines(pairs, compare.diff_summary(pairs), "x", why))
    assert "4 paired, 1 regressed, 1 improved, 1 added, 1 removed" in lines[0] and lines[-1] == "</table>"
    assert lines[1] == '<tr class="regressed"><td>a</td><td>1</td><td>passed</td><td>failed_quality</td><td>no &amp; and; too short</td></tr>'
    assert lines[2] == '<tr class="improved"><td>b&lt;</td><td>1</td><td>failed_quality</td><td>passed</td><td></td></tr>'
    assert [x.split('"')[1] for x in lines[3:-1]] == ["removed", "added", "unchanged", "unchanged"]
    none = compare.paired(base.where("false"), new.where("false"))
    assert len(page(sinks.diff_lines(none, compare.diff_summary(none), "x"))) == 2


def test_page_of_a_folder_sorts_reports_by_a_column(spark):
    cases = spark.createDataFrame([("p1", s) for s in ["passed"] * 3 + ["failed_quality", "skipped"]] + [("p2", s) for s in ("passed", "judge_error")], "path string, status string")
    index = report.index(cases)
    assert {r.path: (r.total, r.evaluated, r.passed, r.errors, r.pass_rate) for r in index.collect()} == {"p1": (5, 4, 3, 0, 0.75), "p2": (2, 1, 1, 1, 1.0)}
    files = spark.createDataFrame([("p1", True), ("p2", True), ("x", False)], "path string, valid boolean")
    lines = page(sinks.directory_lines(index, files, "runs", "pass_rate", descending=True))
    assert "2 reports, 1 other files" in lines[0] and ["p2" in lines[1], "p1" in lines[2]] == [True, True]
    assert lines[2].startswith('<tr class="report"><td>p1</td><td>3</td><td>4</td><td>0</td><td>75.0%</td>')
    assert "p1" in page(sinks.directory_lines(index, files, "runs"))[1]


def test_coverage_page(spark):
    m = spark.createDataFrame([("c2", "two", None, False), ("c1", "one", ["e1", "e2"], True)], "control_id string, description string, evaluators array<string>, covered boolean")
    p = spark.createDataFrame([("p", "by hand")], "control_id string, description string")
    u = spark.createDataFrame([("e9",)], "evaluator string")
    lines = page(sinks.coverage_lines(m, p, u, "law"))
    assert lines[:3] == ["# law: 1 of 2 measurable controls are exercised", "- [x] **c1** one (by e1, e2)", "- [ ] **c2** two (gap)"]
    assert lines[3:] == ["## Process controls, which no evaluator can satisfy", "- **p** by hand", "## Evaluators without a control", "- e9"]
    assert page(sinks.coverage_lines(m.where("false"), p.where("false"), u.where("false"), "law")) == ["# law: 0 of 0 measurable controls are exercised"]


def test_references_are_made_fall_back_or_break_a_case(spark):
    cases = spark.createDataFrame([(1, "a", "x"), (2, "bad", "x"), (3, "none", "yes"), (4, "none", None), (5, None, "yes")], "case_id long, input string, expected_output string")

    def make(inputs):
        if "bad" in inputs:
            raise ValueError("no reference")
        return [None if i in ("none", None) else f"yes {i}" for i in inputs]

    with_refs = suite.with_references(cases, make)
    assert {r.case_id: (r.reference_output, r.reference_error) for r in with_refs.collect()} == {
        1: ("yes a", None), 2: (None, "ValueError: no reference"), 3: ("yes", None), 4: (None, None), 5: ("yes", None),
    }
    got = {r.case_id: r.status for r in suite.validate(with_refs, [ev.contains(["yes"])], contrast=False).collect()}
    assert got == {1: "ok", 2: "broken", 3: "ok", 4: "unvalidatable", 5: "ok"}
