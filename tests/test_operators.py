"""Operators on hand-made tables: folding, comparison, gates, lineage, audit, generation, sources, streams."""

import json

import pytest
from pyspark.sql import functions as F

from assaykit.functions import text
from assaykit.operators import audit, calibration, compare, gates, generate, judge, lineage, report, suite
from assaykit.operators import evaluators as ev
from assaykit.sources import sinks, tables
from assaykit.streaming import chain, trials

CASE = "case_id long, input string, output string, expected_output string, expected_tool_calls array<string>, agent_trace array<struct<thought:string,tool_calls:array<struct<name:string,arguments:string,result:string>>,output:string>>"


def scores(spark, evaluator, rows, schema):
    got = ev.score(spark.createDataFrame(rows, schema), [evaluator], ["case_id"]).orderBy("case_id").collect()
    return [(round(r.score, 4), r.passed, r.skipped) for r in got]


def test_evaluator_table(spark):
    s = "case_id long, output string, expected_output string"
    rows = [(1, " Paris ", "paris"), (2, "x", None), (3, None, "a"), (4, "", "")]
    assert scores(spark, ev.exact_match(), rows, s) == [(1.0, True, False), (1.0, True, True), (0.0, False, False), (1.0, True, False)]
    assert scores(spark, ev.not_empty(), [(1, "\u00a0\n", None), (2, "a", None)], s) == [(0.0, False, False), (1.0, True, False)]
    assert scores(spark, ev.contains(["A", "z"]), [(1, "a b", None)], s) == [(0.5, False, False)]
    assert scores(spark, ev.contains([]), [(1, None, None)], s) == [(1.0, True, False)]
    assert scores(spark, ev.regex_match("É+"), [(1, "ééé", None)], s) == [(1.0, True, False)]
    assert scores(spark, ev.starts_with("hi"), [(1, "  Hi there", None)], s) == [(1.0, True, False)]
    assert scores(spark, ev.levenshtein(), [(1, "kitten", "sitting"), (2, "", "")], s) == [(round(1 - 3 / 7, 4), False, False), (1.0, True, False)]
    assert scores(spark, ev.pii_detection(), [(1, "mail a@b.co", None), (2, "hello", None)], s) == [(0.0, False, False), (1.0, True, False)]
    assert scores(spark, ev.schema_compliance({"type": "object"}), [(1, "```json\n{}\n```", None), (2, "[]", None), (3, "no", None)], s) == [(1.0, True, False), (0.9, False, False), (0.0, False, False)]
    assert scores(spark, ev.latency(100.0, ms="v"), [(1, 150.0), (2, 300.0), (3, None)], "case_id long, v double") == [(0.5, False, False), (0.0, False, False), (1.0, True, False)]


TOOLS = [
    (["a", "b"], ["a", "b"], 1.0, 1.0, 1.0), (["b", "a"], ["a", "b"], 1.0, 0.0, 1.0), (["a"], ["a", "b"], 0.5, 0.5, 0.5), (["a", "c"], ["a"], 1.0, 1.0, 0.5), ([], [], 1.0, 1.0, 1.0), (["a"], [], 0.0, 0.0, 0.0), ([], ["a"], 0.0, 0.0, 0.0), (["a", "a"], ["a", "a", "b"], 0.5, 0.6667, 0.5),
]


@pytest.mark.parametrize(("calls", "want", "plain", "ordered", "strict"), TOOLS)
def test_tool_calls(spark, calls, want, plain, ordered, strict):
    trace = [("", [(c, "{}", "") for c in calls], "")]
    row = [(1, "", "", None, want, trace)]
    for e, expected in ((ev.tool_call_accuracy(), plain), (ev.tool_call_accuracy(ordered=True), ordered), (ev.tool_call_accuracy(strict=True), strict)):
        assert scores(spark, e, row, CASE)[0][0] == expected


def test_tool_calls_skip_on_null(spark):
    assert scores(spark, ev.tool_call_accuracy(), [(1, "", "", None, None, []), (2, "", "", None, ["a"], None)], CASE) == [(1.0, True, True), (1.0, True, True)]


RUN = "case_id long, run_no int, score double, passed boolean, latency_ms double, output string, skipped boolean, model_error string, judge_error string, evaluator_error string"


def run(case, no, score=1.0, passed=True, out="o", skipped=False, model=None, judge_=None, evaluator=None):
    return (case, no, score, passed, 1.0, out, skipped, model, judge_, evaluator)


def test_status_precedence_and_folding(spark):
    rows = [
        run(1, 1), run(1, 2, out="last"), run(2, 1), run(2, 2, 0.0, False), run(3, 1, model="first", judge_="j"), run(3, 2, model="second"), run(4, 1, skipped=True, model="m"), run(5, 1, judge_="j", evaluator="e"), run(6, 1, evaluator="e"), run(7, 1, 0.2, False),
    ]
    cases = report.fold_runs(spark.createDataFrame(rows, RUN))
    got = {r.case_id: r for r in cases.collect()}
    assert {k: r.status for k, r in got.items()} == {1: "passed", 2: "failed_quality", 3: "model_error", 4: "skipped", 5: "judge_error", 6: "evaluator_error", 7: "failed_quality"}
    assert got[1].output == "last" and got[3].model_error == "first" and got[2].is_flaky and got[2].score_std == 0.5
    s = report.summary(cases).first()
    assert (s.total, s.evaluated, s.passed, s.failed, s.errors, s.skipped) == (7, 3, 1, 2, 3, 1)
    assert s.pass_rate == pytest.approx(1 / 3) and s.error_rate == pytest.approx(3 / 7) and s.stability == pytest.approx(6 / 7) and s.runs_per_case == 2
    empty = report.summary(cases.where("false")).first()
    assert empty.total == 0 and empty.pass_rate == 0.0 and empty.pass_rate_high == 1.0 and empty.min_detectable_regression == 1.0 and empty.stability == 1.0


def test_a_run_without_results_fails(spark):
    runs = spark.createDataFrame([(1, 1, 0.0, "o", False, None, None, None)], "case_id long, run_no int, latency_ms double, output string, skipped boolean, model_error string, judge_error string, evaluator_error string")
    none = spark.createDataFrame([], "case_id long, run_no int, score double, passed boolean")
    r = report.run_verdicts(runs, none).first()
    assert not r.passed and r.score == 0.0


def test_order_statistics(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 22)], "latency_ms double")
    assert report.nearest_rank(df, "latency_ms", 0.95).first()[0] == 20.0
    g = spark.createDataFrame([("a", s) for s in (0.9, 0.1, 0.5, 0.7)], "evaluator string, score double")
    assert report.lower_order_statistic(g, "evaluator", "score", 0.25).first().score == 0.1
    assert calibration.recommended_thresholds(g, primary=("a",)).first().threshold == 0.5


def test_sprt_and_zero_pass(spark):
    rows = [run(1, i) for i in range(1, 9)] + [run(2, i, 0.0, False) for i in range(1, 9)] + [run(3, i, passed=i % 2 == 0) for i in range(1, 9)]
    df = spark.createDataFrame(rows, RUN)
    assert {r.case_id: r.stop_at for r in report.sprt(df).collect()} == {1: 6, 2: 6, 3: None}
    assert [r.case_id for r in report.zero_pass(report.fold_runs(df)).collect()] == [2]
    assert report.pass_k(report.fold_runs(df), 9).first().unknown_reason == "k exceeds the recorded runs"


REPORT = "case_index long, case_input string, status string, score double"


def test_pairing_with_uneven_duplicates(spark):
    base = spark.createDataFrame([(0, "a", "passed", 1.0), (1, "a", "failed_quality", 0.0), (2, "b", "skipped", 0.0), (3, "gone", "passed", 1.0), (4, "e", "judge_error", 0.0)], REPORT)
    new = spark.createDataFrame([(0, "a", "failed_quality", 0.0), (1, "a", "passed", 1.0), (2, "a", "passed", 1.0), (3, "b", "passed", 1.0), (4, "e", "passed", 1.0)], REPORT)
    got = {(r.case_input, r.occurrence): (r.presence, r.direction) for r in compare.paired(base, new).collect()}
    assert got == {("a", 1): ("both", "regressed"), ("a", 2): ("both", "improved"), ("a", 3): ("added", None), ("b", 1): ("both", "unchanged"), ("gone", 1): ("removed", None), ("e", 1): ("both", "improved")}
    s = compare.diff_summary(compare.paired(base, new)).first()
    assert (s.paired, s.added, s.removed, s.comparable, s.lost, s.gained) == (4, 1, 1, 3, 1, 2)
    assert compare.diff_summary(compare.paired(base.where("false"), new)).first().p_value is None


def test_adjusted_p_values(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.001, 0.040, 0.030, 0.200, 0.800])], "i int, p_value double")
    assert [round(r.p_adjusted, 4) for r in compare.adjusted(df).orderBy("i").collect()] == [0.005, 0.0667, 0.0667, 0.25, 0.8]


def test_calibration(spark):
    df = spark.createDataFrame([("e", 0.9, True), ("e", 0.8, False), ("e", 0.3, True), ("e", 0.1, False)], "evaluator string, score double, label boolean")
    swept = {r.threshold: (r.tp, r.fp, r.fn, r.tn) for r in calibration.sweep(df, [0.2, 0.5, 0.85]).collect()}
    assert swept == {0.2: (2, 1, 0, 1), 0.5: (1, 1, 1, 1), 0.85: (1, 0, 1, 2)}
    assert calibration.best_threshold(calibration.sweep(df, [0.2, 0.5, 0.85])).first().threshold == 0.2
    k = calibration.kappa(spark.createDataFrame([(True, True), (True, False), (False, False), (False, False)], "a boolean, b boolean"), "a", "b").first()
    assert k.kappa == pytest.approx(0.5)
    x = spark.createDataFrame([(1, 10), (2, 20), (2, 15), (3, 30)], "a int, b int")
    assert calibration.spearman(x, "a", "b").first().rho == pytest.approx(0.9487, abs=1e-4)


def test_near_duplicates_keep_the_chain_rule(spark):
    a = [f"t{i}" for i in range(20)]
    chain = [(0, a), (1, [*a[1:], "x"]), (2, [*a[2:], "x", "y"]), (3, ["q", "r"]), (4, a), (5, []), (6, [])]
    df = spark.createDataFrame(chain, "k long, tokens array<string>")
    got = {(r.a, r.b) for r in gates.near_pairs(df, "k", "tokens", 0.85).collect()}
    assert got == {(0, 1), (1, 2), (0, 4), (5, 6)}
    kept = {r.k: r.kept for r in gates.accepted(df, "k", "tokens", 0.85).collect()}
    assert kept == {0: True, 1: False, 2: True, 3: True, 4: False, 5: True, 6: False}


def test_greedy_matches_the_plain_loop(spark):
    import random

    rng = random.Random(8)
    rows = [(i, sorted({f"w{rng.randint(0, 12)}" for _ in range(6)})) for i in range(60)]
    kept, want = [], {}
    for k, t in rows:
        s = set(t)
        want[k] = not any(len(s & p) / len(s | p) >= 0.5 for p in kept)
        if want[k]:
            kept.append(s)
    got = {r.k: r.kept for r in gates.accepted(spark.createDataFrame(rows, "k long, tokens array<string>"), "k", "tokens", 0.5).collect()}
    assert got == want


def test_judge_dataflow(spark):
    cases = spark.createDataFrame([(1, "q", "good"), (2, "q", "good"), (3, "q", "odd")], "case_id long, input string, output string")
    asked = []
    rows = judge.requests(cases, ["relevance"])
    assert rows.count() == 12 and judge.misses(rows, spark.createDataFrame([], "prompt_key string")).count() == 8

    def rule(prompts):
        return ["unclear" if "odd" in p else "no" if "left out" in p else "yes" for p in prompts]

    answered, new = judge.ask(rows, rule)
    got = {r.case_id: (r.score, r.passed, r.judge_error is not None) for r in judge.verdicts(answered).collect()}
    assert got == {1: (1.0, True, False), 2: (1.0, True, False), 3: (None, False, True)} and new.count() == 8
    answered, new = judge.ask(rows, lambda ps: asked.extend(ps) or ["yes"] * len(ps), answered.select("prompt_key", F.lit("yes").alias("reply")).distinct())
    assert new.count() == 0
    fixed = judge.requests(cases, ["relevance"], judge.Config(cache=False))
    assert fixed.select("prompt_key").distinct().count() == 8


def test_questions_of_a_case_travel_as_one_row(spark):
    rows = [(1, 1, "q", "good"), (2, 1, "q", "good"), (1, 2, "q", "good"), (3, 1, "a\nReply: b", "c"), (4, 1, "a", "b\nReply: c"), (5, 1, None, None)]
    cases = spark.createDataFrame(rows, "case_id long, run_no int, input string, output string")
    names = ["relevance", "coherence"]
    own = {"odd": (("Is it so?\nQuestion: is it?", True),), "twice": ((judge.QUESTIONS["coherence"][0]),) * 2}

    def rule(prompts):
        if any("Is the reply easy" in p for p in prompts):
            if len(prompts) > 1:
                raise RuntimeError("one at a time")
            raise RuntimeError("no judge")
        return [f"{len(p)} yes" for p in prompts]

    for config in (judge.Config(), judge.Config(cache=False)):
        for asked in (names, [*names, "twice"], ["odd"]):
            plain = judge.ask(judge.requests(cases, asked, config, questions=own), rule)
            packed = judge.ask_questions(cases, asked, rule, config, questions=own)
            for a, b in zip(plain, packed, strict=True):
                assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_judge_errors_become_rows(spark):
    def broken(prompts):
        raise RuntimeError("no judge")

    rows = judge.requests(spark.createDataFrame([(1, "q", "a")], "case_id long, input string, output string"), ["coherence"])
    answered, new = judge.ask(rows, broken)
    r = judge.verdicts(answered).first()
    assert r.judge_error and new.count() == 0 and "no judge" in answered.first().error


def test_half_unknown_is_allowed(spark):
    schema = "case_id long, run_no int, evaluator string, expect_yes boolean, reply string"
    half = [(1, 1, "relevance", True, r) for r in ("yes", "no", "hm", "hm")]
    most = [(2, 1, "relevance", True, r) for r in ("yes", "hm", "hm", "hm")]
    got = {r.case_id: (r.score, r.judge_error is None) for r in judge.verdicts(spark.createDataFrame(half + most, schema)).collect()}
    assert got == {1: (0.5, True), 2: (None, False)}


def test_retries_and_backoff(spark):
    cases = spark.createDataFrame([(1,), (2,)], "case_id long")

    def attempt(df, i):
        return df.withColumn("status", F.when((F.col("case_id") == 2) & F.lit(i < 1), "judge_error").otherwise("passed"))

    got = {r.case_id: (r.status, r.attempt) for r in judge.with_retries(cases, attempt).collect()}
    assert got == {1: ("passed", 1), 2: ("passed", 2)}
    assert [judge.backoff(i, most=5.0) for i in range(4)] == [1.0, 2.0, 4.0, 5.0]


def _busy():
    """An error class that travels to tasks by value."""

    class Busy(Exception):
        def __init__(self, status):
            super().__init__(f"HTTP {status}")
            self.status = status

    return Busy


def test_retry_classes():
    Busy = _busy()
    assert [judge.retriable(e) for e in (Busy(429), Busy(503), Busy(400), Busy(501), TimeoutError(), ConnectionResetError(), ValueError())] == [True, True, False, False, True, True, False]
    tries, waits = {}, []

    def ask(prompts):
        for p in prompts:
            tries[p] = tries.get(p, 0) + 1
            if p == "late" and tries[p] < 3:
                raise Busy(429)
            if p == "bad":
                raise Busy(400)
        return [p.upper() for p in prompts]

    import pandas as pd

    # The function that a task runs, here in this process, so that the calls can be counted.
    class Frame:
        def mapInPandas(self, f, schema, **_):
            return f

    for prompt, want, n in (("late", "LATE", 3), ("bad", None, 2), ("x", "X", 1)):
        f = judge.called(Frame(), ask, 5, lambda i: waits.append(i) or 0.0)
        out = next(f(iter([pd.DataFrame({"prompt_key": ["k", "l"], "prompt": [prompt, "other"]})])))
        assert out["reply"][0] == want and tries[prompt] == n
    assert waits == [0, 1]


@pytest.mark.parametrize("workers", [1, 4])
def test_one_rate_for_a_whole_job(spark, workers):
    """Starts a second stay under the limit with one task and with several; overloads wait their turn, others don't."""
    Busy = _busy()

    def ask(prompts):
        if prompts[0].endswith("7"):
            raise Busy(503)
        if prompts[0].endswith("3"):
            raise Busy(401)
        return [prompts[0]]

    calls = spark.createDataFrame([(str(i), f"p{i}") for i in range(60)], "prompt_key string, prompt string")
    got = judge.called_at_rate(calls, ask, 40, workers, attempts=2, wait=lambda i: 0.3).collect()
    assert sorted(int(r.prompt_key) for r in got) == list(range(60))
    assert {r.attempts for r in got if r.prompt_key.endswith("7")} == {2}
    assert {r.attempts for r in got if not r.prompt_key.endswith("7")} == {1} and sum(r.error is not None for r in got) == 12
    starts = sorted(r.started for r in got)
    for i, s in enumerate(starts):
        assert sum(s <= t < s + 0.5 for t in starts[i:]) <= 40 * 0.5 + workers
    assert starts[-1] - starts[0] >= (len(starts) - workers) / 40 * 0.9


def test_pii_reasons(spark):
    df = spark.createDataFrame([(1, "mail a@b.example, c@d.example and e@f.example or call"), (2, "nothing")], "k long, output string")
    said = lambda how: {r.k: r.reason for r in ev.score(df, [ev.pii_detection("ccpa", reasons=how)], ["k"]).collect()}
    assert said("names")[1] == "email"
    assert said("redacted") == {1: '  email: "[REDACTED-EMAIL]", "[REDACTED-EMAIL]" (3 match)', 2: ""}
    assert said("shown") == {1: '  email: "a@b.example", "c@d.example" (3 match)', 2: ""}
    with pytest.raises(ValueError):
        ev.pii_detection(reasons="all")


def test_csv_lines_that_end_with_two_characters(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_bytes(b'input,expected_output,tags\r\nq,"a\r\nb",x\r\nr,,\r\n')
    got = [(r.input, r.expected_output, r.tags) for r in tables.cases(spark, str(p)).collect()]
    assert got == [("q", "a\r\nb", ["x"]), ("r", None, [])]


def test_axes_of_tables(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "v string")
    assert generate.axes_of({"x": (df, "v")}) == {"x": ["a", "b"]}
    with pytest.raises(ValueError, match="more than"):
        generate.axes_of({"x": (spark.range(3000), "id")})


def test_case_files_and_verdicts(spark, tmp_path):
    """Case files by name and by content, broken lines with reasons, cases by the state of their provenance."""
    root = tmp_path / "repo"
    target = {"source": "static", "file_path": "a.py", "line": 1, "sdk": "openai", "call_site": "create", "role": "user", "role_position": 0, "qualname": "f", "is_dynamic": False, "fingerprint": "x", "loose_fingerprint": "x"}
    stamp = lambda **k: json.dumps({"input": "q", "metadata": {"_provenance": {"schema_version": 1, "case_uid": "u", **k}}})
    gone = {**target, "qualname": "gone", "fingerprint": "g", "loose_fingerprint": "g"}
    files = {
        "seed_cases.jsonl": ["{broken", "", "[1]", json.dumps({"input": "q"}), stamp(), stamp(targets=[target]), stamp(targets=[target, gone]), stamp(schema_version=9)],
        "deep/evals.jsonl": [stamp(targets=[gone]), json.dumps({"other": 1}), json.dumps({"input": "r"})],
        "deep/log.jsonl": [json.dumps({"event": i}) for i in range(3)] + [json.dumps({"input": "x"})],
        "build/seed_cases.jsonl": [stamp()], ".hidden/seed_cases.jsonl": [stamp()],
    }
    for name, lines in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("\n".join(lines) + "\n")
    lines = lineage.case_lines(spark, str(root))
    assert {(r.file_path, r["index"], r.reason) for r in lines.where("reason is not null").collect()} == {("seed_cases.jsonl", 0, "no JSON"), ("seed_cases.jsonl", 1, "no object")}
    live = spark.createDataFrame([site(0)], "id long, " + lineage.SITE)
    got = {(r.file_path, r["index"]): (r.state, r.status) for r in lineage.case_verdicts(lines, live).collect()}
    assert got == {
        ("seed_cases.jsonl", 0): ("unreadable", None), ("seed_cases.jsonl", 1): ("unreadable", None), ("seed_cases.jsonl", 2): ("unstamped", None), ("seed_cases.jsonl", 3): ("stamped", None),
        ("seed_cases.jsonl", 4): ("bound", "unchanged"), ("seed_cases.jsonl", 5): ("bound", "changed"), ("seed_cases.jsonl", 6): ("unreadable", None),
        ("deep/evals.jsonl", 0): ("bound", "removed"), ("deep/evals.jsonl", 1): ("unstamped", None), ("deep/evals.jsonl", 2): ("unstamped", None),
    }
    skipped = spark.createDataFrame([("a.py",)], "file_path string")
    one = lineage.case_verdicts(lines.where("file_path = 'deep/evals.jsonl' and index = 0"), live, skipped).first()
    assert one.status == "unknown"


def test_costs_are_unknown_with_an_unpriced_model(spark):
    calls = spark.createDataFrame([("p", "m", 10, 1), ("p", "m", 20, 2), ("p", "n", 5, 5)], "provider string, model string, input_tokens long, output_tokens long")
    prices = spark.createDataFrame([("m", 1.0, 2.0)], "model string, input_per_million double, output_per_million double")
    by = judge.costs(calls, prices)
    assert {r.model: r.cost_usd for r in by.collect()} == {"m": 3.6e-05, "n": None}
    assert judge.total_cost(by).first().cost_usd is None and judge.total_cost(by.where("model = 'm'")).first().tokens == 33


def site(i, file="a.py", line=1, name="f", fp="x", loose=None, dynamic=False):
    return (i, file, line, "openai", "create", "user", 0, name, fp, loose or fp, dynamic)


def test_site_matching_scenarios(spark):
    schema = "id long, " + lineage.SITE
    base = [site(0), site(1, name="moved", fp="m", line=5), site(2, name="edited", fp="e", loose="e"), site(3, name="spaces", fp="s1", loose="s"), site(4, file="old.py", name="renamed", fp="r1", loose="r"), site(5, name="dyn", dynamic=True), site(6, name="gone", fp="g"), site(7, file="bad.py", name="b", fp="b"), site(8, name="code", fp="c"), site(9, name="d1", fp="dup", line=10), site(10, name="d2", fp="dup", line=90)]
    live = [site(0), site(1, file="z.py", name="elsewhere", fp="m"), site(2, name="edited", fp="e2", loose="e2"), site(3, name="spaces", fp="s2", loose="s"), site(4, file="new.py", name="renamed", fp="r2", loose="r"), site(5, name="dyn", dynamic=True), site(8, name="code", fp="", dynamic=True), site(20, name="x1", fp="dup", line=88), site(21, name="x2", fp="dup", line=12), site(30, name="fresh", fp="new")]
    b, v = spark.createDataFrame(base, schema), spark.createDataFrame(live, schema)
    got = lineage.match(b, v, spark.createDataFrame([("bad.py",)], "file_path string"))
    rows = {r.id: (r.status, r.label, r.live_id) for r in got.collect()}
    assert rows == {
        0: ("unchanged", "", 0), 1: ("unchanged", "moved", 1), 2: ("changed", "", 2), 3: ("changed", "formatting-only", 3), 4: ("changed", "file-renamed,formatting-only", 4), 5: ("unknown", "dynamic", 5),
        6: ("removed", "", None), 7: ("unknown", "unscannable", None), 8: ("unknown", "became-dynamic", 8), 9: ("unchanged", "moved", 21), 10: ("unchanged", "moved", 20),
    }
    assert [r.id for r in lineage.added(b, v, got).collect()] == [30]


def test_rollup_and_recordings(spark):
    t = spark.createDataFrame([(1, "removed"), (1, "removed"), (2, "removed"), (2, "unchanged"), (3, "unknown"), (3, "unchanged"), (4, "unchanged")], "case_id long, status string")
    assert {r.case_id: r.status for r in lineage.rollup(t).collect()} == {1: "removed", 2: "changed", 3: "unknown", 4: "unchanged"}
    schema = "anchor string, role string, fingerprint string, loose_fingerprint string, count long, first_seen string, last_seen string, case_uids array<string>"
    a = spark.createDataFrame([("s", "u", "f", "l", 2, "2", "3", ["b"])], schema)
    b = spark.createDataFrame([("s", "u", "f", "l", 5, "1", "2", ["a", "b"]), ("s", "u", "g", "l", 1, "9", "9", [])], schema)
    m = {r.fingerprint: r for r in lineage.merge_recordings(a, b).collect()}
    assert (m["f"]["count"], m["f"].first_seen, m["f"].last_seen, m["f"].case_uids) == (7, "1", "3", ["a", "b"])
    once = lineage.runtime_records(b)
    assert lineage.merge_runtime(once, once).collect()[0].observations == once.first().observations
    o = lineage.observed(lineage.runtime_records(a), b).first()
    assert (o.baseline_renderings, o.matched, o.current_renderings, o.new_renderings) == (1, 1, 2, 1)
    assert lineage.bindings(b).count() == 2


def test_source_scan(spark, tmp_path):
    root = tmp_path / "proj"
    (root / "tests").mkdir(parents=True)
    (root / "app.py").write_text('P = "fixed"\n\nclass C:\n    def f(self, client, q):\n        client.chat.completions.create(messages=[{"role": "system", "content": P}, {"role": "user", "content": f"ask {q}"}])\n        client.messages.create(system="be brief", messages=q)\n')
    (root / "bad.py").write_text("def (")
    (root / "tests" / "test_x.py").write_text('client.messages.create(system="t")\n')
    sites, skipped = lineage.scan_sources(spark, str(root))
    got = {(r.role, r.role_position, r.qualname, r.is_dynamic) for r in sites.collect()}
    assert got == {("system", 0, "C.f", False), ("user", 1, "C.f", True), ("messages", 0, "C.f", True)}
    assert [r.reason for r in skipped.collect()] == ["SyntaxError"]


def test_hash_chain(spark):
    lines = audit.chained([{"record_id": str(i)} for i in range(5)])
    verify = lambda ls: [r.verdict for r in audit.verify_chain(spark.createDataFrame(list(enumerate(ls)), "line_no long, value string")).orderBy("line_no").collect()]
    assert verify(lines) == ["ok"] * 5
    assert verify(lines[:2] + lines[3:]) == ["ok", "ok", "chain_broken", "ok"]
    assert verify([lines[0], lines[1].replace('"1"', '"9"'), *lines[2:]]) == ["ok", "tampered", "chain_broken", "ok", "ok"]
    old = {"record_id": "old"}
    legacy = json.dumps({**old, "record_hash": audit.payload_hash(old)})
    assert verify([legacy, "not json", *audit.chained([{"record_id": "n"}], audit.payload_hash(old))]) == ["legacy", "unreadable", "ok"]


def test_locks_and_packages():
    a = audit.lock([{"name": "x", "threshold": 1}], "h")
    b = audit.lock([{"name": "x", "threshold": 2}, {"name": "y"}], "h2")
    assert audit.lock_diff(a, a) == [] and audit.lock_diff(a, b) == ["evaluator y was added", "evaluator x changed", "cases changed"]
    data = audit.package({"log.ndjson": b"1", "a": b"2"})
    assert audit.verify_package(data) == [] and data == audit.package({"a": b"2", "log.ndjson": b"1"})


def test_generation(spark):
    df = spark.createDataFrame([(1, "x" * 2500), (2, "short"), (3, " " * 2500), (4, None)], "k long, t string")
    got = sorted((r.k, r.start, len(r.chunk)) for r in generate.chunks(df, "k", "t", 1000).collect())
    assert got == [(1, 0, 1000), (1, 800, 1000), (1, 1600, 900), (1, 2400, 100), (2, 0, 5)]
    s = spark.range(1).select(generate.span(F.lit("the quick fox"), F.lit(100), F.lit("quick")).alias("s"), generate.span(F.lit("x"), F.lit(0), F.lit("y")).alias("n")).first()
    assert (s.s.start, s.s.end) == (104, 109) and s.n is None
    cases = spark.createDataFrame([(0, "This is a simple sentence, really.", "a"), (1, "no match", None)], "case_index long, input string, expected_output string")
    m, again = (generate.mutated(cases, per_case=2).orderBy("case_index", "mutation", "attempt").collect() for _ in "ab")
    assert m == again and {r.bucket for r in m} <= {"accepted", "duplicate", "malformed"}
    flips = [r for r in m if r.expectation == "flip"]
    assert flips[0].mutant == "This is not a simple sentence, really." and flips[0].expected_output is None and flips[1].bucket == "duplicate"
    assert all(r.bucket == "malformed" for r in m if r.case_index == 1 and r.expectation == "invariant")
    a = gates.accounting(generate.mutated(cases)).first()
    assert a.generated == a.accepted + a.dropped_malformed + a.dropped_duplicate
    with pytest.raises(ValueError, match="unknown"):
        generate.mutated(cases, ["nope"])
    axes = {"a": ["1", "2", "3"], "b": ["x", "y"], "c": ["p", "q", "r"]}
    rows = generate.pairwise(axes)
    from itertools import combinations, product

    for i, j in combinations(range(3), 2):
        assert {(r[i], r[j]) for r in rows} == set(product(list(axes.values())[i], list(axes.values())[j]))
    assert len(rows) < 18
    with pytest.raises(ValueError, match="2000"):
        generate.grid(spark, {k: range(20) for k in "abc"})


def _mutants(spark, name, texts, per_case=1, seed=0):
    cases = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "case_index long, input string, expected_output string")
    found = {}
    for r in generate.mutated(cases, [name], seed, per_case).collect():
        found.setdefault(texts[r.case_index], []).append(r.mutant)
    return found


def test_mutators_change_what_they_may_and_nothing_else(spark):
    said = "Order 12345 cannot ship, because item 678 is late."
    for name in generate.MUTATIONS:
        for out in _mutants(spark, name, [said], 40).get(said, []):
            assert out != said and [c for c in out if c.isdigit()] == [c for c in said if c.isdigit()]
    typos = _mutants(spark, "typo_noise", ["The refund window is thirty days.", "1234567890 999 42", "a b c d", ""], 30)
    assert set(typos) == {"The refund window is thirty days."} and len(set(typos["The refund window is thirty days."])) > 10
    assert all(abs(len(t) - 33) <= 2 and sum(a != b for a, b in zip(t.split(), "The refund window is thirty days.".split(), strict=True)) == 1 for t in typos["The refund window is thirty days."])
    spaces = _mutants(spark, "whitespace_noise", ["hello world again", "   ", "word"], 20)
    assert set(spaces) == {"hello world again", "word"} and all("".join(t.split()) == "helloworldagain" for t in spaces["hello world again"])
    assert {"\t" in t for t in spaces["hello world again"]} == {True, False} and set(spaces["word"]) == {"word  "}
    case = _mutants(spark, "case_noise", ["please cancel my order", "123 456", "AB"], 20)
    assert set(case) == {"please cancel my order", "AB"} and all(t.lower() == k.lower() for k, v in case.items() for t in v)
    looks = _mutants(spark, "unicode_confusable", ["payment account", "000 111"], 20)
    assert set(looks) == {"payment account"} and all(len(t) == 15 and 1 <= sum(a != b for a, b in zip(t, "payment account", strict=True)) <= 3 for t in looks["payment account"])
    marks = _mutants(spark, "punctuation_strip", ["Is this, then, so? ", "no punctuation here", "one, two", "End."], 10)
    assert set(marks["Is this, then, so? "]) == {"Is this, then, so ", "Is this then so? "} and set(marks) == {"Is this, then, so? ", "one, two", "End."}
    flips = {"The plan is active.": "The plan is not active.", "The plan is not active.": "The plan is active.", "You cannot do this thing": "You can do this thing", "I can": "I cannot", "Do not go": "Do go"}
    got = _mutants(spark, "negation_flip", [*flips, "This is fine and that is not fine.", "Hello there friend"])
    assert got == {k: [v] for k, v in flips.items()}
    assert _mutants(spark, "typo_noise", list(typos), 3, 1) != _mutants(spark, "typo_noise", list(typos), 3, 2)


def test_templates(spark):
    axes = {"item": ["a laptop", "a phone", "some shoes"], "when": ["yesterday", "in March"]}
    said = "Refund for {item} bought {when}"
    rows = generate.from_template(spark, said, axes, expected_output="policy for {item}").collect()
    assert len(rows) == 6 and {r.bucket for r in rows} == {"accepted"} and "policy for a phone" in {r.expected_output for r in rows}
    assert "Refund for some shoes bought in March" in {r.input for r in rows}
    few, again = (generate.from_template(spark, said, axes, n=3, seed=1).collect() for _ in "ab")
    assert few == again and len(few) == 3 and all(r.expected_output is None for r in few)
    assert generate.from_template(spark, said, {"item": ["x", "x"], "when": ["y"]}).where("bucket = 'duplicate'").count() == 1
    assert generate.from_template(spark, "{a}", {"a": [" "]}).first().bucket == "malformed"
    for template, have, why in ((said, {"item": ["x"]}, "no axis values"), ("{item}", {"item": ["x"], "extra": ["y"]}, "do not appear"), ("{item}", {"item": []}, "no axis values")):
        with pytest.raises(ValueError, match=why):
            generate.from_template(spark, template, have)
    with pytest.raises(ValueError, match="sample"):
        generate.from_template(spark, "{item}", {"item": ["x"]}, sample="grid")


def test_case_and_trace_readers(spark, tmp_path):
    p = tmp_path / "cases.jsonl"
    p.write_text('{"input": "q1", "tags": ["a", "b"], "context": ["x", "y"]}\n\n{"input": "q2", "expected_output": "e", "context": "c"}\n')
    rows = tables.cases(spark, str(p)).orderBy("case_index").collect()
    assert [(r.input, r.context, r.context_is_list, r.tags) for r in rows] == [("q1", "x\n\ny", True, ["a", "b"]), ("q2", "c", False, [])]
    c = tmp_path / "cases.csv"
    c.write_text('input,expected_output,tags\nq,,"a, b,"\n')
    r = tables.cases(spark, str(c)).first()
    assert (r.input, r.expected_output, r.context, r.tags) == ("q", None, None, ["a", "b"])
    with pytest.raises(ValueError, match="jsonl"):
        tables.cases(spark, "x.txt")
    t = tmp_path / "t.jsonl"
    t.write_text('// note\n# note\n{"query": "q", "answer": "a"}\n{"output": "no input"}\n{"input": "i", "input2": 1}\n{"input": "cut')
    assert [(r.input, r.output) for r in tables.traces(spark, str(t)).collect()] == [("q", "a"), ("i", None)]
    t.write_text('{"input": "a"}\nbroken\n{"input": "b"}\n')
    with pytest.raises(ValueError, match="line 2"):
        tables.traces(spark, str(t))


def test_report_files(spark, tmp_path):
    good = {"summary": {"pass_rate": 0.5}, "cases": [{"input": "q", "passed": True, "runs": 4, "run_pass_rate": 0.5, "evaluators": [{"name": "e", "score": 1.0, "passed": True, "reason": ""}]}]}
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text('{"summary": {}}')
    files = tables.report_files(spark, str(tmp_path))
    assert sorted(r.valid for r in files.collect()) == [False, True]
    c = tables.report_cases(files).first()
    assert (c.case_input, c.status, c.pass_count, c.evaluators[0].name) == ("q", "passed", 2, "e")


def test_recordings_reader(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"anchor": {"f": 1}, "fingerprint": "x", "count": 3}\nnot json\n{"anchor": "s", "fingerprint": "x"}\n{"anchor": {}, "fingerprint": "y", "schema_version": 9}\n{"anchor": {}}\n')
    assert [(r.fingerprint, r["count"]) for r in tables.recordings(spark, str(p)).collect()] == [("x", 3)]


def test_sinks(spark):
    rows = spark.createDataFrame([(1, "failed_quality", [("e", False, "bad \x01 <x>")]), (2, "judge_error", None), (3, "passed", [("e", True, "")]), (4, "skipped", [("e", True, "")])], "case_id long, status string, results array<struct<evaluator:string,passed:boolean,reason:string>>")
    got = sinks.junit_rows(rows)
    assert [(r.case_id, r.evaluator, r.verb) for r in got.orderBy("case_id").collect()] == [(1, "e", "failure"), (2, "case", "error"), (3, "e", "pass"), (4, "e", "skipped")]
    import xml.etree.ElementTree as ET

    tree = ET.fromstring(sinks.junit_xml(got, "s"))
    assert tree.attrib == {"name": "s", "tests": "4", "failures": "1", "errors": "1", "skipped": "1"}
    lines = spark.createDataFrame([(0, '{"input": "a"}'), (1, '{"input": "b", "metadata": {"k":1}}'), (2, '{"input": "c", "metadata": {"provenance":{"x":1}}}'), (3, '{"input":  "kept" }')], "line_no long, value string")
    out = [r.value for r in sinks.stamped(lines, F.col("line_no") < 3, F.lit('{"by":"me"}')).orderBy("line_no").collect()]
    assert json.loads(out[0])["metadata"] == {"provenance": {"by": "me"}} and json.loads(out[1])["metadata"] == {"provenance": {"by": "me"}, "k": 1}
    assert out[2:] == ['{"input": "c", "metadata": {"provenance":{"x":1}}}', '{"input":  "kept" }']


def test_suite_end_to_end(spark, tmp_path):
    cases = spark.createDataFrame([(1, "two", "2"), (2, "three", "3"), (3, "boom", "x")], "case_id long, input string, expected_output string")

    def model(inputs):
        if "boom" in inputs[0]:
            raise ValueError("no")
        return [{"two": "2", "three": "4"}[inputs[0]]]

    s = suite.Suite("sums", [ev.exact_match(), ev.not_empty()])
    folded, results, summary = s.run(cases, model, runs=2)
    assert {r.case_id: r.status for r in folded.collect()} == {1: "passed", 2: "failed_quality", 3: "model_error"}
    assert results.count() == 4
    with pytest.raises(suite.GateFailure, match="below"):
        suite.enforce(summary, fail_threshold=0.9)
    with pytest.raises(suite.GateFailure, match="error rate"):
        suite.enforce(summary, max_error_rate=0.1)
    suite.enforce(summary, fail_threshold=0.5, max_error_rate=0.5)
    log = str(tmp_path / "log")
    by = report.by_evaluator(results)
    for r in ("a", "b"):
        suite.record_run(spark, log, "x", r, summary, by, {"k": "v"})
    back = spark.read.parquet(log)
    assert [r.run_id for r in tables.experiment_history(back, 1).collect()] == ["b"] and suite.experiments(back).first().runs == 2
    per, head = suite.compare_recorded(back, "a", "b")
    assert head.first().delta == 0.0 and {r.verdict for r in per.collect()} == {"no significant change"}


def test_grader_validation(spark):
    schema = "case_id long, input string, expected_output string, reference_output string, pair_id string, bad_output string"
    rows = [(1, "q", "a", "a", "p", None), (2, "q", "b", "c", None, None), (3, "q", "d", None, None, None), (4, "q", "e", "e", "p", "A "), (5, "q", None, "x", None, None)]
    got = {r.case_id: r.status for r in suite.validate(spark.createDataFrame(rows, schema), [ev.exact_match()]).collect()}
    assert got == {1: "no_discrimination", 2: "broken", 3: "unvalidatable", 4: "ok", 5: "unvalidatable"}


def test_presets_and_pairwise(spark):
    assert len(suite.PRESETS) == 14 and all(suite.preset(k).name == k for k in suite.PRESETS)
    v = spark.createDataFrame([("A",), ("a is better",), ("All equal",), ("Tie",), (None,), ("B\nA",)], "reply string")
    r = compare.pairwise(v).first()
    assert (r.wins_a, r.wins_b, r.ties) == (2, 1, 3) and compare.pairwise(v, strict=False).first().wins_a == 3


def test_item_judges(spark):
    cases = spark.createDataFrame([(1, "q", "First sentence is long enough. Second one is long as well.", ["s1", "s2"], ["c1", "c2", "c3"])], "case_id long, input string, output string, samples array<string>, context_chunks array<string>")
    assert judge.context_precision(cases).count() == 3 and judge.consistency(cases).count() == 4
    calls = spark.createDataFrame([(1, "q", [("a", "{}"), ("b", "{}")])], "case_id long, input string, calls array<struct<name:string,arguments:string>>")
    assert [p.prompt.split("\n")[1] for p in judge.tool_necessity(calls).orderBy("q_ord").collect()] == ["Calls so far: ", "Calls so far: a"]
    assert judge.check_questions("be kind", lambda p: ['ok: ["Is it kind?", 3]']) == ["Is it kind?"]
    assert judge.check_questions("be kind", lambda p: ["nothing"]) == ["Does the reply meet this: be kind?"]
    d = judge.draws(spark.createDataFrame([(1, "q", "a")], "case_id long, input string, output string"), "tone")
    assert d.select("prompt_key").distinct().count() == 2
    graded = judge.mean_grade(d.withColumn("reply", F.when(F.col("run_no") == 1, "8/10").otherwise("none")))
    assert graded.first().score == pytest.approx(0.4)


def test_streams_match_batches(spark, tmp_path):
    rows = [(i % 3, i // 3 + 1, f"2024-01-01 0{i % 8}:10:00", i % 3 != 1) for i in range(36)]
    df = spark.createDataFrame(rows, "case_id long, run_no int, ts string, passed boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    got = trials.drain(trials.pass_rate(trials.replay(spark, str(tmp_path / "in"))), "complete", str(tmp_path / "c1"))
    assert sorted(got.collect()) == sorted(trials.pass_rate(df).collect())
    late = trials.drain(trials.pass_rate(trials.replay(spark, str(tmp_path / "in"), 10)), "append", str(tmp_path / "c2"))
    assert set(late.collect()) <= set(trials.pass_rate(df).collect())


def test_sequential_stops_match_the_batch_form(spark, tmp_path):
    rows = [(c, n, (c == 1) or (c == 3 and n % 2 == 0)) for c in (1, 2, 3) for n in range(1, 11)]
    df = spark.createDataFrame(rows, "case_id long, run_no int, passed boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = trials.drain(trials.sequential_stops(trials.replay(spark, str(tmp_path / "in"), 10)), "append", str(tmp_path / "c"))
    want = report.sprt(df).where("stop_at is not null")
    assert sorted((r.case_id, r.stop_at) for r in got.collect()) == sorted((r.case_id, r.stop_at) for r in want.collect())


def test_one_bad_prompt_spoils_its_own_row(spark):
    calls = spark.createDataFrame([(str(i), f"p{i}") for i in range(5)], "prompt_key string, prompt string").coalesce(1)

    def ask(prompts):
        if "p3" in prompts:
            raise ValueError("bad")
        return ["ok"] * len(prompts)

    got = {r.prompt_key: (r.reply, r.error) for r in judge.called(calls, ask).collect()}
    assert got["3"] == (None, "ValueError: bad") and all(got[k] == ("ok", None) for k in "0124")


def _payloads(spark, *seqs):
    return spark.createDataFrame([(i, json.dumps({"record_id": str(i)})) for i in seqs], "seq long, payload string")


def _ids(log):
    return [json.loads(r.value)["record_id"] for r in log.lines().orderBy("line_no").collect()]


def test_stream_chain_writes_each_batch_once(spark, tmp_path):
    """A driver that dies after the commit record and before the stream's own: the batch comes again."""
    for i in range(3):
        _payloads(spark, *range(5 * i, 5 * i + 5)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    at, cp = str(tmp_path / "log"), tmp_path / "cp"
    chain.append_chain(trials.replay(spark, str(tmp_path / "in")), at, str(cp)).awaitTermination()
    log = chain.Log(spark, at)
    first = log.lines().orderBy("line_no").collect()
    assert [r.line_no for r in first] == list(range(15)) and {r.verdict for r in audit.verify_chain(log.lines()).collect()} == {"ok"}
    for f in (cp / "commits").glob("*2*"):
        f.unlink()
    chain.append_chain(trials.replay(spark, str(tmp_path / "in")), at, str(cp)).awaitTermination()
    assert log.lines().orderBy("line_no").collect() == first
    # Another stream goes on where the log is.
    _payloads(spark, 100, 101).write.parquet(str(tmp_path / "more"))
    chain.append_chain(trials.replay(spark, str(tmp_path / "more"), 9), at, str(tmp_path / "cp2")).awaitTermination()
    assert _ids(log)[15:] == ["100", "101"] and {r.verdict for r in audit.verify_chain(log.lines()).collect()} == {"ok"}


def test_chain_faults(spark, tmp_path):
    log, told = chain.Log(spark, str(tmp_path / "log")), []
    assert log.last() is None and log.lines().count() == 0
    log.write(_payloads(spark, 2, 1), "s", 0, lambda *x: told.append(x))
    assert log.write(_payloads(spark), "s", 1) is None
    end = log.write(_payloads(spark, 3), "s", 2)
    assert _ids(log) == ["1", "2", "3"] and told[0][0] == 1 and log.last() == end
    assert log.write(_payloads(spark, 3), "s", 2) == end and _ids(log) == ["1", "2", "3"]
    with pytest.raises(chain.ChainError, match="other lines"):
        log.write(_payloads(spark, 4), "s", 2)
    # A torn append has no record: it isn't seen, and the next one takes its place.
    spark.createDataFrame([(3, "half a li")], "line_no long, value string").write.parquet(str(tmp_path / "log/append=000000000002"))
    assert _ids(log) == ["1", "2", "3"]
    log.write(_payloads(spark, 4), "t", 0)
    assert _ids(log) == ["1", "2", "3", "4"] and {r.verdict for r in audit.verify_chain(log.lines()).collect()} == {"ok"}
    # Two writers: the second finds the number taken.
    with pytest.raises(chain.ChainError, match="another writer"):
        log._record(log.last())
    commits = tmp_path / "log/_commits"
    record = commits / "000000000002.json"
    held = record.read_text()
    for text in ("{", held.replace('"lines": 1', '"lines": 2'), "[]"):
        (commits / ".000000000002.json.crc").unlink(missing_ok=True)
        record.write_text(text)
        with pytest.raises(chain.ChainError):
            log.write(_payloads(spark, 5), "t", 1)
    record.write_text(held)
    assert log.last().number == 2
    (commits / "000000000001.json").unlink()
    with pytest.raises(chain.ChainError, match="missing"):
        log.last()
    for f in (tmp_path / "log/append=000000000002").glob("*.parquet"):
        f.write_bytes(b"no")
    with pytest.raises(Exception):  # noqa: B017 - an unreadable log isn't an empty one
        chain.Log(spark, str(tmp_path / "log")).write(_payloads(spark, 5), "t", 1)


def test_replayed_keeps_cases_beyond_the_log(spark):
    cases = spark.createDataFrame([(7, "a"), (3, "b"), (5, "c")], "case_id long, input string")
    log = spark.createDataFrame([(1, "first")], "seq long, output string")
    assert {r.case_id: (r.run_no, r.output) for r in suite.replayed(cases, log).collect()} == {3: (1, "first"), 5: (1, None), 7: (1, None)}


@pytest.mark.parametrize("runs", [3, 7, 20])
def test_early_stop_equals_the_serial_loop(spark, runs):
    """As many runs, passes and calls for each case as a loop that stops after each run."""
    passes = lambda case, run: (case * 31 + run * run * (case % 3)) % 5 < case % 6

    def ask(rows):
        return ["long enough" if passes(r["case_id"], r["run_no"]) else "short" for r in rows]

    want = {}
    for case in range(40):
        p = n = 0
        while n < runs:
            n, p = n + 1, p + passes(case, n + 1)
            if n >= 2 and max(1.6**p * 0.4 ** (n - p), 0.4**p * 1.6 ** (n - p)) >= 16:
                break
        want[case] = (n, p)
    cases = spark.createDataFrame([(i, "x") for i in range(40)], "case_id long, input string")
    rows, long = suite.Suite("s", [ev.word_count(2, 9)]).stopped_early(cases, suite.CaseModel(ask), runs)
    got = {r.case_id: (r.n, r.p) for r in rows.groupBy("case_id").agg(F.count("*").alias("n"), F.count_if("passed").alias("p")).collect()}
    assert got == want and long.count() == rows.count() == sum(n for n, _ in want.values())
    assert rows.select("case_id", "run_no").distinct().count() == rows.count()


def test_text_helpers_in_gates(spark):
    df = spark.createDataFrame([(1, " ", "x", None), (2, "q", None, '{"expected": "y"}'), (3, "q", "", None)], "k long, input string, expected_output string, metadata string")
    assert [r[0] for r in df.orderBy("k").select(gates.well_formed()).collect()] == [False, True, False]
    dup = spark.createDataFrame([(1, "a  b"), (2, "a b "), (3, "c")], "k long, t string")
    assert [r.duplicate_of for r in gates.exact_duplicates(dup, "t", "k").orderBy("k").collect()] == [None, 1, None]
    assert spark.range(1).select(text.set_jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))).first()[0] == 1.0
