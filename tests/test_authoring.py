"""Recommendations, trace folding, written cases, simulated talks, baselines and drift reports."""

import json

import pytest
from pyspark.sql import functions as F

from assaykit.operators import authoring, report, suite


def test_recommendations(spark):
    schema = "case_id long, input string, context string, expected_output string, conversation array<struct<role:string,content:string>>, expected_tool_calls array<string>"
    rows = [(1, "q", "c", None, None, None), (2, "q", None, "e", None, None), (3, "q", "c", "e", [("user", "x")], None), (4, " ", None, None, None, None), (5, "q", None, None, None, []), (6, "q", None, None, None, None)]
    got = authoring.recommended(spark.createDataFrame(rows, schema), include_pii=True)
    first = {r.case_id: (r.task, r.evaluator, r.confidence) for r in got.where("rank = 0").collect()}
    assert first == {1: ("rag", "faithfulness", "high"), 2: ("qa", "answer_accuracy", "high"), 3: ("conversation", "conversation_relevance", "low"), 5: ("agent", "tool_call_accuracy", "high"), 6: ("open", "relevance", "low")}
    assert got.where("evaluator = 'pii_detection' and tier = 'guardrail'").count() == 5


def test_steps(spark):
    spans = spark.createDataFrame([(1, i, k, n) for i, (k, n) in enumerate([("llm", ""), ("tool", "a"), ("tool", "b"), ("llm", ""), ("llm", ""), ("tool", "c")])], "trace_id long, seq long, kind string, name string")
    assert [(r.step_no, r.calls) for r in authoring.steps(spans).orderBy("step_no").collect()] == [(1, ["a", "b"]), (2, ["c"])]
    items = spark.createDataFrame([(1, i, k) for i, k in enumerate(["message", "message", "call", "output", "message", "call"])], "trace_id long, seq long, kind string")
    assert [r.step_no for r in authoring.message_steps(items).orderBy("seq").collect()] == [1, 1, 1, 1, 2, 2]


def test_written_cases_are_gated(spark):
    reply = 'Sure:\n[{"input": "a", "expected_output": "1"}, {"input": " A ", "expected_output": "2"}, {"input": "b"}, {"expected_output": "x"}]'
    lined = '{"input": "c", "expected_behavior": "refuse"}\n{"input": "a", "expected_output": "3"}'
    prompts = spark.createDataFrame([(1, "p1"), (2, "p2"), (3, "p3")], "case_id long, prompt string")
    got = authoring.written(prompts, lambda ps: [{"p1": reply, "p2": lined, "p3": "nothing"}[p] for p in ps]).orderBy("case_id", "item_no").collect()
    assert [(r.case_id, r.input.strip(), r.bucket) for r in got] == [(1, "a", "accepted"), (1, "A", "duplicate"), (1, "b", "malformed"), (2, "c", "accepted"), (2, "a", "duplicate")]
    with pytest.raises(ValueError, match="unknown"):
        authoring.adversarial_prompts(spark.createDataFrame([(1, "x")], "case_id long, input string"), ("nope",))
    assert authoring.affordable(prompts, 1.0, 1.0) and not authoring.affordable(prompts, 1e6, 1.0)


def test_simulated_talks(spark):
    people = spark.createDataFrame([("ann", "g"), ("bob", "g"), ("cy", "g"), ("dan", "g")], "name string, goal string")

    def user(ps):
        return ["DONE" if "ann" in p and "ASSISTANT" in p else "" if "dan" in p else "hello" for p in ps]

    def model(ps):
        return ["I cannot do that" if p.count("USER") == 2 and "go on" not in p else "fine" for p in ps]

    got = {r.name: (r.turns, r.stop, r.goal_met) for r in authoring.talk_summary(authoring.simulated(people, user, model, 3)).collect()}
    assert got["ann"] == (1, "goal_reached", True) and got["bob"] == (2, "refusal", False) and got["dan"] == (0, "goal_reached", True)


@pytest.mark.parametrize("limit", [0.0, 5.0, 23.0, 57.5, 1000.0])
def test_simulation_keeps_its_budget(spark, limit):
    """A call is made if its reservation fits what is left, in the order of names; the plain loop over rounds agrees, and nothing is spent above the ceiling."""
    names = [f"n{i:02d}" for i in range(12)]
    most, cost = lambda p: F.lit(3.0), lambda p, r: F.length(r).cast("double")
    ledger = authoring.Ledger(limit, most=most, cost=cost)
    said = authoring.simulated(spark.createDataFrame([(n, "g") for n in names], "name string, goal string"), lambda ps: ["ab" if "n05" not in p else "DONE" for p in ps], lambda ps: ["xyz"] * len(ps), 3, ledger).collect()
    spent, open_, stop, made = 0.0, list(names), {}, dict.fromkeys(names, 0.0)
    for turn in range(3):
        for role in ("user", "assistant"):
            left, fits, now = limit - spent, True, 0.0
            for k, n in enumerate(list(open_)):
                fits = fits and 3.0 * (k + 1) <= left + 1e-9
                if not fits:
                    stop[n] = "budget_exceeded"
                    continue
                price = 3.0 if role == "assistant" else 4.0 if n == "n05" else 2.0
                now += price
                made[n] += price
                if role == "user" and n == "n05":
                    stop[n] = "goal_reached"
                elif role == "assistant" and turn == 2:
                    stop[n] = "max_turns"
            open_ = [n for n in open_ if n not in stop]
            spent += now
    assert {r.name: r.stop for r in said if r.stop} == stop
    ended = {n: sum(r.cost_usd or 0.0 for r in said if r.name == n) for n in names}
    assert ended == made and ledger.spent == pytest.approx(spent) and spent <= max(limit + 1, 0)
    calls = [r for r in said if r.cost_usd is not None]
    assert len(calls) == sum(1 for r in said if r.stop != "budget_exceeded")


def test_baselines(spark, tmp_path):
    p = tmp_path / "b.json"
    for said, why in (("{", "unreadable"), ("[]", "not_object"), ('{"schema_version": 9, "records": []}', "future"), ("{}", "empty")):
        p.write_text(said)
        with pytest.raises(authoring.BaselineError, match=why):
            authoring.baseline(spark, str(p))
    p.write_text(json.dumps({"records": [{"file_path": "a.py", "line": 3, "qualname": "f", "is_dynamic": False}, {"file_path": "a.py", "line": 9, "qualname": "g"}]}))
    sites = authoring.baseline(spark, str(p))
    assert [r.id for r in authoring.site_targets(sites, "a.py:9").collect()] == [1]
    assert [r.id for r in authoring.site_targets(sites, "a.py#f").collect()] == [0]
    assert [authoring.exit_code({"changed": 1}, f, w) for f, w in ((("changed",), False), (("removed",), True), ((), False))] == [1, 2, 0]


def test_baselines_are_replaced_in_one_step(spark, tmp_path):
    """A reader between the new version and the pointer sees the old baseline; a stray file beside it changes nothing."""
    from assaykit.operators.lineage import SITE

    at = tmp_path / "base"
    row = lambda name: ("a.py", 1, "openai", "c", "user", 0, name, "fp", "loose", False)
    write = lambda *names: authoring.write_baseline(spark.createDataFrame([row(n) for n in names], SITE), str(at))
    read = lambda: [r.qualname for r in authoring.baseline(spark, str(at)).orderBy("id").collect()]
    write("f")
    assert read() == ["f"]
    (at / "v-half").mkdir()
    (at / "v-half/part-0.txt").write_text("{")
    assert read() == ["f"]
    write("g", "h")
    assert read() == ["g", "h"] and len(list(at.glob("v-*"))) == 1
    many = tmp_path / "many"
    many.mkdir()
    for n in "ab":
        (many / f"{n}.json").write_text('{"records": []}')
    with pytest.raises(authoring.BaselineError, match="several"):
        authoring.baseline(spark, str(many))


def test_drift_sites_name_their_cases(spark):
    from assaykit.operators import lineage

    site = lambda i, name, fp, dynamic=False: (i, "a.py", i, "openai", "create", "user", 0, name, fp, fp, dynamic)
    schema = "id long, " + lineage.SITE
    base = spark.createDataFrame([site(0, "f", "x"), site(1, "g", "y"), site(2, "h", "z", True)], schema)
    live = spark.createDataFrame([site(0, "f", "new"), site(5, "k", "fresh"), site(2, "h", "z", True)], schema)
    v = lineage.match(base, live, spark.createDataFrame([("b.py",)], "file_path string"))
    added = lineage.added(base, live, v)
    bound = spark.createDataFrame([(f"case-{i}", "x", "none") for i in range(7)] + [("other", "none", "none")], "case_uid string, fingerprint string, anchor string")
    lines = authoring.drift_lines(authoring.drift_sites(v, base, live, added, bound, most=2))
    assert [r.value for r in lines.orderBy("section_no", "line").collect()] == [
        "CHANGED a.py:0 openai.user in f fp x to new cases case-0, case-1 of 7", "REMOVED a.py:1 openai.user in g", "UNKNOWN a.py:2 openai.user in h [dynamic]", "ADDED a.py:5 openai.user in k",
    ]
    table = authoring.drift_lines(authoring.drift_sites(v, base, live, added), "markdown").where("section_no = 6").first()
    assert table.value.startswith("| added | a.py:5 | openai.user in k |")
    targets = spark.createDataFrame([("new", "none", "static", False), ("fresh", "none", "runtime", False)], "fingerprint string, anchor string, source string, is_dynamic boolean")
    told = {r.name: r.value for r in authoring.drift_report(v, added, None, live, targets).collect()}
    assert (told["live.call_sites"], told["live.static"], told["live.dynamic"], told["coverage.sites"], told["coverage.covered"]) == (3, 2, 1, 2, 1)


def test_contrast_and_targets(spark):
    cases = spark.createDataFrame([(1, "q", "Yes"), (2, "q2", "no"), (3, "q3", None)], "case_id long, input string, expected_output string")
    got = authoring.contrast_pairs(cases, lambda ps: [" yes " for p in ps])
    assert [r.case_id for r in got.collect()] == [2]
    t = "array<struct<anchor:string,fp:string>>"
    row = spark.range(1).select(authoring.merge_targets(F.from_json(F.lit('[{"anchor":"a","fp":"1"},{"anchor":"b","fp":"1"}]'), t), F.from_json(F.lit('[{"anchor":"a","fp":"2"}]'), t)).alias("m")).first()
    assert [(x.anchor, x.fp) for x in row.m] == [("b", "1"), ("a", "2")]
    cache = spark.createDataFrame([("k", "old", 1.0), ("k", "new", 5.0), ("j", "gone", 1.0)], "prompt_key string, reply string, created_at double")
    assert [(r.prompt_key, r.reply) for r in authoring.live_cache(cache, 10.0, 6.0).collect()] == [("k", "new")]


def test_reliability_gate(spark):
    cases = spark.createDataFrame([(i, "passed", 4, 4) for i in range(20)], "case_id long, status string, runs long, pass_count long")
    authoring.gate_reliability(cases, 2, 0.8)
    with pytest.raises(suite.GateFailure, match="below"):
        authoring.gate_reliability(cases, 2, 0.99)
    with pytest.raises(suite.GateFailure, match="unknown"):
        authoring.gate_reliability(cases, 9, 0.1)
    assert report.pass_k(cases, 2).first().pass_hat_k == 1.0


def test_contrast_twins_read_whole_answers(spark, sf_dir):
    from assaykit.plans import base, judging

    said = {r.case_id: r for r in base.turn_pairs(spark, sf_dir).collect()}
    got = judging.contrast_twins(spark, sf_dir).collect()
    assert any(len(said[r.case_id].output) > 40 for r in got)
    for r in got:
        prompt = f"Question: {said[r.case_id].input}\nRight answer: {said[r.case_id].output}\nWrite a wrong answer that looks right."
        assert r.bad_output == f"wrong {len(prompt)}"
