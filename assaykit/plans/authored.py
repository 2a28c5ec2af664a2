"""Queries over recommendations, trace folding, judge-written cases and drift reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import authoring, lineage
from ..storage import cut
from .base import PAIRS, table, turn_pairs
from .flows import _TRACES, _sites, _traces

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {_TRACES}, f AS (SELECT conv_id, turns > 5 AS talk, coalesce(length(trim(context, ' \n')) > 0, false) AS ctx, coalesce(length(trim(expected_output, ' \n')) > 0, false) AS exp, coalesce(length(trim(input, ' \n')) > 0, false) AS inp FROM traces),
    t AS (SELECT *, CASE WHEN talk THEN 'conversation' WHEN inp AND ctx THEN 'rag' WHEN inp AND exp THEN 'qa' WHEN inp THEN 'open' END AS task, talk::INT + (inp AND ctx)::INT + (inp AND exp)::INT AS signals FROM f)
    SELECT conv_id, task, CASE WHEN task = 'open' THEN 'low' WHEN signals <= 1 THEN 'high' WHEN signals = 2 THEN 'medium' ELSE 'low' END AS confidence, CASE task WHEN 'conversation' THEN 4 WHEN 'rag' THEN 5 WHEN 'qa' THEN 3 ELSE 2 END::BIGINT AS evaluators FROM t WHERE task IS NOT NULL""")
def case_recommendations(spark, sf_dir):
    r = authoring.recommended(_traces(spark, sf_dir), "conv_id")
    return r.groupBy("conv_id", "task").agg(F.min_by("confidence", "rank").alias("confidence"), F.count("*").alias("evaluators"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, count(*) FILTER (event_type = 'view') OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events),
    g AS (SELECT user_id, step, list(event_type ORDER BY event_id) AS calls FROM e WHERE event_type <> 'view' GROUP BY ALL)
    SELECT user_id, dense_rank() OVER (PARTITION BY user_id ORDER BY step) AS step_no, array_to_string(calls, ',') AS calls FROM g""")
def trace_steps(spark, sf_dir):
    spans = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "view", "llm").otherwise("tool").alias("kind"), F.col("event_type").alias("name"))
    return authoring.steps(spans, "user_id", "event_id").select("user_id", F.col("step_no").cast("long").alias("step_no"), F.array_join("calls", ",").alias("calls"))


@query("""WITH c AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'message' WHEN 'system' THEN 'message' ELSE 'output' END AS kind FROM conversations), o AS (SELECT *, (kind = 'message' AND coalesce(lag(kind) OVER w <> 'message', true))::INT AS o FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, CAST(sum(o) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS step_no FROM o""")
def message_steps(spark, sf_dir):
    items = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role").isin("user", "system"), "message").otherwise("output").alias("kind"))
    return authoring.message_steps(items, "conv_id", "turn").select("conv_id", "turn", "step_no")


@query("""SELECT count(*) FILTER (page_id % 10 NOT IN (2, 3, 5, 7, 9)) AS unchanged, count(*) FILTER (page_id % 10 = 7) AS moved, count(*) FILTER (page_id % 10 IN (3, 5)) AS changed, count(*) FILTER (page_id % 10 = 5) AS formatting_only,
    count(*) FILTER (page_id % 10 = 2) AS removed, count(*) FILTER (page_id % 10 = 9) AS unknown, 0::BIGINT AS unscannable, 0::BIGINT AS added FROM pages""")
def drift_counts(spark, sf_dir):
    base, live = _sites(spark, sf_dir, False), _sites(spark, sf_dir, True)
    v = lineage.match(base, live)
    return authoring.verdict_counts(v, lineage.added(base, live, v))


@query("""WITH c AS (SELECT user_id % 50 AS k, event_id, event_type FROM events WHERE event_id >= (SELECT max(event_id) - 5000 FROM events)) SELECT k::VARCHAR AS prompt_key, arg_max(event_type, event_id) AS reply FROM c GROUP BY k""")
def judge_cache_ttl(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    newest = e.agg(F.max("event_id")).first()[0]
    return authoring.live_cache(e.select((F.col("user_id") % 50).cast("string").alias("prompt_key"), F.col("event_type").alias("reply"), F.col("event_id").cast("double").alias("created_at")), float(newest), 5000.0)


def _writer(prompts):
    """A writer by rule: two cases from the first words of the source, the second one without an expectation every third time."""
    out = []
    for p in prompts:
        w = p.replace("\n", " ").replace('"', "").replace("\\", "").split()
        a, b = " ".join(w[-30:-24]), " ".join(w[-24:-18])
        out.append('Here: [{"input": "%s?", "expected_behavior": "refuse"}, {"input": "%s?"%s}]' % (a, b, "" if len(p) % 3 == 0 else ', "expected_output": "x"'))
    return out


def _written_sql(prompts: str) -> str:
    """What ``_writer`` and the gates make of prompts (case_id, p), in SQL."""
    return f"""WITH {prompts}, w AS (SELECT case_id, p, list_filter(regexp_split_to_array(replace(replace(p, '"', ''), chr(92), ''), '\\s+'), lambda x: x <> '') AS w FROM prompts),
    c AS (SELECT case_id, p, coalesce(array_to_string(w[greatest(len(w) - 29, 1):greatest(len(w) - 24, 0)], ' '), '') || '?' AS a, coalesce(array_to_string(w[greatest(len(w) - 23, 1):greatest(len(w) - 18, 0)], ' '), '') || '?' AS b FROM w),
    i AS (SELECT case_id, 0 AS item_no, a AS input, NULL AS expected_output, 'refuse' AS expected_behavior FROM c UNION ALL SELECT case_id, 1, b, CASE WHEN length(p) % 3 <> 0 THEN 'x' END, NULL FROM c),
    n AS (SELECT *, expected_output IS NOT NULL OR expected_behavior IS NOT NULL AS good, array_to_string(list_filter(regexp_split_to_array(replace(lower(input), 'ß', 'ss'), '\\s+'), lambda x: x <> ''), ' ') AS k FROM i)
    SELECT case_id, item_no, input, expected_output, expected_behavior, CASE WHEN NOT good THEN 'malformed' WHEN row_number() OVER (PARTITION BY k, good ORDER BY case_id, item_no) > 1 THEN 'duplicate' ELSE 'accepted' END AS bucket FROM n"""


_MODES = ", ".join(f"'{m}'" for m in authoring.FAILURE_MODES)


@query(_written_sql(PAIRS + f""", prompts AS (SELECT case_id, 'Write 5 inputs that could make a model fail by ' || unnest([{_MODES}]) || '.' || chr(10) || 'Source: ' || input || chr(10) || 'Answer with a JSON list of {{"input", "expected_behavior"}}.' AS p FROM pairs)"""))
def adversarial_cases(spark, sf_dir):
    """All failure modes over all requests."""
    seeds = turn_pairs(spark, sf_dir).select("case_id", "input")
    return authoring.written(authoring.adversarial_prompts(seeds), _writer)


@query(_written_sql("""prompts AS (SELECT item_id AS case_id, 'Write 3 questions with answers from the text.' || chr(10) || 'Text: ' || text || chr(10) || 'Answer with a JSON list of {"input", "expected_output"}.' AS p FROM benchmark WHERE length(text) <= 3000)"""))
def document_questions(spark, sf_dir):
    return authoring.written(authoring.question_prompts(table(spark, sf_dir, "benchmark").where("length(text) <= 3000"), "item_id", "text"), _writer)


_TALLY = lambda c, w: f"((length({c}) - length(replace({c}, '{w}', ''))) // {len(w)})"


@query(f"""WITH RECURSIVE t AS (SELECT s_name AS name, 'spend ' || s_acctbal AS goal, '' AS so_far, 0 AS turn, NULL::VARCHAR AS stop FROM supplier
    UNION ALL SELECT name, goal, CASE WHEN done THEN so_far ELSE said || chr(10) || 'ASSISTANT: ' || CASE WHEN length(said) % 11 = 0 THEN 'Sorry, no.' ELSE 'reply ' || {_TALLY("said", "ASSISTANT:")} END END, turn + 1,
        CASE WHEN done THEN 'goal_reached' WHEN length(said) % 11 = 0 THEN 'refusal' WHEN turn = 3 THEN 'max_turns' END
    FROM (SELECT *, {_TALLY("p", "USER:")} >= 1 + length(p) % 3 AS done, so_far || chr(10) || 'USER: request ' || {_TALLY("p", "USER:")} AS said FROM (SELECT *, 'You are ' || name || '. Goal: ' || goal || chr(10) || so_far || chr(10) || 'Next message, or DONE.' AS p FROM t WHERE stop IS NULL)))
    SELECT name, (turn - (stop = 'goal_reached')::INT)::BIGINT AS turns, stop, stop = 'goal_reached' AS goal_met FROM t WHERE stop IS NOT NULL""")
def simulated_talks(spark, sf_dir):
    people = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("spend "), F.col("s_acctbal").cast("string")).alias("goal"))
    user = lambda ps: ["DONE" if p.count("USER:") >= 1 + len(p) % 3 else f"request {p.count('USER:')}" for p in ps]
    bot = lambda ps: ["Sorry, no." if len(p) % 11 == 0 else f"reply {p.count('ASSISTANT:')}" for p in ps]
    return authoring.talk_summary(authoring.simulated(people, user, bot))


_GREEDY = f"""t AS (SELECT conv_id, list_sort(list_distinct(list_filter(regexp_split_to_array(replace(lower(coalesce(input, '')), 'ß', 'ss'), '\\s+'), lambda x: x <> ''))) AS s FROM traces), r AS (SELECT *, min(conv_id) OVER (PARTITION BY s) AS rep FROM t),
    w AS (SELECT conv_id, len(s) AS n, unnest(s) AS x FROM r WHERE rep = conv_id), i AS (SELECT a.conv_id AS a, b.conv_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM w a JOIN w b ON a.x = b.x AND a.conv_id < b.conv_id GROUP BY ALL),
    p AS (SELECT b, list_concat([b], list(a ORDER BY a)) AS x FROM i WHERE c::DOUBLE / (na + nb - c) >= 0.85 GROUP BY b),
    d AS (SELECT list_reduce(list(x ORDER BY b), lambda acc, y: CASE WHEN len(list_filter(y[2:], lambda z: NOT list_contains(acc, z))) > 0 THEN list_append(acc, y[1]) ELSE acc END, []::BIGINT[]) AS dropped FROM p),
    u AS (SELECT avg((conv_id = rep AND NOT coalesce(list_contains((SELECT dropped FROM d), conv_id), false))::INT) AS f FROM r)"""
_GATE = f"""{_TRACES}, {_GREEDY}, g AS (SELECT count(*) AS n, avg(coalesce(length(trim(output, ' \n')) > 0, false)::INT) AS o, avg(coalesce(length(trim(context, ' \n')) > 0, false)::INT) AS c, count(context) AS wc,
    avg(coalesce(length(trim(input, ' \n')) > 0 AND (length(trim(expected_output, ' \n')) > 0 OR expects), false)::INT) AS wf FROM traces)"""


@query(f"""WITH {_GATE} SELECT 'trace_count' AS signal, round(n::DOUBLE, 6) AS measured, CASE WHEN n >= 20 THEN 'ok' ELSE 'warn' END AS tier FROM g
    UNION ALL SELECT 'field_completeness', round(o, 6), CASE WHEN o >= 0.8 AND (wc = 0 OR c >= 0.5) THEN 'ok' ELSE 'warn' END FROM g
    UNION ALL SELECT 'near_duplicate_ratio', round(f, 6), CASE WHEN f >= 0.7 THEN 'ok' ELSE 'warn' END FROM u
    UNION ALL SELECT 'case_count', n, 'ok' FROM g UNION ALL SELECT 'well_formed_rate', round(wf, 6), CASE WHEN wf >= 0.8 THEN 'ok' ELSE 'warn' END FROM g""")
def input_gate(spark, sf_dir):
    """The signals of traces and of cases; detections of personal data have queries of their own."""
    from ..operators import gates

    t = _traces(spark, sf_dir)
    found = gates.assess(t, "bootstrap", "conv_id").where("signal != 'pii_secret_density'").unionByName(gates.assess(t, "cases", "conv_id"))
    return found.select("signal", F.round("measured", 6).alias("measured"), "tier")


@query("""WITH p AS (SELECT count(*) AS n, CAST(sum(length(text)) + 2 * (count(*) - 1) AS DOUBLE) AS c FROM benchmark) SELECT 'document_length' AS signal, c AS measured, CASE WHEN c >= 200 THEN 'ok' ELSE 'warn' END AS tier FROM p""")
def document_gate(spark, sf_dir):
    """The benchmark passages as the paragraphs of one source document."""
    from ..operators import gates

    return gates.assess(table(spark, sf_dir, "benchmark"), "generate", "item_id").where("signal = 'document_length'")


@query(f"""WITH {_TRACES} SELECT conv_id, input, coalesce(expected_output, output) AS expected_output, context, '{{"generation":{{"trace_id":"' || conv_id || '","kind":"trace"}}}}' AS metadata FROM traces WHERE length(trim(coalesce(input, ''), ' \n')) > 0""")
def trace_cases(spark, sf_dir):
    return authoring.trace_cases(_traces(spark, sf_dir), "conv_id")


@query("""WITH h AS (SELECT user_id, event_id, event_type AS evaluator, ['primary', 'secondary', 'guardrail'][1 + event_id % 3] AS tier, event_id % 7 AS rank, CASE WHEN event_id % 4 = 0 THEN 'judged' ELSE 'heuristic' END AS source FROM events WHERE event_type <> 'error'),
    f AS (SELECT *, row_number() OVER (PARTITION BY user_id, evaluator ORDER BY source DESC, rank, list_position(['primary', 'secondary', 'guardrail'], tier)) AS nth FROM h),
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY list_position(['primary', 'secondary', 'guardrail'], tier), source DESC, rank, evaluator) AS place FROM f WHERE nth = 1)
    SELECT user_id, (place - 1)::INT AS rank, evaluator, tier, source FROM o WHERE place <= 3""")
def merged_recommendations(spark, sf_dir):
    """Heuristic and judged recommendations for each user: judged ones win, one evaluator can't be built, three stay."""
    e = table(spark, sf_dir, "events")
    tier = F.element_at(F.array(*[F.lit(t) for t in ("primary", "secondary", "guardrail")]), (F.col("event_id") % 3 + 1).cast("int"))
    made = e.select("user_id", "event_id", F.col("event_type").alias("evaluator"), tier.alias("tier"), (F.col("event_id") % 7).alias("rank"))
    own, judged = (made.where(F.col("event_id") % 4 != 0), made.where(F.col("event_id") % 4 == 0))
    return authoring.merged_recommendations(own, judged, 3, F.col("evaluator") != "error", ("user_id",))


@query("""WITH s AS (SELECT CASE page_id % 10 WHEN 2 THEN 'removed' WHEN 3 THEN 'changed' WHEN 5 THEN 'changed' WHEN 9 THEN 'unknown' ELSE 'unchanged' END AS status, page_id, page_id // 3 AS case_id, page_id % 10 AS k FROM pages),
    r AS (SELECT case_id, CASE WHEN bool_and(status = 'removed') THEN 'removed' WHEN bool_or(status IN ('changed', 'removed')) THEN 'changed' WHEN bool_or(status = 'unknown') THEN 'unknown' ELSE 'unchanged' END AS status FROM s GROUP BY case_id),
    g AS (SELECT count(*) FILTER (k NOT IN (2, 3, 5, 7, 9)) AS unchanged, count(*) FILTER (k = 7) AS moved, count(*) FILTER (k IN (3, 5)) AS changed, count(*) FILTER (k = 5) AS formatting_only, count(*) FILTER (k = 2) AS removed, count(*) FILTER (k = 9) AS unknown,
        count(*) FILTER (k <> 2) AS sites, count(*) FILTER (k = 9) AS dynamic, count(*) FILTER (k NOT IN (2, 9) AND page_id % 3 = 0 AND page_id % 7 <> 0) AS covered FROM s)
    SELECT unnest(['sites.unchanged', 'sites.moved', 'sites.changed', 'sites.formatting_only', 'sites.removed', 'sites.unknown', 'sites.unscannable', 'sites.added', 'live.call_sites', 'live.static', 'live.dynamic', 'coverage.sites', 'coverage.covered']) AS name,
        unnest([unchanged, moved, changed, formatting_only, removed, unknown, 0, 0, sites, sites - dynamic, dynamic, sites - dynamic, covered]) AS value FROM g
    UNION ALL SELECT 'cases.' || status, count(*) FROM r GROUP BY status""")
def drift_report(spark, sf_dir):
    """Counts of sites and cases, what a scan can tell of, and what cases cover; targets seen at run time cover nothing."""
    base, live = _sites(spark, sf_dir, False), _sites(spark, sf_dir, True)
    v = cut(lineage.match(base, live))
    cases = lineage.rollup(v.select(F.floor(F.col("id") / 3).alias("case_id"), "status"))
    source = F.when(F.col("id") % 7 == 0, "runtime").otherwise("static").alias("source")
    targets = base.where("id % 3 = 0").select("fingerprint", F.to_json(F.struct(*lineage.ANCHOR)).alias("anchor"), source, "is_dynamic")
    return authoring.drift_report(v, lineage.added(base, live, v), cases, live, targets)


@query("""WITH p AS (SELECT page_id AS i, page_id % 10 AS k, 'src/' || split_part(split_part(url, '//', 2), '/', 1) || '.py' AS f FROM pages),
    r AS (SELECT *, CASE k WHEN 3 THEN 1 WHEN 5 THEN 1 WHEN 2 THEN 2 WHEN 9 THEN 4 WHEN 7 THEN 5 END AS section_no, CASE k WHEN 7 THEN 'lib/' || f ELSE f END AS file FROM p WHERE k IN (2, 3, 5, 7, 9)),
    t AS (SELECT section_no, file AS file_path, i::INT AS line, ['CHANGED', 'REMOVED', 'UNSCANNABLE', 'UNKNOWN', 'MOVED'][section_no] || ' ' || file || ':' || i || ' openai.user in f' || i || CASE k WHEN 5 THEN ' [formatting-only]' WHEN 7 THEN ' [moved]' WHEN 9 THEN ' [dynamic]' ELSE '' END
        || CASE k WHEN 3 THEN ' fp ' || left(sha256(i::VARCHAR), 8) || ' to ' || left(sha256(i || 'new'), 8) WHEN 5 THEN ' fp ' || left(sha256(i::VARCHAR), 8) || ' to ' || left(sha256(i || ' '), 8) ELSE '' END || CASE WHEN i % 3 = 0 THEN ' cases c' || i // 6 ELSE '' END AS value FROM r)
    SELECT section_no, file_path, line, value FROM t""")
def drift_lines(spark, sf_dir):
    """A line for each site that isn't as it was, with the cases that are bound to it."""
    base, live = _sites(spark, sf_dir, False), _sites(spark, sf_dir, True)
    v = cut(lineage.match(base, live))
    bound = base.where("id % 3 = 0").select(F.concat(F.lit("c"), F.floor(F.col("id") / 6).cast("string")).alias("case_uid"), "fingerprint", F.to_json(F.struct(*lineage.ANCHOR)).alias("anchor"))
    return authoring.drift_lines(authoring.drift_sites(v, base, live, lineage.added(base, live, v), bound))
