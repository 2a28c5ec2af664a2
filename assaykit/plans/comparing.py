"""Queries over comparisons, calibration and personal data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pii
from ..operators import calibration, compare
from .base import RUNS, rounded, runs, sql_wilson, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _reports(spark, sf_dir):
    """Two snapshots of orders: a case is a customer's priority, its status that of the order."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "skipped").when(F.col("o_orderstatus") == "F", "passed").otherwise(F.when(F.col("o_totalprice") > 300000, "judge_error").otherwise("failed_quality"))
    cases = o.select(F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderpriority").alias("case_input"), F.col("o_orderkey").alias("case_index"), status.alias("status"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("score"), (F.col("o_orderkey") % 2).alias("half"))
    return (cases.where(f"half = {i}").drop("half") for i in (0, 1))


_PAIRED = """r AS (SELECT concat_ws('/', o_custkey::VARCHAR, o_orderpriority) AS case_input, o_orderkey AS case_index, o_orderkey % 2 AS half, floor(o_totalprice / 1000)::DOUBLE AS score,
        CASE WHEN o_orderstatus = 'P' THEN 'skipped' WHEN o_orderstatus = 'F' THEN 'passed' WHEN o_totalprice > 300000 THEN 'judge_error' ELSE 'failed_quality' END AS status FROM orders),
    n AS (SELECT *, row_number() OVER (PARTITION BY half, case_input ORDER BY case_index) AS occurrence FROM r),
    pairs AS (SELECT case_input, occurrence, b.status AS base_status, p.status AS new_status, b.score AS base_score, p.score AS new_score,
        CASE WHEN b.status IS NULL THEN 'added' WHEN p.status IS NULL THEN 'removed' ELSE 'both' END AS presence,
        CASE WHEN b.status IS NULL OR p.status IS NULL THEN NULL WHEN b.status = 'skipped' OR p.status = 'skipped' OR (b.status = 'passed') = (p.status = 'passed') THEN 'unchanged' WHEN p.status = 'passed' THEN 'improved' ELSE 'regressed' END AS direction
        FROM (SELECT * FROM n WHERE half = 0) b FULL OUTER JOIN (SELECT * FROM n WHERE half = 1) p USING (case_input, occurrence))"""


@query(f"WITH {_PAIRED} SELECT * FROM pairs")
def compare_pairs(spark, sf_dir):
    return compare.paired(*_reports(spark, sf_dir)).withColumn("occurrence", F.col("occurrence").cast("long"))


@query(f"""WITH {_PAIRED}, k AS (SELECT *, coalesce(direction, presence) AS kind FROM pairs),
    l AS (SELECT list_position(['regressed', 'improved', 'removed', 'added', 'unchanged'], kind) AS place, case_input, occurrence,
        '<tr class="' || kind || '"><td>' || case_input || '</td><td>' || occurrence || '</td><td>' || coalesce(base_status, '') || '</td><td>' || coalesce(new_status, '') || '</td></tr>' AS line FROM k)
    SELECT row_number() OVER (ORDER BY place, case_input, occurrence) AS seq, line FROM l UNION ALL SELECT count(*) + 1, '</table>' FROM l
    UNION ALL SELECT 0, '<!DOCTYPE html><meta charset=utf-8><title>odd &amp; even</title><h1>odd &amp; even</h1><p>' || count(*) FILTER (presence = 'both') || ' paired, ' || count(*) FILTER (direction = 'regressed') || ' regressed, '
        || count(*) FILTER (direction = 'improved') || ' improved, ' || count(*) FILTER (presence = 'added') || ' added, ' || count(*) FILTER (presence = 'removed')
        || ' removed</p><table><tr><th>input</th><th>occurrence</th><th>base</th><th>new</th></tr>' FROM k""")
def diff_page(spark, sf_dir):
    """The page that compares orders of even and odd keys."""
    from ..sources import sinks

    pairs = compare.paired(*_reports(spark, sf_dir))
    return sinks.diff_lines(pairs, compare.diff_summary(pairs), "odd & even")


def _sql_tail(stat: str) -> str:
    """Two-sided tail of a non-negative statistic, as a DuckDB expression."""
    x = f"(({stat}) / sqrt(2.0))"
    t = f"(1 / (1 + 0.3275911 * {x}))"
    return f"({t} * (0.254829592::DOUBLE + {t} * (-0.284496736::DOUBLE + {t} * (1.421413741::DOUBLE + {t} * (-1.453152027::DOUBLE + {t} * 1.061405429::DOUBLE)))) * exp(-{x} * {x}))"


_DISCORD = """d AS (SELECT count(*) FILTER (presence = 'both') AS paired, count(*) FILTER (presence = 'added') AS added, count(*) FILTER (presence = 'removed') AS removed,
        count(*) FILTER (direction = 'improved') AS improved, count(*) FILTER (direction = 'regressed') AS regressed,
        count(*) FILTER (presence = 'both' AND base_status <> 'skipped' AND new_status <> 'skipped') AS comparable,
        count(*) FILTER (base_status = 'passed' AND new_status NOT IN ('passed', 'skipped')) AS lost, count(*) FILTER (new_status = 'passed' AND base_status NOT IN ('passed', 'skipped')) AS gained FROM pairs)"""


@query(f"WITH {_PAIRED}, {_DISCORD} SELECT *, round(pow(abs(lost - gained) - 1, 2)::DOUBLE / (lost + gained), 6) AS statistic, round({_sql_tail('sqrt(pow(abs(lost - gained) - 1, 2)::DOUBLE / (lost + gained))')}, 5) AS p_value FROM d")
def compare_summary(spark, sf_dir):
    s = compare.diff_summary(compare.paired(*_reports(spark, sf_dir)))
    return rounded(rounded(s, "statistic"), "p_value", places=5)


@query(f"WITH {_PAIRED}, {_DISCORD} SELECT lost, gained, round(pow(abs(lost - gained) - 1, 2)::DOUBLE / (lost + gained), 6) AS statistic FROM d")
def mcnemar_stat(spark, sf_dir):
    return rounded(compare.diff_summary(compare.paired(*_reports(spark, sf_dir))).select("lost", "gained", "statistic"), "statistic")


@query(f"WITH {_PAIRED} SELECT presence, count(*) AS n FROM pairs WHERE presence <> 'both' GROUP BY presence")
def added_removed(spark, sf_dir):
    return compare.paired(*_reports(spark, sf_dir)).where("presence <> 'both'").groupBy("presence").agg(F.count("*").alias("n"))


def _halves(spark, sf_dir):
    """Two experiment runs: odd and even trials, event types as evaluators."""
    r = runs(spark, sf_dir).withColumn("half", F.col("run_no") % 2)
    g = r.groupBy("half", F.col("event_type").alias("evaluator")).agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"), F.avg("score").alias("avg_score"))
    return (g.where(f"half = {i}").drop("half") for i in (0, 1))


_HALVES = RUNS + """, h AS (SELECT run_no % 2 AS half, event_type AS evaluator, count(*) AS n, count(*) FILTER (passed) AS passed FROM runs GROUP BY ALL),
    e AS (SELECT evaluator, a.n AS n_a, b.n AS n_b, a.passed::DOUBLE / a.n AS p, b.passed::DOUBLE / b.n AS q FROM (SELECT * FROM h WHERE half = 0) a JOIN (SELECT * FROM h WHERE half = 1) b USING (evaluator)),
    z AS (SELECT *, abs(q - p) / sqrt(((p * n_a + q * n_b) / (n_a + n_b)) * (1 - (p * n_a + q * n_b) / (n_a + n_b)) * (1.0::DOUBLE / n_a + 1.0::DOUBLE / n_b)) AS z FROM e),
    v AS (SELECT *, """ + _sql_tail("z") + """ AS p_value FROM z),
    k AS (SELECT *, row_number() OVER (ORDER BY p_value) AS r, count(*) OVER () AS m FROM v),
    j AS (SELECT *, min(least(1.0, p_value * m / r)) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING) AS p_adjusted FROM k)"""


@query(f"WITH {_HALVES} SELECT evaluator, round(z, 6) AS z, round(p_value, 5) AS p_value FROM j")
def two_prop_z(spark, sf_dir):
    x = compare.compare_runs(*_halves(spark, sf_dir)).select("evaluator", "z", "p_value")
    return rounded(rounded(x, "z"), "p_value", places=5)


@query(f"WITH {_HALVES} SELECT evaluator, round(p_value, 5) AS p_value, round(p_adjusted, 5) AS p_adjusted FROM j")
def bh_adjust(spark, sf_dir):
    return rounded(compare.compare_runs(*_halves(spark, sf_dir)).select("evaluator", "p_value", "p_adjusted"), "p_value", "p_adjusted", places=5)


@query(f"WITH {_HALVES} SELECT evaluator, n_a, n_b, round(q - p, 6) AS delta, round({sql_wilson("(p * n_a)", "n_a")[0]}, 6) AS low_a, round({sql_wilson("(p * n_a)", "n_a")[1]}, 6) AS high_a, round({sql_wilson("(q * n_b)", "n_b")[0]}, 6) AS low_b, round({sql_wilson("(q * n_b)", "n_b")[1]}, 6) AS high_b, round(2 * asin(sqrt(q)) - 2 * asin(sqrt(p)), 4) AS h, CASE WHEN p_adjusted < 0.05 AND q > p THEN 'improved' WHEN p_adjusted < 0.05 AND q < p THEN 'regressed' ELSE 'no significant change' END AS verdict FROM j")
def experiment_compare(spark, sf_dir):
    return rounded(compare.compare_runs(*_halves(spark, sf_dir)).select("evaluator", "n_a", "n_b", "delta", "low_a", "high_a", "low_b", "high_b", "h", "verdict"), "delta", "low_a", "high_a", "low_b", "high_b")


@query("""WITH v AS (SELECT CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'B is better' WHEN 'error' THEN 'All equal' WHEN 'signup' THEN ' a.' ELSE 'Tie' END AS reply FROM events)
    , w AS (SELECT count(*) FILTER (reply IN ('A', ' a.')) AS wins_a, count(*) FILTER (reply = 'B is better') AS wins_b, count(*) FILTER (reply IN ('All equal', 'Tie')) AS ties FROM v)
    SELECT *, round(""" + _sql_tail("sqrt(pow(abs(wins_a - wins_b) - 1, 2)::DOUBLE / (wins_a + wins_b))") + """, 5) AS p_value FROM w""")
def pairwise_sign_test(spark, sf_dir):
    t = F.col("event_type")
    reply = F.when(t == "click", "A").when(t == "view", "B is better").when(t == "error", "All equal").when(t == "signup", " a.").otherwise("Tie")
    return rounded(compare.pairwise(table(spark, sf_dir, "events").select(reply.alias("reply"))), "p_value", places=5)


def _labelled(spark, sf_dir):
    """Two free heuristics for quality of all labelled documents, as scores with labels."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    marks = F.length(F.regexp_replace("text", "[^!#$%&*|]", "")) / F.greatest(F.length("text"), F.lit(1))
    caps = F.length(F.regexp_replace("text", "[^A-Z]", "")) / F.greatest(F.length("text"), F.lit(1))
    scores = F.array(F.struct(F.lit("few_marks").alias("evaluator"), F.round(1 - marks, 4).alias("score")), F.struct(F.lit("few_capitals").alias("evaluator"), F.round(1 - caps, 4).alias("score")))
    return d.select("doc_id", (F.col("quality") == 1).alias("label"), F.inline(scores))


_LABELLED = """l AS (SELECT doc_id, quality = 1 AS label, unnest([
        {'evaluator': 'few_marks', 'score': round(1 - length(regexp_replace(text, '[^!#$%&*|]', '', 'g'))::DOUBLE / greatest(length(text), 1), 4)},
        {'evaluator': 'few_capitals', 'score': round(1 - length(regexp_replace(text, '[^A-Z]', '', 'g'))::DOUBLE / greatest(length(text), 1), 4)}], recursive := true) FROM documents JOIN labels USING (doc_id))"""
_CELLS = "count(*) FILTER ({s} AND label) AS tp, count(*) FILTER ({s} AND NOT label) AS fp, count(*) FILTER (NOT {s} AND label) AS fn, count(*) FILTER (NOT {s} AND NOT label) AS tn"
_RATES = """round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 4) AS agreement, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 4) AS recall,
    round(coalesce(2 * coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) * coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) / nullif(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) + coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 0), 0), 4) AS f1"""


@query(f"WITH {_LABELLED}, c AS (SELECT evaluator, {_CELLS.format(s='score >= 0.95')} FROM l GROUP BY GROUPING SETS ((evaluator), ())) SELECT *, {_RATES} FROM c")
def calibrate_confusion(spark, sf_dir):
    return calibration.confusion(_labelled(spark, sf_dir).withColumn("passed", F.col("score") >= 0.95))


_SWEPT = f"""{_LABELLED}, t AS (SELECT unnest([0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9])::DOUBLE AS threshold), c AS (SELECT threshold, {_CELLS.format(s='score >= threshold')} FROM l, t WHERE evaluator = 'few_marks' GROUP BY threshold),
    s AS (SELECT *, {_RATES} FROM c)"""


@query(f"WITH {_SWEPT} SELECT * FROM s")
def threshold_sweep(spark, sf_dir):
    return calibration.sweep(_labelled(spark, sf_dir).where("evaluator = 'few_marks'"))


@query(f"WITH {_SWEPT} SELECT threshold, f1 FROM s ORDER BY f1 DESC, threshold LIMIT 1")
def best_threshold(spark, sf_dir):
    return calibration.best_threshold(calibration.sweep(_labelled(spark, sf_dir).where("evaluator = 'few_marks'"))).select("threshold", "f1")


@query(f"""WITH {_LABELLED}, w AS (SELECT doc_id, bool_or(score >= 0.95) FILTER (evaluator = 'few_marks') AS a, bool_or(score >= 0.95) FILTER (evaluator = 'few_capitals') AS b FROM l GROUP BY doc_id),
    g AS (SELECT count(*) AS n, avg((a = b)::INT) AS observed, avg(a::INT) * avg(b::INT) + (1 - avg(a::INT)) * (1 - avg(b::INT)) AS chance FROM w)
    SELECT n, round(observed, 6) AS observed, round((observed - chance) / (1 - chance), 6) AS kappa FROM g""")
def cohens_kappa(spark, sf_dir):
    wide = _labelled(spark, sf_dir).groupBy("doc_id").agg(*[F.bool_or(F.when(F.col("evaluator") == e, F.col("score") >= 0.95)).alias(n) for n, e in (("a", "few_marks"), ("b", "few_capitals"))])
    return rounded(calibration.kappa(wide, "a", "b"), "observed", "kappa")


@query("""WITH r AS (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS x, rank() OVER (ORDER BY length(lang || source)) + (count(*) OVER (PARTITION BY length(lang || source)) - 1) / 2.0 AS y FROM documents)
    , c AS (SELECT count(*) AS n, corr(x, y) AS rho FROM r) SELECT n, round(rho, 6) AS rho, round(""" + _sql_tail("abs(rho) * sqrt(n - 2) / sqrt(1 - rho * rho)") + """, 5) AS p_value FROM c""")
def spearman(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("n_chars", F.length(F.concat("lang", "source")).alias("m"))
    return rounded(rounded(calibration.spearman(d, "n_chars", "m"), "rho"), "p_value", places=5)


@query(f"""WITH {_LABELLED}, k AS (SELECT evaluator, score, row_number() OVER (PARTITION BY evaluator ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY evaluator) AS n FROM l)
    SELECT evaluator, n, round(score, 2) AS threshold FROM k WHERE i = CAST(floor(0.25 * (n - 1)) AS BIGINT)""")
def calibrate_p25(spark, sf_dir):
    return calibration.recommended_thresholds(_labelled(spark, sf_dir))


@query("""WITH entries AS (SELECT * FROM (VALUES ('faithfulness', 'judge-a', ['a'], 0.9::DOUBLE), ('relevance', 'judge-a', ['a'], 0.3::DOUBLE)) t(evaluator, model, aliases, threshold)),
    known AS (SELECT evaluator, unnest(list_concat([model], aliases)) AS model, threshold FROM entries),
    want AS (SELECT event_id, CASE WHEN event_type = 'click' THEN 'faithfulness' WHEN event_type = 'view' THEN 'relevance' ELSE 'toxicity' END AS evaluator, CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'judge-a' ELSE 'b' END AS model FROM events)
    SELECT event_id, threshold IS NOT NULL AS calibrated, coalesce(threshold, 0.7)::DOUBLE AS threshold FROM want LEFT JOIN known USING (evaluator, model)""")
def calibrated_thresholds(spark, sf_dir):
    entries = spark.createDataFrame([("faithfulness", "judge-a", ["a"], 0.9), ("relevance", "judge-a", ["a"], 0.3)], "evaluator string, model string, aliases array<string>, threshold double")
    t, m = F.col("event_type"), F.col("event_id") % 3
    want = table(spark, sf_dir, "events").select("event_id", F.when(t == "click", "faithfulness").when(t == "view", "relevance").otherwise("toxicity").alias("evaluator"), F.when(m == 0, "a").when(m == 1, "judge-a").otherwise("b").alias("model"))
    return calibration.threshold_for(entries, want).select("event_id", "calibrated", "threshold")


def _pattern(name):
    def run(spark, sf_dir):
        d = table(spark, sf_dir, "documents")
        return d.select("doc_id", F.size(pii.found(F.col("text"), name, pii.BASE[name])).cast("long").alias("n")).where("n > 0")

    return run


QUERIES["pii_email"] = _pattern("email")
SQL["pii_email"] = f"SELECT doc_id, len(regexp_extract_all(text, '(?i){pii.BASE['email']}'))::BIGINT AS n FROM documents WHERE n > 0"
QUERIES["pii_ipv4"] = _pattern("ip_address")
SQL["pii_ipv4"] = f"SELECT doc_id, len(regexp_extract_all(text, '(?i){pii.BASE['ip_address']}'))::BIGINT AS n FROM documents WHERE n > 0"
QUERIES["pii_phone_us"] = _pattern("phone_us")
SQL["pii_phone_us"] = f"SELECT doc_id, len(regexp_extract_all(text, '(?i){pii.BASE['phone_us']}'))::BIGINT AS n FROM documents WHERE n > 0"
QUERIES["pii_card_luhn"] = _pattern("credit_card")
SQL["pii_card_luhn"] = r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b(?:4\d{3}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}|5[1-5]\d{2}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}|3[47]\d{2}[-\s]?\d{6}[-\s]?\d{5}|6011[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4})\b')) AS s FROM documents),
    d AS (SELECT doc_id, s, reverse(regexp_replace(s, '\D', '', 'g')) AS r FROM m),
    v AS (SELECT doc_id, list_sum(list_transform(range(1, length(r) + 1), lambda i: CASE WHEN i % 2 = 1 THEN r[i]::INT WHEN r[i]::INT * 2 > 9 THEN r[i]::INT * 2 - 9 ELSE r[i]::INT * 2 END)) % 10 = 0 AS ok FROM d)
    SELECT doc_id, count(*) AS n FROM v WHERE ok GROUP BY doc_id"""


@query()
def pii_counts_by_type(spark, sf_dir):
    """Surviving matches of every pattern of every jurisdiction, over all documents."""
    d = table(spark, sf_dir, "documents").select(F.explode(pii.counts(F.col("text"))).alias("pattern", "n"))
    return d.groupBy("pattern").agg(F.sum("n").cast("long").alias("n"), F.count("*").alias("documents"))


@query()
def pii_density(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.size(pii.scan(F.col("text"))).alias("n")).agg(F.count("*").alias("items"), F.sum("n").cast("long").alias("detections"), F.round(F.avg("n"), 6).alias("per_item"))


@query()
def pii_span_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(pii.scan(F.col("text"))))


@query()
def pii_redact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", pii.redact(F.col("text")).alias("text"))


@query()
def pii_label_counts(spark, sf_dir):
    return pii.label_counts(table(spark, sf_dir, "documents"), "text")


@query()
def f1_bootstrap(spark, sf_dir):
    """Interval of the F1 of few_marks at 0.95: cases resampled by multinomial cell counts, in one small task."""
    cells = calibration.confusion(_labelled(spark, sf_dir).withColumn("passed", F.col("score") >= 0.95)).where("evaluator = 'few_marks'")

    def resample(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                n = r.tp + r.fp + r.fn + r.tn
                draws = np.random.default_rng(20260603).multinomial(n, np.array([r.tp, r.fp, r.fn, r.tn]) / n, 1000)
                f1 = np.sort(2 * draws[:, 0] / np.maximum(1, 2 * draws[:, 0] + draws[:, 1] + draws[:, 2]))
                rows.append((int(n), float(r.f1), round(float(f1[25]), 4), round(float(f1[974]), 4)))
            yield pd.DataFrame(rows, columns=["n", "f1", "low", "high"])

    return cells.mapInPandas(resample, "n long, f1 double, low double, high double")
