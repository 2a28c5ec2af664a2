"""The catalogue queries without SQL, against plain loops over the same tables."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from assaykit.functions import pii, stats
from assaykit.plans import catalogue
from assaykit.plans.base import runs, turn_pairs

QUERIES = catalogue.queries()
WITHOUT = {"bootstrap_ci", "ev_text_overlap", "f1_bootstrap", "pass_k_ci", "pii_counts_by_type", "pii_density", "pii_label_counts", "pii_redact", "pii_span_scan", "template_pairwise"}


def test_every_other_query_has_a_twin():
    assert set(QUERIES) - set(catalogue.oracle_sql()) == WITHOUT


def case_scores(spark, sf_dir):
    by = defaultdict(lambda: defaultdict(list))
    for r in runs(spark, sf_dir).select("event_type", "case_id", "score").collect():
        by[r.event_type][r.case_id].append(r.score)
    return {t: [round(sum(s) / len(s) + 1e-12, 4) for s in cases.values()] for t, cases in by.items()}


@pytest.mark.parametrize("name", ["bootstrap_ci", "pass_k_ci"])
def test_resampled_intervals(spark, sf_dir, name):
    rng = random.Random(1)
    for r in QUERIES[name](spark, sf_dir).collect():
        scores = case_scores(spark, sf_dir)[r.event_type]
        mean = sum(scores) / len(scores)
        means = sorted(sum(rng.choices(scores, k=len(scores))) / len(scores) for _ in range(1500))
        assert r.n == len(scores) and r.low <= mean <= r.high
        width = means[1462] - means[37]
        assert abs(r.low - means[37]) < 0.15 * width + 1e-4 and abs(r.high - means[1462]) < 0.15 * width + 1e-4


def plain_bleu(h, r):
    n = min(4, len(h), len(r))
    if not n:
        return 0.0
    product = 1.0
    for k in range(1, n + 1):
        a, b = (Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for w in (h, r))
        product *= sum(min(c, b[g]) for g, c in a.items()) / (len(h) - k + 1)
    return round(min(1.0, math.exp(1 - len(r) / len(h))) * product ** (1 / n), 4)


def plain_rouge(h, r):
    table = [[0] * (len(r) + 1) for _ in range(len(h) + 1)]
    for i, x in enumerate(h):
        for j, y in enumerate(r):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return round(2 * table[-1][-1] / (len(h) + len(r)), 4) if h and r else 0.0


def test_text_overlap(spark, sf_dir):
    said = {r.case_id: (r.output.lower().split(), r.input.lower().split()) for r in turn_pairs(spark, sf_dir).collect()}
    got = defaultdict(dict)
    for r in QUERIES["ev_text_overlap"](spark, sf_dir).collect():
        got[r.evaluator][r.case_id] = r.score
    assert got["bleu"] == pytest.approx({k: plain_bleu(*v) for k, v in said.items()}, abs=1e-4)
    assert got["rouge_l"] == {k: plain_rouge(*v) for k, v in said.items()}
    assert set(got["chrf"]) == set(said)


def test_f1_interval(spark, sf_dir):
    r = QUERIES["f1_bootstrap"](spark, sf_dir).first()
    assert r.low <= r.f1 <= r.high and 0 <= r.low and r.high <= 1 and r.n > 0


def plain_spans(text):
    """All rules over the whole text, then by start, keys first, longest first, what doesn't touch the one before."""
    hits = [(m.start(), kind == "pii", -m.end(), label, kind) for kind, rules in (("secret", pii.KEYS), ("pii", pii.PERSONAL)) for label, p in rules.items() for m in re.finditer(p, text)]
    for m in re.finditer(pii.CARD, text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if i % 2 == 0 else sum(map(int, str(2 * d))) for i, d in enumerate(reversed(digits)))
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            hits.append((m.start(), True, -m.end(), "credit_card", "pii"))
    kept, reach = [], 0
    for start, _, end, label, kind in sorted(hits):
        if start >= reach:
            kept.append((kind, label, start, -end))
            reach = -end
    return kept


def test_personal_spans(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    want = {k: plain_spans(t) for k, t in texts.items()}
    got = defaultdict(list)
    for r in QUERIES["pii_span_scan"](spark, sf).collect():
        got[r.doc_id].append((r.kind, r.label, r.start, r.end))
        assert texts[r.doc_id][r.start : r.end] == r.match
    assert {k: v for k, v in want.items() if v} == {k: sorted(v, key=lambda x: x[2]) for k, v in got.items()} and got
    counts = Counter(label for v in want.values() for _, label, _, _ in v)
    assert {r.label: r.n for r in QUERIES["pii_label_counts"](spark, sf).collect()} == counts
    assert tuple(QUERIES["pii_density"](spark, sf).first()) == (len(texts), counts.total(), round(counts.total() / len(texts), 6))
    for r in QUERIES["pii_redact"](spark, sf).collect():
        out, at = "", 0
        for _, label, a, z in want[r.doc_id]:
            out, at = out + texts[r.doc_id][at:a] + f"[REDACTED:{label}]", z
        assert (r.text or "") == out + texts[r.doc_id][at:]


def test_personal_counts(spark, sf_dir):
    """Patterns without checksums against Python's regular expressions, without any cue before them."""
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    want = Counter()
    for name, p in pii.patterns().items():
        rule = re.compile(p, 0 if name in pii.CASE_SENSITIVE else re.I)
        want[name] = sum(len(rule.findall(t)) for t in texts)
    got = {r.pattern: r.n for r in QUERIES["pii_counts_by_type"](spark, sf_dir).collect()}
    assert {k: v for k, v in got.items() if k not in pii.CHECKS} == {k: v for k, v in want.items() if v and k not in pii.CHECKS}
    assert all(n <= want[k] for k, n in got.items())


def test_cues_never_hide_a_match():
    """Every pattern's cue, and every scanner rule's literal, is in each text that the pattern matches."""
    said = [
        "mail A.b@c.org now", "see HTTP://x.example/abcd", "DOB: 1/2/1990", "D.O.B 01-02-90", "born on 3.4.1999", "BIRTH DATE: 3/4/99", "zip 12345", "Postal Code: 12345-6789", "POSTCODE 12345", "MRN 12345", "Patient ID: 4444", "Medical Record No. 12345",
        "Member ID A12345", "group no. 55555A", "FAX: 212-555-1234", "admitted on: 1/2/2020", "date of death: 1-2-20", "discharged: 1/1/2001", "UDI abcdefgh", "Device ID 1234567", "implant no. 123456", "Acct 1234567", "account # 1234567", "NPI 123456", "Licence", "Lic. ABC1234",
        "registration ABC123", "Cert ABC123", "certificate-AB12345", "aged 95", "years old: 101", "12345 near some street", "54321 at ST.", "Steuer-IdNr. 12345678901", "tax id 12345678901", "BSN 12345678", "Burgerservicenummer: 123456789", "12345678901 PESEL", "900101-1234 pnr", "010190-1234 cpr",
        "1234567A PPSN", "1234567W PPS Number", "routing 12345678", "CA DL A1234567", "california driver's license B7654321", "dl no. C1234567", "Ration Card: ABCD1234", "+44 20 7946 0958",
    ]
    met = set()
    for name, p in pii.patterns().items():
        rule = re.compile(p, 0 if name in pii.CASE_SENSITIVE else re.I)
        for t in said:
            if rule.search(t) and name in pii.CUES:
                met.add(name)
                assert any(c in t.lower() for c in pii.CUES[name]), (name, t)
    assert met == set(pii.CUES)


def test_pairwise_cover(spark, sf_dir):
    from assaykit.plans.flows import template_axes

    axes = list(template_axes(spark, sf_dir).values())
    rows = [tuple(r) for r in QUERIES["template_pairwise"](spark, sf_dir).collect()]
    for i, j in ((0, 1), (0, 2), (1, 2)):
        assert {(r[i], r[j]) for r in rows} == {(a, b) for a in axes[i] for b in axes[j]}
    assert len(rows) < len(axes[0]) * len(axes[1]) * len(axes[2]) and stats.wilson_value(0, 0) == (0.0, 1.0)


def plain_match(base, live):
    """lineage.match as loops over dictionaries: three passes, then site by site."""
    anchor = lambda s: (s["file_path"], s["qualname"])
    used, out, left = set(), {}, list(base)

    def tier(sites, fits, status, label, confidence, nearest):
        rest = []
        for b in sites:
            can = [x for x in live if x["id"] not in used and fits(b, x)]
            if not can:
                rest.append(b)
                continue
            best = min(can, key=(lambda x: (x["file_path"] != b["file_path"], abs(x["line"] - b["line"]), x["id"])) if nearest else (lambda x: x["id"]))
            used.add(best["id"])
            out[b["id"]] = (best["id"], status, label(b, best), "ambiguous" if nearest and len(can) > 1 else confidence)
        return rest

    static = lambda x: not x["is_dynamic"]
    none = lambda b, x: ""
    gone = [(b, "dynamic") for b in tier([b for b in left if b["is_dynamic"]], lambda b, x: anchor(b) == anchor(x), "unknown", lambda b, x: "dynamic", "structural", False)]
    left = tier([b for b in left if static(b)], lambda b, x: static(x) and anchor(b) == anchor(x) and b["fingerprint"] == x["fingerprint"], "unchanged", none, "exact", False)
    left = tier(left, lambda b, x: static(x) and b["fingerprint"] == x["fingerprint"], "unchanged", lambda b, x: "moved", "moved", True)
    rest = []
    for b in left:
        open_ = [x for x in live if x["id"] not in used]
        here = [x for x in open_ if anchor(b) == anchor(x)]
        fixed = [x for x in here if static(x)]
        away = [x for x in open_ if static(x) and b["file_path"] != x["file_path"] and b["qualname"] == x["qualname"] and b["loose_fingerprint"] == x["loose_fingerprint"]]
        if fixed:
            x = min(fixed, key=lambda x: (abs(x["line"] - b["line"]), x["id"]))
            out[b["id"]] = (x["id"], "changed", "formatting-only" if b["loose_fingerprint"] == x["loose_fingerprint"] else "", "ambiguous" if len(fixed) > 1 else "structural")
        elif here or len(away) == 1:
            x = (here or away)[0]
            out[b["id"]] = (x["id"], "unknown", "became-dynamic", "structural") if here else (x["id"], "changed", "file-renamed,formatting-only", "structural")
        else:
            rest.append(b)
            continue
        used.add(x["id"])
    left = rest
    for b, label in [*gone, *((b, "") for b in left)]:
        out[b["id"]] = (None, "removed", label, "structural")
    return out


def test_sites_with_ties_and_duplicates(spark):
    from assaykit.operators import lineage

    names = [f.split()[0] for f in lineage.SITE.split(", ")]
    for seed in range(5):
        rng = random.Random(seed)

        def sites(n, rng=rng):
            made = []
            for i in range(n):
                text = f"prompt {rng.randint(0, 12)}"
                said = text + " " * rng.randint(0, 1)
                row = {"id": i, "file_path": f"f{rng.randint(0, 3)}.py", "line": rng.randint(1, 40), "sdk": "openai", "call_site": "c", "role": "user", "role_position": 0, "qualname": f"q{rng.randint(0, 5)}", "fingerprint": said, "loose_fingerprint": text, "is_dynamic": rng.random() < 0.15}
                made.append(row)
            return made

        base, live = sites(50), sites(45)
        frame = lambda rows: spark.createDataFrame([tuple(r[k] for k in ("id", *names)) for r in rows], f"id long, {lineage.SITE}")
        got = {r.id: (r.live_id, r.status, r.label, r.confidence) for r in lineage.match(frame(base), frame(live)).collect()}
        assert got == plain_match(base, live)
