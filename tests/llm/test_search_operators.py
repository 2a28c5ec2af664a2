"""Lexical search, toxicity and collocations against plain loops."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from assaykit.llm import collocations, search, toxicity

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, items, top):
    tokens = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in docs]
    tokens = [(d, Counter(w), len(w)) for d, w in tokens if w]
    big_n, big_l = len(tokens), sum(n for _, _, n in tokens)
    df = Counter(t for _, c, _ in tokens for t in c)
    asked = defaultdict(Counter)
    for i, t in items:
        asked[i].update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for i, terms in asked.items():
        scored = []
        for d, c, n in tokens:
            m = 100 - 25 + (25 * n * big_n) // big_l
            s = sum(times * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in terms.items() if t in c)
            if s > 0:
                scored.append((-s, d))
        out += [(i, k + 1, d, -s) for k, (s, d) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def searched(spark, docs, items, top):
    got = search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), top)
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect())


@pytest.mark.parametrize("small", [search.SMALL_TERMS, 3])
def test_search_matches_plain_loops(spark, small, monkeypatch):
    monkeypatch.setattr(search, "SMALL_TERMS", small)
    rng = random.Random(3)
    words = ["the"] * 30 + [f"w{i}" for i in range(60)] + ["Ünder", "É2", "a_b", "x-y", "İ", "the\x00cat", "10"]
    text = lambda n: rng.choice(" ,.\n").join(rng.choice(words).upper() if rng.random() < 0.3 else rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.choice((1, 5, 40, 200)))) for i in range(150)] + [(900, ""), (901, None), (902, "._-"), (903, "the " * 30000)]
    docs += [(1000 + i, docs[0][1]) for i in range(40)]
    items = [(i, text(rng.choice((1, 4, 30)))) for i in range(12)] + [(50, None), (51, ""), (52, "nowhere"), (53, docs[0][1]), (53, "the the")]
    assert searched(spark, docs, items, 20) == plain_search(docs, items, 20)
    assert searched(spark, docs, items, 3) == plain_search(docs, items, 3)


def test_search_edges(spark):
    docs, items = "doc_id long, text string, row long, term string", "item_id long, text string, n long"
    empty = search.search(spark.createDataFrame([], docs), spark.createDataFrame([(1, "a", 1)], items))
    assert empty.columns == ["item_id", "rank", "doc_id", "score"] and not empty.collect()
    some = spark.createDataFrame([(1, "alpha beta", 7, "x"), (1, "alpha beta", 7, "x"), (None, "alpha", 8, "y"), (4, "gamma", 0, None), (5, "delta", 0, None)], docs)
    assert search.search(some, spark.createDataFrame([], items)).count() == 0
    got = search.search(some, spark.createDataFrame([(None, "Beta", 1), (2, "alpha", None)], items)).collect()
    assert [(r["rank"], r.doc_id) for r in got if r.item_id is None] == [(1, 1), (2, 1)]
    assert sorted((r["rank"], r.doc_id) for r in got if r.item_id == 2) == [(1, None), (2, 1), (3, 1)]


def plain_collocations(rows, least, deepest, top):
    pieces = [(lang or "und", re.findall(r"[^\x20\x09]+", p)) for lang, t in rows for p in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER))]
    n, f = Counter(), Counter()
    for lang, words in pieces:
        n[lang] += len(words)
        for size in range(1, deepest + 1):
            for i in range(len(words) - size + 1):
                f[lang, tuple(words[i : i + size])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = lambda x, y: any(y[i : i + len(x)] == x for i in range(len(y) - len(x) + 1))
    out = defaultdict(list)
    for (lang, words), a in cand.items():
        if any(la == lang and len(w) > len(words) and 100 * b >= 100 * a and inside(words, w) for (la, w), b in cand.items()):
            continue
        score, _, left, right = min(((1000 * a * n[lang]) // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))
        out[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for k, (s, a, p, left, right) in enumerate(sorted(x)[:top]))


@pytest.mark.parametrize("parts, shard, bits", [(4, 2_000_000, 24), (13, 400, 24), (2, 1000, 9)])
def test_collocations_match_plain_loops(spark, parts, shard, bits):
    """Few ranges and many, shards of all sizes, and bitmaps so small that they rule nothing out."""
    limits = collocations.Limits(shard, shard, bits)
    rng = random.Random(5)
    fixed = ["new york city hall", "é\x01 é b", "the end of the line is near", "a\x02 b", "the the the the the the", "İstanbul x\x85y"]
    rows = []
    for i in range(300):
        words = [rng.choice(fixed) if rng.random() < 0.2 else rng.choice(("the", "of", "A", f"r{rng.randint(0, 300)}", "x.", "y,\n", "z\t")) for _ in range(rng.choice((0, 3, 60)))]
        rows.append((rng.choice(("en", "en", "en", "fr", None, "und")), " ".join(words)))
    rows += [("en", None), ("en", ""), ("fr", ",,;."), ("xx", "one two"), (None, "\x0b \x0c")]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame(rows, "lang string, text string").repartition(7)
        for top in (2000, 4):
            got = collocations.mine(docs, least=12, top=top, limits=limits).collect()
            assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == plain_collocations(rows, 12, 5, top)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_collocations_edges(spark):
    schema = "lang string, text string, phrase string, f long, part int"
    out = collocations.mine(spark.createDataFrame([], schema))
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and not out.collect()
    assert not collocations.mine(spark.createDataFrame([("en", "a b c", "x", 1, 2), (None, None, None, None, None)], schema)).collect()
    long = "alpha beta " * 60 + "gamma"
    got = collocations.mine(spark.createDataFrame([(None, long, "x", 1, 2)], schema), least=50).collect()
    assert [(r.lang, r["rank"], r.n) for r in got][:1] == [("und", 1, 121)] and {r.phrase for r in got} >= {"alpha beta alpha beta alpha"}


def test_scores_are_exact_beyond_64_bits(spark):
    a, n, left, right = 3 * 10**12, 9 * 10**13, 7 * 10**12, 11 * 10**12
    got = spark.sql(f"SELECT (cast(1000 * cast({a} as decimal(18,0)) as decimal(20,0)) * cast({n} as decimal(18,0))) div (cast({left} as decimal(18,0)) * cast({right} as decimal(18,0))) AS s").first().s
    assert got == 1000 * a * n // (left * right)


def plain_features(word, lengths=toxicity.LENGTHS, spread=toxicity.SPREAD):
    """Sum of weights by subsequence, by plain loops."""
    found = defaultdict(float)
    s = f"\x02{word}\x03"
    for n in lengths:
        for at in itertools.combinations(range(len(s)), n):
            skipped = at[-1] - at[0] + 1 - n
            if skipped <= spread:
                found["".join(s[i] for i in at)] += toxicity.DECAY**skipped
    return found


def test_kernel_matches_plain_subsequences():
    words = ["idiot", "i.d.i.o.t", "id", "a", "banana", "wörld"]
    sums = {w: plain_features(w) for w in words}
    norm = {w: math.sqrt(sum(toxicity.DECAY ** (2 * (at[-1] - at[0] + 1 - len(at))) for n in toxicity.LENGTHS for at in itertools.combinations(range(len(w) + 2), n) if at[-1] - at[0] + 1 - n <= toxicity.SPREAD)) for w in words}
    got = toxicity.gram(words, toxicity.embedded(words))
    for i, x in enumerate(words):
        for j, y in enumerate(words):
            want = sum(v * sums[y].get(k, 0) for k, v in sums[x].items()) / max(norm[x] * norm[y], 1e-12)
            assert abs(got[i, j] - want) < 0.02, (x, y)  # a hashed feature may meet another


def test_scores_are_those_of_the_landmarks():
    """One weight for each subsequence gives the margins that landmarks and coefficients give; long words count whole."""
    rng = random.Random(1)
    toxic = {"idiot": 5.0, "moron": 4.0, "idiots": 1.0}
    clean = {"".join(rng.choice("thernadiso") for _ in range(rng.randint(1, 9))): 1.0 for _ in range(60)}
    m = toxicity.fit(toxic, clean)
    words = ["idiot", "ridiot", "there", "moro"]
    base = toxicity.gram(words, m.weights[:, None] * np.float32(1))[:, 0] + m.bias
    assert np.allclose(m.margins(words), base, atol=1e-4)
    assert m.margins(["idiot"])[0] > 0 > m.margins([next(iter(clean))])[0]
    filler = "".join(rng.choice("qzjxkv") for _ in range(300))
    low, high = m.margins([filler * 2, filler + "idiot" + filler])
    assert high > low
    assert m.margins([]).shape == (0,)


def test_units_of_spelled_words():
    assert toxicity.units("You I d  i o\nt a b") == {"you", "i", "d", "o", "t", "a", "b", "idiotab"}
    assert toxicity.units("a b") == {"a", "b"} and toxicity.units("") == set()


def _toxic_corpus(n=900, seed=2):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(("ta", "re", "no", "mi", "sel", "or", "in", "the", "sh", "ul")) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice((5, 40, 150)))]
        bad = rng.random() < 0.2
        if bad:
            w = rng.choice(("idiot", "moron", "stupid", "scumbag"))
            w = rng.choice((w, w, w + rng.choice("s,!"), "-".join(w), " ".join(w), w[:3] + "." + w[3:]))
            words.insert(rng.randrange(len(words) + 1), w)
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity_held_out(spark):
    docs, labels = _toxic_corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = {r.doc_id: r for r in toxicity.classify(frame, model).collect()}
    held = [i for i in rows if rows[i].held_out]
    truth = dict(labels)
    assert len(held) > 100
    right = sum(rows[i].predicted == truth[i] for i in held) / len(held)
    clean = [i for i in held if not truth[i]]
    assert right > 0.95 and sum(rows[i].predicted for i in clean) <= 0.02 * len(clean)
    odd = [(1, "ta re i d i o t no"), (2, "ta re st-u-p-id no"), (3, "ta mo.ron"), (4, "ta re no mi"), (5, None), (6, "")]
    got = {r.doc_id: (r.predicted, r.unit) for r in toxicity.classify(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()}
    assert got == {1: (1, "idiot"), 2: (1, "st-u-p-id"), 3: (1, "mo.ron"), 4: (0, None), 5: (0, None), 6: (0, None)}


def test_toxicity_edges(spark):
    schema, kinds = "doc_id long, text string, score string, Unit int", "doc_id long, toxic int, text string"
    some = spark.createDataFrame([(1, "a b", "x", 1), (1, "a b", "x", 1), (None, None, None, None), (3, "long " * 40000, "y", 2)], schema)
    for labels, want in (([], 0.5), ([(1, 1, "")], 1.0), ([(1, 0, ""), (1, 1, ""), (None, 1, ""), (3, None, "")], 0.0)):
        model = toxicity.train(some, spark.createDataFrame(labels, kinds))
        out = toxicity.classify(some, model, drop_text=False)
        assert out.columns == ["doc_id", "text", "input_score", "input_Unit", "score", "predicted", "unit", "held_out"]
        got = out.collect()
        assert len(got) == 4 and all(abs(r.score - want) < 1e-6 for r in got)
        assert {(r.doc_id, r.held_out) for r in got if r.doc_id is None} == {(None, False)}
    empty = spark.createDataFrame([], schema)
    assert toxicity.classify(empty, toxicity.train(empty, spark.createDataFrame([], kinds))).count() == 0
