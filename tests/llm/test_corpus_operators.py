"""Operators over the whole corpus, and the pipeline, against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from assaykit.llm import components, jaccard, mixing, pieces, quality, queries, repeats, secrets
from assaykit.llm.common import documents


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_components(rows):
    """doc_id -> (set size, component), all pairs that share a shingle compared."""
    sets, inverted, root = {}, defaultdict(list), {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, t in rows:
        sets[d], root[d] = shingle_set(t), d
        for s in sets[d]:
            inverted[s].append(d)
    for pair in {(a, b) for ds in inverted.values() for a in ds for b in ds if a < b}:
        x, y = sets[pair[0]], sets[pair[1]]
        if 100 * len(x & y) >= 80 * len(x | y):
            a, b = find(pair[0]), find(pair[1])
            root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def varied(n=60, seed=4):
    """Texts with chains of near copies, exact copies, short and empty ones."""
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 40))
    texts = []
    for _ in range(n):
        words = [word() for _ in range(rng.choice((3, 5, 30, 60, 120)))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            words = list(words)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = word()
            texts.append(rng.choice((" ", "\t", "  ")).join(words).upper() if rng.random() < 0.2 else " ".join(words))
    texts += ["", None, "  \n ", "one", "ONE", "one two", "nul\x00 a b c d", "é x y z w"]
    return list(enumerate(texts))


def test_jaccard_join_matches_brute_force(spark):
    rows = varied()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def thue_morse(n):
    """Two different words of n characters whose sums of powers agree modulo 2**64 for every odd base."""
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_long_words_have_names_of_their_own(spark):
    rows = []
    for k in (10, 12, 14, 16):
        a, b = thue_morse(1 << k)
        rows += [(10 * k, a), (10 * k + 1, b), (10 * k + 2, f"x {a} y"), (10 * k + 3, f"x {b} y"), (10 * k + 4, f"x {a} y")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)
    one, two = (quality.Features(("words",)).of(t).copy() for t in thue_morse(4096))
    assert (one != two).any()


@pytest.mark.parametrize("hot", [1, 16])
def test_jaccard_join_with_one_large_group(spark, hot, monkeypatch):
    """Near copies of one text, linked or not, and a passage that all texts share."""
    monkeypatch.setattr(jaccard, "HOT", hot)
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 500)}" for _ in range(90)]
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 6))):
            words[rng.randrange(90)] = f"v{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(passage + [f"u{rng.randint(0, 10**6)}" for _ in range(rng.choice((1, 3, 9, 60)))])) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()}
    assert got == brute_components(rows)


def test_jaccard_links_inside_large_groups(spark):
    """All pairs of a group of near copies, linked or not, and each document's number of links."""
    rng = random.Random(12)
    base, rows = [f"w{rng.randint(0, 500)}" for _ in range(90)], varied(15)
    for i in range(60):
        words = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            words[rng.randrange(90)] = f"v{rng.randint(0, 10**6)}"
        rows.append((1000 + i, " ".join(words)))
    sets = {d: shingle_set(t) for d, t in rows}
    linked = lambda x, y: bool(sets[x]) and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])
    rep = {d: min(e for e in sets if sets[e] == s) for d, s in sets.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(rep[x], rep[y]) for x in sets for y in sets if rep[x] < rep[y] and linked(x, y)}
    assert {(r.a, r.b) for r in jaccard.links(docs).collect()} == want
    assert {r.doc_id: r.n_links for r in jaccard.with_link_counts(docs).collect()} == {x: sum(linked(x, y) for y in sets if x != y) for x in sets}


def test_jaccard_join_edges(spark):
    schema = "doc_id long, text string, n long, rep long"
    rows = [(1, "a b c d e f", 1, 1), (1, "a b c d e f", 1, 1), (2, "A b c d e f", 2, 2), (None, "a b c d e f", 3, 3), (None, None, 0, 0), (5, None, 0, 0)]
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard.join(spark.createDataFrame(rows, schema)).collect()))
    assert got == [(-1, 0, -1), (-1, 2, -1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (5, 0, 5)]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, schema))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, -1, 1, 5] and kept.columns == ["doc_id", "text", "n", "rep"]
    assert jaccard.join(spark.createDataFrame([], schema)).count() == 0


def test_jaccard_rows_of_one_id_are_one_document(spark):
    one, two = "a b c d e f g", "q r s t u v w"
    rows = [(5, one), (7, one), (7, two), (9, two), (7, ""), (11, ""), (12, None), (12, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in jaccard.join(docs).collect()}
    assert got == {(5, 5), (7, 5), (9, 5), (11, 11), (12, 12)}
    assert sorted(r.doc_id for r in jaccard.one_of_each(docs).collect()) == [5, 11, 12]


def test_prefix_never_drops_a_link():
    """Any two sets over the bound share the smaller required number of prefix tokens."""
    import numpy as np

    rng = np.random.default_rng(3)
    universe = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    counts = rng.integers(1, 3000, 400)
    for _ in range(300):
        n = int(rng.integers(5, 200))
        x = rng.choice(400, n, replace=False)
        drop = int(rng.integers(0, max(1, n // 9) + 1))
        y = np.append(x[drop:], rng.choice(np.setdiff1d(np.arange(400), x), drop, replace=False))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both):
            (i, p), (j, q) = (jaccard.prefix(*map(np.array, zip(*sorted(zip(universe[s], counts[s], strict=True)), strict=True))) for s in (x, y))
            assert len(np.intersect1d(p, q)) >= min(i, j)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200)] + [(rng.randint(300, 360), rng.randint(300, 360)) for _ in range(40)] + [(None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_removed(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = [True] * length
            seen.add(b[i : i + length])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def repeating(seed=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8)))
    passages = [" ".join(word() for _ in range(rng.randint(20, 90))) for _ in range(6)]
    texts = []
    for _ in range(50):
        parts = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(2)]
        if rng.random() < 0.7:
            p = rng.choice(passages)
            parts.insert(1, p[rng.randint(0, 30) :] if rng.random() < 0.5 else p)
        texts.append(" ".join(parts))
    texts += [texts[3], texts[3], "a" * 500, "a" * 450, "ab" * 300, "", None, "short", "x" * 99, "x" * 100, "x" * 100, "the same line again\n" * 40]
    return list(enumerate(texts))


def test_repeats_match_brute_force(spark):
    rows = repeating()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove(docs).collect()}
    assert got == brute_removed(rows)
    kept = repeats.remove(docs, keep_bytes=True).where("doc_id = 3").first()
    assert hashlib.sha256(bytes(kept.kept)).hexdigest() == kept.kept_sha256


def test_repeats_over_many_batches(spark):
    """Groups that go over batch bounds."""
    rows = repeating(8) + [(100 + i, t) for i, (_, t) in enumerate(repeating(8))]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove(docs).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == brute_removed(rows)


def test_repeats_with_hot_triggers(spark, monkeypatch):
    """All phrases by ranges of the suffix array instead of by trigger; and the sketch finds a stock line."""
    rows = repeating(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(repeats, "hot_triggers", lambda docs, length: __import__("numpy").ones(1 << repeats.SKETCH_BITS, bool))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove(docs).collect()}
    assert got == brute_removed(rows)
    monkeypatch.undo()
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefghijklm nop") for _ in range(n))
    line = word(70)
    stock = [(i, word(60) + line + word(60)) for i in range(3000)]
    dealt = repeats.parsed(repeats.identified(spark.createDataFrame(stock, "doc_id long, text string").repartition(4)))
    assert dealt.where("state = 2").count() >= 1000
    assert dealt.groupBy("key").count().agg(F.max("count")).first()[0] <= 200


def test_corpus_order_is_the_suffix_array(spark):
    rng = random.Random(5)
    block = "".join(rng.choice("abcé ") for _ in range(260))
    texts = [block * 3, block * 2 + "x" + block, block[40:] + block, "a" * 700, "short", "", None, "short", block[:150], "".join(rng.choice("ab") for _ in range(400))]
    rows = list(enumerate(texts))
    raw = {i: (t or "").encode() for i, t in rows}
    want = sorted(((i, a) for i, b in raw.items() for a in range(len(b))), key=lambda x: (raw[x[0]][x[1] :], x))
    got = repeats.corpus_order(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).orderBy("order").collect()
    assert [(r.doc_id, r.at) for r in got] == want
    assert repeats.corpus_order(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeats_of_texts_with_one_doc_id(spark):
    rng = random.Random(4)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(120))
    rows = [(i % 2 or None, f"{i} " * 40 + shared) for i in range(40)]
    got = [r.n_removed for r in repeats.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == 40 and sum(n >= 120 for n in got) == 39


def test_repeats_edges(spark):
    rng = random.Random(0)
    text = "".join(rng.choice("abcdefgh ") for _ in range(150))
    rows = [(None, text, "x"), (4, text, "x"), (4, text, "x"), (7, None, None)]
    schema = "doc_id long, text string, doc string"
    got = sorted(((-1 if r.doc_id is None else r.doc_id, r.n_removed) for r in repeats.remove(spark.createDataFrame(rows, schema)).collect()))
    assert got == [(-1, 0), (4, 150), (4, 150), (7, 0)]
    once = repeats.remove(spark.createDataFrame([(4, text, "x"), (4, text, "x")], schema)).collect()
    assert [r.n_removed for r in once] == [0, 0]
    assert repeats.remove(spark.createDataFrame([], schema)).count() == 0


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, share = dict(weight), 1.5 * sum(sizes.values())
    target = {}
    while left:
        level = share / sum(left.values())
        full = [s for s in left if level * left[s] > 2 * sizes[s]]
        if not full:
            return target | {s: level * w for s, w in left.items()}
        for s in full:
            target[s] = 2.0 * sizes[s]
            share -= target[s]
            del left[s]
    return target


def brute_amounts(sizes, slots):
    """source -> words: golden-ratio points counted per interval of the targets, times the slots' length; small sources give their targets."""
    quota = {s: int(t + 0.5) for s, t in brute_targets(sizes).items()}
    total, ends, at = sum(quota.values()), [], 0
    order = sorted(sizes, key=lambda s: (256 * quota[s] < total, s is None, (s or "").encode()))
    for s in order:
        at += quota[s]
        ends.append((at / total, s))
    met = Counter()
    for n in range(slots):
        u = (n + 0.5) * 0.6180339887498949
        met[next(s for end, s in ends if u - int(u) < end)] += 1
    return {s: quota[s] if 256 * quota[s] < total else min(met[s] * total // slots, 2 * sizes[s]) for s in order}


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 40))), rng.choice(["b", "a", "é", "Z", None, "a"])) for i in range(500)]
    rows += [(500, None, "only null"), (501, "x " * 20000, "long"), (3, rows[3][1], rows[3][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix(docs, slots=512).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    amount = brute_amounts(sizes, 512)
    assert taken == Counter(amount)
    # A source's slots differ from its share by a few, and the schedule alone decides how much is taken.
    assert all(abs(taken[s] - want[s]) <= 4 * sum(want.values()) / 512 + 2 for s in sizes)
    coarse = mixing.mix(docs, slots=7).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    assert Counter({r.source: r.n for r in coarse}) == Counter(brute_amounts(sizes, 7)) != taken
    again = mixing.mix(docs.repartition(7), slots=512).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)
    kept = mixing.apply_mix(docs, slots=512)
    times = Counter(r.doc_id for r in kept.collect())
    assert kept.columns == docs.columns and all(0 <= n <= 4 for n in times.values())
    assert {r["size"] for r in kept.collect()} == {"clash"}
    odd = docs.withColumnsRenamed({"size": "slot"}).withColumns({c: F.lit(7) for c in ("_k", "_times", "_copy", "whole", "ord", "rank", "part", "bucket", "digest")})
    assert mixing.apply_mix(odd, slots=512).columns == odd.columns and mixing.apply_mix(odd, slots=512).count() == sum(times.values())


def test_a_hot_source_is_spread_over_all_partitions(spark):
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 20).cast("string"))).alias("source"))
    sizes = sorted(r["count"] for r in mixing.apply_mix(docs).groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 8 and sizes[-1] < 1.2 * sizes[4]


def test_a_hot_group_of_copies_joins_as_one_class(spark):
    """A third of 50,000 rows hold one text, a tenth nothing."""
    text = F.when(F.col("id") % 3 == 0, "the same old words again here").when(F.col("id") % 10 == 1, "").otherwise(F.concat_ws(" ", *[F.hex(F.xxhash64("id", F.lit(i))) for i in range(6)]))
    got = jaccard.join(spark.range(50_000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit(1).alias("n")))
    groups = {r["count"] for r in got.where("component_id = 0").groupBy("component_id", "class_id", "n_shingles").count().collect()}
    assert groups == {16_667} and got.count() == 50_000 and got.where("n_shingles = 0 and component_id != doc_id").count() == 0


def test_mixed_documents_stand_in_slot_order(spark):
    """Any stretch of the output holds the sources in about their shares."""
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(1, 30), rng.choice("aaaabbcd")) for i in range(4000)]
    mixed = mixing.apply_mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)).collect()
    words = [(r.source, len(r.text.split())) for r in mixed]
    whole = Counter()
    for s, n in words:
        whole[s] += n
    for a in range(0, len(words), len(words) // 4):
        part = Counter()
        for s, n in words[a : a + len(words) // 4]:
            part[s] += n
        if sum(part.values()) > sum(whole.values()) / 8:
            assert all(abs(part[s] / sum(part.values()) - n / sum(whole.values())) < 0.03 for s, n in whole.items())


def test_mix_schedule_has_low_discrepancy(spark):
    rows = [(i, s, n) for i, (s, n) in enumerate([("a", 100), ("b", 300), ("c", 50), ("d", 900)])]
    plan = mixing.planned(mixing.targets(spark.createDataFrame(rows, "doc_id long, source string, size long")))
    share = {r.ord: r.target for r in plan.collect()}
    total = sum(share.values())
    slots = mixing.schedule(plan, 1000).orderBy("slot").collect()
    seen = Counter()
    for n, r in enumerate(slots, 1):
        seen[r.lane] += 1
        assert all(abs(seen[o] - n * t / total) < 6 for o, t in share.items())
    assert [r.slot for r in slots] == list(range(1000))
    ranks = defaultdict(list)
    for r in slots:
        ranks[r.lane].append(r["rank"])
    assert all(x == list(range(len(x))) for x in ranks.values())


@pytest.mark.parametrize("n_small, big", [(20, 1_000_000), (5000, 300_000)])
def test_no_source_is_too_small_for_the_mix(spark, n_small, big):
    """Sources far below a slot's length, few and thousands, beside large ones: each gives its target and stays in the output."""
    small = [(i, "two words", f"s{i:05d}") for i in range(n_small)]
    rows = small + [(10_000 + i, "w " * (big // 100), rng) for i, rng in enumerate(["big", "large"] * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    sizes = Counter({s: 2 for _, _, s in small}) + Counter({"big": big // 2, "large": big // 2})
    want = brute_targets(sizes)
    got = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect()
    assert len(got) == n_small + 2
    for r in got:
        assert r.t == pytest.approx(want[r.source]) and abs(r.n - r.t) <= max(1, 0.01 * r.t), r
    mixed = mixing.apply_mix(docs).collect()
    seen = Counter(r.source for r in mixed)
    assert all(seen[s] >= int(want[s] >= 2) for _, _, s in small) and len(seen) >= 2 + sum(want[s] >= 2 for _, _, s in small)


def test_mixing_edges(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, None), (None, "", "a")], schema)).collect()
    assert [r.taken for r in got] == [0, 0]
    one = mixing.mix(spark.createDataFrame([(1, "a b c d", "s")], schema)).first()
    assert (one.target, one.taken) == (6.0, 6)
    assert mixing.apply_mix(spark.createDataFrame([], schema)).count() == 0


#: Queries whose contract is a report by group, not a row per document: the group's column and its most rows.
RANKED = {"op11_ranked_lexical_search": ("item_id", 20), "op13_phrase_collocations": ("lang", 2000)}


def test_every_query_gives_a_row_per_document_or_a_ranked_report(spark, sf_dir):
    n = documents(spark, sf_dir).count()
    for name, f in queries.queries().items():
        if name in RANKED:
            by, most = RANKED[name]
            ranks = {}
            for r in f(spark, sf_dir).select(by, "rank").collect():
                ranks.setdefault(r[by], []).append(r["rank"])
            assert ranks and all(sorted(x) == list(range(1, len(x) + 1)) and len(x) <= most for x in ranks.values()), name
            continue
        want = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count() + 1 if name.startswith("op1_") else n
        assert f(spark, sf_dir).count() == want, name


def test_pipeline_matches_brute_force(spark, sf_dir):
    import corpus_pipeline
    import sentencepiece

    docs = [r.asDict() for r in documents(spark, sf_dir).collect()]
    model = quality.train(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    features = quality.Features()
    docs = [d for d in docs if model.score(features.of(d["text"] or "")) >= quality.THRESHOLD]
    group = brute_components([(d["doc_id"], d["text"]) for d in docs])
    docs = [d for d in docs if group[d["doc_id"]][1] == d["doc_id"]]
    for d in docs:
        base = secrets.base_spans(d["text"])
        d["text"] = secrets.redacted(d["text"], sorted(base + secrets.random_spans(d["text"], base)))
    size = {d["doc_id"]: len(d["text"].encode().split()) for d in docs}
    sizes = Counter()
    for d in docs:
        sizes[d["source"]] += size[d["doc_id"]]
    amount, at, want = brute_amounts(sizes, mixing.SLOTS), Counter(), Counter()
    for d in sorted(docs, key=lambda d: hashlib.md5(str(d["doc_id"]).encode()).hexdigest()):
        n, s = size[d["doc_id"]], d["source"]
        times = sum(2 * max(0, min(n, amount[s] - at[s] - k * sizes[s])) >= n for k in (0, 1)) if n else 1
        at[s] += n
        if times:
            want[d["doc_id"]] = times
    text = {d["doc_id"]: d["text"] for d in docs}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in got) == want
    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
    assert all(r.piece_ids == library.encode(text[r.doc_id]) and r.round_trip for r in got)
    assert pieces.Encoder(queries.tokenizer("piece_bpe_32k.model")).decode(__import__("numpy").array(got[0].piece_ids)) == text[got[0].doc_id]


def test_stages_keep_columns_and_stand_empty_input(spark, sf_dir):
    import corpus_pipeline

    docs = documents(spark, sf_dir).where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 0
