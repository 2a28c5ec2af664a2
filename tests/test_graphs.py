"""Components, first independent sets and depth-first numbers against plain loops."""

import random

import pytest

from assaykit.operators import gates, graphs


def plain_components(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(0, k) for k in range(1, 40)] + [(500, 500)]
    got = {r.node: r.component for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == plain_components(edges)
    named = graphs.components(spark.createDataFrame([("b", "a"), ("b", "c"), (None, "x")], "a string, b string")).collect()
    assert {(r.node, r.component) for r in named} == {("a", "a"), ("b", "a"), ("c", "a")}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_first(edges):
    before = {}
    for a, b in edges:
        before.setdefault(a, set())
        before.setdefault(b, set()).add(a)
    kept = {}
    for k in sorted(before):
        kept[k] = not any(kept[x] for x in before[k])
    return kept


@pytest.mark.parametrize("small", [graphs.SMALL, 40, 0])
def test_first_independent_set(spark, small):
    rng = random.Random(8)
    edges = {(i, i + 1) for i in range(200)}
    edges |= {(1000 + min(i, j), 1000 + max(i, j)) for i, j in ((rng.randrange(80), rng.randrange(80)) for _ in range(200)) if i != j}
    edges |= {(2000, 2000 + k) for k in range(1, 30)} | {(3000 + i, 3000 + i + d) for i in range(25) for d in (1, 2)}
    frame = spark.createDataFrame(sorted(edges), "a long, b long")
    assert {r.k: r.kept for r in graphs.first_independent(frame, small).collect()} == plain_first(edges)
    assert graphs.first_independent(frame.where("a < 0"), small).count() == 0


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """10,000 rows, each like the next: halves of the chain settle in each round."""
    rounds = []
    real = graphs.cut
    monkeypatch.setattr(graphs, "cut", lambda df: rounds.append(1) or real(df))
    n = 10_000
    edges = spark.range(n - 1).selectExpr("id as a", "id + 1 as b")
    got = graphs.first_independent(edges, small=0)
    assert len(rounds) <= 4 * 20 and got.where("kept = (k % 2 = 0)").count() == n == got.count()
    monkeypatch.undo()
    words = spark.range(300).selectExpr("id as k", "transform(sequence(id, id + 19), x -> concat('w', x)) as tokens")
    kept = {r.k: r.kept for r in gates.accepted(words, "k", "tokens").collect()}
    assert kept == {k: k % 2 == 0 for k in range(300)}


def plain_walk(nodes):
    """id -> (root, depth, pre) of (id, parent, at)."""
    ids, kids = {n[0] for n in nodes}, {}
    for i, p, at in nodes:
        kids.setdefault(p if p in ids else None, []).append((at, i))
    out = {}

    def visit(i, root, depth, counter):
        out[i] = (root, depth, counter[0])
        counter[0] += 1
        for _, k in sorted(kids.get(i, ())):
            visit(k, root, depth + 1, counter)

    for _, i in kids.get(None, ()):
        visit(i, i, 0, [0])
    return {i: out.get(i, (None, None, None)) for i in ids}


def test_depth_first_numbers(spark):
    rng = random.Random(6)
    nodes = [(f"n{i}", f"n{rng.randrange(max(1, i - 40), i)}" if i % 9 else rng.choice((None, "gone")), rng.randint(0, 5)) for i in range(2, 300)]
    nodes += [("hub", None, 0)] + [(f"h{i}", "hub", i % 7) for i in range(120)]
    nodes += [(f"c{i}", f"c{i - 1}" if i else None, 0) for i in range(90)]
    nodes += [("x", "z", 0), ("y", "x", 0), ("z", "y", 0), ("tail", "z", 0), ("self", "self", 0)]
    got = {r.id: (r.root, r.depth, r.pre) for r in graphs.depth_first(spark.createDataFrame(nodes, "id string, parent string, at int"), ["at"]).collect()}
    assert got == plain_walk(nodes)
    assert graphs.depth_first(spark.createDataFrame([], "id string, parent string, at int"), ["at"]).count() == 0
