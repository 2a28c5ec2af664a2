"""Graphs as edge tables: connected components, first independent sets, depth-first numbers.

All run in rounds of joins whose number grows with the logarithm of a chain's length;
each round is written to the shared folder, and only counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .ranks import numbered

#: Literals that one task may settle in order, as a stream.
SMALL = 200_000


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of the edges (a, b) reaches. Null ends go; loops give their node alone.

    In turn each node's larger neighbours are hung under its smallest one, then its smaller
    neighbours are; in the end every node hangs under its component's smallest.
    """
    edges = cut(edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    links, before = edges.where("a > b"), None
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        links = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = links.groupBy("a").agg(F.min("b").alias("low"))
        links = cut(links.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).union(least).where("a != b").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return nodes.join(links, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("component"))


def first_independent(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """k, kept of every node of the edges (a, b), a < b: whether it is in the set that takes nodes in order, each unless a smaller neighbour is in.

    A node is kept if all its literals are false; at first a literal says that a smaller
    neighbour is kept. A round puts in what is settled, and replaces a neighbour that has a single
    literal left by that literal's node, with the sign turned: chains halve in each round. Literals
    that contradict each other drop their node. Once no more than ``small`` literals
    are left, one task settles them in order, as a stream.
    """
    edges = cut(edges.select("a", "b").where("a is not null and b is not null and a < b").distinct())
    kind = edges.schema["a"].dataType.simpleString()
    heads = edges.select(F.col("a").alias("k")).distinct().join(edges.select(F.col("b").alias("k")).distinct(), "k", "left_anti")
    settled = [heads.select("k", F.lit(True).alias("kept"))]
    # (w, v, on): w is out if v's being kept equals on.
    left, fresh = edges.select(F.col("b").alias("w"), F.col("a").alias("v"), F.lit(True).alias("on")), settled[0]
    while True:
        met = left.join(fresh.select(F.col("k").alias("v"), "kept"), "v", "left").withColumn("holds", F.col("kept") == F.col("on"))
        out = F.bool_or(F.coalesce("holds", F.lit(False)))
        clash = F.count_distinct(F.when(F.col("kept").isNull(), F.col("v"))) < F.count_if(F.col("kept").isNull())
        state = cut(met.groupBy("w").agg(out.alias("out"), F.count_if(F.col("kept").isNull()).alias("open"), clash.alias("clash")))
        done = cut(state.where("out or clash or open = 0").select(F.col("w").alias("k"), (~F.col("out") & ~F.col("clash")).alias("kept")))
        settled.append(done)
        rest = cut(met.where("kept is null").select("w", "v", "on").join(done.select(F.col("k").alias("w")), "w", "left_anti"))
        n = rest.count()
        if not n:
            break
        if n <= small:
            settled.append(_in_order(rest, done, kind))
            break
        single = rest.join(state.where("open = 1").select("w"), "w", "left_semi").select(F.col("w").alias("v"), F.col("v").alias("to"), F.col("on").alias("sign"))
        hop = rest.join(single, "v", "left")
        # acc(v) is not(acc(to) = sign), so acc(v) = on where acc(to) = (sign xor on).
        left = cut(hop.select("w", F.coalesce("to", "v").alias("v"), F.when(F.col("to").isNull(), F.col("on")).otherwise(F.col("sign") != F.col("on")).alias("on")).distinct())
        fresh = done
    every = settled[0]
    for x in settled[1:]:
        every = every.unionByName(x)
    return every


def _in_order(rest: DataFrame, done: DataFrame, kind: str) -> DataFrame:
    """Settles what is left, a bounded number of literals, in the order of nodes."""
    met = rest.join(done.select(F.col("k").alias("v"), "kept"), "v", "left")
    rows = met.groupBy("w").agg(F.collect_list(F.struct("v", "on", "kept")).alias("literals"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict = {}
        for pdf in batches:
            for w, literals in zip(pdf["w"], pdf["literals"], strict=True):
                kept[w] = not any((kept[x["v"]] if x["kept"] is None else x["kept"]) == x["on"] for x in literals)
            yield pd.DataFrame({"k": pdf["w"], "kept": [kept[w] for w in pdf["w"]]})

    return cut(rows.repartition(1).sortWithinPartitions("w").mapInPandas(run, f"k {kind}, kept boolean"))


def depth_first(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds root, depth and pre (number in its tree, the root's is 0, by depth and then by ``order`` among siblings) to nodes (id, parent).

    A node whose parent is null or isn't there is a root. Nodes on a circle of parents, or below one, get
    nulls. Each node is entered and left once on a walk of its tree; every step of all walks
    knows its next, and steps take over the sums of their nexts, twice as far each round. Siblings are
    numbered in sorted ranges, so a node with very many children is no single task's.
    """
    placed = numbered(nodes, "parent", *order, "id", name="_no").withColumn("_no", F.col("_no").cast("long"))
    at = placed.select(F.col("id").alias("parent"), F.col("_no").alias("_up"))
    placed = cut(placed.join(at, "parent", "left"))
    child = placed.where("_up is not null")
    nexts = child.select((F.col("_no") - 1).alias("_no"), F.col("_up"), F.col("_no").alias("_sib"))
    first = child.groupBy("_up").agg(F.min("_no").alias("_first")).withColumnRenamed("_up", "_no")
    x = placed.select("_no", "_up").join(nexts, ["_no", "_up"], "left").join(first, "_no", "left")
    enter = x.select((F.col("_no") * 2).alias("s"), F.coalesce(F.col("_first") * 2, F.col("_no") * 2 + 1).alias("next"), F.lit(1).cast("long").alias("enters"), F.lit(1).cast("long").alias("deep"))
    leave = x.select((F.col("_no") * 2 + 1).alias("s"), F.coalesce(F.col("_sib") * 2, F.col("_up") * 2 + 1).alias("next"), F.lit(0).cast("long").alias("enters"), F.lit(-1).cast("long").alias("deep"))
    steps = cut(enter.unionByName(leave).withColumn("last", F.col("s")))
    todo, far = steps.count(), 1
    while far < 2 * todo and steps.where("next is not null").limit(1).count():
        ahead = steps.select(F.col("s").alias("next"), F.col("next").alias("to"), F.col("enters").alias("e"), F.col("deep").alias("d"), F.col("last").alias("l"))
        hop = steps.where("next is not null").join(ahead, "next").select("s", F.col("to").alias("next"), (F.col("enters") + F.col("e")).alias("enters"), (F.col("deep") + F.col("d")).alias("deep"), F.col("l").alias("last"))
        steps = cut(steps.where("next is null").select("s", "next", "enters", "deep", "last").unionByName(hop))
        far *= 2
    ended = steps.where("next is null and s % 2 = 0").select(F.floor(F.col("s") / 2).alias("_no"), F.floor(F.col("last") / 2).alias("_root"), "enters", "deep")
    sizes = ended.where("_no = _root").select("_root", F.col("enters").alias("_size"))
    found = ended.join(sizes, "_root").select("_no", "_root", (-F.col("deep")).alias("depth"), (F.col("_size") - F.col("enters")).alias("pre"))
    roots = placed.select(F.col("_no").alias("_root"), F.col("id").alias("root"))
    return placed.join(found, "_no", "left").join(roots, "_root", "left").select(*nodes.columns, "root", "depth", "pre")
