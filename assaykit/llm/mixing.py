"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame operations only.

``targets`` gives every source (by code point, null last) a weight from a repeating
pattern, shares ``share`` times the corpus size among the sources by weight, and
stops a source at ``most`` times its own size, resharing the excess until none is
above. ``schedule`` maps the golden-ratio points of ``slots`` slots through the
cumulative targets: each slot belongs to the source whose interval holds its point,
and slots are ranked within their source. All slots are of one length, the targets'
sum over the number of slots, so a source gives as many words as it has slots: any
run of consecutive slots, and so the whole mix, holds the sources close to their
target shares (within a few slots of ``slots``), without any slot knowing the others.
A source whose target is below one part in ``SMALL`` of all is too small for that: such sources
share one interval, the pool, and its slots are dealt inside by the same points: a small source
gives its target to the word, spread evenly over the pool's slots from a golden-ratio
point of its own on. The pool has one slot at least. The r-th slot of a source takes the r-th block of that length of the source's stream:
its documents in a shuffled order (digest of doc_id), read up to ``most`` times.

Defined cases: a null text has size 0; documents of size 0 take 0 and ``apply_mix``
keeps them once; null sources form one source, last in order; repeated rows are
documents of their own; blocks past the end of a source's last reading are cut; an empty table gives an
empty result. ``mix`` drops extra columns; ``apply_mix`` keeps all columns, whatever
their names, as it carries each row as one struct.

Scale: per-source order comes from 4096 digest buckets per source, so a source with a
third of all rows is spread over 4096 groups; prefix sums over buckets read one
pre-aggregated row per (source, bucket), sums over sources one row per source, and the
schedule's size is a parameter. ``mix`` shuffles sizes, never texts. ``apply_mix``
moves each text once, straight to the place of its slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SLOTS = 1 << 17
GOLDEN = 0.6180339887498949
#: A source whose target is below one part in so many of all targets is in the pool. Points miss an interval's share by a few slots, so by 1 % at most of the 512 that such a part has.
SMALL = 256
POOL = -1
#: (source, bucket) rows that are sent to all executors at most; beyond, they are joined by a shuffle.
SMALL_SIDE = 400_000


def _digest(doc_id: str) -> Column:
    return F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the shuffled place (bucket, digest) of each document."""
    return docs.select("doc_id", "source", word_count("text").alias("size"), _digest("doc_id").alias("digest")).withColumn("bucket", F.substring("digest", 1, 3))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: source_size, ord, weight, target, from (source, size) rows.

    The water level L solves sum(min(most * size, L * weight)) = share * total.
    Sources are sorted by the level at which they stop; the level follows from
    running sums at the first source that isn't stopped.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = Window.partitionBy()
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    stops = Window.orderBy("stop", "ord")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("ord") % len(weights)).cast("int") + 1)
    t = (
        by.withColumn("ord", F.row_number().over(ordered) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("stop", F.col("cap") / F.col("weight"))
        .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(whole))
        .withColumn("below", F.sum("cap").over(stops) - F.col("cap"))
        .withColumn("left", F.sum("weight").over(whole) - F.sum("weight").over(stops) + F.col("weight"))
        .withColumn("level", (F.col("total") - F.col("below")) / F.col("left"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "ord", "level"))).over(whole)["level"])
    )
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return t.select("source", "source_size", "ord", "weight", target.alias("target"))


def planned(plan: DataFrame) -> DataFrame:
    """Adds each source's quota (its target in whole words), lane (its ord, or POOL), the lane's interval start (before), and total."""
    ordered, whole = Window.orderBy("lane_at", "ord"), Window.partitionBy()
    q = plan.withColumn("quota", F.round("target").cast("long")).withColumn("total", F.sum("quota").over(whole))
    small = F.col("quota") * SMALL < F.col("total")
    q = q.withColumn("lane", F.when(small, POOL).otherwise(F.col("ord"))).withColumn("lane_at", small.cast("int"))
    return q.withColumn("before", F.sum("quota").over(ordered) - F.col("quota")).withColumn("before", F.min("before").over(Window.partitionBy("lane"))).drop("lane_at")


def schedule(plan: DataFrame, slots: int = SLOTS) -> DataFrame:
    """slot, lane, rank: which source, or the pool, each slot reads, and which of the lane's slots it is.

    Slot n has the point frac((n + 0.5) * golden ratio). Points and interval starts
    are sorted together and each point takes the last start before it, so no source
    is compared with every slot.
    """
    starts = plan.where("quota > 0").select((F.col("before") / F.col("total")).alias("at"), F.col("lane").cast("int").alias("lane")).distinct()
    points = plan.sparkSession.range(slots).select(F.col("id").alias("slot"), ((F.col("id") + 0.5) * F.lit(GOLDEN)).alias("u")).select("slot", (F.col("u") - F.floor("u")).alias("at"))
    both = points.select("at", F.lit(1).alias("kind"), "slot", F.lit(None).cast("int").alias("lane")).unionByName(
        starts.select("at", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("slot"), "lane")
    )
    last = F.last("lane", ignorenulls=True).over(Window.orderBy("at", "kind", "slot").rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumn("lane", last).where("kind = 1 and lane is not null").select("slot", "lane")
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("lane").orderBy("slot")) - 1)


def _plan(docs: DataFrame, slots: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes of all documents, ranked slots, and one row per source with its lane's n_slots and its amount of words."""
    sizes = cut(sized(docs))
    plan = cut(planned(targets(sizes)))
    slot = schedule(plan, slots)
    # A pool too small to hold a point is read by the first slot.
    held = plan.where(f"lane = {POOL} and quota > 0").limit(1).select(F.lit(0).cast("long").alias("slot"), F.lit(POOL).alias("lane"), F.lit(0).alias("rank"))
    slot = cut(slot.unionByName(held.join(slot.where(f"lane = {POOL}").limit(1).select("lane"), "lane", "left_anti").select("slot", "lane", "rank")))
    n = slot.groupBy("lane").agg(F.count("*").alias("n_slots"))
    # A block's words are [rank * total / slots, (rank + 1) * total / slots), whole numbers by rounding down.
    amount = F.expr(f"if(lane = {POOL}, quota, least(n_slots * total div {slots}, {MOST} * source_size))")
    per = plan.join(F.broadcast(n), "lane", "left").withColumn("n_slots", F.coalesce("n_slots", F.lit(0)))
    return sizes, slot, per.withColumn("amount", amount).select("source", "ord", "lane", "source_size", "target", "total", "n_slots", "amount")


def _buckets(sizes: DataFrame, per: DataFrame) -> DataFrame:
    """One row per (source, bucket) that has documents: base, the words of its source before it, and the source's row."""
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    by = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return by.alias("b").join(per.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source"))).select("b.*", *[f"p.{c}" for c in per.columns if c != "source"])


def _joined(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """Rows with source and bucket, and the other columns of their bucket's row."""
    small = buckets.limit(SMALL_SIDE + 1).count() <= SMALL_SIDE
    x, y = rows.alias("x"), (F.broadcast(buckets) if small else buckets).alias("y")
    met = x.join(y, F.col("x.source").eqNullSafe(F.col("y.source")) & (F.col("x.bucket") == F.col("y.bucket")))
    return met.select("x.*", *[f"y.{c}" for c in buckets.columns if c not in ("source", "bucket")])


def _rank_of(word: str, slots: int) -> str:
    """The lane's block that a word of a source's stream lies in, or the one before it."""
    point = f"(({word} + 0.5D) / greatest(amount, 1) + (ord + 1) * {GOLDEN}D)"
    return f"if(lane = {POOL}, cast(({point} - floor({point})) * n_slots as bigint), {word} * {slots} div greatest(total, 1))"


def blocks(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Every document with the blocks that read it: a row for each (document, pass, slot), one with a null slot for a document that no slot reads.

    The blocks that a document meets follow by arithmetic and are joined to the ranked
    slots. Columns: doc_id, source, size, source_size, target, bucket, row, slot, pass,
    from_word, to_word.
    """
    sizes, slot, per = _plan(docs, slots)
    inside = Window.partitionBy("source", "bucket").orderBy("digest", "doc_id", "size")
    rows = (
        _joined(sizes, _buckets(sizes, per))
        .withColumn("at", F.col("base") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("row", F.row_number().over(inside))
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MOST - 1))))
        .withColumn("start", F.col("at") + F.col("pass") * F.col("source_size"))
        .withColumn("end", F.least(F.col("start") + F.col("size"), F.col("amount")))
    )
    first, last = (F.expr(_rank_of(c, slots)) for c in ("start", "end"))
    met = F.when(F.col("lane") == POOL, F.array(F.least(first, F.col("n_slots") - 1))).otherwise(F.sequence(F.least(first, last), last + 1))
    rows = rows.withColumn("rank", F.explode_outer(F.when((F.col("start") < F.col("end")) & (F.col("n_slots") > 0), met)))
    # A document of the pool lies whole in one of its slots.
    rows = rows.withColumn("from_word", F.expr(f"if(lane = {POOL}, 0, greatest(rank * total div {slots}, start) - start)"))
    rows = rows.withColumn("to_word", F.expr(f"if(lane = {POOL}, end, least((rank + 1) * total div {slots}, end)) - start"))
    keep = ["doc_id", "source", "size", "source_size", "target", "bucket", "row", "slot", "pass", "from_word", "to_word"]
    return rows.where("rank is null or from_word < to_word").join(F.broadcast(slot), ["lane", "rank"], "left").select(*keep)


def mix(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: the words that the scheduled blocks take of each document."""
    key = ["source", "bucket", "row", "doc_id", "size", "source_size", "target"]
    taken = F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("to_word") - F.col("from_word"))), F.lit(0)).cast("long")
    return blocks(docs, slots).groupBy(*key).agg(taken.alias("taken")).drop("bucket", "row")


def apply_mix(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The documents as the mix takes them, in the order of their slots: whole, once for each pass that takes at least half of their words.

    A document stands at the slot that reads its first word; one without words can't be
    taken in part and stays once. Partition k of the result holds the k-th part of the
    slots, in order; a bucket of documents goes with the slot of its first word.
    """
    sizes, slot, per = _plan(docs, slots)
    n = parts(docs.sparkSession)
    every = _buckets(sizes, per).withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MOST - 1)))).withColumn("first", F.expr("base + pass * source_size"))
    every = every.withColumn("met", F.col("first") < F.col("amount")).where("pass = 0 or met").withColumn("rank", F.expr(f"least(n_slots - 1, {_rank_of('first', slots)})"))
    # Of buckets that no slot reads only documents without words stay; they go anywhere.
    part = F.expr(f"cast(if(met, coalesce(slot, 0) * {n} div {slots}, pmod(xxhash64(source, bucket), {n})) as int)")
    placed = cut(every.join(F.broadcast(slot), ["lane", "rank"], "left").withColumn("part", part).select("source", "bucket", "pass", "first", "part", "ord", "met"))
    rows = docs.select(F.struct("*").alias("whole"), "source", word_count("text").alias("size"), _digest("doc_id").alias("digest")).withColumn("bucket", F.substring("digest", 1, 3))
    dealt = _joined(rows, placed).where("met or size = 0 and pass = 0").drop("met").repartitionById(n, F.col("part")).join(per.select("ord", "lane", "total", "n_slots", "amount"), "ord")
    inside = Window.partitionBy("part", "source", "bucket", "pass").orderBy("digest", "whole.doc_id", "size", F.xxhash64("whole.text"))
    dealt = (
        dealt.withColumn("start", F.col("first") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("given", F.least(F.col("start") + F.col("size"), F.col("amount")) - F.col("start"))
        .where("if(size = 0, pass = 0, given * 2 >= size)")
        .withColumn("rank", F.expr(f"least(n_slots - 1, {_rank_of('start', slots)})"))
    )
    return dealt.join(F.broadcast(slot), ["lane", "rank"], "left").sortWithinPartitions("part", "slot", "start", "whole.doc_id").select("whole.*")
