"""Similarity join on word shingles: adaptive multi-match prefixes, then exact verification.

A document's set holds the 64-bit names of its distinct 5-word shingles. Documents
with equal sets form one class, which its smallest doc_id stands for. Tokens of all
sets share one order, rarest first, by a count sketch over all documents (a fixed
number of buckets, so its size does not follow the input; it decides order and cost,
never results). Two sets that link share at least l tokens among their first
``n - ceil(0.8 n) + l``, for every l: each class lengthens its prefix to the l with
the least estimated cost: of comparing that prefix with those of the classes it meets,
and of verifying the candidates that are left, at most postings / l. A pair is verified
only if it shares the smaller l of the two. Classes meet by the tokens of the prefix for
l = 1, which any link shares; the longer prefixes are compared whole when two have met.

Large posting groups don't emit all their pairs: first each member is compared with
the group's smallest member alone, links found there form components, and pairs
inside one component are not compared again: ``join`` returns classes and components,
which such links can't change. ``links`` compares all and returns every link between
classes; ``with_link_counts`` adds each document's number of links. Verification recomputes both sets from
whole texts and tests 100 * intersection >= 80 * union.

Defined cases: null and empty texts, and texts without words, have 0 shingles and
link with nothing; fewer than five words count as one shingle; rows with one doc_id
are one document that has all their links and one component; a null doc_id has a null component;
extra columns are ignored, and kept by ``one_of_each`` whatever their names. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import count_sketch, cut, mix64, slices, texts_of, trim, word_names
from .components import components

WIDTH, PERCENT = 5, 80
SKETCH_BITS = 20
DEEPEST, COMPARE_COST, VERIFY_COST, HOT = 16, 0.02, 50.0, 16
SMALL_SIDE = 100_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = mix64(np.arange(256).astype(np.uint64) + np.uint64(1))
_PLACES = mix64(np.arange(1, WIDTH + 1).astype(np.uint64)) | np.uint64(1)


def shingles(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """Names of each text's shingles, in order and with repeats."""
    raw = "\n".join(texts).encode().lower() + b"\n"
    b = np.frombuffer(raw, np.uint8)
    inside = ~_SPACE[b]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = word_names(_BYTES[b], start, end)
    lens = np.fromiter((len(t.encode()) + 1 for t in texts), np.int64, len(texts))
    at = np.searchsorted(start, np.concatenate([[0], np.cumsum(lens)])).tolist()
    if len(words) >= width:
        n = len(words) - width + 1
        names = np.zeros(n, np.uint64)
        for j in range(width):
            names += words[j : j + n] * _PLACES[j]
        names = mix64(names)
    out = []
    for a, z in zip(at, at[1:], strict=False):
        if z - a >= width:
            out.append(names[a : z - width + 1])
        elif z > a:
            out.append(mix64(np.array([(words[a:z] * _PLACES[: z - a]).sum() + np.uint64(z - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def token_sketch(docs: DataFrame) -> np.ndarray:
    """Shingle counts over all documents by hash bucket: 2**SKETCH_BITS numbers."""
    counts = count_sketch(docs.select("text"), lambda batch: np.concatenate(shingles(texts_of(batch))), SKETCH_BITS)
    return np.minimum(counts, (1 << 32) - 1).astype(np.uint32)


def needed(n: int, percent: int = PERCENT) -> int:
    """Least intersection of a set of n with any set that it links to."""
    return -(-n * percent // 100)


def prefix(tokens: np.ndarray, counts: np.ndarray, percent: int = PERCENT) -> tuple[int, np.ndarray]:
    """(matches required, tokens of the prefix) of a sorted set, by least estimated cost."""
    n = len(tokens)
    order = np.lexsort((tokens, counts))
    least = needed(n, percent)
    base = n - least + 1
    deep = min(DEEPEST, least)
    lists = np.cumsum(np.maximum(counts[order[: base + deep - 1]].astype(np.float64) - 1, 0))
    depth = np.arange(1, deep + 1)
    met, read = lists[base - 1], lists[base - 1 : base - 1 + deep]
    best = int(np.argmin(met * (base + depth) * COMPARE_COST + VERIFY_COST * read / depth + depth))
    return best + 1, tokens[order[: base + best]]


def classed(docs: DataFrame, counts: np.ndarray, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """doc_id, n, set_key, depth, tokens: each document's set and its prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        for batch in slices(batches, "text", 1 << 20):
            rows = []
            for names in shingles(texts_of(batch), width):
                u = np.unique(names)
                depth, tokens = prefix(u, sketch[u >> np.uint64(64 - SKETCH_BITS)], percent) if len(u) else (0, u)
                rows.append((len(u), hashlib.blake2b(u.tobytes(), digest_size=16).digest(), depth, tokens.view(np.int64)))
            n, key, depth, tokens = zip(*rows, strict=True)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(t) for t in tokens])]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(tokens), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(depth, pa.int32()), lists], names=["doc_id", "n", "set_key", "depth", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, set_key binary, depth int, tokens array<long>")


def verified(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """The pairs (a, b) of doc_ids whose sets link, from whole texts."""
    ids = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    few = ids.count() <= SMALL_SIDE
    texts = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"))
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "y", 1 << 20):
            a, b, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))
            place = {t: i for i, t in enumerate(dict.fromkeys(t or "" for t in [*x, *y]))}
            sets = [np.unique(s) for s in shingles([*place], width)]
            hit = []
            for i, (s, t) in enumerate(zip(x, y, strict=True)):
                u, v = sets[place[s or ""]], sets[place[t or ""]]
                common = len(np.intersect1d(u, v, assume_unique=True))
                if common and 100 * common >= percent * (len(u) + len(v) - common):
                    hit.append(i)
            if hit:
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in hit], pa.int64()), pa.array([b[i] for i in hit], pa.int64())], names=["a", "b"])

    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _base(n: Column, percent: int) -> Column:
    """Length of the prefix in which any link shares at least one token."""
    return (n - F.ceil(n * percent / F.lit(100.0) - 1e-9) + 1).cast("int")


def _need(m: Column, n: Column, percent: int) -> Column:
    """Least intersection of two linked sets of these sizes."""
    return F.ceil((m + n) * percent / F.lit(100.0 + percent) - 1e-9)


def _may_link(percent: int) -> Column:
    """Whether two sets whose first common token has these places may link: by sizes, and by what follows the places.

    A pair that links passes at its first common token, which both base prefixes hold.
    """
    m, n = F.col("n_x"), F.col("n_y")
    return (m * 100 >= n * percent) & (n * 100 >= m * percent) & (F.least(m - F.col("pos_x"), n - F.col("pos_y")) >= _need(m, n, percent))


def _matched(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs that share as many prefix tokens as the shallower of the two requires, and may still reach the intersection they need."""
    x, y = (classes.select(F.col("rep").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "depth", "tokens")]) for side in "ab")
    hits = F.size(F.array_intersect("tokens_a", "tokens_b"))
    rest = F.greatest(*[F.col(f"n_{s}") - F.size(f"tokens_{s}") for s in "ab"])
    met = pairs.join(x, "a").join(y, "b").withColumn("hits", hits)
    return met.where((F.col("hits") >= F.least("depth_a", "depth_b")) & (F.col("hits") + rest >= _need(F.col("n_a"), F.col("n_b"), percent))).select("a", "b")


def _posted(docs: DataFrame, percent: int, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets of all rows, classes of equal sets, and the base prefixes' postings of tokens that classes share."""
    sets = cut(classed(docs, token_sketch(docs), percent, width))
    keyed = sets.where("n > 0 and doc_id is not null")
    classes = keyed.groupBy("n", "set_key").agg(F.min("doc_id").alias("rep"), F.first("depth").alias("depth"), F.first("tokens").alias("tokens"))
    classes = cut(classes)
    postings = classes.select("rep", "n", F.posexplode(F.slice("tokens", 1, _base(F.col("n"), percent))).alias("pos", "token"))
    # Counted with map-side sums and joined back, so that a frequent token is split where adaptive execution splits skewed joins.
    sizes = postings.groupBy("token").agg(F.count("*").alias("size"), F.min("rep").alias("lead")).where("size > 1")
    return sets, classes, cut(postings.join(sizes, "token"))


def _met(x: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of representatives that share a token of postings and may link, with the columns of both."""
    a, b = (x.select("token", *[F.col(c).alias(f"{c}_{k}") for c in x.columns if c != "token"]) for k in "xy")
    return a.join(b, "token").where((F.col("rep_x") < F.col("rep_y")) & _may_link(percent)).withColumns({"a": F.col("rep_x"), "b": F.col("rep_y")})


def links(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """a, b: every pair of linked classes, by their representatives, a < b.

    Unlike join(), which needs components only, it compares all members of large
    groups, so its cost follows the number of pairs, up to the square of a group.
    """
    _, classes, shared = _posted(docs, percent, width)
    pairs = cut(_met(shared.select("token", "rep", "n", "pos"), percent).select("a", "b").distinct())
    return verified(cut(_matched(pairs, classes, percent)), docs, percent, width)


def with_link_counts(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """The rows of join() and n_links: with how many other documents each row's own set links, those with an equal set among them."""
    rows = cut(join(docs, percent, width))
    members = rows.where("n_shingles > 0 and doc_id is not null").select("class_id", "doc_id").distinct().groupBy("class_id").agg(F.count("*").alias("size"))
    pairs = cut(links(docs, percent, width))
    both = pairs.union(pairs.select("b", "a")).toDF("class_id", "other")
    far = both.join(members.toDF("other", "far"), "other").groupBy("class_id").agg(F.sum("far").alias("far"))
    counts = members.join(far, "class_id", "left").select("class_id", (F.col("size") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    none = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    return rows.join(counts, "class_id", "left").select(*rows.columns, F.when(~none, F.col("n_links")).otherwise(0).alias("n_links"))


def _same_ids(sets: DataFrame, classes: DataFrame) -> DataFrame | None:
    """doc_id, rep, first (smallest rep of the doc_id) of doc_ids with different sets; None where there are none."""
    key = F.xxhash64("set_key")
    many = cut(sets.where("doc_id is not null").groupBy("doc_id").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo < hi").select("doc_id"))
    if not many.limit(1).count():
        return None
    held = sets.where("n > 0").join(many, "doc_id", "left_semi").join(classes.select("n", "set_key", "rep"), ["n", "set_key"]).select("doc_id", "rep").distinct()
    return cut(held.join(held.groupBy("doc_id").agg(F.min("rep").alias("first")), "doc_id"))


def join(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id of every row."""
    sets, classes, shared = _posted(docs, percent, width)
    trim(docs.sparkSession)
    found = None
    stars = shared.where((F.col("size") > HOT) & (F.col("rep") != F.col("lead")))
    if stars.limit(1).count():
        leads = shared.where(F.col("rep") == F.col("lead")).select("token", F.col("n").alias("n_x"), F.col("pos").alias("pos_x"))
        near = stars.withColumnsRenamed({"n": "n_y", "pos": "pos_y"}).join(leads, "token").where(_may_link(percent)).select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
        found = cut(verified(_matched(cut(near), classes, percent), docs, percent, width))
        group = components(found).select(F.col("node").alias("rep"), F.col("component").alias("comp"))
        shared = cut(shared.join(group, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")))
        trim(docs.sparkSession)
    else:
        shared = shared.withColumn("comp", F.col("rep"))

    # Groups that lie in one component already have nothing left to compare.
    mixed = shared.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    side = shared.join(mixed, "token", "left_semi").select("token", "rep", "n", "pos", "comp")
    pairs = _met(side, percent).where(F.col("comp_x") != F.col("comp_y")).select("a", "b").distinct()
    pairs = cut(_matched(cut(pairs), classes, percent))
    links = verified(pairs, docs, percent, width)
    links = links.union(found) if found is not None else links
    same_ids = _same_ids(sets, classes)
    if same_ids is not None:
        links = links.union(same_ids.where("rep != first").select("first", "rep"))
    links = cut(links)
    trim(docs.sparkSession)
    linked = components(links)
    trim(docs.sparkSession)

    class_of = classes.select("n", "set_key", "rep").join(linked, F.col("rep") == F.col("node"), "left").select("n", "set_key", "rep", F.coalesce("component", "rep").alias("comp"))
    # Rows without shingles have no class; apart, they don't meet in one join key.
    bare = sets.where("n = 0").select("n", "set_key", "doc_id").withColumns({"rep": F.lit(None).cast("long"), "comp": F.lit(None).cast("long")})
    every = sets.where("n > 0").select("doc_id", "n", "set_key").join(class_of, ["n", "set_key"], "left").select(*bare.columns).union(bare)
    if same_ids is not None:
        # A row without shingles goes with the other rows of its doc_id.
        alike = same_ids.groupBy("doc_id").agg(F.min("first").alias("node")).join(linked, "node", "left").select("doc_id", F.coalesce("component", "node").alias("other"))
        every = every.join(alike, "doc_id", "left").withColumn("comp", F.coalesce("comp", "other"))
    return every.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("class_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component: the one with the smallest doc_id; documents that link with nothing stay.

    Of rows that repeat the doc_id of a kept document, one stays.
    """
    kept = join(docs).where("doc_id = component_id").select(F.col("doc_id").alias("key")).distinct()
    # A row travels as one struct, so its columns may have any names.
    rows = docs.select(F.struct("*").alias("whole"), F.col("doc_id").cast("long").alias("key"))
    first = F.row_number().over(Window.partitionBy("key").orderBy("whole.text"))
    single = rows.join(kept, "key", "left_semi").withColumn("nth", first).where("nth = 1")
    return single.select("whole.*").unionByName(docs.where("doc_id is null"))
