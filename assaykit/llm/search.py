"""Ranked lexical search: postings bucketed by term, joined with the terms of items.

``postings`` is the index: a row (bucket, term, doc_id, row, n, tf) for each document
and term of it, sorted by bucket and term in each part, so that a search for a few terms reads
few row groups; bucket -1 holds a row for each document that has terms, which gives the
number of documents N and the total of terms L. Terms are maximal runs of ASCII letters
and digits and of all characters beyond ASCII, with A-Z lower-cased.

``search`` counts in how many documents each asked term is (df), weighs it, scores each
posting in 64-bit integers, joins the items that ask for the term, sums by item and
document, and ranks by row_number. Postings meet by document before the items multiply
them, so that the sums need no second shuffle: a term that every document holds is dealt
like any other, and only an item's best k of each task travel on.

Defined cases: null texts and texts without terms are no documents (N leaves them out)
and no items; each row is a document of its own, also where doc_ids repeat, and their
ties may come in any order of rows; rows of one item_id are one item, whose terms add
up; null ids are ids like any other and sort first; terms of weight 0 (in nearly all
documents) add nothing; an item that meets no document has no rows; empty tables give an
empty result; extra columns are ignored.

Scale: what is broadcast is counted first: terms of items, at most ``SMALL_TERMS``
distinct ones and ``SMALL_TERMS`` (item, term) rows; beyond that the same tables are
joined by a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, slices

BUCKETS, TOP = 64, 20
SMALL_TERMS = 200_000
#: Other characters than those of terms; with them split, A-Z lower-cased.
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(docs: DataFrame, asked: set[bytes] | None = None) -> DataFrame:
    """bucket, term, doc_id, row, n (terms of the document), tf of all terms, or of the asked ones; one row more for each document, in bucket -1."""
    terms = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = terms.value
        for batch in slices(batches, "text", 4 << 20):
            at, n, term, tf = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                if text is None or not (words := text.translate(_TABLE).split()):
                    continue
                counts = Counter(words)
                held = counts if wanted is None else counts.keys() & wanted
                term += [b"", *held]
                tf += [0, *map(counts.__getitem__, held)]
                at += [i] * (len(held) + 1)
                n += [len(words)] * (len(held) + 1)
            if at:
                at = pa.array(at, pa.int32())
                cols = [batch.column("doc_id").take(at), batch.column("row").take(at), pa.array(n, pa.int64()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(tf, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", "n", "term", "tf"])

    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("row long, n long, term string, tf long")])
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.monotonically_increasing_id().alias("row")).mapInArrow(run, schema)
    bucket = F.when(F.col("term") == "", -1).otherwise(bucket_of(F.col("term"))).alias("bucket")
    return rows.select(bucket, "term", "doc_id", "row", "n", "tf").sortWithinPartitions("bucket", "term")


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, bucket, term, times of each item."""
    words = F.filter(F.split(F.translate("text", _UPPER, _LOWER), APART), lambda x: x != "")
    rows = items.select("item_id", F.explode(words).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))
    return rows.withColumn("bucket", bucket_of(F.col("term")))


def ranked(index: DataFrame, wanted: DataFrame, top: int = TOP) -> DataFrame:
    """The best documents of a written index for the terms of items."""
    n_docs, n_terms = index.where("bucket = -1").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    small = wanted.limit(SMALL_TERMS + 1).count() <= SMALL_TERMS
    sent = F.broadcast if small else (lambda x: x)
    found = index.where("bucket >= 0").join(sent(wanted.select("bucket", "term").distinct()), ["bucket", "term"], "left_semi")
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    weighed = found.groupBy("bucket", "term").agg(F.count("*").alias("df")).select("bucket", "term", weight.alias("w")).where("w > 0")
    m = f"(75 + (25 * n * {n_docs}L) div {max(1, n_terms)}L)"
    part = F.expr(f"w * ((1000000000L * tf) div (1000 * tf + 12 * {m}))").alias("part")
    scored = found.join(sent(weighed), ["bucket", "term"]).select("row", "doc_id", "term", part).repartition("row")
    summed = scored.join(sent(wanted.select("term", "item_id", "times")), "term").groupBy("item_id", "row", "doc_id").agg(F.sum(F.col("part") * F.col("times")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return summed.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of each item.

    The index is made of the asked terms alone where these are few; else of all.
    """
    wanted = cut(item_terms(items))
    asked = wanted.select(F.col("term").cast("binary")).distinct().limit(SMALL_TERMS + 1).toArrow().column(0).to_pylist()
    return ranked(cut(postings(docs, set(asked) if len(asked) <= SMALL_TERMS else None)), wanted, top)
