"""The corpus pipeline: quality, near duplicates, secrets, mixing, encoding.

Each stage takes and returns whole tables. All but the last return the columns of
documents: the classifier drops what it rejects, the join keeps one document of
each group, the scan replaces each secret in a text by [SECRET], the mix repeats or
drops documents as its schedule takes them, in the order of its slots, and the last stage
encodes the texts. Extra columns go through whatever their names; the last stage renames
those that clash with its own to input_NAME.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm import jaccard, mixing, pieces, quality, secrets
from assaykit.llm.common import documents, restored, trim
from assaykit.llm.queries import tokenizer
from assaykit.session import ship
from assaykit.storage import scope

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: SQL can't express the classifier or the encoder; a test compares the pipeline with brute force.
ORACLE_SQL = None


def staged(f: Stage) -> Stage:
    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        # What the stages before left in the driver goes before this one's plans add to it.
        trim(spark)
        out = f(spark, docs, sf_dir)
        trim(spark)
        return out

    return run


@staged
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return restored(quality.classify(docs, model, drop_text=False).where("predicted = 1"), docs.columns, quality.ADDED)


@staged
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


@staged
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.scan(docs).withColumn("text", F.col("redacted"))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return restored(found, docs.columns, [f.split()[0] for f in secrets.FOUND.split(", ")])


@staged
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


@staged
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, tokenizer("piece_bpe_32k.model"), keep_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("piece encoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        # A stage's own tables go with it; what it returns stays.
        with scope(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir))
    return docs
