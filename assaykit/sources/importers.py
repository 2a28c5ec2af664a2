"""Importers of cases and traces from other stores, as Python data sources.

An importer lists its pages and reads one page at a time; Spark reads pages in
parallel, each where its task lies, and again where a task is lost.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.graphs import depth_first

TRACE = "trace_id string, input string, output string, context string, metadata string"
NAMES = tuple(f.split()[0] for f in TRACE.split(", "))


class Importer(ABC):
    """What a store must offer; instances travel to tasks, so they hold settings, not connections."""

    @abstractmethod
    def pages(self) -> list[str]:
        """Names of the pages, on the driver."""

    @abstractmethod
    def page(self, name: str) -> Iterator[dict[str, str | None]]:
        """Rows of one page, fields as in TRACE; missing ones are null, others are left out."""


class _Reader(DataSourceReader):
    def __init__(self, importer: Importer):
        self.importer = importer

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.importer.pages()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:
            return
        for row in self.importer.page(partition.value):
            yield tuple(row.get(n) for n in NAMES)


RUN = "run_id string, parent_id string, run_type string, name string, inputs string, outputs string, error string, start_time double"


def _value(fields: Column) -> Column:
    """The text of a JSON object of inputs or outputs: its first usual key, else its first value."""
    usual = F.coalesce(*[F.get_json_object(fields, f"$.{k}") for k in ("input", "output", "question", "answer", "text", "content")])
    some = F.map_values(F.from_json(fields, "map<string,string>"))
    return F.coalesce(usual, F.try_element_at(some, F.lit(1)), F.lit(""))


def run_trees(runs: DataFrame) -> DataFrame:
    """Runs (as in RUN) with root, depth and pre: their place on a walk of their tree, siblings by start time. See graphs.depth_first."""
    named = runs.withColumnsRenamed({"run_id": "id", "parent_id": "parent"})
    return depth_first(named, ["start_time"]).withColumnsRenamed({"id": "run_id", "parent": "parent_id"})


def run_traces(trees: DataFrame, deep: bool = True) -> DataFrame:
    """trace_id, input, output, error, steps of each root of ``run_trees``.

    Tool runs between two model runs are one step, in the order of the walk: of all runs below the root, or
    with ``deep`` off of its children alone. The root's output goes to the last step, which
    is made for it where there is none. A tool that failed has its error for a result.
    """
    below = trees.where("depth > 0" if deep else "depth = 1")
    seen = Window.partitionBy("root").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    result = F.when(F.col("error").isNotNull(), F.concat(F.lit("[ERROR: "), "error", F.lit("]"))).otherwise(_value(F.col("outputs")))
    call = F.struct(F.coalesce("name", F.lit("unknown_tool")).alias("name"), F.coalesce("inputs", F.lit("{}")).alias("arguments"), result.alias("result"))
    tools = below.withColumn("part", F.count_if(F.col("run_type") == "llm").over(seen)).where("run_type = 'tool'")
    parts = tools.groupBy("root", "part").agg(F.array_sort(F.collect_list(F.struct("pre", call.alias("c")))).alias("x"))
    steps = parts.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("part", F.transform("x", lambda s: s["c"]).alias("tool_calls")))).alias("x"))
    rows = trees.where("depth = 0").join(steps, "root", "left").withColumn("said", _value(F.col("outputs")))
    calls = F.coalesce(F.transform("x", lambda s: s["tool_calls"]), F.array().cast("array<array<struct<name:string,arguments:string,result:string>>>"))
    n = F.size(calls)
    told = F.transform(calls, lambda c, i: F.struct(c.alias("tool_calls"), F.when((i == n - 1) & (F.col("said") != ""), F.col("said")).alias("output")))
    bare = F.array(F.struct(F.array().cast("array<struct<name:string,arguments:string,result:string>>").alias("tool_calls"), F.col("said").alias("output")))
    made = F.when((n == 0) & (F.col("said") != ""), bare).otherwise(told)
    return rows.select(F.col("run_id").alias("trace_id"), _value(F.col("inputs")).alias("input"), F.col("said").alias("output"), "error", made.alias("steps"))


def imported(spark: SparkSession, importer: Importer, name: str = "assaykit_import") -> DataFrame:
    """Rows of all pages of an importer."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return TRACE

        def reader(self, schema) -> DataSourceReader:
            return _Reader(importer)

    spark.dataSource.register(Source)
    return spark.read.format(name).load()
