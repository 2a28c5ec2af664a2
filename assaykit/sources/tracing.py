"""A tracer for code that calls models and tools: spans of one process, as rows."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession

SPAN = "trace_id string, seq long, kind string, name string, input string, output string, error string, latency_ms double"


class Tracer:
    """Records spans in the order in which they start. A span's block may set its output; an error is noted and raised on."""

    def __init__(self, trace_id: str):
        self.trace_id = trace_id
        self.rows: list[dict[str, Any]] = []

    @contextmanager
    def span(self, kind: str, name: str, given: str | None = None) -> Iterator[dict[str, Any]]:
        row = {"trace_id": self.trace_id, "seq": len(self.rows), "kind": kind, "name": name, "input": given, "output": None, "error": None, "latency_ms": 0.0}
        self.rows.append(row)
        began = time.perf_counter()
        try:
            yield row
        except Exception as e:
            row["error"] = f"{type(e).__name__}: {e}"
            raise
        finally:
            row["latency_ms"] = (time.perf_counter() - began) * 1000

    def spans(self, spark: SparkSession) -> DataFrame:
        """The spans so far; ``authoring.steps`` folds them into an agent's steps."""
        names = [f.split()[0] for f in SPAN.split(", ")]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in self.rows], SPAN)
