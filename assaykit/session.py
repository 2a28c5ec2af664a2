"""Making the package importable for Python workers."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Once a context: on one machine workers get the package's folder on their path, elsewhere a ZIP of it.

    Arrow batches stay small unless the session says otherwise: both sides hold several
    of them for each running task, outside the JVM's heap.
    """
    sc = spark.sparkContext
    if BATCH not in spark.conf.getAll:
        spark.conf.set(BATCH, "4m")
    if getattr(sc, "_assaykit", False):
        return
    if sc.master.startswith("local"):
        held = sc.environment.get("PYTHONPATH", "")
        sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT.parent), held]))
    else:
        path = Path(tempfile.mkdtemp(prefix="assaykit-")) / "assaykit.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(ROOT.rglob("*.py")):
                z.write(f, f.relative_to(ROOT.parent))
        sc.addPyFile(str(path))
    sc._assaykit = True


def shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run
