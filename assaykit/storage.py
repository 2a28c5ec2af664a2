"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

FOLDER = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; without one, a temporary folder on a single machine and an error on a cluster."""
    named = spark.conf.get(FOLDER, None) or spark.sparkContext.getConf().get(FOLDER)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {FOLDER} to a folder that the driver and all executors share")
    named = tempfile.mkdtemp(prefix="assaykit-")
    spark.conf.set(FOLDER, named)
    return named


#: Paths made inside the scopes that are open, innermost last.
_scopes: list[list[str]] = []


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the intermediate tables that are made inside, when it ends; gives a ``cut`` whose tables stay.

    What is computed inside must be written before the scope ends, by that cut or elsewhere: a frame
    that still reads an intermediate table can't be computed afterwards.
    """
    made: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        _scopes.append([])
        try:
            return cut(df)
        finally:
            _scopes.pop()

    _scopes.append(made)
    try:
        yield keep
    finally:
        _scopes.remove(made)
        for path in made:
            at, files = _path(spark, path)
            files.delete(at, True)


def new_path(spark: SparkSession) -> str:
    """A path under the shared folder that is deleted when the scope it is made in ends, or the application."""
    path = f"{shared_dir(spark).rstrip('/')}/assaykit/{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    if _scopes:
        _scopes[-1].append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """A frame written as Parquet under the shared folder and read back.

    Lineage ends at files that all executors see, so a lost executor costs a re-read,
    not a recomputation.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there; a store that can't be asked is an error."""
    at, files = _path(spark, path)
    return files.exists(at)


def read_file(spark: SparkSession, path: str) -> str:
    """A small text file of any file system that Spark knows."""
    at, files = _path(spark, path)
    stream = files.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small text file under another name and renames it over the one that is there: a reader sees the old or the new text."""
    jvm = spark.sparkContext._jvm
    at, files = _path(spark, path)
    temp, _ = _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = files.create(temp, False)
    out.write(text.encode())
    out.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(temp, at, how)
