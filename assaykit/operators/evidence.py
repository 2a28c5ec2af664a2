"""Evidence packages of any size: tables as JSON Lines files, a manifest of their hashes, a record that commits both.

Files are written, hashed and checked by the tasks that hold them; the driver sees one row of totals.
``audit.package`` gives the same as one ZIP for evidence that fits the driver.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EvidenceError
from ..storage import exists, read_file, replace_file
from .audit import ordered_hash
from .ranks import numbered

#: Rows of one file; a file is hashed as one value, so it must stay well below 2 GB.
ROWS_PER_FILE = 200_000
MANIFEST = "part string, file string, bytes long, sha256 string"


def _place(path: Column) -> Column:
    """part/file of a data file's path."""
    return F.regexp_extract(path, "/data/([^/]+/[^/]+)$", 1)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """part, file, bytes and sha256 of the files that are there now."""
    if not exists(spark, f"{path}/data"):
        return spark.createDataFrame([], MANIFEST)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(f"{path}/data")
    at = F.split(_place(F.col("path")), "/")
    return raw.select(at[0].alias("part"), at[1].alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _sealed(manifest: DataFrame) -> dict:
    """Files, bytes and hash of a manifest in the order of its files; blocks of files hash apart."""
    line = F.concat_ws(" ", "part", "file", F.col("bytes").cast("string"), "sha256")
    rows = numbered(manifest.select("part", "file", F.sha2(line, 256).alias("digest"), "bytes"), "part", "file", name="nth")
    total = manifest.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    return {"files": total["files"], "bytes": total["bytes"], "manifest": ordered_hash(rows, "nth").first()["hash"]}


def write(spark: SparkSession, path: str, parts: dict[str, DataFrame], facts: dict | None = None, rows_per_file: int = ROWS_PER_FILE) -> dict:
    """Writes a package of named tables under a new path and gives its record.

    Nulls are kept as fields. The record is written last: a folder without one isn't a package.
    """
    if exists(spark, path):
        raise EvidenceError(f"{path} is there already")
    if bad := [n for n in parts if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", n)]:
        raise EvidenceError(f"no name of a part: {bad[0]!r}")
    for name, df in parts.items():
        df.write.option("maxRecordsPerFile", rows_per_file).option("ignoreNullFields", False).json(f"{path}/data/{name}")
    _files(spark, path).write.json(f"{path}/manifest")
    record = {**(facts or {}), **_sealed(_manifest(spark, path)), "parts": sorted(parts)}
    replace_file(spark, f"{path}/package.json", json.dumps(record, sort_keys=True))
    return record


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def record(spark: SparkSession, path: str) -> dict:
    """A package's record; a folder that was never finished, or whose manifest isn't the one it was sealed with, is an error."""
    if not exists(spark, f"{path}/package.json"):
        raise EvidenceError(f"{path} has no record: it was never finished or isn't a package")
    said = json.loads(read_file(spark, f"{path}/package.json"))
    if not exists(spark, f"{path}/manifest") or any(said.get(k) != v for k, v in _sealed(_manifest(spark, path)).items()):
        raise EvidenceError(f"the manifest of {path} isn't the one it was sealed with")
    return said


def verify(spark: SparkSession, path: str) -> DataFrame:
    """part, file, verdict of every file of a package: ok, changed, missing or extra."""
    record(spark, path)
    have = _files(spark, path).select("part", "file", F.col("sha256").alias("now"))
    verdict = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when(F.col("now") == F.col("sha256"), "ok").otherwise("changed")
    return _manifest(spark, path).join(have, ["part", "file"], "full_outer").select("part", "file", verdict.alias("verdict"))


def lines(spark: SparkSession, path: str, part: str) -> DataFrame:
    """value: the lines of a part; a part with a file that is changed, missing or extra is an error."""
    said = record(spark, path)
    if part not in said["parts"]:
        raise EvidenceError(f"{path} has no part {part}")
    broken = verify(spark, path).where((F.col("part") == part) & (F.col("verdict") != "ok")).orderBy("file").first()
    if broken:
        raise EvidenceError(f"{part}/{broken['file']} is {broken['verdict']}")
    return spark.read.option("pathGlobFilter", "*.json").text(f"{path}/data/{part}")
