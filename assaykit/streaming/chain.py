"""A hash-chained log with one writer at a time and appends that happen once.

An append's lines are written into a folder of their own, and count only once the
append's commit record is there: a small JSON file, made under another name and renamed to
its number, which fails if that number is taken. A record holds the append's number, its
source and batch, its first line, the number of lines, the hash before and the hash at its end,
the batches that each source has committed, and a hash of all that; it is the log's checkpoint.
Before an append the last record is read and verified, and the last line of the log against it.

* A batch that a source sends again (its commit of progress was lost) is compared with what the
  log holds and left out; if its lines differ, that is an error.
* An append without record (its writer died) is overwritten by the next one; readers don't see it.
* A record or line that can't be read or doesn't fit is an error. Only a log whose folder has
  no records is empty.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import GENESIS, heads, links

Anchor = Callable[[int, str], None]


class ChainError(RuntimeError):
    """The log can't be trusted or written."""


@dataclass
class Commit:
    number: int
    source: str
    batch: int
    first_line: int
    lines: int
    before: str
    after: str
    batches: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        body = json.dumps(asdict(self), sort_keys=True)
        return json.dumps({"commit": asdict(self), "sha256": hashlib.sha256(body.encode()).hexdigest()}, sort_keys=True)

    @classmethod
    def read(cls, text: str) -> Commit:
        try:
            held = json.loads(text)
            found = cls(**held["commit"])
            whole = json.loads(found.text())["sha256"] == held["sha256"]
        except (ValueError, TypeError, KeyError) as e:
            raise ChainError(f"a commit record can't be read: {e}") from e
        if not whole:
            raise ChainError(f"commit record {found.number} was changed")
        return found


class Log:
    """The log in a folder that the driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def numbers(self) -> list[int]:
        """Numbers of all commit records; a folder that isn't there has none."""
        at = self._at("_commits")
        if not self.fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def commit(self, number: int) -> Commit:
        stream = self.fs.open(self._at(f"_commits/{number:012d}.json"))
        try:
            return Commit.read(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def last(self) -> Commit | None:
        """The last record, after a check that none is missing and that the log's last line has its hash."""
        numbers = self.numbers()
        if not numbers:
            return None
        if numbers != list(range(len(numbers))):
            raise ChainError("commit records are missing")
        found = self.commit(numbers[-1])
        if found.number != numbers[-1]:
            raise ChainError(f"commit record {numbers[-1]} is another's")
        end = self._lines(found.number).where(F.col("line_no") == found.first_line + found.lines - 1).collect()
        if len(end) != 1 or _hash(end[0]["value"]) != found.after:
            raise ChainError(f"the last line of append {found.number} doesn't fit its record")
        return found

    def _lines(self, number: int) -> DataFrame:
        return self.spark.read.schema("line_no long, value string").parquet(f"{self.path}/append={number:012d}")

    def lines(self) -> DataFrame:
        """line_no, value of all committed appends."""
        numbers = self.numbers()
        if not numbers:
            return self.spark.createDataFrame([], "line_no long, value string")
        every = self.spark.read.schema("line_no long, value string, append string").parquet(self.path)
        return every.where(F.col("append").cast("long") <= numbers[-1]).select("line_no", "value")

    def write(self, payloads: DataFrame, source: str, batch: int, anchor: Anchor | None = None) -> Commit | None:
        """Appends payloads (seq, payload JSON) in seq order, once for each (source, batch); None for an empty batch."""
        last = self.last()
        if last and batch <= last.batches.get(source, -1):
            return self._again(payloads, source, batch)
        number, line, prev = (last.number + 1, last.first_line + last.lines, last.after) if last else (0, 0, GENESIS)
        held = f"{self.path}/append={number:012d}"
        _linked(payloads, line, prev).write.mode("overwrite").parquet(held)
        end = self._lines(number).agg(F.count("*").alias("n"), F.max_by("value", "line_no").alias("value")).first()
        if not end["n"]:
            self.fs.delete(self._at(f"append={number:012d}"), True)
            return None
        made = Commit(number, source, batch, line, end["n"], prev, _hash(end["value"]), {**(last.batches if last else {}), source: batch})
        self._record(made)
        if anchor is not None:
            anchor(made.first_line + made.lines - 1, made.after)
        return made

    def _again(self, payloads: DataFrame, source: str, batch: int) -> Commit:
        for n in reversed(self.numbers()):
            found = self.commit(n)
            if found.source == source and found.batch == batch:
                end = _linked(payloads, found.first_line, found.before).agg(F.count("*").alias("n"), F.max_by("value", "line_no").alias("value")).first()
                if (end["n"], _hash(end["value"]) if end["n"] else None) != (found.lines, found.after):
                    raise ChainError(f"batch {batch} of {source} was committed with other lines")
                return found
        raise ChainError(f"batch {batch} of {source} comes after its later ones")

    def _record(self, made: Commit) -> None:
        """The commit: a rename that fails where the number is taken, as by another writer."""
        temp, final = self._at(f"_commits/.{uuid.uuid4().hex}"), self._at(f"_commits/{made.number:012d}.json")
        out = self.fs.create(temp, False)
        out.write(made.text().encode())
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri() if temp.toUri().getScheme() else self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(temp, final, self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self.fs.delete(temp, False)
            raise ChainError(f"append {made.number} was committed by another writer") from e


def _hash(line: str) -> str:
    try:
        return json.loads(line)["record_hash"]
    except (ValueError, KeyError, TypeError) as e:
        raise ChainError(f"a line of the log can't be read: {e}") from e


def _linked(payloads: DataFrame, line: int, prev: str) -> DataFrame:
    """line_no, value of payloads in seq order, linked to the hash before: heads are made by many tasks, the links by one."""
    made = payloads.select("seq", "payload", heads("payload").alias("head"))
    return made.orderBy("seq", "payload").select("head").coalesce(1).mapInPandas(links(line, prev), "line_no long, value string")


def append_chain(stream: DataFrame, path: str, checkpoint: str, anchor: Anchor | None = None):
    """Writes payloads (seq, payload JSON) of a stream to the log at ``path``, an append for each batch.

    The stream's checkpoint names the source, so a restart from it goes on where the log is. ``anchor``
    gets (line_no, hash) of each append's end, and may store it where the log's writer can't change it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        Log(batch.sparkSession, path).write(batch, checkpoint, batch_id, anchor)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
