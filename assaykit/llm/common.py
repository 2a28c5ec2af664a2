"""Shared plumbing: intermediate tables in the cluster's shared folder and streaming mappers."""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut as cut

_BASE = 0xD6E8FEB86659FD93
_powers: dict[str, np.ndarray] = {}
#: Pieces in which the counts of a sketch travel.
SEGMENTS = 64


def parts(spark: SparkSession, least: int = 8) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche on unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling hashes' base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers.get("up", ())) < n:
        size = -(-n // (1 << 18)) << 18
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


#: Places whose factors are kept as a table.
_PLACED = 1 << 16


def _factors(places: np.ndarray) -> np.ndarray:
    return mix64(places.astype(np.uint64) * np.uint64(_BASE) + np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)


def word_names(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit names of the stretches [start, end) of a row of mixed symbols; stretches don't overlap and are in order.

    Each symbol is multiplied by a factor that is drawn for its place in the stretch, not a
    power of anything, before all are summed: no two different words, however long, agree by their
    structure, as they can in sums of powers modulo a power of two.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    before = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=before[1:])
    place = np.arange(before[-1]) - np.repeat(before[:-1], size)
    at = place + np.repeat(start, size)
    if int(size.max()) <= _PLACED:
        if "place" not in _powers:
            _powers["place"] = _factors(np.arange(_PLACED))
        factor = _powers["place"][place]
    else:
        factor = _factors(place)
    sums = np.zeros(len(place) + 1, np.uint64)
    np.cumsum(values[at] * factor, out=sums[1:])
    return mix64(sums[before[1:]] - sums[before[:-1]] + mix64(size.astype(np.uint64)))


def count_sketch(texts: DataFrame, names: Callable[[pa.RecordBatch], np.ndarray], bits: int, most_bytes: int = 1 << 20) -> np.ndarray:
    """How often the names of all rows fall into each of 2**bits buckets, by their top bits.

    Each task adds up its own rows and sends fixed segments; segments are added as they
    stream in, so the driver gets 2**bits numbers, whatever the input.
    """
    wide = (1 << bits) // SEGMENTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in slices(batches, "text", most_bytes):
            total += np.bincount((names(batch) >> np.uint64(64 - bits)).astype(np.int64), minlength=len(total))
        if total.any():
            rows = [(i, total[i * wide : (i + 1) * wide].tobytes()) for i in range(SEGMENTS)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["segment", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(raw.as_buffer(), np.int64)
                sums[i] = sums[i] + x if i in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["segment", "counts"])

    kind = "segment int, counts binary"
    found = texts.mapInArrow(count, kind).repartition(SEGMENTS, "segment").mapInArrow(add, kind).toArrow()
    total = np.zeros(1 << bits, np.int64)
    for i, raw in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
        total[i * wide : (i + 1) * wide] = np.frombuffer(raw, np.int64)
    return total


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Split Arrow batches so that the text column of each piece stays near most_bytes.

    Workers serve many tasks, and idle ones stay: what the tasks before left free
    goes back to the system at the start, and this task's at the end.
    """
    trim()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // most_bytes
        cuts = np.flatnonzero(np.diff(group)) + 1
        edges = [0, *cuts.tolist(), n]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)
    trim()


def trim(spark: SparkSession | None = None) -> None:
    """Gives memory that is free back to the system; with a session the driver's JVM as well, with the classes and broadcasts of plans that are done."""
    gc.collect()
    if spark is not None:
        spark.sparkContext._jvm.System.gc()
    pa.default_memory_pool().release_unused()
    if release := getattr(ctypes.CDLL(None), "malloc_trim", None):
        release(0)


def renames(columns: Iterable[str], added: Iterable[str]) -> dict[str, str]:
    """New names for columns of a table whose names, in any case, an operator's own columns need.

    One rule for all operators that add columns to a table: the operator's columns have
    their documented names, and a clashing column of the table stays as input_NAME, with
    as many input_ as make it free.
    """
    columns, own = list(columns), {a.lower() for a in added}
    taken, out = own | {c.lower() for c in columns}, {}
    for c in columns:
        if c.lower() in own:
            new = f"input_{c}"
            while new.lower() in taken:
                new = f"input_{new}"
            taken.add(new.lower())
            out[c] = new
    return out


def apart(df: DataFrame, added: Iterable[str]) -> DataFrame:
    """The table with clashing columns renamed."""
    return df.withColumnsRenamed(renames(df.columns, added))


def restored(out: DataFrame, columns: Iterable[str], added: Iterable[str]) -> DataFrame:
    """The columns that a table had before an operator added its own."""
    new = renames(columns, added)
    return out.select(*[F.col(new.get(c, c)).alias(c) for c in columns])


_kept: dict[tuple[type, bytes], Any] = {}


def kept(kind: Callable[[bytes], Any], model: bytes) -> Any:
    """What a model file gives, once a worker process: tasks that follow in it share its tables and caches, which are bounded. One of each kind is kept."""
    key = (kind, hashlib.sha256(model).digest())
    if key not in _kept:
        for old in [k for k in _kept if k[0] is kind]:
            del _kept[old]
        _kept[key] = kind(model)
    return _kept[key]


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: str) -> F.Column:
    """Words of [^\\x20\\x09-\\x0D]+ in a text column; null counts as empty."""
    runs = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.regexp_replace(runs, r"[\x20\x09-\x0D]+", "")).cast("long")
