"""Streams of trials and judge calls.

A stream here is any streaming frame of trials (case_id, run_no, ts, passed, ...);
``replay`` makes one from a folder of Parquet files. Windowed results append once
the watermark has passed a window, so late rows up to the bound are in, later ones
are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..storage import new_path


def replay(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A bounded stream over Parquet files."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def pass_rate(trials: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """window_start, n, passed for each tumbling window of event time; works on batches and streams."""
    timed = trials.withColumn("ts", F.col("ts").cast("timestamp"))
    if trials.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.count_if("passed").alias("passed")).select(F.col("w.start").alias("window_start"), "n", "passed")


def cost_totals(calls: DataFrame) -> DataFrame:
    """Calls and tokens by provider and model; for streams in update or complete mode."""
    return calls.groupBy("provider", "model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def recorder_totals(observations: DataFrame) -> DataFrame:
    """Count, first and last sighting and, where observations name cases, the set of case_uids of each prompt rendering."""
    users = [F.array_sort(F.collect_set("case_uid")).alias("case_uids")] if "case_uid" in observations.columns else []
    return observations.groupBy("anchor", "fingerprint").agg(F.count("*").alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), *users)


def over_budget(calls: DataFrame, limit: float, order: str = "seq") -> DataFrame:
    """Adds stop: whether the calls before this one have used up the limit. Calls carry suite and cost_usd; a suite is one budget."""
    from pyspark.sql import Window

    w = Window.partitionBy("suite").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("stop", F.coalesce(F.sum("cost_usd").over(w) >= limit, F.lit(False)))


def _sequential(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counts a case's passes and trials until its test stops; emits the stop once."""
    passes, n, stopped = state.get if state.exists else (0, 0, False)
    rows = pd.concat(list(batches))
    if stopped:
        return
    for ok in rows.sort_values("run_no")["passed"]:
        passes, n = passes + int(bool(ok)), n + 1
        fails = n - passes
        if n >= 2 and max(1.6**passes * 0.4**fails, 0.4**passes * 1.6**fails) >= 16:
            stopped = True
            yield pd.DataFrame({"case_id": [key[0]], "stop_at": [n]})
            break
    state.update((passes, n, stopped))


def sequential_stops(trials: DataFrame) -> DataFrame:
    """case_id, stop_at: emitted once, at the trial after which a case's sequential test stops."""
    return trials.groupBy("case_id").applyInPandasWithState(_sequential, "case_id long, stop_at long", "passes long, n long, stopped boolean", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str, checkpoint: str) -> DataFrame:
    """Runs a bounded stream to its end into Parquet under the shared folder.

    Appended rows go to the file sink; in complete mode each trigger's whole result
    replaces the one before.
    """
    path = new_path(stream.sparkSession)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").start(path)
    elif mode == "complete":
        q = writer.foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(path)).start()
    else:
        raise ValueError(f"a stream is drained in append or complete mode, not {mode!r}")
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
