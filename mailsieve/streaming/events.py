"""Streams of message events: duplicates dropped, bursts joined, only changes passed on, what vanished taken back.

Event time and watermarks are an extension: late rows count until the watermark has passed them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark; state is dropped behind it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def debounced(stream: DataFrame, key: str, time: str, value: str, gap: str = "200 milliseconds", late: str = "1 hour") -> DataFrame:
    """One row per burst of a key: bursts end when nothing came for ``gap``; the last value of a burst stands for it."""
    window = F.session_window(time, gap)
    return stream.withWatermark(time, late).groupBy(key, window).agg(F.max_by(value, time).alias(value), F.count("*").alias("events")).select(key, F.col("session_window.start").alias("began"), F.col("session_window.end").alias("ended"), value, "events")


def windowed(stream: DataFrame, key: str, time: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("events")).select(F.col("window.start").alias("began"), key, "events")


def changes(stream: DataFrame, key: str, signature: str, order: str, grace: str | None = None) -> DataFrame:
    """Rows (key, signature, change) whenever a key's signature differs from the last one passed on: change is
    'changed', or 'gone' when a key was silent for ``grace`` in processing time. Of a batch's rows of one key the latest
    by ``order`` wins; the state is one string per key."""
    kinds = stream.schema[key].dataType.simpleString()

    def run(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], signature: [last], "change": ["gone"]})
            return
        newest = pd.concat(list(rows)).sort_values(order).iloc[-1]
        now = str(newest[signature])
        before = state.get[0] if state.exists else None
        state.update((now,))
        if grace:
            state.setTimeoutDuration(grace)
        if now != before:
            yield pd.DataFrame({key: [k[0]], signature: [now], "change": ["changed"]})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if grace else GroupStateTimeout.NoTimeout
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kinds}, {signature} string, change string", f"{signature} string", "append", timeout)


def drained(stream: DataFrame) -> DataFrame:
    """Runs a stream over all that is there now, in micro-batches, into a table of the shared folder, and reads it."""
    spark: SparkSession = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def drained_to_the_end(stream: DataFrame, time: str, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Like ``drained(operator(stream))`` for an operator with a watermark on ``time``, but windows and sessions that the
    watermark has not passed when the table ends are written too. When all rows are through, the query goes on from its
    checkpoint with one row far in the future, which closes all that is open; the window of that row never ends."""
    spark: SparkSession = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/last")
    out = operator(stream.unionByName(spark.readStream.schema(stream.schema).parquet(f"{folder}/last")))

    def run() -> None:
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()

    run()
    last = [F.lit("9999-12-01").cast(f.dataType).alias(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema]
    spark.range(1).select(*last).write.mode("append").parquet(f"{folder}/last")
    run()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def shared_folder(spark: SparkSession) -> str:
    import tempfile

    return spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="mailsieve-")


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table, one file or a folder of files, as a stream; times without zone are taken in the session's."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = there.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(there).isDirectory()
    reader = spark.readStream.schema(schema)
    stream = reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    zoneless = [f.name for f in schema if f.dataType.simpleString() == "timestamp_ntz"]
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})
