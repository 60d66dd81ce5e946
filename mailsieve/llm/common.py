"""Helpers shared by the corpus operators: reading, deduplicating, spreading, cutting lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Letter-and-digit runs; applied to lower-cased text.
WORD = r"[\p{L}\p{N}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fan_out(spark: SparkSession) -> int:
    """Partitions for a stage whose cost is CPU in Python rather than bytes: every core gets several."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out evenly at a width that AQE does not merge again: stages of Python cost time per row, and neither a
    file of one row group nor a mailbox with a third of all rows may keep one task busy while others wait."""
    return df.repartition(fan_out(df.sparkSession))


def one_per_message(df: DataFrame, *columns: str) -> DataFrame:
    """One row per msg_id, the earliest received. Redeliveries repeat the content, so nothing is lost; rows
    without msg_id are dropped, as no result could name them. A message delivered a million times is reduced
    before the shuffle."""
    rest = F.struct(*columns)
    return (
        df.where("msg_id IS NOT NULL")
        .groupBy("msg_id")
        .agg(F.min_by(rest, F.coalesce("received_at", F.lit("9999-01-01").cast("timestamp"))).alias("_one"))
        .select("msg_id", "_one.*")
    )


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the folder of spark.checkpoint.dir, which all executors share, and forgets its
    lineage. Only where that setting is absent (tests) a temporary folder is set."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="mailsieve-"))
    return df.checkpoint(eager=True)


def some_rows(df: DataFrame, most: int) -> list[Row]:
    """At most ``most`` rows, chosen by their hash, the same ones however df is partitioned. A first filter by a
    fraction of the hash range keeps what reaches the driver near that number whatever the number of partitions."""
    count = df.count()
    hashed = F.xxhash64(*df.columns)
    if count > 2 * most:
        share = int((1 << 30) * 1.5 * most / count) + 64
        df = df.where(F.pmod(F.xxhash64(F.lit(7), *df.columns), F.lit(1 << 30)) < share)
    return df.orderBy(hashed, *df.columns).limit(most).collect()


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))
