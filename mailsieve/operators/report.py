"""Corpus reports: what the batch evaluation counts, per group of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_class(scored: DataFrame) -> DataFrame:
    return scored.groupBy("family", "classification").agg(F.count("*").alias("messages"))


def by_floor(scored: DataFrame) -> DataFrame:
    return scored.groupBy("family", "floor_basis", "floor").agg(F.count("*").alias("messages"))


def by_rule(signals: DataFrame) -> DataFrame:
    """Messages per group, rule and severity; a message counts once however many findings it has."""
    return signals.select("family", "msg_id", "id", "severity").distinct().groupBy("family", "id", "severity").agg(F.count("*").alias("messages"))


def top_rules(signals: DataFrame, most: int = 30) -> DataFrame:
    """The report's leading rules of each group, by messages, then id."""
    counts = signals.select("family", "msg_id", "id").distinct().groupBy("family", "id").agg(F.count("*").alias("messages"))
    place = F.row_number().over(Window.partitionBy("family").orderBy(F.desc("messages"), "id"))
    return counts.withColumn("place", place.cast("long")).where(F.col("place") <= most)


def flagged_share(scored: DataFrame) -> DataFrame:
    flagged = F.count_if(F.col("classification") != "low")
    return scored.groupBy("family").agg(F.count("*").alias("scored"), flagged.alias("flagged")).withColumn("share", F.round(100.0 * F.col("flagged") / F.greatest("scored", F.lit(1)), 4))


def rollup(scored: DataFrame) -> DataFrame:
    """Totals at every level of group and class; an extension. null stands for all."""
    return scored.rollup("family", "classification").agg(F.count("*").alias("messages"), F.sum("score").cast("long").alias("points"))


def rows(scored: DataFrame, path: str) -> None:
    """The sink of flagged messages, as JSON."""
    scored.where("classification <> 'low'").write.mode("overwrite").json(path)
