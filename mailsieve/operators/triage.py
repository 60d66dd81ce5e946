"""The sender line alone: identity rules that need no body, of high severity at least; the worst one per message."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dialect import SPARK
from .rules import TRIAGE, identity
from .scoring import rank, sender_lines, signals


def of_senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst finding of each sender line; bodies, attachments and links are not read."""
    found = [r for r in identity(SPARK) if r.id in TRIAGE and "party" not in r.when and "name_reused" not in r.when]
    return worst(sender_lines(spark, sf_dir).select("msg_id", signals(found).alias("signals")))


def worst(bag: DataFrame) -> DataFrame:
    """msg_id, severity, id, score of the worst sender finding: by severity, then score, then id. No row means that
    nothing was found, not that the sender is safe."""
    kept = F.filter("signals", lambda s: s["id"].isin(TRIAGE) & (rank(s["severity"]) >= 3))
    order = F.array_sort(F.transform(kept, lambda s: F.struct((-rank(s["severity"])).alias("r"), (-s["score"]).alias("s"), s["id"].alias("id"), s["severity"].alias("severity"), s["score"].alias("score"))))
    return bag.select("msg_id", F.get(order, F.lit(0)).alias("w")).where("w IS NOT NULL").select("msg_id", F.col("w.severity").alias("severity"), F.col("w.id").alias("id"), F.col("w.score").cast("long").alias("score"))


def displayed(signals: DataFrame) -> DataFrame:
    """Findings of long signals as they are shown: equal ones once with their number, worst first (``place``)."""
    from pyspark.sql import Window

    once = signals.groupBy("msg_id", "id", "severity", "score").agg(F.count("*").alias("times"))
    order = Window.partitionBy("msg_id").orderBy(rank(F.col("severity")).desc(), F.col("score").desc(), "id")
    return once.withColumn("place", F.row_number().over(order))
