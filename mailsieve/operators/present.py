"""What a reader is shown of a result: as columns, without a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CATEGORIES

#: Characters of evidence below which it can't be found again in a text, and quoted parts of a reason at most.
LOCATABLE, PARTS = 12, 12
# The badge of each class, text and colour.
BADGES = {"high-risk": ("!", "red"), "suspicious": ("!", "orange"), "caution": ("?", "yellow"), "low": ("", "green"), "not checked": ("–", "grey")}


def badge(classification: Column) -> Column:
    """struct(text, colour) for a class; that of unchecked mail for anything else."""
    text, colour = (F.lit(x) for x in BADGES["not checked"])
    for name, (t, c) in BADGES.items():
        text, colour = F.when(classification == name, t).otherwise(text), F.when(classification == name, c).otherwise(colour)
    return F.struct(text.alias("text"), colour.alias("colour"))


def contributions(prefix: str = "") -> Column:
    """The categories that add to a score, the largest first, as array of struct(category, points)."""
    all_ = F.array(*[F.struct((-F.col(f"{prefix}{c}_score")).alias("n"), F.lit(c).alias("category"), F.col(f"{prefix}{c}_score").alias("points")) for c in CATEGORIES])
    return F.transform(F.filter(F.array_sort(all_), lambda x: x["points"] > 0), lambda x: F.struct(x["category"].alias("category"), x["points"].alias("points")))


def counted(signals: Column) -> Column:
    """How many findings count: those with points and those that were softened."""
    return F.size(F.filter(signals, lambda s: (s["score"] > 0) | s["dampened"]))


def score_summary(total: Column, floor: Column, score: Column) -> Column:
    """How a score came about, in words."""
    return F.when(score.isNull(), "not checked: sender or text could not be read").when(floor > total, F.format_string("%d points, raised to %d by the gravest findings", total, floor)).otherwise(F.format_string("%d points", total))


def quoted_parts(reason: Column) -> Column:
    """The parts of a reason that stand in quotation marks, at most PARTS."""
    return F.slice(F.regexp_extract_all(reason, F.lit('["“]([^"“”]+)["”]'), F.lit(1)), 1, PARTS)


def locatable(evidence: Column) -> Column:
    return F.length(F.trim(evidence)) >= LOCATABLE


def located(body: Column, evidence: Column) -> Column:
    """struct(begin, end), from 1, of evidence in a body, blanks apart and in any case; null if it is too short or absent."""
    plain = lambda c: F.lower(F.regexp_replace(c, r"\s", " "))
    at = F.instr(plain(body), plain(evidence))
    return F.when(locatable(evidence) & (at > 0), F.struct(at.alias("begin"), (at + F.length(evidence) - 1).alias("end")))


def health(runs: DataFrame) -> DataFrame:
    """Counters of scoring runs (status, milliseconds): runs, failures, median and longest time; the metrics table."""
    return runs.agg(F.count("*").alias("runs"), F.count_if(F.col("status") != "ok").alias("failed"), F.median("milliseconds").alias("median_ms"), F.max("milliseconds").alias("longest_ms"))


def skipped(messages: DataFrame, reason: Column) -> DataFrame:
    """How many messages were left out, by reason; null reasons are messages that were not."""
    return messages.select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("messages"))


def limited(messages: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """The first ``most`` messages of each group: the limit of a report, by rank, without gathering a group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return messages.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")
