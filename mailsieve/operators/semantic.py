"""The optional model stage: prompts, readings, and the little that a reading may add to a score.

A scorer is a function from an Arrow batch of prompts to JSON readings, registered by name. Equal prompts are read
once. A reading adds to a score only where a rule has already found something, and never more than its category's
weight."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BOUNDS
from ..functions.text import collapse_whitespace, redacted_addresses

DELIMITER = "<<<MESSAGE>>>"
# What a reading may call a message, and how its risk and confidence count.
KINDS = "credential_theft payment_fraud malware extortion impersonation advance_fee job_scam spam benign".split()
LEAST_RISK, LEAST_CONFIDENCE, FULL_SCORE, MEDIUM_RISK, HIGH_RISK, MOST_KINDS = 45, 0.35, 30, 55, 70, 4
COUNTS = "zero one two three four five".split()
ROLES = r"(?i)(?<![A-Za-z0-9_])(?:team|support|service|security|admin|notification|alert|help ?desk|no-?reply)(?![A-Za-z0-9_])"
SIGNALS = "array<struct<id: string, category: string, severity: string, score: int>>"
READING = "risk double, categories array<string>, reasons array<string>, confidence double"

Scorer = Callable[[pd.Series], pd.Series]


def stub(prompts: pd.Series) -> pd.Series:
    """A deterministic reader without a model: the share of telling words in a prompt."""
    telling = ("verify", "password", "account", "urgent", "gift card", "wire transfer", "suspended", "confirm your", "bank details", "click here")

    def read(p: str) -> str:
        hits = sum(w in p.lower() for w in telling)
        return json.dumps({"risk": min(100, 18 * hits), "categories": ["credential_theft"] if hits > 2 else ["benign"], "reasons": [f"{hits} telling words"], "confidence": 0.4 + 0.05 * hits})

    return prompts.map(read)


SCORERS: dict[str, Scorer] = {"stub": stub}


def prompt(sender: Column, subject: Column, body: Column) -> Column:
    """The text that a reader gets: bounded, without the delimiter that frames it."""
    clean = lambda c, most: F.substring(F.replace(collapse_whitespace(F.coalesce(c, F.lit(""))), F.lit(DELIMITER), F.lit("")), 1, most)
    return F.concat_ws("\n", F.concat(F.lit("From: "), clean(sender, BOUNDS.prompt_header)), F.concat(F.lit("Subject: "), clean(subject, BOUNDS.prompt_header)), F.lit(DELIMITER), clean(body, BOUNDS.prompt_body), F.lit(DELIMITER))


def readings(df: DataFrame, text: str, scorer: str = "stub") -> DataFrame:
    """Adds ``reading`` to every row: each distinct text is read once and joined back by its hash."""
    keyed = df.withColumn("_key", F.sha2(F.col(text), 256))
    read = SCORERS[scorer]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_key": b["_key"], "answer": read(b["t"])})

    distinct = keyed.groupBy("_key").agg(F.any_value(text).alias("t")).where("t IS NOT NULL")
    answers = distinct.mapInPandas(run, "_key string, answer string")
    return keyed.join(answers, "_key", "left").withColumn("reading", parsed(F.col("answer"))).drop("_key", "answer")


def parsed(answer: Column) -> Column:
    """A reading from an answer, fenced or within other text; null unless it has a risk, a confidence and a reason.
    Unknown kinds are dropped, at most four are kept."""
    r = F.from_json(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), READING)
    kinds = F.slice(F.filter(F.coalesce(r["categories"], F.array()), lambda k: k.isin(KINDS)), 1, MOST_KINDS)
    good = r["risk"].between(0, 100) & r["confidence"].between(0, 1) & (F.size(F.coalesce(r["reasons"], F.array())) > 0)
    return F.when(good, F.struct(r["risk"].alias("risk"), kinds.alias("kinds"), r["reasons"].alias("reasons"), r["confidence"].alias("confidence")))


def points(reading: Column, corroborated: Column) -> Column:
    """What a reading adds: by risk beyond the least and by confidence; nothing for the benign or uncorroborated."""
    benign = F.size(F.array_except(reading["kinds"], F.array(F.lit("benign")))) == 0
    raw = (reading["risk"] - LEAST_RISK) / (100 - LEAST_RISK) * reading["confidence"] * FULL_SCORE
    return F.when(reading.isNull() | benign | ~corroborated | (reading["risk"] < LEAST_RISK) | (reading["confidence"] < LEAST_CONFIDENCE), 0).otherwise(F.floor(raw + 0.5)).cast("int")


def severity(risk: Column) -> Column:
    return F.when(risk >= HIGH_RISK, "high").when(risk >= MEDIUM_RISK, "medium").when(risk >= LEAST_RISK, "low").otherwise("info")


def corroborated(signals: str = "signals") -> Column:
    return F.exists(signals, lambda s: (s["category"] != "llm") & (s["score"] > 0) & ~s["dampened"])


def name_shape(name: Column) -> Column:
    """What kind of display name it is, without revealing it: how many words, and what is telling about them."""
    trimmed = collapse_whitespace(F.coalesce(name, F.lit("")))
    n = F.size(F.split(trimmed, " "))
    count = F.concat(F.coalesce(F.get(F.array(*map(F.lit, COUNTS)), n), F.lit("many")), F.when(n == 1, "-word").otherwise("-words"))
    telling = {"contains-address": "[<>@]", "all-caps": r"^[A-Z\s]{4,}$", "non-ascii": r"[^\x00-\x7F]", "role-account": ROLES}
    return F.when(trimmed == "", "empty").otherwise(F.concat_ws("-", count, *[F.when(trimmed.rlike(pattern), k) for k, pattern in telling.items()]))


def extensions(attachments: Column) -> Column:
    """The distinct extensions of all attachments, lower-cased; what has none, or one that could be a name, has no part."""
    visible = lambda a: F.regexp_replace(F.coalesce(a["filename"], F.lit("")), r"\p{Cf}+", "")
    found = F.transform(F.coalesce(attachments, F.array()), lambda a: F.lower(F.regexp_extract(visible(a), r"(?s)^.+\.([A-Za-z0-9]{1,16})[.\s]*$", 1)))
    return F.array_distinct(F.filter(found, lambda e: e != ""))


def payload(subject: Column, body: Column, sender_name: Column, sender_domain: Column, reply_domain: Column, domains: Column, extensions: Column, ids: Column) -> Column:
    """What may leave the engine: addresses reduced to domains, names to their shape, lists distinct and bounded.
    ``reply_domain`` is null where replies go to the sender's own."""
    return F.struct(
        F.substring(redacted_addresses(F.coalesce(subject, F.lit(""))), 1, 300).alias("subject"),
        F.substring(redacted_addresses(F.coalesce(body, F.lit(""))), 1, BOUNDS.prompt_body).alias("excerpt"),
        sender_domain.alias("sender_domain"),
        name_shape(sender_name).alias("sender_name_shape"),
        reply_domain.alias("reply_to_domain"),
        F.slice(F.array_distinct(domains), 1, 25).alias("link_domains"),
        F.slice(F.array_distinct(extensions), 1, 15).alias("extensions"),
        F.slice(ids, 1, 40).alias("signal_ids"),
    )


def to_signals(reading: Column, sure: Column) -> Column:
    """The signals of a reading, as ``scoring.SIGNAL``: its assessment, with points only where a rule has found something
    too (``sure``), and a note if it was not confident. None for a missing reading."""
    risk, confident = reading["risk"], reading["confidence"] >= LEAST_CONFIDENCE
    made = lambda id_, level, score: F.struct(F.lit(id_).alias("id"), F.lit("llm").alias("category"), level.alias("severity"), score.cast("int").alias("score"))
    assessment = made("llm.assessment", F.when(sure & confident, severity(risk)).otherwise("info"), points(reading, sure))
    unsure = F.when(~confident & (risk > 0), made("llm.low_confidence", F.lit("info"), F.lit(0)))
    return F.when(reading.isNull(), F.array().cast(SIGNALS)).otherwise(F.array_compact(F.array(assessment, unsure)))


def with_readings(bag: DataFrame, prompts: DataFrame, scorer: str = "stub") -> DataFrame:
    """Refined bags with the signals that readings of corroborated messages add; prompts: msg_id, prompt. Only those are
    read, each distinct prompt once; other signals stay as they are."""
    wanted = prompts.join(bag.where(corroborated()).select("msg_id"), "msg_id", "left_semi")
    read = readings(wanted, "prompt", scorer).select("msg_id", "reading")
    added = F.transform(to_signals(F.col("reading"), corroborated()), lambda s: F.struct(s["id"].alias("id"), s["category"].alias("category"), s["severity"].alias("severity"), s["score"].alias("score"), F.lit(False).alias("dampened")))
    return bag.join(read, "msg_id", "left").withColumn("signals", F.concat("signals", added)).drop("reading")


def sanitized(made: Column) -> Column:
    """A payload checked again where it leaves: null for none; a field that doesn't fit the contract is dropped or emptied."""
    domain = lambda c: F.when(c.rlike(r"^[a-z0-9.-]{1,253}$"), c)
    fitting = lambda c, pattern, most: F.slice(F.array_distinct(F.filter(F.coalesce(c, F.array()), lambda x: x.rlike(pattern))), 1, most)
    sender = F.coalesce(domain(made["sender_domain"]), F.lit(""))
    reply = domain(made["reply_to_domain"])
    return F.when(
        made.isNotNull(),
        F.struct(
            F.substring(redacted_addresses(collapse_whitespace(F.coalesce(made["subject"], F.lit("")))), 1, 300).alias("subject"),
            F.substring(redacted_addresses(F.coalesce(made["excerpt"], F.lit(""))), 1, BOUNDS.prompt_body).alias("excerpt"),
            sender.alias("sender_domain"),
            F.when(made["sender_name_shape"].rlike("^[a-z-]{1,64}$"), made["sender_name_shape"]).otherwise("unknown").alias("sender_name_shape"),
            F.when(reply != sender, reply).alias("reply_to_domain"),
            fitting(made["link_domains"], r"^[a-z0-9.-]{1,253}$", 25).alias("link_domains"),
            fitting(made["extensions"], "^[a-z0-9]{1,16}$", 15).alias("extensions"),
            fitting(made["signal_ids"], "^[a-z0-9_.]{1,64}$", 40).alias("signal_ids"),
        ),
    )
