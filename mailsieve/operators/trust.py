"""Senders that a reader trusts: by address where many share a domain, by host on shared platforms, else by domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..refdata import DISPOSABLE, FREEMAIL, OPEN_HOSTING, PLATFORMS

#: Entries of a list, and their characters together, at most.
ENTRIES, CHARACTERS = 50, 6_000


def normalized_list(entries: list[str]) -> list[str]:
    """A list as it may be used: lower-cased addresses or domains, each once, bounded."""
    out: list[str] = []
    for e in entries:
        e = e.strip().lower()
        if e and len(e) < 254 and " " not in e and "." in e.rpartition("@")[2] and e not in out and sum(map(len, out)) + len(e) <= CHARACTERS:
            out.append(e)
    return out[:ENTRIES]


def key(registrable: Column, domain: Column, address: Column) -> Column:
    """What of a sender can be trusted; null for throwaway domains and senders without one."""
    return (
        F.when((registrable == "") | registrable.isin(DISPOSABLE), None)
        .when(registrable.isin(FREEMAIL), F.lower(address))
        .when(registrable.isin([*PLATFORMS, *OPEN_HOSTING]), domain)
        .otherwise(registrable)
    )


def with_trust(ctx: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds ``trusted``; entries: one string column, one row per entry. An equi-join on the key."""
    wanted = entries.toDF("_entry").select(F.lower("_entry").alias("_entry")).distinct().withColumn("trusted", F.lit(True))
    keyed = ctx.withColumn("_key", key(F.col("registrable"), F.col("sender_domain"), F.col("raw_email")))
    return keyed.join(wanted, F.col("_key") == F.col("_entry"), "left").fillna(False, ["trusted"]).drop("_key", "_entry")


def state(trusted: Column, proven: Column) -> Column:
    """trusted: on the list and proven; unproven: on the list, but nothing shows that it is the sender; none else."""
    return F.when(trusted & proven, "trusted").when(trusted, "unproven").otherwise("none")
