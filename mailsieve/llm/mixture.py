"""Records of several sources mixed to target shares of the total size in tokens.

Every document gets a hash-random key; within its source, documents are laid out in the order of that key, in buckets
of the key's range. Sums per bucket, a running sum over buckets and one within each bucket give every document the
number of tokens before it without gathering a source in one task. A source is then cut where its budget is reached,
after as many whole repetitions as the budget holds. The total is the largest for which no source is repeated more
often than it may be.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, spread

#: Public vocabularies; every node must have the folder.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: Documents per bucket of the random order, about.
BUCKET = 20_000
_SPACE = 1 << 40


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True  # their names in a text are ordinary text
    return made


def token_counts(df: DataFrame, text: str, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """Adds ``tokens``, the number of tokens of the whole text; 0 for a null or empty text."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = _tokenizer(path)
        for texts in batches:
            yield pd.Series([len(x.ids) for x in made.encode_batch(texts.fillna("").tolist(), add_special_tokens=False)], dtype="int64")

    return df.withColumn("tokens", count(F.col(text)))


def tidy_source(name: str):
    return F.lower(F.trim(F.col(name)))


def budgets(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: its tokens, documents, budget, and how many whole repetitions and rest the budget makes.
    targets must be a bounded table, as one row per source is; the result is as long. A source without documents or
    without a share gets nothing, and the others keep their proportions."""
    wanted = targets.select(tidy_source("source").alias("source"), "target_share", "max_repeats").where("source IS NOT NULL").dropDuplicates(["source"])
    held = sized.groupBy("source").agg(F.sum("tokens").alias("held"), F.count("*").alias("documents"))
    both = wanted.join(held, "source", "left").fillna(0, ["held", "documents"])
    usable = both.where("held > 0 AND target_share > 0 AND max_repeats > 0")
    total = usable.agg(F.min(F.col("held") * F.col("max_repeats") / F.col("target_share")).alias("total"))
    budget = F.when((F.col("held") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0), F.floor(F.col("target_share") * F.col("total") + 1e-6)).otherwise(0)
    whole = F.least(F.floor(F.col("budget") / F.greatest("held", F.lit(1))), F.col("max_repeats"))
    # total is one row
    return both.join(F.broadcast(total)).withColumn("budget", F.coalesce(budget, F.lit(0)).cast("long")).withColumn("whole", whole.cast("int")).withColumn("rest", F.col("budget") - F.col("whole") * F.col("held")).drop("total")


def mix(df: DataFrame, key: str, text: str, source: str, targets: DataFrame, seed: int = 42, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """The mixture: one row per use of a document: source (tidy), key, epoch (from 1), tokens.

    The last, partial repetition takes the documents whose middle lies within the rest of the budget, so a source
    misses its budget by at most half a document. Documents with a null key or source, or of a source without target,
    are left out; empty texts have no tokens and cost nothing; repeated keys are taken as different documents.
    Whoever needs the texts joins them by key."""
    docs = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), tidy_source(source).alias("source"), F.col(text).alias("_text"))
    wanted = targets.select(tidy_source("source").alias("source")).where("source IS NOT NULL").distinct()
    sized = cut(token_counts(spread(docs.join(wanted, "source", "left_semi")), "_text", path).select("_key", "source", "tokens"))
    plan = budgets(sized, targets)
    drawn = (
        sized.join(plan.where("budget > 0").select("source", "documents", "whole", "rest"), "source")
        .withColumn("_at", F.pmod(F.xxhash64(F.lit(seed), "_key"), F.lit(_SPACE)))
        .withColumn("_bucket", F.floor(F.col("_at") / _SPACE * F.ceil(F.col("documents") / BUCKET)))
    )
    sums = drawn.groupBy("source", "_bucket").agg(F.sum("tokens").alias("_sum"))
    before = sums.select("source", "_bucket", (F.sum("_sum").over(Window.partitionBy("source").orderBy("_bucket")) - F.col("_sum")).alias("_before"))
    inside = Window.partitionBy("source", "_bucket").orderBy("_at", "_key").rowsBetween(Window.unboundedPreceding, 0)
    placed = drawn.withColumn("_upto", F.sum("tokens").over(inside)).join(before, ["source", "_bucket"])
    middle = F.col("_before") + F.col("_upto") - F.col("tokens") / 2
    uses = F.col("whole") + F.when((F.col("rest") > 0) & (middle <= F.col("rest")), 1).otherwise(0)
    return placed.withColumn("_uses", uses).where("_uses > 0").select("source", F.col("_key").alias(key), F.explode(F.sequence(F.lit(1), F.col("_uses").cast("int"))).alias("epoch"), "tokens")


def shares(mixed: DataFrame, key: str, targets: DataFrame) -> DataFrame:
    """Per target source: target_share, max_repeats, tokens and actual_share reached, uses, documents, most_repeats."""
    total = mixed.agg(F.sum("tokens").alias("total"))
    per_doc = mixed.groupBy("source", key).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("uses"))
    held = per_doc.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("uses").alias("uses"), F.count("*").alias("documents"), F.max("uses").alias("most_repeats"))
    wanted = targets.select(tidy_source("source").alias("source"), "target_share", "max_repeats").where("source IS NOT NULL").dropDuplicates(["source"])
    both = wanted.join(held, "source", "left").fillna(0, ["tokens", "uses", "documents", "most_repeats"])
    return both.join(F.broadcast(total)).withColumn("actual_share", F.when(F.col("total") > 0, F.col("tokens") / F.col("total")).otherwise(0.0)).drop("total")
