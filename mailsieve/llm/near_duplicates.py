"""Near-duplicate records: an exact set-similarity self-join by prefix filtering, and the groups its links form.

Plan. Records become sets of hashed word n-grams. Records with equal sets are folded into one class, so copies
cost one row however many there are. Each class orders its n-grams rarest first (document frequency over all
classes) and publishes only its prefix, the n-grams of which two similar sets must share one. Postings meet on the
n-gram; the join condition applies the length, positional, suffix and bitmap filters, a pair that shares too few
n-grams of its prefixes is dropped, and each surviving pair is verified once against the full sets. Connected components of the links are the groups.

Skew. A frequent n-gram's posting list is cut into blocks by the number of prefixes that hold it, and every pair of
blocks meets in a task of its own (``block_pairs``), so no list is gathered in one task and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fan_out, words

#: Postings of one n-gram that may meet in one task; longer lists are split into blocks of about this size.
BLOCK = 2_000
#: Hot n-grams, of two longs each, that are sent to every task at most; more of them are joined by a shuffle.
SMALL = 500_000
#: Buckets of the suffix histogram; eight counts of one byte each fit a long.
BUCKETS = 8
#: Longs of the bitmap over a whole set.
MAPS = 3


def shingles(text: Column, n: int) -> Column:
    """The distinct n-grams of words of a text as sorted 64-bit hashes; a text of fewer words has one of all its words, and
    a text without words none."""
    listed = words(text)

    def gram(w: Column, i: Column) -> Column:
        return F.xxhash64(*[F.get(w, i + k) for k in range(n)])

    return F.transform(
        F.array(listed),
        lambda w: F.when(
            F.size(w) >= n,
            F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: gram(w, i)))),
        )
        .when(F.size(w) > 0, F.array(F.xxhash64(w)))
        .otherwise(F.array().cast("array<bigint>")),
    )[0]


def _need(threshold: float, a: Column, b: Column) -> Column:
    """The least overlap of two sets of sizes a and b whose Jaccard similarity reaches the threshold."""
    return F.ceil(F.lit(threshold / (1 + threshold)) * (a + b) - 1e-9)


def _postings(threshold: float):
    """Prefix postings of each class: n-gram, position from 1, set size, and the histogram of what follows."""

    shifts = (8 * np.arange(BUCKETS)).astype(np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            total, sizes = batch.n.to_numpy(np.int64), batch.grams.map(len).to_numpy(np.int64)
            grams = np.concatenate(batch.grams.to_numpy()).astype(np.int64)
            freq = np.concatenate(batch.df.to_numpy()).astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            row = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(grams)) - starts[row] + 1 + (total - sizes)[row]  # the set's own n-grams come first
            upto = np.cumsum(np.eye(BUCKETS, dtype=np.int64)[grams & (BUCKETS - 1)], axis=0)
            after = upto[starts + sizes - 1][row] - upto
            packed = (np.minimum(after, 255).astype(np.uint64) << shifts).sum(1, dtype=np.uint64).view(np.int64)
            bit = (grams >> 8) % (64 * MAPS)  # not the bits that chose the bucket
            one = np.left_shift(np.uint64(1), (bit & 63).astype(np.uint64))
            maps = {f"m{k}": np.bitwise_or.reduceat(np.where(bit >> 6 == k, one, np.uint64(0)), starts).view(np.int64)[row] for k in range(MAPS)}
            prefix = total - np.ceil(threshold * total - 1e-9).astype(np.int64) + 1
            keep = pos <= prefix[row]
            yield pd.DataFrame({"gram": grams, "df": freq, "cid": batch.cid.to_numpy()[row], "n": total[row], "pos": pos, "after": packed, **maps})[keep]

    return run


def block_pairs(df: DataFrame, size: Column, key: str, member: str) -> DataFrame:
    """Splits the groups of ``key`` into blocks of about BLOCK rows; a group of b blocks becomes b(b+1)/2 meetings.
    Adds ``meet_a`` and ``meet_b``: rows of one group that share both values are to be paired, and any two rows of
    the group share them exactly once if the pair is taken where their own blocks are the two."""
    blocks = F.greatest(F.lit(1), F.ceil(size / BLOCK)).cast("int")
    mine = F.pmod(F.xxhash64(F.col(member)), F.col("_blocks")).cast("int")
    return (
        df.withColumn("_blocks", blocks)
        .withColumn("block", mine)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("meet_a", F.least("block", "_other"))
        .withColumn("meet_b", F.greatest("block", "_other"))
        .drop("_blocks", "_other")
    )


def _suffix_distance(a: Column, b: Column) -> Column:
    """A lower bound of the Hamming distance of two suffixes: their bucket counts differ at least so much."""
    parts = [F.abs(F.shiftrightunsigned(a, 8 * i).bitwiseAND(255) - F.shiftrightunsigned(b, 8 * i).bitwiseAND(255)) for i in range(BUCKETS)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def _absent(a: Column, b: Column) -> Column:
    """Members of a's set that b's surely lacks, at least: bits of one bitmap that the other lacks."""
    total = F.lit(0)
    for k in range(MAPS):
        total = total + F.bit_count(a[k].bitwiseAND(F.bitwise_not(b[k])))
    return total


def candidate_pairs(classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b), a < b, of classes that no filter rules out, each once. classes: cid, n (size of its set), and
    grams and df: those n-grams that another class has too, rarest first, and their document frequencies."""
    spark = classes.sparkSession
    posted = classes.mapInPandas(_postings(threshold), "gram long, df long, cid long, n int, pos int, after long, " + ", ".join(f"m{k} long" for k in range(MAPS)))
    # only an n-gram of many documents can be in many prefixes; how many it is in decides how it is cut
    hot = cut(posted.where(F.col("df") > BLOCK).groupBy("gram").agg(F.count("*").alias("prefixes")).where(F.col("prefixes") > BLOCK))
    sized = posted.join(F.broadcast(hot) if hot.count() <= SMALL else hot, "gram", "left")
    met = block_pairs(sized, F.coalesce("prefixes", F.lit(1)), "gram", "cid").drop("prefixes").repartition(fan_out(spark), "gram", "meet_a", "meet_b")
    left, right = met.alias("l"), met.alias("r")
    a, b = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    need = _need(threshold, a("n"), b("n"))
    maps_a, maps_b = ([side(f"m{k}") for k in range(MAPS)] for side in (a, b))
    rest_a, rest_b = a("n") - a("pos"), b("n") - b("pos")
    return (
        left.join(
            right,
            (a("gram") == b("gram"))
            & (a("meet_a") == b("meet_a"))
            & (a("meet_b") == b("meet_b"))
            & (a("cid") < b("cid"))
            # in the meeting of two different blocks, only pairs across
            & ((a("meet_a") == a("meet_b")) | (a("block") != b("block")))
            # length filter
            & (F.least(a("n"), b("n")) >= F.lit(threshold) * F.greatest(a("n"), b("n")) - 1e-9)
            # positional filter: at most the smaller position's n-grams before, this one, the shorter rest after
            & (F.least(a("pos"), b("pos")) + F.least(rest_a, rest_b) >= need)
            # suffix filter: overlap after this n-gram is at most (rest_a + rest_b - distance) / 2
            & (2 * F.least(a("pos"), b("pos")) + rest_a + rest_b - _suffix_distance(a("after"), b("after")) >= 2 * need)
            # bitmap filter
            & (a("n") - _absent(maps_a, maps_b) >= need)
            & (b("n") - _absent(maps_b, maps_a) >= need),
        )
        .groupBy(a("cid").alias("a"), b("cid").alias("b"), a("n").alias("na"), b("n").alias("nb"))
        .agg(F.count("*").alias("shared"))
        # beyond the n-grams shared by both prefixes, at most what follows one of the prefixes
        .where(F.col("shared") + F.ceil(threshold * F.greatest("na", "nb") - 1e-9) - 1 >= _need(threshold, F.col("na"), F.col("nb")))
        .select("a", "b")
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) as (node, root), root the least node: alternating large and small stars.
    Each round is two aggregations without gathered neighbour lists; lineage is cut every round. Ends when a round
    changes no edge. An empty table of edges gives an empty result."""
    # loops can come of a step; they carry no information
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(0xFFFFFFFF))).first()

    def large(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()

    def small(e: DataFrame) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    before = state(now)
    while True:
        now = cut(small(large(now)))
        after = state(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(df: DataFrame, key: str, text: Column, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per record: ``key``, ``class_id`` (the least key of records with the same n-gram set) and
    ``group_id`` (the least class joined to it by links of Jaccard similarity >= threshold).

    df: one row per key (a long). Null keys are dropped; repeated keys must have been removed. Texts of fewer than n words
    are alike if all their words are the same; null texts and texts without words are each a class and group of its own. An empty table gives an
    empty result; columns other than key are ignored, whatever their names."""
    sets = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), shingles(F.coalesce(text, F.lit("")), n).alias("grams"))
    keyed = cut(sets.withColumn("print", F.when(F.size("grams") == 0, F.concat(F.lit("key "), F.col("key"))).otherwise(F.md5(F.concat_ws(",", F.col("grams").cast("array<string>"))))))
    classes = keyed.groupBy("print").agg(F.min("key").alias("cid"), F.min_by("grams", "key").alias("grams"))
    classes = cut(classes)

    tokens = classes.select("cid", F.explode("grams").alias("gram"))
    counts = tokens.groupBy("gram").agg(F.count("*").cast("int").alias("df")).where("df > 1")
    ordered = (
        tokens.join(counts, "gram")
        .groupBy("cid")
        .agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("x"))
        .join(classes.select("cid", F.size("grams").alias("n")), "cid")
        .select("cid", "n", F.col("x.gram").alias("grams"), F.col("x.df").alias("df"))
    )
    ids = candidate_pairs(ordered, threshold)
    held = classes.select("cid", "grams")
    overlap = F.size(F.array_intersect("ga", "gb"))
    links = (
        ids.join(held.toDF("a", "ga"), "a")
        .join(held.toDF("b", "gb"), "b")
        .where(overlap >= F.lit(threshold) * (F.size("ga") + F.size("gb") - overlap) - 1e-9)
        .select("a", "b")
    )
    roots = components(links)
    return (
        keyed.select("key", "print")
        .join(classes.select("print", "cid"), "print")
        .join(roots, F.col("cid") == F.col("node"), "left")
        .select(F.col("key").alias(key), F.col("cid").alias("class_id"), F.coalesce("root", "cid").alias("group_id"))
    )


def group_pairs(groups: DataFrame, key: str) -> DataFrame:
    """Every two records of one group as (key_a, key_b), key_a < key_b; large groups meet in blocks."""
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("size")).where("size > 1")
    met = block_pairs(groups.join(sizes, "group_id"), F.col("size"), "group_id", key).select("group_id", key, "block", "meet_a", "meet_b")
    left, right = met.alias("l"), met.alias("r")
    return left.join(
        right,
        (F.col("l.group_id") == F.col("r.group_id"))
        & (F.col("l.meet_a") == F.col("r.meet_a"))
        & (F.col("l.meet_b") == F.col("r.meet_b"))
        & (F.col(f"l.{key}") < F.col(f"r.{key}"))
        & ((F.col("l.meet_a") == F.col("l.meet_b")) | (F.col("l.block") != F.col("r.block"))),
    ).select(F.col(f"l.{key}").alias(f"{key}_a"), F.col(f"r.{key}").alias(f"{key}_b"))
