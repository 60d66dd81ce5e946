"""Evaluation items inside a corpus: a distributed positional inverted index, searched from the rarest terms.

The index holds, per term and document, the sorted word positions; only terms of the items are posted. Document
frequencies are counted first, in fixed-size tables.

Phrases: every window of as many consecutive item words as make a leak is represented by its two rarest terms, so each
item needs few anchors, and over all documents only anchors are posted. The rarest term's posting at position p, less
its offset in the item, is a place where the item would begin; the second rarest must agree within SLOP. A phrase holds
both terms, so none is lost.

Proximity: of an item of n words, k of which a match holds, a match misses at most n - k, so it holds at least r of the
item's n - k + r rarest word offsets, whatever words were changed. Documents that have the terms of r such offsets are
the candidates; this is counted where the documents lie, without a shuffle, and loses nothing either.

The offset-adjusted lists of all the item's terms are then intersected for each candidate document and item, over all
places at which a word of the item stands. Runs of consecutive offsets are exact phrases; places that agree within SLOP
words are proximity matches.

Items are searched in blocks of bounded size. What is shuffled is the postings of rare terms, and the texts once, to
meet the candidates.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, spread

#: Consecutive words that make a leak.
WORDS = 12
#: Words by which a place may shift within a proximity match.
SLOP = 3
#: Share of an item's words that a proximity match holds at least.
NEAR = 0.6
#: Rare offsets of an item that a candidate for proximity has at least; any number gives the same matches.
RARE = 12
#: Items searched at a time; their vocabulary is sent to every task.
BLOCK_ITEMS = 5_000

_word = re.compile(r"[^\W_]+")


def positional_index(docs: DataFrame, key: str, text: str, vocabulary: dict[str, int]) -> DataFrame:
    """Postings (term, doc, positions) of the words in vocabulary; built without a shuffle, one document at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, terms, places = [], [], []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = [vocabulary.get(w, -1) for w in _word.findall(body.lower())]
                ids = np.asarray(found, np.int32)
                at = np.flatnonzero(ids >= 0)
                docs_.append(np.full(len(at), doc, np.int64))
                terms.append(ids[at])
                places.append(at.astype(np.int32))
            if not docs_:
                continue
            d, t, p = np.concatenate(docs_), np.concatenate(terms), np.concatenate(places)
            if not len(d):
                continue
            order = np.lexsort((p, t, d))
            d, t, p = d[order], t[order], p[order]
            first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])])
            offsets = np.r_[first, len(d)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(t[first]), pa.array(d[first]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(p))], ["term", "doc", "positions"])

    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long"), text)
    return spread(rows).mapInArrow(run, "term int, doc long, positions array<int>")


def document_frequencies(docs: DataFrame, text: str, vocabulary: dict[str, int]) -> DataFrame:
    """(term, df) of the words in vocabulary over all documents; each task counts into one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for body in batch.column(0).to_pylist():
                counts[[k for w in set(_word.findall(body.lower())) if (k := vocabulary.get(w)) is not None]] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["term", "n"])

    rows = spread(docs.where(F.col(text).isNotNull()).select(text))
    return rows.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("df"))


def _needed(size: int) -> int:
    """Words of an item of that size that a proximity match holds at least."""
    return max(WORDS, math.ceil(Fraction(str(NEAR)) * size))


def _phrase_pairs(docs: DataFrame, key: str, text: str, vocabulary: dict[str, int], ranked: DataFrame) -> DataFrame:
    """(doc, item) where the two rarest terms of a window of WORDS item words stand in place."""
    spark = docs.sparkSession
    ahead = Window.partitionBy("item").orderBy("off").rowsBetween(0, WORDS - 1)
    in_order = F.array_sort(F.collect_list(F.struct("df", "off", "term")).over(ahead))
    windows = ranked.withColumn("w", in_order).where(F.col("off") + WORDS <= F.col("size"))
    rarest = windows.select("item", *[F.col("w")[k][f].alias(f"{f}{k}") for k in (0, 1) for f in ("off", "term")]).distinct().collect()  # some per item of the block
    anchors = spark.createDataFrame(rarest, "item long, off0 int, term0 int, off1 int, term1 int")
    anchored = {t for r in rarest for t in (r.term0, r.term1)}
    index = cut(positional_index(docs, key, text, {w: k for w, k in vocabulary.items() if k in anchored}))
    begun = index.join(anchors, F.col("term") == F.col("term0")).select("item", "doc", "term1", "off1", F.explode("positions").alias("p"), "off0").select("item", "doc", "term1", "off1", (F.col("p") - F.col("off0")).alias("place")).distinct()
    second = index.select(F.col("doc"), F.col("term").alias("term1"), "positions")
    agree = F.exists("positions", lambda p: F.abs(p - F.col("off1") - F.col("place")) <= SLOP)
    return cut(begun.join(second, ["doc", "term1"]).where(agree).select("doc", "item").distinct())


def _rare_offsets(sizes: list[int], ranked: DataFrame, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the items whose rarest offsets hold a term, by term, as one array and where each term begins."""
    most = F.create_map(*[F.lit(x) for n in sorted(set(sizes)) for x in (n, n - _needed(n) + min(RARE, _needed(n)))])
    place = F.row_number().over(Window.partitionBy("item").orderBy("df", "term", "off"))
    chosen = ranked.withColumn("place", place).where(F.col("place") <= most[F.col("size")]).select("term", "nth").collect()  # some per item of the block
    by_term = np.asarray(sorted((r.term, r.nth) for r in chosen), np.int64).reshape(-1, 2)
    return by_term[:, 1], np.searchsorted(by_term[:, 0], np.arange(terms + 1))


def intersected(ids: np.ndarray, order: np.ndarray, terms: np.ndarray) -> tuple[int, int]:
    """(longest run of consecutive item words, most item words within SLOP of a place where one stands) of a document's
    term ids, ``order`` of which sorts them, and an item's terms."""
    ranked = ids[order]
    first, last = np.searchsorted(ranked, terms, "left"), np.searchsorted(ranked, terms, "right")
    counts = last - first
    total = int(counts.sum())
    if not total:
        return 0, 0
    off = np.repeat(np.arange(len(terms)), counts)
    begins = np.cumsum(counts) - counts
    at = order[np.arange(total) - np.repeat(begins - first, counts)]
    place = at - off + len(terms) + SLOP
    # each offset covers the places within SLOP of its own once, so what overlaps the next interval is cut
    ends = place + SLOP + 1
    same = off[1:] == off[:-1]
    ends[:-1][same] = np.minimum(ends[:-1][same], place[1:][same] - SLOP)
    width = len(ids) + 2 * len(terms) + 2 * SLOP + 2
    near = np.cumsum(np.bincount(place - SLOP, minlength=width) - np.bincount(ends, minlength=width))
    by_place = np.lexsort((off, place))
    p, o = place[by_place], off[by_place]
    breaks = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (o[1:] != o[:-1] + 1), True])
    return int(np.diff(breaks).max()), int(near[place].max())


def _search(docs: DataFrame, key: str, text: str, items: list[tuple[int, list[str]]], near: bool) -> DataFrame:
    """(doc, item, size, longest_run, near_words) of all candidates for phrases and, if ``near``, for proximity."""
    spark = docs.sparkSession
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
    words = spark.createDataFrame([(n, i, o, vocabulary[w], len(ws)) for n, (i, ws) in enumerate(items) for o, w in enumerate(ws)], "nth int, key long, off int, term int, size int")
    ranked = cut(words.withColumn("item", F.col("nth")).join(document_frequencies(docs, text, vocabulary), "term", "left").fillna(0, ["df"]))
    pairs = _phrase_pairs(docs, key, text, vocabulary, ranked)
    keys, terms = [i for i, _ in items], [np.asarray([vocabulary[w] for w in ws], np.int32) for _, ws in items]
    least = np.asarray([min(RARE, _needed(len(ws))) for _, ws in items])
    needed = [_needed(len(ws)) for _, ws in items]
    rare, begins = _rare_offsets([len(ws) for _, ws in items], ranked, len(vocabulary)) if near and items else (np.empty(0, np.int64), np.zeros(len(vocabulary) + 1, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, body, given in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                ids = np.asarray([vocabulary.get(w, -1) for w in _word.findall(body.lower())], np.int32)
                asked = set(given or ())
                if len(rare):
                    held = [rare[begins[t] : begins[t + 1]] for t in np.unique(ids[ids >= 0])]
                    if held:
                        asked.update(np.flatnonzero(np.bincount(np.concatenate(held), minlength=len(keys)) >= least).tolist())
                order = np.argsort(ids, kind="stable")
                for n in asked:
                    longest, most = intersected(ids, order, terms[n])
                    if longest >= WORDS or most >= needed[n]:
                        rows.append((doc, keys[n], len(terms[n]), longest, most))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["doc", "item", "size", "longest_run", "near_words"])

    held = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("_text"))
    asked = pairs.groupBy("doc").agg(F.collect_list("item").alias("_items"))
    there = held.join(asked, "doc", "left" if near else "inner").select("doc", "_text", "_items")
    hits = spread(there).mapInArrow(run, "doc long, item long, size int, longest_run int, near_words int")
    return hits.groupBy("item", "doc", "size").agg(F.max("longest_run").alias("longest_run"), F.max("near_words").alias("near_words"))


def _blocks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, near: bool) -> DataFrame:
    listed = [(r[0], _word.findall(r[1].lower())) for r in items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(item_key, item_text).distinct().toLocalIterator()]
    listed = sorted((i, ws) for i, ws in listed if len(ws) >= WORDS)
    blocks = [listed[at : at + BLOCK_ITEMS] for at in range(0, len(listed), BLOCK_ITEMS)] or [[]]
    found = None
    for block in blocks:
        part = _search(docs, key, text, block, near)
        found = part if found is None else found.unionByName(part)
    return found


def leaked_items(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """One row per document and item it contains: key, item_key, longest_run (consecutive words in common), near_words
    (words of the item within SLOP of their place), item_words, and kind: 'phrase' for a run of at least WORDS words,
    else 'proximity' for at least NEAR of the item's words and WORDS of them. Both are found without loss.

    Null keys and texts on either side match nothing; an item of fewer than WORDS words can't leak; repeated rows
    count once. Whole texts are indexed. The items must be a bounded evaluation set; they pass through the driver in
    blocks of BLOCK_ITEMS."""
    found = _blocks(docs, key, text, items, item_key, item_text, near=True)
    kind = F.when(F.col("longest_run") >= WORDS, "phrase").otherwise("proximity")
    return found.select(F.col("doc").alias(key), F.col("item").alias(item_key), "longest_run", "near_words", F.col("size").alias("item_words"), kind.alias("kind"))


def leaked_phrases(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(key, item_key) of the phrases among ``leaked_items``, without looking for proximity matches."""
    found = _blocks(docs, key, text, items, item_key, item_text, near=False)
    return found.where(F.col("longest_run") >= WORDS).select(F.col("doc").alias(key), F.col("item").alias(item_key))
