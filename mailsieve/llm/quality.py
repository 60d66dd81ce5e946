"""Per-document text statistics, and what is not prose: robust Mahalanobis distance from the prose of its language.

For each language the mean and covariance of all statistics are estimated over all documents by concentration: from
median and spread, the nearest share of the documents is kept and the moments are taken anew, so lists, tables and
junk don't move them. A document's squared distance is the sum of its statistics' contributions; beyond a threshold
validated on labelled documents it is an outlier, and the statistics that contribute most say of which kind.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, spread

#: The statistics, in order, and the least spread that each is given: what less than that differs means nothing.
STATISTICS = {
    "log_words": 0.5, "mean_word_length": 0.5, "symbol_ratio": 0.02, "digit_ratio": 0.03, "end_punctuation_share": 0.15, "common_word_share": 0.06,
    "entry_share": 0.08, "row_share": 0.05, "top_word_share": 0.04, "vowelless_share": 0.04, "markup_share": 0.03,
}
#: Statistics whose contributions speak for a kind; direction 1: high, -1: low, 0: either.
SIGNS = {"list": {"entry_share": 1}, "table": {"row_share": 1}, "junk": {"mean_word_length": 0, "symbol_ratio": 1, "digit_ratio": 1, "common_word_share": -1, "top_word_share": 1, "vowelless_share": 1, "markup_share": 1}}
#: A list or table consists mostly of entries or rows.
MOSTLY = 0.5
#: A longer line is no entry and no part of a narrow column.
LONG_LINE = 110
#: Most frequent words of a language that count as common.
COMMON = 100
#: Share of a language's documents that each concentration step keeps; steps.
KEEP, STEPS = 0.7, 3
#: Documents whose weight the pooled moments have in a language's own.
PRIOR = 100
#: Distances among which the threshold is validated; the one that holds without labels.
CANDIDATES = np.exp(np.linspace(np.log(15), np.log(400), 60))
THRESHOLD = 60.0

_word = re.compile(r"[^\W_]+(?:[’'][^\W_]+)*")
_marked = re.compile(r"^\s*(?:[-*•–—+·▪◦‣→]|\(?\d{1,3}[.)]|\(?[A-Za-z][.)]|\[[ xX✓]?\]|\([ xX✓]?\))\s+\S")
_label = re.compile(r"^\s*[^\W\d_][\w /’'&-]{0,28}:\s+\S")
_quote = re.compile(r"^\s*(?:>\s?)+")
_url = re.compile(r"^\s*(?:https?://|www\.)\S+\s*$")
_scheme = re.compile(r"\b(?:https?|ftp)://(?:www\.)?")
_border = re.compile(r"^[\s+|=:\-─│┼]{5,}$")
_pair = re.compile(r"^[^\s=]+=")
_markup = re.compile(r"<[/!]?[A-Za-z][^<>]*>|%%?\w+%%?|\{\{?[^{}]*\}\}?|\\x[0-9a-fA-F]{2}|&#?\w+;|(?<![0-9A-Za-z])[0-9a-f]{2}(?:\s[0-9a-f]{2}){3,}(?![0-9A-Za-z])|[A-Za-z0-9+/]{40,}={0,2}")
_vowel = re.compile(r"[aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýœ]", re.I)
_latin = re.compile(r"^[a-z]{3,}$", re.I)
_ended = re.compile(r"[.?!…।:;»”\"'’)]\s*$")
_stopped = re.compile(r"[.?!…।][»”\"'’)]?\s*$")


def _cells(line: str) -> tuple[str, int]:
    """The separator that makes most cells of a line, and their number."""
    best = ("", 1)
    bare = line.strip().strip("|")
    for mark, parts in (("|", bare.split("|")), ("tab", line.strip("\n").split("\t")), (";", line.split(";")), ("space", re.split(r"\s{2,}", line.strip()))):
        if len(parts) > best[1] and all(len(p.split()) <= 6 for p in parts):
            best = (mark, len(parts))
    words = line.split()
    if len(words) >= 3 and all(_pair.match(w) for w in words) and len(words) > best[1]:
        best = ("=", len(words))
    parts = line.split(",")
    if len(parts) > max(2, best[1]) and " " not in line.strip():
        best = (",", len(parts))
    return best


def _entries(text: str) -> list[bool]:
    """For each non-blank line whether it is an entry of a list: marked, a label with its entry, an address, or a short
    line without full stop. Lines of wrapped prose are none: most were ended because the next word did not fit."""
    out: list[bool] = []
    run: list[str] = []

    def close() -> None:
        width = max(map(len, run), default=0)
        full = [len(x) + 1 + len(y.split()[0]) > width or bool(_stopped.search(x)) for x, y in zip(run, run[1:])]
        told = sum(bool(_marked.match(x) or _label.match(x) or _url.match(x)) for x in run)
        wrapped = len(run) > 2 and sum(full) >= 0.8 * len(full) and told < 0.3 * len(run)
        for x in run:
            words = x.split()
            letters = sum(c.isalpha() or "ऀ" <= c <= "ॿ" for c in x)
            if _marked.match(x) or _label.match(x):
                out.append(len(words) <= 14 and not (wrapped and _stopped.search(x)))
            elif _url.match(x):
                out.append(True)
            else:
                out.append(not wrapped and len(words) <= 9 and not _stopped.search(x) and 2 * letters >= len("".join(words)))
        run.clear()

    for line in text.split("\n"):
        bare = _quote.sub("", line).rstrip()
        if not bare.strip():
            close()
            out += [False] * bool(line.strip())
        elif len(bare) > LONG_LINE:
            close()
            out.append(False)
        else:
            run.append(bare)
    close()
    return out


def line_shares(text: str) -> tuple[float, float, float]:
    """Shares of the non-blank lines that end in punctuation, are entries of a list, and are rows of a table."""
    lines = [x for x in text.split("\n") if x.strip()]
    n = len(lines)
    ended = sum(bool(_ended.search(x)) for x in lines) / n
    cells = [_cells(x) for x in lines]
    shapes = Counter(c for c in cells if c[1] >= 3)
    row = [False] * n
    if shapes:
        (mark, count), _ = shapes.most_common(1)[0]
        row = [c == (mark, count) for c in cells]
        if mark == "space":  # wide cells may touch the next, but columns begin at the same places; stretched prose has none
            begins = [[m.end() for m in re.finditer(r"\S\s{2,}", x)] for x in lines]
            often = {b for b, k in Counter(b for bs in begins for b in set(bs)).items() if k >= 0.3 * n}
            row = [bool(bs) and sum(b in often for b in bs) >= 0.6 * len(bs) for bs in begins]
        row = [r or bool(_border.match(x)) for r, x in zip(row, lines)]
    entries = sum(not r and e for r, e in zip(row, _entries(text)))
    return ended, entries / n, sum(row) / n


def statistics(text: str, common: set[str]) -> list[float]:
    """The statistics of a text that is not blank, in the order of STATISTICS."""
    words = [w.lower() for w in _word.findall(_scheme.sub(" ", text))]
    n = max(1, len(words))
    solid = [c for c in text if not c.isspace()]
    marks = sum(not c.isalnum() and not "ऀ" <= c <= "ॿ" for c in solid)
    digits = sum(c.isdigit() for c in solid)
    ended, entry, row = line_shares(text)
    latin = [w for w in words if _latin.match(w)]
    counted = Counter(words)
    top = sum(c - 1 for _, c in counted.most_common(5)) / n  # repetitions, which a short text need not have
    return [
        np.log1p(len(words)),
        sum(map(len, words)) / n,
        marks / len(solid),
        digits / len(solid),
        ended,
        sum(w in common for w in words) / n,
        entry,
        row,
        top,
        sum(not _vowel.search(w) for w in latin) / n,
        sum(len(m[0]) for m in _markup.finditer(text)) / len(text),
    ]


def common_words(df: DataFrame, text: str, language: str) -> dict[str, set[str]]:
    """The COMMON most frequent words of each language over all documents, and under '' those of all languages.
    The result is bounded by the number of languages; words are counted and ranked where the data are."""
    words = df.select(F.coalesce(F.lower(F.trim(language)), F.lit("")).alias("lang"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))).alias("w")).where("lang <> ''")
    counts = words.groupBy("lang", "w").agg(F.count("*").alias("n")).where("n > 1")
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).where(F.col("r") <= COMMON)
    out: dict[str, set[str]] = {"": set()}
    for r in ranked.collect():
        out.setdefault(r.lang, set()).add(r.w)
        out[""].add(r.w)
    return out


class Moments:
    """Mean and inverse covariance per language; '' for the pooled ones."""

    def __init__(self, mean: dict[str, np.ndarray], inverse: dict[str, np.ndarray]):
        self.mean, self.inverse = mean, inverse

    def contributions(self, languages: list[str], x: np.ndarray) -> np.ndarray:
        """Per document and statistic its part of the squared distance; a part may be below zero."""
        out = np.empty_like(x)
        names = np.array([k if k in self.mean else "" for k in languages], object)
        for k in set(names):
            rows = names == k
            d = x[rows] - self.mean[k]
            out[rows] = d * (d @ self.inverse[k])
        return out


def _matrix(batch: pd.DataFrame) -> np.ndarray:
    return np.array(batch["x"].tolist(), np.float64).reshape(len(batch), len(STATISTICS))


def fit(stats: DataFrame) -> Moments:
    """Robust moments by language from rows (lang, x); each step is two aggregations of fixed size per language."""
    k, floor = len(STATISTICS), np.array(list(STATISTICS.values()))
    middle = [F.percentile_approx(F.get("x", F.lit(i)), [0.25, 0.5, 0.75]).alias(f"q{i}") for i in range(k)]
    starts = {r.lang: r for r in stats.groupBy("lang").agg(*middle).collect()}
    pooled = stats.agg(*middle).first()
    starts[""] = pooled if pooled["q0"] is not None else None
    mean, inverse = {}, {}
    for lang, r in starts.items():
        q = np.array([r[f"q{i}"] for i in range(k)]) if r else np.zeros((k, 3))
        mean[lang], inverse[lang] = q[:, 1], np.diag(1 / np.maximum((q[:, 2] - q[:, 0]) / 1.35, floor) ** 2)
    moments = Moments(mean, inverse)
    for _ in range(STEPS):
        moments = _concentrated(stats, moments, floor)
    return moments


def _concentrated(stats: DataFrame, moments: Moments, floor: np.ndarray) -> Moments:
    def distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"lang": b["lang"], "x": b["x"], "d": moments.contributions(list(b["lang"]), _matrix(b)).sum(1)})

    far = stats.mapInPandas(distances, "lang string, x array<double>, d double")
    cuts = {r.lang: r.c for r in far.groupBy("lang").agg(F.percentile_approx("d", KEEP).alias("c")).collect()}

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, list] = {}
        for b in batches:
            langs, x = list(b["lang"]), _matrix(b)
            d = moments.contributions(langs, x).sum(1)
            near = d <= np.array([cuts[k] for k in langs])
            for k in set(langs):
                y = x[near & (np.array(langs, object) == k)]
                t = total.setdefault(k, [0, np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1]))])
                t[0], t[1], t[2] = t[0] + len(y), t[1] + y.sum(0), t[2] + y.T @ y
        if total:
            yield pd.DataFrame({"lang": list(total), "n": [t[0] for t in total.values()], "s": [t[1].tolist() for t in total.values()], "p": [t[2].ravel().tolist() for t in total.values()]})

    k = len(floor)
    parts = stats.mapInPandas(sums, "lang string, n long, s array<double>, p array<double>")
    # element by element, so that what a task holds of a language is one number each
    flat = parts.select("lang", "n", F.posexplode(F.concat("s", "p")).alias("i", "v")).groupBy("lang", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    held: dict[str, tuple[int, np.ndarray]] = {}
    for r in flat:
        held.setdefault(r.lang, (r.n, np.zeros(k + k * k)))[1][r.i] = r.v
    if not held:
        return moments
    n = sum(c for c, _ in held.values())
    every = sum(v for _, v in held.values())
    grown = 1.0 / KEEP  # what is cut off shrinks the spread
    mean, inverse = {}, {}
    centre = every[:k] / n
    spread_ = (every[k:].reshape(k, k) / n - np.outer(centre, centre)) * grown
    for lang, (c, v) in [*held.items(), ("", (n, every))]:
        m = v[:k] / max(1, c)
        own = (v[k:].reshape(k, k) / max(1, c) - np.outer(m, m)) * grown
        w = c / (c + PRIOR)
        mean[lang] = (c * m + 5 * centre) / (c + 5)
        inverse[lang] = np.linalg.inv(w * own + (1 - w) * spread_ + np.diag(floor**2))
    return Moments(mean, inverse)


def _kind(parts: np.ndarray, x: np.ndarray, mean: np.ndarray, threshold: float) -> str:
    """Prose within the threshold. Beyond it a document that consists of rows or of readable entries for the most part
    is a table or a list, if that is what makes it an outlier; every other one is junk."""
    if parts.sum() <= threshold:
        return "prose"
    names = list(STATISTICS)
    value = dict(zip(names, x))
    weight = {kind: sum(max(0.0, parts[i]) for i, s in enumerate(names) if s in signs and signs[s] * (x[i] - mean[i]) >= 0) for kind, signs in SIGNS.items()}
    readable = value["markup_share"] + value["vowelless_share"] <= 0.2 and value["symbol_ratio"] <= 0.4
    if value["row_share"] > MOSTLY and weight["table"] > 0 and weight["table"] >= weight["list"]:
        return "table"
    return "list" if value["entry_share"] > MOSTLY and weight["list"] > 0 and readable else "junk"


def text_quality(df: DataFrame, key: str, text: str, language: str, labels: DataFrame | None = None) -> DataFrame:
    """Per document: key, lang, every statistic, distance (squared Mahalanobis), contributions (a map by statistic) and
    kind: prose, list, table or junk.

    labels: (key, kind), which only validate the threshold; every labelled document counts, one that is judged both
    prose and not on both sides, a repeated label once. Without them THRESHOLD holds. A null or blank text has null
    statistics, distance 0 and kind prose (there is nothing wrong in it). A null or unknown language is measured against
    the pooled prose of all. Null keys and repeated rows are kept."""
    common = common_words(df.where(F.col(text).isNotNull()), text, language)
    key_type = df.schema[key].dataType.simpleString()

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "lang": b["lang"], "x": [statistics(t, common.get(g) or common[""]) if t and t.strip() else None for t, g in zip(b["t"], b["lang"])]})

    rows = spread(df.select(F.col(key).alias("k"), F.coalesce(F.lower(F.trim(language)), F.lit("")).alias("lang"), F.col(text).alias("t")))
    stats = cut(rows.mapInPandas(measured, f"k {key_type}, lang string, x array<double>"))
    held = stats.where("x IS NOT NULL")
    moments = fit(held.select("lang", "x"))

    threshold = THRESHOLD
    if labels is not None:
        sides = labels.select(F.col(key).alias("k"), (F.col("kind") == "prose").alias("prose")).where("prose IS NOT NULL").distinct()
        threshold = validated_threshold(moments, held.join(sides, "k").select("lang", "x", "prose"))

    names = list(STATISTICS)

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = b["x"].notna().to_numpy()
            x = np.full((len(b), len(names)), np.nan)
            parts = np.zeros((len(b), len(names)))
            if ok.any():
                x[ok] = _matrix(b[ok])
                parts[ok] = moments.contributions(list(b["lang"][ok]), x[ok])
            means = [moments.mean.get(g, moments.mean[""]) for g in b["lang"]]
            out = pd.DataFrame({"k": b["k"], "lang": b["lang"].where(b["lang"] != "", None)})
            for i, s in enumerate(names):
                out[s] = x[:, i]
            out["distance"] = parts.sum(1)
            out["contributions"] = [dict(zip(names, p)) for p in parts]
            out["kind"] = [_kind(p, v, m, threshold) if good else "prose" for p, v, m, good in zip(parts, x, means, ok)]
            yield out

    kinds = ", ".join(f"{s} double" for s in names)
    return stats.mapInPandas(judged, f"k {key_type}, lang string, {kinds}, distance double, contributions map<string, double>, kind string").withColumnRenamed("k", key)


def validated_threshold(moments: Moments, labelled: DataFrame) -> float:
    """The distance that tells labelled prose from the rest with the fewest errors, each kind weighing the same, in the
    middle of the best range; THRESHOLD if the rows (lang, x, prose) lack either. They are counted by side and by the
    candidates that they lie between, where the data are."""

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for b in batches:
            d = moments.contributions(list(b["lang"]), _matrix(b)).sum(1)
            counts.update(zip(b["prose"].tolist(), np.searchsorted(CANDIDATES, d).tolist()))
        if counts:
            yield pd.DataFrame([(*at, n) for at, n in counts.items()], columns=["prose", "i", "n"])

    found = {side: np.zeros(len(CANDIDATES) + 1) for side in (True, False)}
    for r in labelled.mapInPandas(placed, "prose boolean, i int, n long").groupBy("prose", "i").agg(F.sum("n").alias("n")).collect():
        found[r.prose][r.i] = r.n
    prose, rest = found[True], found[False]
    if not prose.sum() or not rest.sum():
        return THRESHOLD
    beyond, within = prose.sum() - np.cumsum(prose)[:-1], np.cumsum(rest)[:-1]
    wrong = beyond / prose.sum() + within / rest.sum()
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    return float(CANDIDATES[best[len(best) // 2]])
