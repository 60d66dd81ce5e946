"""Text that was decoded with the wrong character encoding: found, and restored where its bytes survive.

A smoothed character trigram model is counted over all clean records. Every token with a non-ASCII character is
rewritten by chains "encode as read, decode as written", and the rewriting that the model finds likeliest is accepted if
its log-likelihood exceeds that of the token as it stands by more than a margin. The margin is validated beforehand on
all distinct clean tokens and on the same tokens damaged on purpose. A replacement character marks a text as damaged
that no chain restores.

Searched are chains of UTF-8 steps from any of READ_AS, up to DEPTH deep, and single steps from any of READ_AS to one of
WRITTEN_IN. Text truly in another single-byte encoding and chains that mix both kinds of steps are not found.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread


# Encodings that text was wrongly read in, and those it was truly written in.
READ_AS = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "koi8_r", "cp866", "iso8859_15")
WRITTEN_IN = ("cp1252", "cp1251", "mac_roman")
#: Chains are at most this deep; text is seldom damaged more than twice.
DEPTH = 3
#: Buckets of the hashed trigram and bigram counts: the size of the model, whatever the corpus.
TRIGRAMS, BIGRAMS = 1 << 21, 1 << 21
#: The margins that are tried.
MARGINS = np.arange(1.0, 12.1, 0.25)
#: The first model has counted damaged records too, so what it finds likelier by this much is left out of the second.
IN_DOUBT = 2.0
LOST = "�"
#: Tokens that a worker remembers, at most.
REMEMBERED = 300_000

_utf8 = re.compile("[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf4][\x80-\xbf]{3}")
#: A token is bounded by ASCII white space only: a no-break space may be half of a damaged letter.
_space = re.compile(r"[\t\n\r ]+")
_digit = re.compile("[0-9]")
_control = re.compile("[\x80-\x9f]")
_token = re.compile(r"[^\t\n\r ]*[^\x00-\x7f][^\t\n\r ]*")


def _decoded(encoding: str) -> dict[int, str]:
    """What each upper byte is in an encoding; bytes it leaves undefined stand for themselves, as browsers do it."""
    return {b: bytes([b]).decode(encoding, "ignore") or chr(b) for b in range(128, 256)}


_ENCODE = {e: {ord(c): b for b, c in _decoded(e).items()} for e in READ_AS}
#: Per encoding the translation of a text to its bytes as characters; what it can't encode becomes a mark.
_BYTES = {e: {**{c: "" for c in range(128, 256)}, **{c: chr(b) for c, b in t.items()}} for e, t in _ENCODE.items()}
_SINGLE = {f"{e}>{d}": {c: _decoded(d)[b] for c, b in _ENCODE[e].items() if _decoded(d)[b] != chr(c)} for e in READ_AS for d in WRITTEN_IN if d != e}


def _from_utf8(token: str, encoding: str) -> str:
    """The token with each run that is UTF-8 in the bytes of an encoding decoded; the rest as it is."""
    raw = token.translate(_BYTES[encoding])
    out, at = [], 0
    for m in _utf8.finditer(raw):
        out += [token[at : m.start()], m[0].encode("latin-1").decode("utf-8", "ignore")]
        at = m.end()
    return "".join([*out, token[at:]]) if at else token


def rewritings(token: str) -> dict[str, str]:
    """Every different text that a searched chain makes of a token, with the shortest chain that makes it."""
    found: dict[str, str] = {}
    edge = {token: ""}
    for _ in range(DEPTH):
        new = {}
        for text, chain in edge.items():
            for e in READ_AS:
                out = _from_utf8(text, e)
                if out != text and out != token and out not in found and out:
                    found[out] = new[out] = f"{chain}{' ' if chain else ''}{e}>utf-8"
        edge = new
    for e in READ_AS:  # a no-break space that was the second half of a letter has become a space
        raw = token[-1].translate(_BYTES[e])
        if "\xc2" <= raw <= "\xdf":
            last = (raw + "\xa0").encode("latin-1").decode("utf-8", "ignore")
            found.setdefault(_from_utf8(token[:-1], e) + last, f"{e}>utf-8")
    for chain, table in _SINGLE.items():
        out = token.translate(table)
        if out != token and not any("\x80" <= c < "\xa0" for c in out):
            found.setdefault(out, chain)
    return found


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket numbers of trigrams and of the bigrams before and at each character, and where each text starts."""
    # words stand alone, as tokens are scored; which digit it is says nothing
    padded = [f"  {_space.sub('  ', _digit.sub('0', t))} " for t in texts]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    c = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    mixed = c * np.uint32(2654435761)
    mixed ^= mixed >> np.uint32(15)  # else sums of multiples of two characters collide
    pair = np.zeros_like(mixed)
    pair[1:] = mixed[:-1] * np.uint32(2246822507) + mixed[1:]
    before = np.zeros_like(pair)
    before[1:] = pair[:-1]
    three = before * np.uint32(3266489909) + mixed
    fold = lambda x, size: (((x ^ (x >> np.uint32(15))) * np.uint32(2246822519)) >> np.uint32(9)) % np.uint32(size)
    return fold(three, TRIGRAMS).astype(np.int64), fold(before, BIGRAMS).astype(np.int64), fold(pair, BIGRAMS).astype(np.int64), np.cumsum(sizes) - sizes


@dataclass
class Model:
    """Counts of hashed trigrams and bigrams, and the margin. ``known`` remembers what a worker found out."""

    three: np.ndarray
    two: np.ndarray
    margin: float = 6.0
    known: dict[str, tuple[str, str, float]] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        """Only the buckets that hold something travel to the workers."""
        at = [np.flatnonzero(t).astype(np.int32) for t in (self.three, self.two)]
        return {"at": at, "n": [t[k].astype(np.float32) for t, k in zip((self.three, self.two), at)], "size": [len(self.three), len(self.two)], "margin": self.margin}

    def __setstate__(self, state: dict) -> None:
        tables = [np.zeros(size, np.float32) for size in state["size"]]
        for table, at, n in zip(tables, state["at"], state["n"]):
            table[at] = n
        self.three, self.two = tables
        self.margin, self.known = state["margin"], {}

    def likelihood(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood of each text: trigrams backed off to the last bigram's share, that to a uniform character."""
        if not texts:
            return np.zeros(0)
        three, before, pair, starts = _grams(texts)
        share = (self.two[pair] + 1e-4) / (self.two.sum() + 1)
        p = (self.three[three] + 4 * np.minimum(1, share * 400)) / (self.two[before] + 4)
        logs = np.log(np.maximum(p, 1e-7))
        logs[starts], logs[starts + 1] = 0, 0
        return np.add.reduceat(logs, starts)

    def best(self, tokens: Iterable[str]) -> None:
        """Finds for each new token its likeliest rewriting, the chain, and by how much it is likelier."""
        new = [t for t in dict.fromkeys(tokens) if t not in self.known]
        for at in range(0, len(new), 2_000):
            part = new[at : at + 2_000]
            options = [list(rewritings(t).items()) for t in part]
            flat = [*part, *(o for os in options for o, _ in os)]
            scores = self.likelihood(flat)
            k = len(part)
            for i, (token, os) in enumerate(zip(part, options)):
                if LOST in token:  # nothing is less likely than a mark that a decoder puts for what it can't read
                    likelier = os and scores[k : k + len(os)].max() > scores[i]
                    self.known[token] = (*(os[int(np.argmax(scores[k : k + len(os)]))] if likelier else (token, "lost")), np.inf)
                elif os:
                    j = int(np.argmax(scores[k : k + len(os)]))
                    self.known[token] = (*os[j], float(scores[k + j] - scores[i]))
                else:
                    self.known[token] = (token, "", -np.inf)
                k += len(os)

    def damaged(self, text: str) -> bool:
        """Whether a token is likelier rewritten by more than the margin; its tokens must be known."""
        return any(self.known[t][2] > self.margin for t in set(_token.findall(text)))

    def repair(self, text: str) -> tuple[str, list[str], float]:
        """The text restored as far as chains go, the chains used, and the greatest gain; its tokens must be known."""
        if not self.damaged(text):
            return text, [], 0.0
        used = {self.known[t][1:] for t in _token.findall(text) if self.known[t][2] > 0}
        fixed = _token.sub(lambda m: self.known[m[0]][0] if self.known[m[0]][2] > 0 else m[0], text)
        return fixed, sorted({c for c, _ in used}), max(g for _, g in used)

    def forget(self) -> None:
        """Keeps what a worker remembers below a fixed size."""
        if len(self.known) > REMEMBERED:
            self.known.clear()


def fit(df: DataFrame, text: str) -> Model:
    """Counts the model over all clean records of df and validates its margin on all distinct clean tokens. Clean are, for
    a first model, records without replacement or control characters; for the second those that the first finds whole.

    Each task counts into its own fixed tables; what reaches the driver is one number per bucket."""
    model = Model(np.zeros(TRIGRAMS), np.zeros(BIGRAMS))
    texts = df.select(F.col(text).alias("t")).where("t IS NOT NULL")

    def clean(texts: list[str], first: bool) -> list[str]:
        kept = [t for t in texts if LOST not in t and not _control.search(t)]
        if not first:
            model.best(w for t in kept for w in _token.findall(t))
            kept = [t for t in kept if not model.damaged(t)]
        return kept

    def count(batches: Iterator[pd.DataFrame], first: bool) -> Iterator[pd.DataFrame]:
        three, two = np.zeros(TRIGRAMS, np.int64), np.zeros(BIGRAMS, np.int64)
        for batch in batches:
            kept = clean(list(batch["t"]), first)
            model.forget()
            if kept:
                a, _, b, _ = _grams(kept)
                three += np.bincount(a, minlength=TRIGRAMS)
                two += np.bincount(b, minlength=BIGRAMS)
        for kind, counts in enumerate((three, two)):
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"kind": np.full(len(at), kind, np.int32), "at": at.astype(np.int32), "n": counts[at]})

    def counted(first: bool) -> Model:
        summed = texts.mapInPandas(lambda it: count(it, first), "kind int, at int, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).toPandas()
        tables = []
        for kind, size in ((0, TRIGRAMS), (1, BIGRAMS)):
            rows = summed[summed["kind"] == kind]
            tables.append(np.zeros(size, np.float32))
            tables[-1][rows["at"].to_numpy(int)] = rows["n"]
        return Model(*tables)

    model = counted(True)
    model.margin = IN_DOUBT
    model = counted(False)

    def clean_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens = {w for t in clean(list(batch["t"]), False) for w in _token.findall(t)}
            model.forget()
            yield pd.DataFrame({"w": sorted(tokens)})

    margin = validated_margin(model, texts.mapInPandas(clean_tokens, "w string").distinct())
    model.margin = margin
    model.known.clear()
    return model


def broken(token: str) -> set[str]:
    """What a clean token becomes by every chain of one step."""
    raw = token.encode("utf-8", "ignore")
    out = {"".join(_decoded(e).get(b, chr(b)) for b in raw) for e in ("cp1252", "cp437", "mac_roman", "cp1251")}
    if all(c.isascii() or ord(c) in _ENCODE["cp1252"] for c in token):
        out |= {"".join(_decoded(e).get(b, chr(b)) for b in token.encode("cp1252", "ignore")) for e in ("cp437", "cp850", "cp1251")}
    return {b for b in out if not b.isascii()}


def validated_margin(model: Model, clean: DataFrame) -> float:
    """Half way between the gains of clean tokens (column w) and those of the same tokens damaged by every chain of one
    step: the margin at which the fewest of both are taken for the other, each kind weighing the same. Gains are found
    in the tasks; what reaches the driver is how many lie between two margins."""

    def damage(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(w, True) for w in batch["w"]] + [(b, False) for w in batch["w"] for b in broken(w)]
            yield pd.DataFrame(rows, columns=["w", "whole"])

    def gains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            model.best(batch["w"])
            gain = np.array([model.known[w][2] for w in batch["w"]], float)
            exceeds = np.searchsorted(MARGINS, gain, "left")  # so many margins
            yield pd.DataFrame({"whole": batch["whole"], "exceeds": exceeds.astype(np.int32)})[np.isfinite(gain)]
            model.known.clear()

    tokens = spread(clean).mapInPandas(damage, "w string, whole boolean").groupBy("w").agg(F.max("whole").alias("whole"))  # what is also clean is not damaged
    counts = {True: np.zeros(len(MARGINS) + 1), False: np.zeros(len(MARGINS) + 1)}
    some = {True: 0, False: 0}
    for r in spread(tokens).mapInPandas(gains, "whole boolean, exceeds int").groupBy("whole", "exceeds").count().collect():
        counts[r["whole"]][r["exceeds"]] = r["count"]
        some[r["whole"]] += r["count"]
    if not some[False]:
        return model.margin
    taken = 1 - np.cumsum(counts[True])[:-1] / some[True] if some[True] else np.zeros(len(MARGINS))
    missed = np.cumsum(counts[False])[:-1] / some[False]
    wrong = taken + missed
    best = np.flatnonzero(np.isclose(wrong, wrong.min()))
    return float(MARGINS[best[len(best) // 2]])


def damaged_texts(df: DataFrame, keys: list[str], text: str, model: Model | None = None) -> DataFrame:
    """The rows of df whose text was wrongly decoded, wholly or in part: the keys, ``damaged`` (the text as it is),
    ``restored`` (as far as the chains go), ``chains``, ``gain`` (of log-likelihood), and ``whole``, false where
    characters are lost for good. Null and empty texts are never damaged; repeated rows are kept. Without a model, one
    is fitted on df; an empty df fits an empty model and has no damaged rows."""
    model = model or fit(df, text)
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            model.best(t for x in batch["_text"] for t in _token.findall(x))
            fixed = [model.repair(x) for x in batch["_text"]]
            keep = [bool(f[1]) for f in fixed]
            out = batch.assign(restored=[f[0] for f in fixed], chains=[f[1] for f in fixed], gain=[max(f[2], 0.0) for f in fixed], whole=[LOST not in x for x in batch["_text"]])
            yield out[keep].rename(columns={"_text": "damaged"})
            model.forget()

    rows = df.select(*keys, F.col(text).alias("_text")).where(F.col("_text").rlike(r"[^\x00-\x7F]"))
    return rows.mapInPandas(run, f"{kinds}, damaged string, restored string, chains array<string>, gain double, whole boolean")
