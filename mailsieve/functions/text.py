"""Text functions: Column builders where built-ins suffice, Arrow UDFs where Unicode forms are needed."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

INVISIBLE = "[​-‏‪-‮⁠-⁤⁦-⁩﻿­͏᠎]"
DIRECTION = "[‪-‮⁦-⁩]"
STYLED = "[\\x{1D400}-\\x{1D7FF}\\x{2102}\\x{210A}-\\x{2113}\\x{2115}\\x{2119}-\\x{211D}\\x{2124}\\x{212C}-\\x{2138}]"
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Hebrew", "Arabic", "Devanagari", "Thai", "Han", "Hiragana", "Katakana", "Hangul", "Georgian")


def collapse_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def truncate(c: Column, most: int) -> Column:
    return F.substring(c, 1, most)


def format_list(items: Column, most: int = 3) -> Column:
    """"a, b and c", or "a, b, c and N more" of a longer array; empty for an empty one."""
    shown, n = F.slice(items, 1, most), F.size(items)
    return (
        F.when(n > most, F.concat(F.array_join(shown, ", "), F.lit(" and "), (n - most).cast("string"), F.lit(" more")))
        .when(n > 1, F.concat(F.array_join(F.slice(items, 1, n - 1), ", "), F.lit(" and "), F.element_at(items, -1)))
        .otherwise(F.array_join(items, ""))
    )


def excerpt(c: Column, pattern: str, around: int = 32) -> Column:
    """The first match with so many characters on either side, ellipses where text was cut; null without a match."""
    at = F.regexp_instr(c, F.lit(pattern))
    start = F.greatest(at - around, F.lit(1))
    length = F.length(F.regexp_extract(c, pattern, 0)) + 2 * around
    return F.when(at > 0, F.concat(F.when(start > 1, "…").otherwise(""), c.substr(start, length), F.when(start + length <= F.length(c), "…").otherwise("")))


def mailbox(c: Column) -> Column:
    """struct(name, address) of ``Name <address>``, split at the last "<"; a bare address has an empty name."""
    inside = F.regexp_extract(c, r"<([^<>]*)>\s*$", 1)
    return F.struct(
        F.when(inside != "", F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^<>]*>\s*$", ""), '^\\s*"|"\\s*$', ""))).otherwise("").alias("name"),
        F.lower(F.trim(F.when(inside != "", inside).otherwise(c))).alias("address"),
    )


def extension_chain(filename: Column) -> Column:
    """The extensions of a file name, lower-cased, in order; direction marks, hidden characters and trailing dots don't
    count, and only parts of one to eight letters or digits are extensions."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(filename), INVISIBLE, ""), r"[. ]+$", "")
    return F.filter(F.slice(F.split(bare, r"\."), 2, 16), lambda x: x.rlike("^[a-z0-9]{1,8}$"))


def scripts_used(c: Column) -> Column:
    return F.array_compact(F.array(*[F.when(c.rlike(rf"\p{{Is{s}}}"), s) for s in SCRIPTS]))


def suspicious_mixture(c: Column) -> Column:
    """More than one script, but for the mixtures that are ordinary in East Asian writing."""
    used = scripts_used(c)
    east = F.array(*map(F.lit, ("Latin", "Han", "Hiragana", "Katakana", "Hangul")))
    return (F.size(used) > 1) & (F.size(F.array_except(used, east)) > 0)


def content_chars(c: Column) -> Column:
    """How many letters and digits a text has."""
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def redacted_addresses(c: Column) -> Column:
    """Every mail address reduced to its domain."""
    return F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)", "<address@$1>")


# Letters and what they resemble, and pairs of letters that look like one.
LOOKS = dict(zip("аеорсхуіјѕһԁԛԝкмтвнзαεικνορτυχωηβɑɡıȷꞷ013$@|!¡", "aeopcxyijshdqwkmtbh3aeikvoptuxwnbagijwole" "sa" "lll", strict=True))
PAIRS = (("rn", "m"), ("vv", "w"), ("cl", "d"), ("nn", "m"))


def skeleton_of(text: str) -> str:
    """What a word looks like: decomposed without marks, look-alikes replaced, look-alike pairs joined, i and l one."""
    flat = "".join(LOOKS.get(c, c) for c in unicodedata.normalize("NFKD", text.lower()) if unicodedata.category(c) != "Mn")
    for pair, one in PAIRS:
        flat = flat.replace(pair, one)
    return re.sub(r"[\s._-]+", "", flat.replace("i", "l"))


def edit_distance(a: str, b: str, most: int = 2) -> int:
    """Optimal string alignment distance, a swap of neighbours counting one; most + 1 for anything farther."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j - 1] + 1, last[j] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, two[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        two, last = last, row
    return min(last[-1], most + 1)


def folded_of(text: str) -> str:
    """Latin letters without their marks; other characters, and the length, stay as they are."""
    out = []
    for c in text:
        parts = unicodedata.normalize("NFD", c)
        out.append(parts[0] if len(parts) > 1 and parts[0].isascii() and all(unicodedata.category(m) == "Mn" for m in parts[1:]) else c)
    return "".join(out)


def normalized_of(text: str) -> str:
    """One form for matching: compatibility form, no direction marks or hidden characters, plain quotes and dashes."""
    flat = re.sub(INVISIBLE, "", unicodedata.normalize("NFKC", text)).lower().replace("ß", "ss")
    return re.sub(r"\s+", " ", flat.translate(str.maketrans("‘’“”–—−", "''\"\"---"))).strip()


def decoded_host(host: str) -> str:
    """A host with its xn-- labels decoded; a label that can't be decoded stays."""
    labels = []
    for label in host.split("."):
        try:
            labels.append(label[4:].encode("ascii").decode("punycode") if label.lower().startswith("xn--") else label)
        except (UnicodeError, ValueError, OverflowError):
            labels.append(label)
    return ".".join(labels)


def _each(f, returns: str):
    """An Arrow UDF that applies f once per distinct value of a batch; null stays null."""

    @F.pandas_udf(returns)
    def apply(values: pd.Series) -> pd.Series:
        known = {v: f(v) for v in values.dropna().unique()}
        return pd.Series([known.get(v) for v in values], dtype=object)

    return apply


def skeleton(c: Column) -> Column:
    return _each(skeleton_of, "string")(c)


def folded(c: Column) -> Column:
    return _each(folded_of, "string")(c)


def normalized(c: Column) -> Column:
    return _each(normalized_of, "string")(c)


def idn_decoded(c: Column) -> Column:
    return _each(decoded_host, "string")(c)


def osa_distance(a: Column, b: Column, most: int = 2) -> Column:
    @F.pandas_udf("int")
    def apply(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([edit_distance(p, q, most) if p is not None and q is not None else None for p, q in zip(x, y)], dtype="Int32")

    return apply(a, b)


_NEGATED_BEFORE = re.compile(r"\b(?:never|do not|don'?t|will not|won'?t|does not|doesn'?t|nobody|no one|not)\b[^.!?]{0,80}$", re.I)
_NEGATED_AFTER = re.compile(r"^[^.!?]{0,30}\b(?:is never|will never be|should not be|must not be)\b", re.I)
_CONDITIONAL = re.compile(r"\b(?:if|unless|when|in case)\b[^.!?]{0,80}$", re.I)


def unnegated(c: Column, pattern: str) -> Column:
    """The first match of a pattern that its sentence does not deny; null if all are denied.
    A conditional before a denial keeps the match ("if you did not ... send the code")."""
    found = re.compile(pattern, re.I)

    def first(text: str) -> str | None:
        at = 0
        while m := found.search(text, at):
            before = text[max(0, m.start() - 320) : m.start()]
            denied = _NEGATED_BEFORE.search(before) and not _CONDITIONAL.search(before) or _NEGATED_AFTER.search(text[m.end() :])
            if not denied:
                return m[0]
            at = m.start() + 1
        return None

    return _each(first, "string")(c)


def first_match(c: Column, pattern: str) -> Column:
    """struct(text, at): the first hit of a pattern and where it begins, from 1; null without one."""
    at = F.regexp_instr(c, F.lit(pattern))
    return F.when(at > 0, F.struct(F.regexp_extract(c, pattern, 0).alias("text"), at.alias("at")))


def is_confusable(a: Column, b: Column) -> Column:
    """Whether two different names look the same."""
    return (F.lower(a) != F.lower(b)) & (skeleton(a) == skeleton(b))


def fingerprint(*columns: Column) -> Column:
    """A short key of what columns hold, by which a change is seen; equal for equal contents, nulls included."""
    return F.lower(F.conv(F.hex(F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))), 16, 36))


def duration(milliseconds: Column) -> Column:
    """"340 ms", "2.4 s", "1 min 05 s"."""
    seconds = milliseconds / 1000
    return (
        F.when(milliseconds < 1000, F.concat(F.round(milliseconds).cast("long").cast("string"), F.lit(" ms")))
        .when(seconds < 60, F.concat(F.format_number(seconds, 1), F.lit(" s")))
        .otherwise(F.format_string("%d min %02d s", F.floor(seconds / 60).cast("long"), F.floor(seconds % 60).cast("long")))
    )
