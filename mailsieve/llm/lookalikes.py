"""Text that looks the same in other characters: script-aware repair against the corpus' own vocabulary.

Compatibility forms, invisible characters, odd spaces and hyphens have one plain equivalent and are replaced outright;
combining accents are composed. Look-alike letters are not: only a token that mixes scripts is repaired, towards the
script that dominates it before any other that it has, whichever that is, and only if the result is a word of the
corpus, that is a token of one script, or of a given reference. A token of nothing but look-alikes is taken as one of
the script that dominates the rest of its value. "Волна" beside a Latin name stays.

Vocabulary and suspicious tokens meet on a skeleton, in which every look-alike stands as the letter it resembles, so
the vocabulary is a shuffled, never a broadcast, table. Only distinct values that hold a non-ASCII character are
brought into Python.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, spread

# Letters and the plain letter each resembles: Cyrillic, Greek, Armenian, Latin outside the alphabet, Cherokee.
LOOKALIKES = dict(
    zip(
        "аеорсхуіјѕһԁԛԝѵӏкмтвнзьгпАВЕКМНОРСТХУІЈЅԌԚԜҮ"
        "αεικνορστυχωγηςβϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ"
        "օսոհցգզքՕՍԼ"
        "ɑɡıȷɩʋꞷᴏᴄᴠᴡᴢꜱᴍᴋᴛʜʟɴʀɢʙʏɪ"
        "ᎪᏴᏟᎠᎬᎻᏗᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃ",
        "aeopcxyijshdqwvlkmtbh3brnABEKMHOPCTXYIJSGQWY"
        "aeikvopotuxwynsbcjABEZHIKMNOPTYXC"
        "ounhgqqpOUL"
        "agijivwocvwzsmkthlnrgbyi"
        "ABCDEHJJKLMPSTVWZ",
        strict=True,
    )
)
#: Letters that resemble a second one, for the comparison letter by letter.
SECOND = {"υ": "v", "η": "h", "һ": "n", "ӏ": "i", "ı": "l", "ѵ": "y", "γ": "v", "ո": "h", "І": "l", "Ι": "l"}
PUNCTUATION = dict.fromkeys("‐‑‒–—―−⁃﹣－˗", "-") | {"․": ".", "。": ".", "ꓸ": ".", "’": "'", "‘": "'", "ʼ": "'"}
_token = re.compile(r"\w+")
_mark_or_hidden = re.compile("[͏ᅟᅠ឴឵ㅤﾠ︀-️]")


def _script(ch: str) -> str:
    """The script of a letter; look-alikes of the Latin script count as foreign to it; digits have none."""
    if ch.isascii():
        return "LATIN" if ch.isalpha() else ""
    if not ch.isalpha():
        return ""
    name = unicodedata.name(ch, "").split(" ")[0]
    return "LATIN OTHER" if name == "LATIN" and ch in LOOKALIKES else name


def plain(text: str) -> str:
    """Everything but look-alike letters in its one plain form; accents composed."""
    out = []
    for ch in text:
        kind = unicodedata.category(ch)
        if ch in LOOKALIKES:
            out.append(ch)
        elif kind == "Cf" or _mark_or_hidden.match(ch):
            continue
        elif ch in PUNCTUATION:
            out.append(PUNCTUATION[ch])
        elif kind in ("Zs", "Zl", "Zp"):
            out.append(" ")
        else:
            out.append("".join(PUNCTUATION.get(c, c) for c in unicodedata.normalize("NFKC", ch)))
    return unicodedata.normalize("NFC", "".join(out))


def skeleton(text: str) -> str:
    """Lower-cased, look-alikes as the plain letter. A letter with two readings has the one that LOOKALIKES gives;
    letters that share a reading with it (i and l, u and v and so on) are therefore one in the skeleton."""
    lowered = "".join(LOOKALIKES.get(c, c) for c in text).lower()
    return "".join(_MERGED.get(c, c) for c in (LOOKALIKES.get(c, c).lower() for c in lowered))


#: Plain letters that some look-alike can stand for alike, under one representative.
_MERGED: dict[str, str] = {}
for _ch, _other in SECOND.items():
    _a, _b = LOOKALIKES.get(_ch, _ch).lower(), _other.lower()
    _a, _b = _MERGED.get(_a, _a), _MERGED.get(_b, _b)
    if _a != _b:
        _MERGED |= {k: _a for k, v in _MERGED.items() if v == _b} | {_b: _a}


def _readings(ch: str) -> set[str]:
    return {ch.lower(), LOOKALIKES.get(ch, ch).lower(), SECOND.get(ch, ch)}


def resembles(suspect: str, word: str) -> bool:
    """Whether each character of the suspect is that of the word, but for case, or one that looks like it."""
    return len(suspect) == len(word) and all(s.lower() == w.lower() or _readings(s) & _readings(w) for s, w in zip(suspect, word))


def _dominant(letters: list[str]) -> str:
    """The script of most letters that resemble none of another script; of most letters if all do; Latin of equals."""
    sure = [c for c in letters if c not in LOOKALIKES and c.lower() not in _IMAGES]
    counts = Counter(map(_script, sure or letters))
    return max(counts, key=lambda s: (counts[s], s == "LATIN", s)) if counts else ""


#: Plain letters that some look-alike resembles.
_IMAGES = {v.lower() for v in LOOKALIKES.values()} | set(SECOND.values())


def suspicious(text: str) -> list[tuple[str, list[str]]]:
    """The tokens of a plain text that need repair, and the scripts towards which, the likeliest first: those of mixed
    scripts, and those of look-alikes alone that stand in a text of another script."""
    tokens = [(t, [c for c in t if _script(c)]) for t in _token.findall(text)]
    out = []
    for k, (token, letters) in enumerate(tokens):
        scripts = set(map(_script, letters))
        if scripts <= {"LATIN"}:
            continue
        if len(scripts) > 1:
            main = _dominant(letters)
            main, plain_scripts = main.removesuffix(" OTHER"), {s.removesuffix(" OTHER") for s in scripts}
            out.append((token, sorted(plain_scripts, key=lambda s: (s != main, s))))
        elif all(c in LOOKALIKES for c in letters):
            around = _dominant([c for i, (_, cs) in enumerate(tokens) if i != k for c in cs])
            if around and around not in scripts:
                out.append((token, [around]))
    return out


def _analyse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        forms = [plain(v) for v in batch["value"]]
        tokens = [dict(suspicious(f)) for f in forms]
        yield pd.DataFrame({"value": batch["value"], "n": batch["n"], "form": forms, "tokens": [[{"token": t, "key": skeleton(t), "scripts": ss} for t, ss in ts.items()] for ts in tokens]})


def _vocabulary_key(word: Column) -> Column:
    """The skeleton of a lower-cased word, as an expression."""
    looks = {k: v.lower() for k, v in LOOKALIKES.items() if k == k.lower()} | {k: skeleton(v) for k, v in _MERGED.items()}
    looks |= {k: skeleton(k) for k in looks}
    return F.translate(word, "".join(looks), "".join(looks.values()))


#: Lower-cased words of one script: by script, what their characters are.
ONE_SCRIPT = {
    "LATIN": r"^[0-9_a-z\x{DF}-\x{130}\x{132}-\x{17F}]+$",
    **{s.upper(): rf"^[0-9_\p{{Is{s}}}]+$" for s in ("Cyrillic", "Greek", "Armenian", "Cherokee")},
}


def one_form(df: DataFrame, value: str, reference: DataFrame | None = None) -> DataFrame:
    """Adds ``form``, the value in one comparable form, to every row of df; ASCII case is kept as it is.

    The vocabulary is every token of one script of all values, with the tokens of ``reference`` (one string column).
    Several words may fit a token; one of the reference, then one of the likeliest script, then the most frequent, then
    the first by alphabet is taken. Null values keep a null form, empty ones an empty form; repeated rows are kept; df
    must have no column ``form``. Work is done once per distinct value, so a value that a third of all rows hold costs
    one row."""
    counted = cut(df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n")).where("value IS NOT NULL"))
    odd = counted.where(F.col("value").rlike(r"[^\x00-\x7F]"))
    analysed = cut(spread(odd).mapInPandas(_analyse, "value string, n long, form string, tokens array<struct<token: string, key: string, scripts: array<string>>>"))

    ascii_only = counted.where(~F.col("value").rlike(r"[^\x00-\x7F]")).select(F.lower("value").alias("v"), "n", F.lit(0).alias("given"))
    known = ascii_only.union(analysed.select(F.lower("form"), "n", F.lit(0)))
    if reference is not None:
        known = known.union(reference.toDF("v").select(F.lower("v"), F.lit(0).cast("long"), F.lit(1)))
    script = F.coalesce(*[F.when(F.col("word").rlike(p), k) for k, p in ONE_SCRIPT.items()])
    words = known.select(F.explode(F.regexp_extract_all("v", F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))).alias("word"), "n", "given")
    vocabulary = words.withColumn("script", script).where("script IS NOT NULL").groupBy("word", "script").agg(F.sum("n").alias("n"), F.max("given").alias("given"))

    @F.pandas_udf("boolean")
    def fits(token: pd.Series, word: pd.Series) -> pd.Series:
        return pd.Series([resembles(t, w) for t, w in zip(token, word)], dtype=bool)

    suspects = analysed.select("value", "form", F.explode("tokens").alias("t")).select("value", "form", "t.token", "t.key", "t.scripts")
    distinct = suspects.select("token", "key", "scripts").distinct()
    repaired = (
        distinct.join(vocabulary.withColumn("key", _vocabulary_key(F.col("word"))), "key")
        .where(F.array_contains("scripts", F.col("script")) & fits("token", "word"))
        .groupBy("token", "scripts")
        .agg(F.max_by("word", F.struct("given", -F.array_position("scripts", F.col("script")), "n", F.transform(F.split("word", ""), lambda c: -F.ascii(c)))).alias("word"))
    )
    replaced = suspects.join(repaired, ["token", "scripts"]).groupBy("value").agg(F.map_from_entries(F.collect_list(F.struct("token", "word"))).alias("words"))

    @F.pandas_udf("string")
    def substituted(form: pd.Series, words: pd.Series) -> pd.Series:
        def one(f: str, m) -> str:
            m = dict(m or {})

            def cased(t: str) -> str:
                w = m.get(t)
                return "".join(a.upper() if b.isupper() else a for a, b in zip(w, t)) if w else t

            return _token.sub(lambda x: cased(x[0]), f)

        return pd.Series([one(f, m) for f, m in zip(form, words)])

    forms = analysed.select("value", "form").join(replaced, "value", "left").select("value", F.when(F.col("words").isNull(), F.col("form")).otherwise(substituted("form", "words")).alias("form"))
    # a value that many rows hold: only the rows with non-ASCII values need the join, the others keep their own form
    keyed = df.withColumn("_odd", F.when(F.col(value).rlike(r"[^\x00-\x7F]"), F.col(value)))
    ascii_rows = keyed.where("_odd IS NULL").withColumn("form", F.col(value)).drop("_odd")
    odd_rows = keyed.where("_odd IS NOT NULL").join(forms.withColumnRenamed("value", "_value"), F.col("_odd") == F.col("_value")).select(*df.columns, "form")
    return ascii_rows.unionByName(odd_rows)


def same_face(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose value looks like a known one of the same field but is made of other characters.

    rows: any keys, field, value, form. known: field, entry_id, written. ASCII case never matters. known must be a
    bounded table; it is broadcast only if the planner finds it below spark.sql.autoBroadcastJoinThreshold."""

    def ascii_lower(c: Column) -> Column:
        return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    reference = known.select(F.col("field").alias("_field"), "entry_id", ascii_lower(F.col("written")).alias("_written")).distinct()
    return rows.join(reference, (F.col("field") == F.col("_field")) & (ascii_lower(F.col("form")) == F.col("_written"))).where(ascii_lower(F.col("value")) != F.col("_written")).drop("_field", "_written")
