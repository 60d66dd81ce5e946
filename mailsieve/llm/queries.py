"""The pN_ queries: each applies its operator, with production parameters, to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import one_per_message, spread, table, text_or_empty
from .encodings import damaged_texts
from .languages import document_languages
from .leakage import leaked_items, leaked_phrases
from .lookalikes import one_form, same_face
from .mixture import mix, shares
from .near_duplicates import group_pairs, near_duplicates
from .personal import personal_information
from .quality import text_quality
from .quoted_history import newly_written


def _family(spark: SparkSession, sf_dir: str, family: str, *columns: str) -> DataFrame:
    rows = table(spark, sf_dir, "messages").where(F.col("name") == family).select("msg_id", "received_at", *columns)
    return one_per_message(rows, *columns)


def _lure_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    lures = _family(spark, sf_dir, "payment-lure", "subject", "body_text")
    text = F.concat(text_or_empty("subject"), F.lit("\n"), text_or_empty("body_text"))
    return near_duplicates(lures, "msg_id", text, n=3, threshold=0.5)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_pairs(_lure_groups(spark, sf_dir), "msg_id")


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lure_groups(spark, sf_dir)


def _new_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newly_written(_family(spark, sf_dir, "supplier-invoice", "body_text"), "msg_id", "body_text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _new_parts(spark, sf_dir).select("msg_id", F.explode("lines").alias("line_no"))


def p2_new_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _new_parts(spark, sf_dir).select("msg_id", "new_text")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "cases").where("id IS NOT NULL").select("id", "body_text", "lang").dropDuplicates(["id"])
    news = _family(spark, sf_dir, "newsletter", "body_text", "lang")
    return cases.select(F.lit("cases").alias("src"), F.col("id").alias("rec_id"), "body_text", "lang").unionByName(
        news.select(F.lit("messages").alias("src"), F.col("msg_id").cast("string").alias("rec_id"), "body_text", "lang")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_languages(spark, sf_dir).where("seg_no > 0 AND NOT lang <=> declared").select("src", "rec_id", "seg_no", "lang")


def p3_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_languages(_labelled(spark, sf_dir), ["src", "rec_id"], "body_text", "lang")


#: The host of an absolute URL: after the scheme and any user part, before port, path, query or fragment.
HOST = r"^\s*[A-Za-z][A-Za-z0-9+.-]*:[/\\]{2}(?:[^/\\?#@]*@)?([^/\\?#:：／？＃]+)"


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    senders = one_per_message(table(spark, sf_dir, "messages").select("msg_id", "received_at", "sender_name", "sender_email"), "sender_name", "sender_email")
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("sender_name", "sender_email")])).alias("f")
    named = senders.select("msg_id", F.lit(-1).alias("link_index"), fields).select("msg_id", "link_index", "f.*")
    hosts = table(spark, sf_dir, "message_links").select("msg_id", "link_index", F.lit("href").alias("field"), F.regexp_extract("href", HOST, 1).alias("value"))
    return named.unionByName(hosts.where("msg_id IS NOT NULL AND value <> ''").distinct()).where("value IS NOT NULL")


def _known_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "known_senders")
    sides = {"sender_name": "display_name", "sender_email": "email", "href": "site_host"}
    return known.select("entry_id", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(v).alias("written")) for k, v in sides.items()])).alias("x")).select("entry_id", "x.*")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_forms(spark, sf_dir).select("msg_id", "field", F.col("link_index").cast("int"), "entry_id").distinct()


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _known_faces(spark, sf_dir)
    return same_face(one_form(_faces(spark, sf_dir), "value", known.select("written")), known)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_redacted(spark, sf_dir).select("msg_id", "field", F.explode("found").alias("x")).select("msg_id", "field", "x.kind", "x.value").distinct()


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_information(_family(spark, sf_dir, "supplier-invoice", "subject", "body_text"), ["msg_id"], ["subject", "body_text"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_restored(spark, sf_dir).select("src", "rec_id", "part_no").distinct()


def p6_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "parsed_messages").select(F.lit("parsed_messages").alias("src"), F.col("parsed_id").alias("rec_id"), F.posexplode("text").alias("part_no", "t"))
    subjects = _family(spark, sf_dir, "roundup-newsletter", "subject").select(F.lit("messages").alias("src"), F.col("msg_id").alias("rec_id"), F.lit(-1).alias("part_no"), F.col("subject").alias("t"))
    return damaged_texts(spread(parsed.unionByName(subjects)), ["src", "rec_id", "part_no"], "t")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_phrases(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source", table(spark, sf_dir, "source_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(p8_mixture(spark, sf_dir), "doc_id", table(spark, sf_dir, "source_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_quality(spark, sf_dir).where("kind <> 'prose'").select("doc_id", "kind")


def p9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", table(spark, sf_dir, "doc_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"

#: The same results by plain means: all pairs that share an n-gram, counted; all windows of words, compared.
_P1 = f"""WITH RECURSIVE one AS (SELECT * FROM messages WHERE name = 'payment-lure' AND msg_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY received_at) = 1),
w AS (SELECT msg_id, {_WORDS.format("coalesce(subject, '') || chr(10) || coalesce(body_text, '')")} AS ws FROM one),
g AS (SELECT DISTINCT msg_id, array_to_string(ws[i : i + 2], ' ') AS gram FROM w, unnest(range(1, len(ws) - 1)) AS t(i)),
n AS (SELECT msg_id, count(*) AS size FROM g GROUP BY 1),
shared AS (SELECT a.msg_id AS a, b.msg_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.msg_id <> b.msg_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n x ON a = x.msg_id JOIN n y ON b = y.msg_id WHERE 2 * c >= x.size + y.size - c),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT a AS msg_id_a, b AS msg_id_b FROM reach WHERE a < b"""
_P7 = f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS.format("text")} AS ws FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(ws[k : k + 11], ' ') AS g FROM d, unnest(range(1, len(ws) - 10)) AS t(k)), ig AS (SELECT item_id, array_to_string(ws[k : k + 11], ' ') AS g FROM i, unnest(range(1, len(ws) - 10)) AS t(k))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _P1, "p7_found": _P7}
