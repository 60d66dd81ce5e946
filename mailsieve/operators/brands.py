"""Identities to protect, and where messages claim or imitate them. All meetings of messages and identities are
equi-joins: on a word, on a domain, on a label, or, for imitations, on a segment that few edits leave intact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dialect import DUCK, SPARK, Dialect
from ..plans.context import scan


def brand_columns(q: Dialect) -> dict[str, str]:
    domain = q.domain("email")
    return {"brand_id": "entry_id", "brand_domain": q.registrable(domain), "keyword": q.extract(domain, r"^([a-z0-9]+)"), "target": q.extract(q.registrable(domain), r"^([^.]+)")}


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = scan(spark, sf_dir, "known_senders").where("email IS NOT NULL")
    return known.select(*[F.expr(v).alias(k) for k, v in brand_columns(SPARK).items()])


def claims(ctx: DataFrame, known: DataFrame) -> DataFrame:
    """(msg_id, claim_id, claim_domain): the identity that a sender name names first, by position, then by id."""
    words = ctx.select("msg_id", F.posexplode(F.split(F.trim("name_words"), " ")).alias("at", "word"))
    first = words.join(known, F.col("word") == F.col("keyword")).groupBy("msg_id").agg(F.min(F.struct("at", "brand_id", "brand_domain")).alias("c"))
    return first.select("msg_id", F.col("c.brand_id").alias("claim_id"), F.col("c.brand_domain").alias("claim_domain"))


def same_core(known: DataFrame) -> DataFrame:
    """(core, core_brand): the first identity by id whose domain has this core."""
    return known.groupBy(F.col("target").alias("core")).agg(F.min("brand_id").alias("core_brand"))


def labelled(hosts: DataFrame, known: DataFrame) -> DataFrame:
    """(host, label_brand): the first identity by id whose core is a label left of the host's registrable domain.
    hosts: host, registrable."""
    inner = F.expr("substring(host, 1, greatest(length(host) - length(registrable) - 1, 0))")
    labels = hosts.where("registrable <> ''").distinct().select("host", F.explode(F.split(inner, r"\.")).alias("label"))
    return labels.join(known, F.col("label") == F.col("target")).groupBy("host").agg(F.min("brand_id").alias("label_brand"))


def segments(length: F.Column, part: F.Column) -> tuple[F.Column, F.Column]:
    """Start (from 0) and size of the third number ``part`` of a word of the given length."""
    start = F.floor(length * part / 3).cast("int")
    return start, F.floor(length * (part + 1) / 3).cast("int") - start


def met_targets(cores: DataFrame, known: DataFrame) -> DataFrame:
    """cores (core, plain and other columns) with the targets that they may imitate: brand_id, target, ``shown`` and ``face``,
    the skeletons of both, null for a core without one; a pair may come several times. Two edits leave one of three
    segments of a core intact, moved by at most two places in the target: they meet on that segment, or on the whole. A
    core gives four rows, however many targets there are; the targets' pieces are many, but few in all."""
    made = cores.where("core <> ''").withColumn("shown", F.expr(SPARK.skeleton("plain"))).withColumn("len", F.length("shown"))
    targets = known.select("brand_id", "target", F.expr(SPARK.skeleton("target")).alias("face")).where("length(face) >= 4")
    parts, whole = F.explode(F.array(*map(F.lit, range(4)))), F.col("part") == 3
    start, width = segments(F.col("len"), F.col("part"))
    keyed = made.withColumn("part", parts).withColumn("piece", F.when(whole, F.col("shown")).otherwise(F.substring("shown", start + 1, width)))
    pieces = targets.withColumn("len", F.explode(F.array(*[F.length("face") + d for d in range(-2, 3)]))).withColumn("part", parts).withColumn("shift", F.explode(F.array(*map(F.lit, range(-2, 3)))))
    pieces = pieces.where("(part = 3 AND shift = 0 AND len = length(face)) OR (part < 3 AND len >= 5 AND length(face) >= 5)").withColumn("from", start + F.col("shift")).where("part = 3 OR from >= 0")
    moved = pieces.withColumn("piece", F.when(whole, F.col("face")).otherwise(F.substring("face", F.col("from") + 1, width))).select("brand_id", "target", "face", "len", "part", "piece").distinct()
    return keyed.join(moved, ["len", "part", "piece"], "left")


#: How far a core is from a target it met, null if too far: 0 if it looks the same, else one edit, or two of long names.
FAR = """CASE WHEN shown = face THEN CASE WHEN plain <> target THEN 0 END
WHEN length(shown) >= 5 AND length(face) >= 5 AND (levenshtein(shown, face) = 1 OR (levenshtein(shown, face) = 2 AND length(shown) >= 8 AND length(face) >= 8)) THEN levenshtein(shown, face) END"""


def near_targets(cores: DataFrame, known: DataFrame) -> DataFrame:
    """(core, target, brand_id, distance): all pairs of a core and a target that it imitates."""
    met = met_targets(cores.select("core").distinct().withColumn("plain", F.col("core")), known)
    return met.withColumn("distance", F.expr(FAR)).where("distance IS NOT NULL").select("core", "target", "brand_id", "distance").distinct()


def brands_sql(q: Dialect = DUCK) -> str:
    """Brand, claim and nearest-target tables over ``ctx`` and ``lnk``, for the checking engine."""
    columns = ", ".join(f"{v} AS {k}" for k, v in brand_columns(q).items())
    near = "(shown = face AND written <> target AND length(face) >= 4) OR (length(shown) >= 5 AND length(face) >= 5 AND (levenshtein(shown, face) = 1 OR (levenshtein(shown, face) = 2 AND length(shown) >= 8 AND length(face) >= 8)))"
    return f"""brand AS (SELECT {columns} FROM known_senders WHERE email IS NOT NULL),
nw AS (SELECT msg_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT msg_id, string_split(trim(name_words), ' ') AS ws FROM ctx)),
claim AS (SELECT msg_id, brand_id AS claim_id, brand_domain AS claim_domain FROM nw JOIN brand ON word = keyword QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY pos, brand_id) = 1),
cores AS (SELECT sender_core AS core FROM ctx UNION SELECT regexp_extract(host_registrable, '^([^.]+)', 1) FROM lnk),
plain AS (SELECT core AS written, regexp_replace({q.skeleton("core")}, '[^\x00-\x7F]', '?', 'g') AS shown FROM cores WHERE core <> ''), -- distances here are of bytes
faces AS (SELECT brand_id, target, {q.skeleton("target")} AS face FROM brand),
close AS (SELECT written AS core, target, brand_id, levenshtein(shown, face)::INTEGER AS distance FROM plain, faces WHERE {near}),
near AS (SELECT core, brand_id AS near_id, distance AS near_distance FROM close QUALIFY row_number() OVER (PARTITION BY core ORDER BY distance, brand_id) = 1)"""
