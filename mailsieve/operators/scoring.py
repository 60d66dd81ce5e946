"""From contexts to signals, and from signals to scores.

Message rules are evaluated in the row. Link findings are ranked within (message, rule), capped and brought to their
message by one aggregation. From there on a message's signals are one array: correlation, softening, category sums,
floors and classes are expressions over it, without another shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CATEGORIES, SCORING, SEVERITIES
from ..dialect import DUCK, SPARK, Dialect
from ..plans.context import context_sql, link_context, message_context, sender_context
from ..functions import text
from . import rules as R
from .brands import FAR, brands, brands_sql, claims, labelled, met_targets, same_core

SIGNAL = "array<struct<id: string, category: string, severity: string, score: int>>"


def rank(severity: Column) -> Column:
    out = F.lit(0)
    for k, s in enumerate(SEVERITIES):
        out = F.when(severity == s, k).otherwise(out)
    return out


#: The label before the ending of a host, as parties are compared.
REGISTRABLE_CORE = r"([^.]+)\.[^.]+$"
PARTY_DOMAIN = r"@([^@\s<>]+)>?\s*$"


def near_names(a: Column, b: Column) -> Column:
    """One edit apart, or two where both are long; short names are never near."""
    far = F.levenshtein(a, b)
    return (F.length(a) >= 5) & (F.length(b) >= 5) & ((far == 1) | ((far == 2) & (F.length(a) >= 8) & (F.length(b) >= 8)))


def link_totals(links: DataFrame, senders: DataFrame) -> DataFrame:
    """Per message: web links, links of an unsubscribe kind, links to others than the sender's domain."""
    unsubscribe = F.lower(F.col("anchor")).rlike("unsubscribe|abbestellen|désabonner|darse de baja|manage|uitschrijven")
    own = senders.select("msg_id", "registrable")
    entry = F.col("web") & (F.col("hop") == 0)
    return links.join(own, "msg_id").groupBy("msg_id").agg(F.count_if(entry).alias("web_links"), F.count_if(entry & unsubscribe).alias("unsubscribe_links"), F.count_if(F.expr("web AND host_registrable <> registrable")).alias("foreign_links"), F.count_if(F.expr("web AND NOT tracker AND host_registrable <> registrable")).alias("strange_links"))


#: Columns of a text that no rule reads once its flags are known.
TEXTS = ("body_words", "text_words", "said")


def senders(ctx: DataFrame, lines: DataFrame, known: DataFrame, cores: DataFrame) -> DataFrame:
    """ctx with whom its sender lines, which ``lines`` has too, claim, belong to, imitate: all that identity rules need of
    joins."""
    owner = owners(known)
    return (
        ctx.join(claims(lines, known), "msg_id", "left")
        .join(cores.select(F.col("core").alias("sender_core"), "near_id", F.col("mixed").alias("sender_mixed")), "sender_core", "left")
        .join(owner.select(F.col("brand_domain").alias("registrable"), F.col("owner").alias("sender_brand")), "registrable", "left")
        .join(owner.select(F.col("brand_domain").alias("reply_registrable"), F.col("owner").alias("reply_brand")), "reply_registrable", "left")
        .join(same_core(known).withColumnRenamed("core", "sender_core"), "sender_core", "left")
        .join(labelled(lines.select(F.col("sender_domain").alias("host"), "registrable"), known).withColumnRenamed("host", "sender_domain"), "sender_domain", "left")
        .fillna(False, ["sender_mixed"])
    )


def owners(known: DataFrame) -> DataFrame:
    return known.groupBy("brand_domain").agg(F.min("brand_id").alias("owner"))


def judged_cores(cores: DataFrame, known: DataFrame) -> DataFrame:
    """(core, near_id, mixed) of the distinct labels of domains that imitate a brand or mix scripts; labels in punycode are
    judged by what they show."""
    shown = cores.where("core <> ''").distinct().withColumn("plain", text.idn_decoded(F.col("core"))).withColumn("mixed", text.suspicious_mixture(F.col("plain")))
    met = met_targets(shown, known).withColumn("distance", F.expr(FAR)).where("distance IS NOT NULL OR mixed")
    nearest = F.min(F.when(F.col("distance").isNotNull(), F.struct("distance", "brand_id")))
    return met.groupBy("core").agg(nearest["brand_id"].alias("near_id"), F.max("mixed").alias("mixed"))


def sender_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sender lines alone, with what comes of joins; neither bodies nor links are read."""
    ctx, known = sender_context(spark, sf_dir), brands(spark, sf_dir)
    return senders(ctx, ctx, known, judged_cores(ctx.select(F.col("sender_core").alias("core")), known)).withColumn("self_described", F.lit(False))


def parties() -> dict[str, Column]:
    """Flags of a sender against the earlier parties of its thread."""
    prior = F.coalesce("prior_senders", F.array())
    domain = lambda p: F.regexp_replace(F.lower(F.regexp_extract(p["email"], r"@([^@\s<>]+)>?\s*$", 1)), r"\.+$", "")
    core = lambda p: F.regexp_extract(F.regexp_extract(F.lower(p["email"]), r"@([^@\s<>]+)>?\s*$", 1), REGISTRABLE_CORE, 1)
    same = F.exists(prior, lambda p: core(p) == F.col("sender_core"))
    # as in SQL text, so that both engines fold alike
    looks = F.expr(f"exists(coalesce(prior_senders, array()), p -> {SPARK.skeleton(f'regexp_extract(regexp_extract(lower(p.email), {SPARK.literal(PARTY_DOMAIN)}, 1), {SPARK.literal(REGISTRABLE_CORE)}, 1)')} = sender_skeleton AND sender_skeleton <> '')")
    return {
        "name_reused": F.coalesce(F.exists(prior, lambda p: (F.lower(p["name"]) == F.lower("raw_name")) & (F.col("raw_name") != "") & (domain(p) != F.col("sender_domain"))), F.lit(False)),
        # an earlier party's domain but for one or two letters, and no earlier party has the sender's own
        "party_imitated": F.coalesce(F.exists(prior, lambda p: near_names(F.col("sender_core"), core(p))) & ~same, F.lit(False)),
        "party_confused": F.coalesce(looks & ~same, F.lit(False)),
    }


def enriched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Messages and the addresses of their links with everything that comes of joins. Texts are reduced to flags before
    any join; the links meet narrow sender lines, which are read apart, without bodies."""
    lnk, known = link_context(spark, sf_dir), brands(spark, sf_dir)
    ctx = message_context(spark, sf_dir)
    ctx = ctx.select("*", *[F.expr(v).alias(k) for k, v in R.language_flags(SPARK).items()])
    ctx = ctx.select(*[c for c in ctx.columns if c not in TEXTS], *[F.expr(v).alias(k) for k, v in R.text_columns(SPARK).items()])
    ctx = ctx.select("*", *[v.alias(k) for k, v in parties().items()]).drop("prior_senders")
    lines = sender_context(spark, sf_dir)
    cores = judged_cores(lines.select(F.col("sender_core").alias("core")).union(lnk.select("host_core")), known)
    full = senders(ctx, lines, known, cores).join(link_totals(lnk, lines), "msg_id", "left").fillna(0, ["web_links", "unsubscribe_links", "foreign_links", "strange_links"])

    owner = owners(known)
    labels = lnk.select("host").distinct().select("host", F.explode(F.split("host", r"[.-]")).alias("keyword")).join(known, "keyword").groupBy("host").agg(F.min("brand_id").alias("label_brand"))
    anchors = lnk.where("anchor <> ''").select("anchor", "anchor_words").distinct().select("anchor", F.explode(F.split(F.trim("anchor_words"), " ")).alias("keyword")).join(known, "keyword").groupBy("anchor").agg(F.min("brand_id").alias("anchor_brand"))
    whose = lines.select("msg_id", "registrable", "proven", "freemail", "recipient_registrable", "subject_words", "name_words")
    whose = whose.join(claims(whose, known), "msg_id", "left").drop("name_words").join(owner.select(F.col("brand_domain").alias("registrable"), F.col("owner").alias("sender_brand")), "registrable", "left")
    links = (
        lnk.join(owner.select(F.col("brand_domain").alias("host_registrable"), F.col("owner").alias("owner_brand")), "host_registrable", "left")
        .join(owner.select(F.col("brand_domain").alias("shown_registrable"), F.col("owner").alias("shown_brand")), "shown_registrable", "left")
        .join(labels, "host", "left")
        .join(anchors, "anchor", "left")
        .join(cores.select(F.col("core").alias("host_core"), F.col("near_id").alias("host_near"), F.col("mixed").alias("host_mixed")), "host_core", "left")
        .fillna(False, ["host_mixed"])
        .join(whose, "msg_id")
    )
    return full, links


def signals(found: list[R.Rule]) -> Column:
    """The signals of those rules whose condition holds."""
    parts = [f"CASE WHEN {r.when} THEN named_struct('id', '{r.id}', 'category', '{r.category}', 'severity', '{r.severity}', 'score', {r.score}) END" for r in found]
    return F.expr(f"array_compact(array({', '.join(parts)}))")


def wording(ctx: DataFrame) -> DataFrame:
    """Adds ``bulk`` and the themes that survive it."""
    flagged = ctx.withColumn("bulk", F.expr(R.bulk_flag()))
    return flagged.select("*", *[F.expr(v).alias(k) for k, v in R.theme_columns().items()])


def link_findings(links: DataFrame) -> DataFrame:
    """(msg_id, id, category, severity, score, link_index, n): of each rule its first findings of a message in the
    order of the document; n counts from 1."""
    found = R.links(SPARK)
    caps = F.create_map(*[F.lit(x) for k, cap in {r.id: r.cap for r in found}.items() for x in (k, cap)])
    every = links.select("msg_id", "link_index", "url", "hop", F.explode(signals(found)).alias("s")).select("msg_id", "link_index", "url", "hop", "s.*")
    # of the addresses on a link's way the first that a rule objects to
    long = every.groupBy("msg_id", "id", "link_index", "url").agg(F.min(F.struct("hop", "category", "severity", "score")).alias("s")).select("msg_id", "id", "link_index", "url", "s.category", "s.severity", "s.score")
    ranked = long.withColumn("n", F.row_number().over(Window.partitionBy("msg_id", "id").orderBy("link_index", "url")))
    return ranked.where(F.col("n") <= F.element_at(caps, F.col("id"))).drop("url")


def _asked(s: Column) -> Column:
    """A link finding, weightier where the message asks for a sign-in."""
    severity, score = s["severity"], s["score"]
    for id_, (more, points) in R.ASKED.items():
        hit = F.col("asks") & (s["id"] == id_)
        severity, score = F.when(hit, more).otherwise(severity), F.when(hit, points).otherwise(score)
    return F.struct(s["id"].alias("id"), s["category"].alias("category"), severity.alias("severity"), score.cast("int").alias("score"))


def bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per message: its context and ``signals``, correlations included."""
    ctx, links = enriched(spark, sf_dir)
    rows = wording(ctx).select("msg_id", "family", "registrable", "recipient_registrable", "freemail", "disposable", "proven", "claim_id", "claim_domain", "sender_brand", "web_links", "strange_links", "readable", "pretext", "asks", *[signals(part).alias(name) for name, part in (("_a", R.authentication(SPARK)), ("_i", R.identity(SPARK)), ("_f", R.attachments(SPARK)), ("_c", R.content(SPARK)))])
    of_links = link_findings(links).groupBy("msg_id").agg(F.array_sort(F.collect_list(F.struct("id", "category", "severity", "score"))).alias("_l"))
    whole = rows.join(of_links, "msg_id", "left").withColumn("signals", F.concat("_a", "_i", "_f", "_c", F.transform(F.coalesce("_l", F.array().cast(SIGNAL)), _asked))).drop("_a", "_i", "_f", "_c", "_l")

    whole = whole.withColumn("signals", F.col("signals").cast(SIGNAL))

    def has(ids: list[str]) -> Column:
        return F.exists("signals", lambda s: s["id"].isin(ids))

    def finding(id_: str, severity: str, score: int) -> Column:
        return F.struct(F.lit(id_).alias("id"), F.lit(id_.partition(".")[0]).alias("category"), F.lit(severity).alias("severity"), F.lit(score).alias("score"))

    outside = (F.col("freemail") | F.col("disposable")) & (F.col("recipient_registrable") != "") & (F.col("recipient_registrable") != F.col("registrable"))
    correlated = F.array_compact(F.array(
        F.when(has(R.MONEY) & outside, finding("identity.external_financial_request", "high", 30)),
        F.when(has(R.IMPERSONATION) & has(R.CREDENTIAL), finding("identity.impersonation_with_credential_request", "critical", 40)),
        F.when(has(R.DANGEROUS_FILES) & F.col("pretext"), finding("attachment.executable_with_document_pretext", "critical", 40)),
    ))
    return whole.withColumn("signals", F.concat("signals", correlated)).drop("pretext", "asks")


def refined(bag: DataFrame) -> DataFrame:
    """``signals`` softened where the sender is proven to be who it says and nothing technical speaks against it: a
    content finding below high drops one severity and keeps a quarter of its score; a combination that a proven sender
    refutes counts for nothing. A column ``trusted`` (``operators.trust``) softens as a verified identity does, but
    refutes nothing. Adds ``dampened`` to every signal."""
    blocked = F.exists("signals", lambda s: s["category"].isin(list(SCORING.blockers)) & (rank(s["severity"]) >= 2))
    trusted = F.col("trusted") if "trusted" in bag.columns else F.lit(False)
    aligned = F.expr("proven AND NOT freemail AND (claim_domain = registrable OR (sender_brand IS NOT NULL AND claim_id IS NULL)) AND (web_links = 0 OR strange_links = 0)")
    apply = ~blocked & (F.coalesce(aligned, F.lit(False)) | (F.coalesce(trusted, F.lit(False)) & F.col("proven")))

    def softer(s: Column) -> Column:
        level = rank(s["severity"])
        refuted = s["id"].isin(list(SCORING.refutable))
        content = apply & (s["category"] == "content")
        zero = content & refuted & F.coalesce(aligned, F.lit(False))
        drop = content & ~refuted & (level >= 1) & (level <= 2)
        lower = F.when(s["severity"] == "medium", "low").otherwise("info")
        return F.struct(
            s["id"].alias("id"),
            s["category"].alias("category"),
            F.when(zero, "info").when(drop, lower).otherwise(s["severity"]).alias("severity"),
            F.when(zero, 0).when(drop, F.floor(s["score"] * SCORING.softened_factor + 0.5)).otherwise(s["score"]).cast("int").alias("score"),
            (zero | drop).alias("dampened"),
        )

    return bag.withColumn("signals", F.transform("signals", softer))


def _capped(s: Column) -> Column:
    ceiling = F.lit(0)
    for severity, most in SCORING.ceilings.items():
        ceiling = F.when(s["severity"] == severity, most).otherwise(ceiling)
    return F.least(F.greatest(s["score"], F.lit(0)), ceiling)


def classify(score: Column) -> Column:
    out = F.lit(SCORING.bands[-1][1])
    for least, name in reversed(SCORING.bands):
        out = F.when(score >= least, name).otherwise(out)
    return out


def scored(refined_bags: DataFrame) -> DataFrame:
    """msg_id, family, signals, one column per category, total, floor, floor_basis, score, classification. A message whose
    sender or body could not be read (``readable``) has no score, and its class is "not checked"."""

    def category(name: str) -> Column:
        return F.least(F.aggregate(F.filter("signals", lambda s: s["category"] == name), F.lit(0), lambda a, s: a + _capped(s)), F.lit(SCORING.weights[name]))

    readable = F.col("readable") if "readable" in refined_bags.columns else F.lit(True)
    named = refined_bags.select("msg_id", "family", "signals", readable.alias("_readable"), *[category(c).cast("long").alias(f"{c}_score") for c in CATEGORIES])
    eligible = F.filter("signals", lambda s: ~s["category"].isin(list(SCORING.floor_excluded_categories)) & ~s["id"].isin(list(SCORING.floor_excluded_ids)) & (s["score"] > 0))
    single = F.coalesce(F.array_max(F.transform(eligible, lambda s: F.when(s["severity"] == "critical", SCORING.floors["critical"]).when(s["severity"] == "high", SCORING.floors["high"]).otherwise(0))), F.lit(0))
    severe = F.size(F.array_distinct(F.transform(F.filter(eligible, lambda s: s["severity"].isin("high", "critical") & ~s["dampened"]), lambda s: s["category"])))
    together = F.when(severe >= SCORING.convergence_categories, SCORING.convergence_floor).otherwise(0)
    total = F.least(sum((F.col(f"{c}_score") for c in CATEGORIES[1:]), F.col(f"{CATEGORIES[0]}_score")), F.lit(100))
    return (
        named.withColumn("total", total)
        .withColumn("_single", single)
        .withColumn("floor", F.greatest("_single", together).cast("long"))
        .withColumn("floor_basis", F.when(F.col("floor") == 0, "none").when(F.col("floor") > F.col("_single"), "convergence").otherwise("finding"))
        .withColumn("score", F.greatest("total", "floor"))
        .withColumn("classification", F.when(F.col("_readable"), classify(F.col("score"))).otherwise("not checked"))
        .withColumn("score", F.when(F.col("_readable"), F.col("score")))
        .drop("_single", "_readable")
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(refined(bags(spark, sf_dir)))


def long_signals(df: DataFrame) -> DataFrame:
    return df.select("msg_id", "family", F.explode("signals").alias("s")).select("msg_id", "family", "s.*")


# ---- the same in SQL, for the checking engine


def signals_sql(q: Dialect = DUCK) -> str:
    """Common table expressions up to ``sig`` (msg_id, id, category, severity, score, dampened) and ``scored``."""
    unsub = q.match("lower(anchor)", "unsubscribe|abbestellen|désabonner|darse de baja|manage|uitschrijven")
    domain = "regexp_replace(lower(regexp_extract(p.email, '@([^@\\s<>]+)>?\\s*$', 1)), '\\.+$', '', 'g')"
    flags = ", ".join(f"{v} AS {k}" for k, v in R.language_flags(q).items())
    texts = ", ".join(f"{v} AS {k}" for k, v in R.text_columns(q).items())
    themes = ", ".join(f"{v} AS {k}" for k, v in R.theme_columns().items())
    asked = lambda k, own: f"CASE {' '.join(f'WHEN asks AND id = {i!r} THEN {v[k]!r}' for i, v in R.ASKED.items())} ELSE {own} END"

    def cases(found: list[R.Rule]) -> str:
        return ", ".join(f"CASE WHEN {r.when} THEN {{'id': '{r.id}', 'category': '{r.category}', 'severity': '{r.severity}', 'score': {r.score}}} END" for r in found)

    links = R.links(q)
    caps = " ".join(f"WHEN '{r.id}' THEN {r.cap}" for r in {r.id: r for r in links}.values())
    ids = lambda xs: ", ".join(f"'{x}'" for x in xs)
    level = "CASE severity " + " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(SEVERITIES)) + " END"
    ceiling = "CASE severity " + " ".join(f"WHEN '{s}' THEN {n}" for s, n in SCORING.ceilings.items()) + " END"
    sums = ", ".join(f"least(coalesce(sum(capped) FILTER (WHERE category = '{c}'), 0), {SCORING.weights[c]})::BIGINT AS {c}_score" for c in CATEGORIES)
    eligible = f"category NOT IN ({ids(SCORING.floor_excluded_categories)}) AND id NOT IN ({ids(SCORING.floor_excluded_ids)}) AND score > 0"
    bands = "CASE " + " ".join(f"WHEN score >= {n} THEN '{c}'" for n, c in SCORING.bands) + " END"
    return f"""WITH {context_sql(q)}, {brands_sql(q)},
own AS (SELECT brand_domain, min(brand_id) AS owner FROM brand GROUP BY 1),
tot AS (SELECT l.msg_id, count_if(web AND hop = 0) AS web_links, count_if(web AND hop = 0 AND {unsub}) AS unsubscribe_links, count_if(web AND host_registrable <> registrable) AS foreign_links, count_if(web AND NOT tracker AND host_registrable <> registrable) AS strange_links FROM lnk l JOIN (SELECT msg_id, registrable FROM ctx) USING (msg_id) GROUP BY 1),
prior AS (SELECT msg_id, unnest(prior_senders) AS p FROM ctx),
reuse AS (SELECT DISTINCT c.msg_id FROM ctx c JOIN prior USING (msg_id) WHERE raw_name <> '' AND lower(p.name) = lower(raw_name) AND {domain} <> sender_domain),
conf AS (SELECT DISTINCT c.msg_id FROM ctx c JOIN prior USING (msg_id) WHERE sender_skeleton <> '' AND {q.skeleton("regexp_extract(regexp_extract(lower(p.email), '@([^@\\s<>]+)>?\\s*$', 1), '([^.]+)\\.[^.]+$', 1)")} = sender_skeleton),
plainp AS (SELECT c.msg_id, regexp_replace(sender_core, '[^\\x00-\\x7F]', '?', 'g') AS s, sender_core, regexp_extract(regexp_extract(lower(p.email), '@([^@\\s<>]+)>?\\s*$', 1), '([^.]+)\\.[^.]+$', 1) AS pc FROM ctx c JOIN prior USING (msg_id)),
party AS (SELECT msg_id FROM plainp GROUP BY 1 HAVING bool_or(length(s) >= 5 AND length(pc) >= 5 AND (levenshtein(s, pc) = 1 OR (levenshtein(s, pc) = 2 AND length(s) >= 8 AND length(pc) >= 8))) AND NOT bool_or(pc = sender_core)),
same AS (SELECT target, min(brand_id) AS core_brand FROM brand GROUP BY 1),
slab AS (SELECT host, min(brand_id) AS label_brand FROM (SELECT DISTINCT sender_domain AS host, unnest(string_split(substring(sender_domain, 1, greatest(length(sender_domain) - length(registrable) - 1, 0)), '.')) AS label FROM ctx WHERE registrable <> '') JOIN brand ON label = target GROUP BY 1),
known_party AS (SELECT msg_id FROM plainp GROUP BY 1 HAVING bool_or(pc = sender_core)),
lang AS (SELECT *, {flags} FROM ctx), texted AS (SELECT *, {texts} FROM lang),
base AS (SELECT ctx.*, core_brand, label_brand, false AS sender_mixed, rep.owner AS reply_brand, party.msg_id IS NOT NULL AS party_imitated, conf.msg_id IS NOT NULL AND known_party.msg_id IS NULL AS party_confused, claim_id, claim_domain, near_id, own.owner AS sender_brand, coalesce(web_links, 0) AS web_links, coalesce(unsubscribe_links, 0) AS unsubscribe_links, coalesce(foreign_links, 0) AS foreign_links, coalesce(strange_links, 0) AS strange_links, reuse.msg_id IS NOT NULL AS name_reused FROM texted ctx LEFT JOIN claim USING (msg_id) LEFT JOIN near ON sender_core = core LEFT JOIN own ON registrable = own.brand_domain LEFT JOIN own rep ON reply_registrable = rep.brand_domain LEFT JOIN conf USING (msg_id) LEFT JOIN known_party USING (msg_id) LEFT JOIN tot USING (msg_id) LEFT JOIN reuse USING (msg_id) LEFT JOIN party USING (msg_id) LEFT JOIN same ON sender_core = same.target LEFT JOIN slab ON sender_domain = slab.host),
flagged AS (SELECT *, {R.bulk_flag()} AS bulk FROM base),
themed AS (SELECT *, {themes} FROM flagged),
msig AS (SELECT msg_id, unnest([{cases(R.message_rules(q))}]) AS s FROM themed),
lab AS (SELECT host, min(brand_id) AS label_brand FROM (SELECT DISTINCT host, unnest(regexp_split_to_array(host, '[.-]')) AS keyword FROM lnk) JOIN brand USING (keyword) GROUP BY 1),
anc AS (SELECT anchor, min(brand_id) AS anchor_brand FROM (SELECT DISTINCT anchor, unnest(string_split(trim(anchor_words), ' ')) AS keyword FROM lnk) JOIN brand USING (keyword) GROUP BY 1),
lfull AS (SELECT lnk.*, o.owner AS owner_brand, o2.owner AS shown_brand, lab.label_brand, anchor_brand, n.near_id AS host_near, false AS host_mixed, b.registrable, b.proven, b.freemail, b.recipient_registrable, b.subject_words, b.sender_brand, b.claim_id, b.claim_domain FROM lnk JOIN base b USING (msg_id) LEFT JOIN own o ON lnk.host_registrable = o.brand_domain LEFT JOIN own o2 ON lnk.shown_registrable = o2.brand_domain LEFT JOIN lab ON lnk.host = lab.host LEFT JOIN anc ON lnk.anchor = anc.anchor LEFT JOIN near n ON lnk.host_core = n.core),
lsig AS (SELECT msg_id, link_index, url, hop, unnest([{cases(links)}]) AS s FROM lfull),
ldist AS (SELECT * FROM lsig WHERE s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY msg_id, s.id, link_index, url ORDER BY hop, s.severity, s.score) = 1),
lrank AS (SELECT *, row_number() OVER (PARTITION BY msg_id, s.id ORDER BY link_index, url) AS n FROM ldist),
lfound AS (SELECT msg_id, link_index, s.id AS id, s.category AS category, s.severity AS severity, s.score AS score, n FROM lrank WHERE n <= CASE s.id {caps} END),
raw AS (SELECT msg_id, s.id AS id, s.category AS category, s.severity AS severity, s.score AS score FROM msig WHERE s IS NOT NULL UNION ALL SELECT msg_id, id, category, {asked(0, 'severity')}, {asked(1, 'score')} FROM lfound JOIN (SELECT msg_id, asks FROM base) USING (msg_id)),
cor AS (SELECT msg_id, bool_or(id IN ({ids(R.MONEY)})) AS money, bool_or(id IN ({ids(R.IMPERSONATION)})) AS posed, bool_or(id IN ({ids(R.CREDENTIAL)})) AS cred, bool_or(id IN ({ids(R.DANGEROUS_FILES)})) AS files FROM raw GROUP BY 1),
extra AS (SELECT msg_id, 'identity.external_financial_request' AS id, 'identity' AS category, 'high' AS severity, 30 AS score FROM cor JOIN base USING (msg_id) WHERE money AND (freemail OR disposable) AND recipient_registrable <> '' AND recipient_registrable <> registrable
 UNION ALL SELECT msg_id, 'identity.impersonation_with_credential_request', 'identity', 'critical', 40 FROM cor WHERE posed AND cred
 UNION ALL SELECT msg_id, 'attachment.executable_with_document_pretext', 'attachment', 'critical', 40 FROM cor JOIN base USING (msg_id) WHERE files AND pretext),
bag AS (SELECT * FROM raw UNION ALL SELECT * FROM extra),
gate AS (SELECT b.msg_id, family, readable, coalesce(proven AND NOT freemail AND (claim_domain = registrable OR (sender_brand IS NOT NULL AND claim_id IS NULL)) AND (web_links = 0 OR strange_links = 0), false) AND NOT coalesce(x.blocked, false) AS soft FROM base b LEFT JOIN (SELECT msg_id, bool_or(category IN ({ids(SCORING.blockers)}) AND {level} >= 2) AS blocked FROM bag GROUP BY 1) x USING (msg_id)),
sig AS (SELECT msg_id, family, id, category, CASE WHEN zero THEN 'info' WHEN low THEN CASE severity WHEN 'medium' THEN 'low' ELSE 'info' END ELSE severity END AS severity, (CASE WHEN zero THEN 0 WHEN low THEN floor(score * {SCORING.softened_factor} + 0.5) ELSE score END)::INTEGER AS score, zero OR low AS dampened FROM (SELECT *, soft AND category = 'content' AND id IN ({ids(SCORING.refutable)}) AS zero, soft AND category = 'content' AND id NOT IN ({ids(SCORING.refutable)}) AND {level} BETWEEN 1 AND 2 AS low FROM bag JOIN gate USING (msg_id))),
summed AS (SELECT msg_id, {sums}, coalesce(max(CASE severity WHEN 'critical' THEN {SCORING.floors['critical']} WHEN 'high' THEN {SCORING.floors['high']} ELSE 0 END) FILTER (WHERE {eligible}), 0) AS single, count(DISTINCT category) FILTER (WHERE {eligible} AND severity IN ('high', 'critical') AND NOT dampened) AS severe FROM (SELECT *, least(greatest(score, 0), {ceiling}) AS capped FROM sig) GROUP BY 1),
filled AS (SELECT g.msg_id, g.family, g.readable, {', '.join(f'coalesce({c}_score, 0) AS {c}_score' for c in CATEGORIES)}, coalesce(single, 0) AS single, CASE WHEN coalesce(severe, 0) >= {SCORING.convergence_categories} THEN {SCORING.convergence_floor} ELSE 0 END AS together FROM gate g LEFT JOIN summed USING (msg_id)),
scored AS (SELECT * REPLACE (CASE WHEN readable THEN score END AS score), CASE WHEN readable THEN {bands} ELSE 'not checked' END AS classification FROM (SELECT *, greatest(total, floor) AS score, CASE WHEN floor = 0 THEN 'none' WHEN floor > single THEN 'convergence' ELSE 'finding' END AS floor_basis FROM (SELECT *, least({' + '.join(f'{c}_score' for c in CATEGORIES)}, 100)::BIGINT AS total, greatest(single, together)::BIGINT AS floor FROM filled)))"""
