"""The engine's queries over the mail tables, and the SQL that checks them where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import BOUNDS, CATEGORIES
from .dialect import DUCK, HOST, SPARK
from .functions import html, text, url
from .operators import report, rules, scoring, semantic, triage, trust
from .operators.brands import brands, claims, near_targets
from .plans.context import delivered_once, distinct_links, link_context, message_context, scan, sender_context
from .refdata import FREEMAIL, OPEN_HOSTING, PRIVATE_TLDS
from .sources import mail
from .streaming import events
from .suffixes import delegated

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | Callable[[], str] | None = None):
    """Registers a query under its name; sql is the equivalent statement, or one that makes it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql if isinstance(sql, str) else sql()
        return f

    return add


def _whole(select: str) -> str:
    return f"{scoring.signals_sql(DUCK)} {select}"


def _values(names: list[str]) -> str:
    return ", ".join(f"('{n}')" for n in names)


def _dimension(spark: SparkSession, column: str, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], f"{column} string")


_once = "(SELECT * FROM messages WHERE msg_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY received_at) = 1)"
_ctx = f"WITH {scoring.context_sql(DUCK)}"
_brands = f"{_ctx}, {scoring.brands_sql(DUCK)}"

# ---- scores


@query(lambda: _whole(f"SELECT msg_id, family, {', '.join(f'{c}_score' for c in CATEGORIES)}, total, floor, floor_basis, score, classification FROM scored"))
def message_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scores(spark, sf_dir).select("msg_id", "family", *[f"{c}_score" for c in CATEGORIES], "total", "floor", "floor_basis", "score", "classification")


@query(lambda: _whole("SELECT family, classification, count(*) AS messages FROM scored GROUP BY ALL"))
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_class(scoring.scores(spark, sf_dir))


@query(lambda: _whole("SELECT family, floor_basis, floor, count(*) AS messages FROM scored GROUP BY ALL"))
def score_floor_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_floor(scoring.scores(spark, sf_dir))


@query(lambda: _whole(" UNION ALL ".join(f"SELECT '{c}' AS category, sum({c}_score)::BIGINT AS points, count_if({c}_score > 0)::BIGINT AS messages FROM scored" for c in CATEGORIES)))
def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = scoring.scores(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"{c}_score").alias("s")) for c in CATEGORIES])).alias("x")).select("x.*")
    return long.groupBy("category").agg(F.sum("s").alias("points"), F.count_if(F.col("s") > 0).alias("messages"))


@query(lambda: _whole("SELECT family, count(*) AS scored, count_if(classification <> 'low')::BIGINT AS flagged, round(100.0 * count_if(classification <> 'low') / greatest(count(*), 1), 4)::DOUBLE AS share FROM scored GROUP BY family"))
def flagged_share_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.flagged_share(scoring.scores(spark, sf_dir))


@query(lambda: _whole("SELECT family, classification, count(*) AS messages, sum(score)::BIGINT AS points FROM scored GROUP BY ROLLUP (family, classification)"))
def score_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.rollup(scoring.scores(spark, sf_dir))


@query(lambda: _whole("SELECT family, id, severity, count(DISTINCT msg_id) AS messages FROM sig GROUP BY ALL"))
def signals_by_rule_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_rule(scoring.long_signals(scoring.refined(scoring.bags(spark, sf_dir))))


@query(lambda: _whole("SELECT * FROM (SELECT family, id, messages, row_number() OVER (PARTITION BY family ORDER BY messages DESC, id) AS place FROM (SELECT family, id, count(DISTINCT msg_id) AS messages FROM sig GROUP BY ALL)) WHERE place <= 30"))
def top_rules_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_rules(scoring.long_signals(scoring.refined(scoring.bags(spark, sf_dir))))


@query(lambda: _whole("SELECT msg_id, id, severity, score, times, row_number() OVER (PARTITION BY msg_id ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, score DESC, id)::INTEGER AS place FROM (SELECT msg_id, id, severity, score, count(*) AS times FROM sig GROUP BY ALL)"))
def display_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.displayed(scoring.long_signals(scoring.refined(scoring.bags(spark, sf_dir))))


@query(lambda: _whole("SELECT family, id, count(*) AS softened FROM sig WHERE dampened GROUP BY ALL"))
def dampening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.long_signals(scoring.refined(scoring.bags(spark, sf_dir))).where("dampened").groupBy("family", "id").agg(F.count("*").alias("softened"))


@query(lambda: _whole("SELECT msg_id, id, severity, score FROM extra"))
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = ["identity.external_financial_request", "identity.impersonation_with_credential_request", "attachment.executable_with_document_pretext"]
    return scoring.long_signals(scoring.bags(spark, sf_dir)).where(F.col("id").isin(ids)).select("msg_id", "id", "severity", "score")


@query(lambda: _whole(f"SELECT msg_id, severity, id, score::BIGINT AS score FROM bag WHERE id IN ({', '.join(repr(t) for t in rules.TRIAGE)}) AND severity IN ('high', 'critical') QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY CASE severity WHEN 'critical' THEN 0 ELSE 1 END, score DESC, id) = 1"))
def triage_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.of_senders(spark, sf_dir)


@query(lambda: _whole("SELECT msg_id, id, severity, score, link_index, n FROM lfound"))
def top3_links_per_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.link_findings(scoring.enriched(spark, sf_dir)[1]).select("msg_id", "id", "severity", "score", "link_index", F.col("n").cast("long").alias("n"))


# ---- wording


@query(lambda: _whole(f"SELECT theme, family, count(*) AS messages FROM (UNPIVOT (SELECT family, {', '.join(f't_{t}' for t in rules.THEMES)} FROM themed) ON {', '.join(f't_{t}' for t in rules.THEMES)} INTO NAME theme VALUE hit) WHERE hit GROUP BY ALL"))
def theme_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.wording(scoring.enriched(spark, sf_dir)[0])
    hit = F.array_compact(F.array(*[F.when(F.col(f"t_{t}"), f"t_{t}") for t in rules.THEMES]))
    return rows.select("family", F.explode(hit).alias("theme")).groupBy("theme", "family").agg(F.count("*").alias("messages"))


@query(lambda: _whole("SELECT msg_id, id FROM bag WHERE id LIKE 'content.combo.%'"))
def theme_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relational division in the row: combinations all of whose themes a message has."""
    rows = scoring.wording(scoring.enriched(spark, sf_dir)[0]).select("msg_id", F.array_compact(F.array(*[F.when(F.col(f"t_{t}"), t) for t in rules.THEMES])).alias("themes"))
    found = F.array_compact(F.array(*[F.when(F.size(F.array_except(F.array(*map(F.lit, needs)), "themes")) == 0, f"content.combo.{k}") for k, (needs, _, _) in rules.COMBINATIONS.items()]))
    return rows.select("msg_id", F.explode(found).alias("id"))


@query(lambda: _whole("SELECT family, bulk, count(*) AS messages, sum(web_links)::BIGINT AS links FROM flagged GROUP BY ALL"))
def bulk_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.wording(scoring.enriched(spark, sf_dir)[0]).groupBy("family", "bulk").agg(F.count("*").alias("messages"), F.sum("web_links").alias("links"))


@query(lambda: _whole("SELECT msg_id, " + ", ".join(rules.language_flags(DUCK)) + " FROM flagged"))
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dialect import SPARK

    return message_context(spark, sf_dir).select("msg_id", *[F.expr(v).alias(k) for k, v in rules.language_flags(SPARK).items()])


# ---- messages, senders, authentication, attachments


@query(_ctx + " SELECT spf, dkim, dmarc, proven, count(*) AS messages FROM ctx GROUP BY ALL")
def auth_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return message_context(spark, sf_dir).groupBy("spf", "dkim", "dmarc", "proven").agg(F.count("*").alias("messages"))


@query(f"{_ctx}, entry AS (SELECT DISTINCT regexp_extract(lower(email), '@(.*)$', 1) AS e FROM known_senders) SELECT CASE WHEN e IS NOT NULL AND proven THEN 'trusted' WHEN e IS NOT NULL THEN 'unproven' ELSE 'none' END AS state, count(*) AS messages FROM ctx LEFT JOIN entry ON e = CASE WHEN registrable = '' OR disposable THEN NULL WHEN freemail THEN lower(raw_email) ELSE registrable END GROUP BY 1")
def sender_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by trust, with the protected identities' domains as the list of trusted senders."""
    listed = scan(spark, sf_dir, "known_senders").select(F.regexp_extract(F.lower("email"), "@(.*)$", 1))
    rows = trust.with_trust(message_context(spark, sf_dir), listed)
    return rows.groupBy(trust.state(F.col("trusted"), F.col("proven")).alias("state")).agg(F.count("*").alias("messages"))


@query(lambda: _whole("SELECT id, severity, count(*) AS messages FROM bag WHERE category = 'attachment' GROUP BY ALL"))
def attachment_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.long_signals(scoring.bags(spark, sf_dir)).where("category = 'attachment'").groupBy("id", "severity").agg(F.count("*").alias("messages"))


@query(f"{_ctx} SELECT msg_id, registrable FROM ctx WHERE registrable IN ({', '.join(repr(f) for f in FREEMAIL)})")
def sender_freemail_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return message_context(spark, sf_dir).select("msg_id", "registrable").join(_dimension(spark, "registrable", FREEMAIL), "registrable", "left_semi").select("msg_id", "registrable")


@query(f"{_ctx} SELECT tld, count(*) AS messages FROM (SELECT regexp_extract(sender_domain, '([^.]+)$', 1) AS tld FROM ctx WHERE sender_domain <> '') WHERE NOT {DUCK.delegated('tld')} GROUP BY tld")
def unknown_tld_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    tlds = message_context(spark, sf_dir).where("sender_domain <> ''").select(F.regexp_extract("sender_domain", r"([^.]+)$", 1).alias("tld")).groupBy("tld").agg(F.count("*").alias("messages"))
    return tlds.join(_dimension(spark, "tld", list(delegated())), "tld", "left_anti").where("NOT startswith(tld, 'xn--')")


@query(_brands + " SELECT msg_id, claim_id, claim_domain FROM claim")
def brand_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(message_context(spark, sf_dir), brands(spark, sf_dir))


@query(_brands + " SELECT DISTINCT core, target, distance FROM close")
def lookalike_theta_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All near pairs of domain cores and protected names, by what they look like and by segments that edits leave intact."""
    cores = sender_context(spark, sf_dir).select(F.col("sender_core").alias("core")).union(link_context(spark, sf_dir).select("host_core"))
    return near_targets(cores.distinct(), brands(spark, sf_dir)).select("core", "target", "distance").distinct()


@query(f"SELECT msg_id, pos::INTEGER AS place, p.email AS email, p.name AS name FROM (SELECT msg_id, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS pos FROM (SELECT msg_id, thread.prior_senders[1:{BOUNDS.parties}] AS ps FROM {_once}))")
def thread_prior_senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = delivered_once(scan(spark, sf_dir, "messages"), "thread")
    return once.select("msg_id", F.posexplode(F.slice("thread.prior_senders", 1, BOUNDS.parties)).alias("place", "p")).select("msg_id", "place", "p.email", "p.name")


@query(f"SELECT recipient_email, arg_max(msg_id, (sent_at, msg_id)) AS msg_id, count(*) AS readable FROM {_once} WHERE recipient_email IS NOT NULL AND sent_at IS NOT NULL AND sender_email IS NOT NULL AND coalesce(body_text, '') <> '' GROUP BY recipient_email")
def last_readable_per_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last readable message of each mailbox: map-side maximum, no window over a hot recipient."""
    once = delivered_once(scan(spark, sf_dir, "messages"), "recipient_email", "sender_email", "body_text", "sent_at")
    readable = once.where("recipient_email IS NOT NULL AND sent_at IS NOT NULL AND sender_email IS NOT NULL AND coalesce(body_text, '') <> ''")
    return readable.groupBy("recipient_email").agg(F.max_by("msg_id", F.struct("sent_at", "msg_id")).alias("msg_id"), F.count("*").alias("readable"))


@query(f"{_ctx} SELECT lower(raw_name) AS name, count(DISTINCT registrable) AS domains, count(*) AS messages FROM ctx WHERE raw_name <> '' GROUP BY 1 HAVING count(DISTINCT registrable) > 1")
def name_reuse_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that more than one domain uses, by aggregation instead of a self-join."""
    named = message_context(spark, sf_dir).where("raw_name <> ''").groupBy(F.lower("raw_name").alias("name"), "registrable").agg(F.count("*").alias("n"))
    return named.groupBy("name").agg(F.count("*").alias("domains"), F.sum("n").alias("messages")).where("domains > 1")


@query(f"SELECT count(*) AS messages, count_if(sender_email IS NULL)::BIGINT AS no_sender_email, count_if(subject IS NULL)::BIGINT AS no_subject, count_if(body_text IS NULL)::BIGINT AS no_body_text, count_if(auth IS NULL)::BIGINT AS no_auth FROM {_once}")
def extraction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = delivered_once(scan(spark, sf_dir, "messages"), "sender_email", "subject", "body_text", "auth")
    return mail.extraction_quality(once, "sender_email", "subject", "body_text", "auth").withColumnRenamed("rows", "messages")


@query(f"SELECT msg_id, regexp_replace(coalesce(body_text, ''), '[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+)', '<address@\\1>', 'g') AS redacted FROM {_once}")
def redact_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivered_once(scan(spark, sf_dir, "messages"), "body_text").select("msg_id", text.redacted_addresses(F.coalesce("body_text", F.lit(""))).alias("redacted"))


# ---- links


@query(_ctx + " SELECT msg_id, link_index, url, scheme, host, host_registrable, path, query, subdomain_labels::INTEGER AS subdomain_labels, tracker, open_hosting FROM lnk WHERE hop = 0")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_context(spark, sf_dir).where("hop = 0").select("msg_id", "link_index", "url", "scheme", "host", "host_registrable", "path", "query", "subdomain_labels", "tracker", "open_hosting")


@query(_ctx + " SELECT host_registrable, count(*) AS links, count(DISTINCT host) AS hosts, count(DISTINCT msg_id) AS messages FROM lnk GROUP BY 1")
def registrable_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_context(spark, sf_dir).groupBy("host_registrable").agg(F.count("*").alias("links"), F.count_distinct("host").alias("hosts"), F.count_distinct("msg_id").alias("messages"))


@query(_ctx + f", suf AS (SELECT * FROM (VALUES {_values([*OPEN_HOSTING, *PRIVATE_TLDS])}) AS t(suffix)) SELECT DISTINCT host, suffix FROM lnk JOIN suf ON host = suffix OR host LIKE '%.' || suffix")
def suffix_match_open_hosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts below listed suffixes, of open hosting or reserved: every suffix of a host is a key of an equi-join."""
    hosts = link_context(spark, sf_dir).select("host").distinct()
    return hosts.select("host", F.explode(url.suffixes(F.col("host"))).alias("suffix")).join(_dimension(spark, "suffix", [*OPEN_HOSTING, *PRIVATE_TLDS]), "suffix").select("host", "suffix")


@query(f"SELECT msg_id, count(*) AS links, count(DISTINCT href) AS targets, count_if(text IS NULL)::BIGINT AS silent, count_if(normalized_domain IS DISTINCT FROM regexp_replace(lower(regexp_extract(href, '{HOST}', 1)), '^www\\.|\\.+$', '', 'g'))::BIGINT AS disagree FROM (SELECT DISTINCT * FROM message_links) WHERE msg_id IS NOT NULL GROUP BY msg_id")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links per message, and how many give another domain than their address has."""
    links = distinct_links(scan(spark, sf_dir, "message_links"))
    return links.groupBy("msg_id").agg(F.count("*").alias("links"), F.count_distinct("href").alias("targets"), F.count_if(F.col("text").isNull()).alias("silent"), F.count_if(~F.col("normalized_domain").eqNullSafe(url.host("href"))).alias("disagree"))


#: Wrapped forms of an address as SQL, and how many redirects each has.
WRAPPED = {
    "plain": ("href", 0),
    "parameter": ("'https://go.hopper.test/r?id=7&url=' || url_encode(href)", 1),
    "listed_first": ("'https://go.hopper.test/r?link=https%3A%2F%2Fother.test%2F&u=' || url_encode(href)", 1),
    "twice": ("'https://go.hopper.test/r?next=' || url_encode('https://two.hopper.test/?dest=' || url_encode(href))", 2),
    "path": ("'https://t.hopper.test/L0/' || href", 1),
    "base64": ("'https://t.hopper.test/c/' || regexp_replace(replace(replace(base64(CAST(href AS {blob})), '+', '-'), '/', '_'), '[^A-Za-z0-9_-]', '') || '/x'", 1),
    "withheld": ("'https://go.hopper.test/r?redirect=https%3A%2F%2F'", 0),
}
_forms = " UNION ALL ".join(f"SELECT '{k}' AS form, href, {hops} AS hops, {repr(k == 'withheld').lower()} AS opaque, CASE WHEN '{k}' = 'withheld' THEN {made} ELSE href END AS destination FROM plain" for k, (made, hops) in WRAPPED.items() if "{blob}" not in made)
_forms += " UNION ALL SELECT 'base64', href, 1, false, href FROM plain"


@query(f"WITH plain AS (SELECT DISTINCT href FROM message_links WHERE regexp_matches(href, '^https?://[!-~]+$')) {_forms}")
def redirect_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every web address as it stands and wrapped in redirects of each kind, peeled again: the address itself comes out."""
    hrefs = scan(spark, sf_dir, "message_links").where(F.col("href").rlike("^https?://[!-~]+$")).select("href").distinct()
    made = F.explode(F.array(*[F.struct(F.lit(k).alias("form"), F.expr(v.format(blob="BINARY")).alias("made")) for k, (v, _) in WRAPPED.items()]))
    return url.unwrapped(hrefs.select("href", made.alias("f")).select("href", "f.*"), "made").select("form", "href", "hops", "opaque", "destination")


# ---- text forms


@query()
def skeleton_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = message_context(spark, sf_dir).where("raw_name <> ''").select("raw_name").distinct()
    return names.select("raw_name", text.skeleton(F.col("raw_name")).alias("skeleton"), text.folded(F.col("raw_name")).alias("folded"), text.normalized(F.col("raw_name")).alias("normalized"), F.array_join(text.scripts_used(F.col("raw_name")), ",").alias("scripts"), text.suspicious_mixture(F.col("raw_name")).alias("mixed"))


@query()
def osa_lookalike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near pairs with swaps counted once: the segment join proposes, the alignment distance decides."""
    pairs = lookalike_theta_levenshtein(spark, sf_dir)
    return pairs.withColumn("osa", text.osa_distance(F.expr(SPARK.skeleton("core")), F.expr(SPARK.skeleton("target")))).where("osa <= 2")


@query()
def negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for a code that are not denied: the pattern gates the function, so few rows reach it."""
    pattern = r"\b(?:ask you for|send|share|tell|enter)\b[^.!?]{0,40}\bcode\b"
    bodies = delivered_once(scan(spark, sf_dir, "messages"), "name", "body_text").where(F.col("body_text").rlike(f"(?i){pattern}"))
    return bodies.select("msg_id", "name", text.unnegated(F.col("body_text"), pattern).alias("request"))


@query()
def hidden_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = scan(spark, sf_dir, "parsed_messages").select("parsed_id", F.posexplode("html").alias("part_no", "page"))
    return pages.select("parsed_id", "part_no", html.page(F.col("page")).alias("p")).select("parsed_id", "part_no", F.length("p.body").alias("chars"), "p.hidden_chars", F.array_join("p.techniques", ",").alias("techniques"), F.size("p.links").alias("links"))


@query()
def mime_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages written out as multipart RFC 822 messages of all their parsed parts, and read again by the source's parser."""
    raw = mail.written(F.col("headers"), F.col("text"), F.col("html"), F.col("attachments"))
    rows = scan(spark, sf_dir, "parsed_messages").select("parsed_id", mail.parsed(raw).alias("m"))
    return rows.select("parsed_id", "m.sender_name", "m.sender_email", F.length("m.body_text").alias("chars"), F.size("m.links").alias("links"), F.size("m.attachments").alias("attachments"), "m.sent_at")


# ---- model stage


@query()
def semantic_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with the readings of corroborated messages, each distinct prompt once, and what they add."""
    once = delivered_once(scan(spark, sf_dir, "messages"), "sender_name", "subject", "body_text")
    prompts = once.select("msg_id", semantic.prompt(F.col("sender_name"), F.col("subject"), F.col("body_text")).alias("prompt"))
    scored = scoring.scored(semantic.with_readings(scoring.refined(scoring.bags(spark, sf_dir)), prompts))
    return scored.where(F.exists("signals", lambda s: s["category"] == "llm")).select("msg_id", "llm_score", "score", "classification")


@query(f"SELECT count(*) AS prompts, count(DISTINCT concat(coalesce(sender_name, ''), '|', coalesce(subject, ''), '|', coalesce(body_text, ''))) AS distinct_prompts FROM {_once}")
def reading_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many readings the cache saves: two-level count, so equal prompts meet once."""
    once = delivered_once(scan(spark, sf_dir, "messages"), "sender_name", "subject", "body_text")
    key = F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("sender_name", "subject", "body_text")]), 256)
    return once.groupBy(key.alias("k")).agg(F.count("*").alias("n")).agg(F.sum("n").alias("prompts"), F.count("*").alias("distinct_prompts"))


@query()
def cloud_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = delivered_once(scan(spark, sf_dir, "messages"), "sender_name", "sender_email", "reply_to", "subject", "body_text", "attachments")
    sender, reply = (F.coalesce(F.expr(SPARK.domain(c)), F.lit("")) for c in ("sender_email", "reply_to"))
    domains = link_context(spark, sf_dir).groupBy("msg_id").agg(F.array_sort(F.collect_set("host_registrable")).alias("domains"))
    bag = scoring.bags(spark, sf_dir).select("msg_id", "registrable", F.transform("signals", lambda s: s["id"]).alias("ids"))
    rows = once.join(bag, "msg_id").join(domains, "msg_id", "left")
    made = semantic.payload(
        F.col("subject"), F.col("body_text"), F.col("sender_name"), F.col("registrable"), F.when((reply != "") & (reply != sender), reply),
        F.coalesce("domains", F.array().cast("array<string>")), semantic.extensions(F.col("attachments")), F.col("ids"),
    )
    return rows.select("msg_id", F.to_json(made).alias("payload"))


# ---- streams


@query("SELECT count(*) AS rows, count(DISTINCT event_id) AS events FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through the deduplicating stream; what comes out is counted."""
    out = events.drained(events.deduplicated(events.stored(spark, sf_dir, "events"), ["event_id"], "ts", "3650 days"))
    return out.agg(F.count("*").alias("rows"), F.count_distinct("event_id").alias("events"))


@query()
def stream_session_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.drained_to_the_end(events.stored(spark, sf_dir, "events"), "ts", lambda s: events.debounced(s, "user_id", "ts", "event_type", "30 minutes"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS began, event_type, count(*) AS events FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.drained_to_the_end(events.stored(spark, sf_dir, "events"), "ts", lambda s: events.windowed(s, "event_type", "ts", "1 day"))


@query("SELECT user_id, event_type, 'changed' AS change FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest state, emitted once per change; the stored table is one batch, so one change a user."""
    stream = events.stored(spark, sf_dir, "events").withColumn("place", F.concat(F.date_format("ts", "yyyyMMddHHmmss.SSSSSS"), F.lpad(F.col("event_id").cast("string"), 20, "0")))
    return events.drained(events.changes(stream.select("user_id", "event_type", "place"), "user_id", "event_type", "place"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
