"""From delivered messages and their links to the wide rows that the rules read.

``message_context`` and ``link_context`` are single projections over a scan, but for the aggregation that makes one row
of a redelivered message and the equi-joins against the table of identities. Expressions come from a ``Dialect``, so the
checking engine computes the same columns from the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BOUNDS
from ..dialect import SPARK, UNSEEN, Dialect
from ..functions.url import hop_steps
from ..refdata import DISPOSABLE, FREEMAIL, OPEN_HOSTING, PLATFORMS, SHORTENERS, TRACKERS, WALLET

MESSAGE_FIELDS = ["name", "sender_name", "sender_email", "reply_to", "recipient_email", "subject", "body_text", "lang", "hidden_text", "attachments", "auth", "thread", "sent_at"]


SAID = "concat(coalesce(subject, ''), ' . ', coalesce(body_text, ''))"
DENIABLE_WORDS = r"(?i)(code|otp|pin\b|passcode|password|tan\b|código|codice|bitcoin|btc|crypto|ethereum|usdt|कोड|ओटीपी)"
#: Wording of a provider's notice that judges a message, and of one that only says where it is filed.
VERDICT = r"(careful|danger|suspicious|spoof|phish|not (be )?(verif|proven)|unverified|impersonat|caution|fraud|malware|scam)"
PLACEMENT = r"((in|to) (your )?(spam|trash|junk|the bin)|(marked|reported) (it |this |this message )?as spam|you marked|like other messages|similar to messages)"


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def delivered_once(messages: DataFrame, *columns: str) -> DataFrame:
    """One row per msg_id, its earliest delivery; partial aggregation comes before the shuffle."""
    wanted = columns or tuple(c for c in MESSAGE_FIELDS if c in messages.columns)
    first = F.min_by(F.struct("received_at", *wanted), F.coalesce("received_at", F.lit("9999-01-01").cast("timestamp")))
    return messages.where("msg_id IS NOT NULL").groupBy("msg_id").agg(first.alias("_")).select("msg_id", "_.*")


def distinct_links(links: DataFrame) -> DataFrame:
    return links.where("msg_id IS NOT NULL").select("msg_id", "link_index", "text", "href", "normalized_domain").distinct()


def message_columns(q: Dialect) -> dict[str, str]:
    """Name -> expression over the columns of ``messages``; later ones may use earlier ones."""
    domain = q.domain("sender_email")
    return {
        "msg_id": "msg_id",
        "family": "name",
        "sender_domain": f"coalesce({domain}, '')",
        "registrable": f"coalesce({q.registrable(domain)}, '')",
        "local_part": f"coalesce(lower({q.extract('sender_email', r'^(.*)@')}), '')",
        "raw_local": f"coalesce({q.extract('sender_email', r'^(.*)@')}, '')",
        "has_sender": "coalesce(sender_email, '') <> ''",
        # without a sender or a body a score would mislead
        "readable": f"coalesce(sender_email, '') <> '' AND {q.match("coalesce(body_text, '')", r'\S')}",
        "raw_name": "coalesce(sender_name, '')",
        "raw_email": "coalesce(sender_email, '')",
        "name_words": q.words("coalesce(sender_name, '')"),
        "reply_registrable": f"coalesce({q.registrable(q.domain('reply_to'))}, '')",
        "recipient_registrable": f"coalesce({q.registrable(q.domain('recipient_email'))}, '')",
        "raw_subject": "coalesce(subject, '')",
        "subject_words": q.words(q.head("coalesce(subject, '')", BOUNDS.subject)),
        "body_words": q.words(q.head("coalesce(body_text, '')", BOUNDS.body)),
        # sentences, where something may be asked for that a denial turns into its opposite
        "said": f"CASE WHEN {q.match(SAID, DENIABLE_WORDS)} THEN {q.sentences(SAID)} ELSE '' END",
        "wallet": q.match("coalesce(body_text, '')", WALLET),
        # lines of a filled-in form, and whether one gives the reader's own address
        "form_lines": q.count("coalesce(body_text, '')", r"(?m)^[A-Za-z][A-Za-z /-]{1,30}: \S.*$"),
        "echoes_reader": f"coalesce(recipient_email, '') <> '' AND {q.match('lower(coalesce(body_text, chr(10)))', r'(?m)^[a-z][a-z /-]{1,30}: ')} AND lower(coalesce(body_text, '')) LIKE concat('%: ', lower(coalesce(recipient_email, '?')), '%')",
        "long_form_value": q.match("coalesce(body_text, '')", r"(?m)^[A-Za-z][A-Za-z /-]{1,30}: [^\n]{40,}$"),
        "body_chars": "length(coalesce(body_text, ''))",
        "spf": "coalesce(lower(auth.spf), 'unknown')",
        "dkim": "coalesce(lower(auth.dkim), 'unknown')",
        "dmarc": "coalesce(lower(auth.dmarc), 'unknown')",
        "signed_registrable": f"coalesce({q.registrable('lower(auth.signed_by)')}, '')",
        "via_registrable": f"coalesce({q.registrable('lower(auth.via)')}, '')",
        "provider_warning": f"{q.match("lower(coalesce(auth.gmail_warning, ''))", VERDICT)} AND NOT {q.match("lower(coalesce(auth.gmail_warning, ''))", PLACEMENT)}",
        "unauthenticated": "coalesce(auth.unauthenticated_indicator, false)",
        "hidden_chars": "coalesce(hidden_text.chars, 0)",
        "prior_senders": "thread.prior_senders",
    }


#: Columns made of the ones above.
def derived_columns(q: Dialect) -> dict[str, str]:
    fails = "(spf IN ('fail', 'softfail') OR dkim IN ('fail', 'softfail') OR dmarc IN ('fail', 'softfail'))"
    return {
        "text_words": "concat(subject_words, substring(body_words, 2))",
        "freemail": q.one_of("registrable", FREEMAIL),
        "disposable": q.one_of("registrable", DISPOSABLE),
        "reply_freemail": q.one_of("reply_registrable", FREEMAIL),
        "platform_signed": q.one_of("signed_registrable", PLATFORMS),
        "auth_failed": fails,
        "auth_passed": f"(spf = 'pass' OR dkim = 'pass' OR dmarc = 'pass') AND NOT {fails}",
        "proven": f"(NOT {fails} AND NOT unauthenticated AND registrable <> '' AND (dmarc = 'pass' OR signed_registrable = registrable))",
        "sender_core": q.extract("registrable", r"^([^.]+)"),
        "recipient_core": q.extract("recipient_registrable", r"^([^.]+)"),
        "sender_skeleton": q.skeleton(q.extract("registrable", r"^([^.]+)")),
        "recipient_skeleton": q.skeleton(q.extract("recipient_registrable", r"^([^.]+)")),
    }


def attachment_columns(q: Dialect) -> dict[str, str]:
    """Arrays over the attachments; the extension is what follows the last dot, trailing dots and blanks apart."""
    last, before = r"\.([A-Za-z0-9-]+)[. ]*$", r"\.([A-Za-z0-9]{1,8})\.[A-Za-z0-9-]+[. ]*$"
    seen = q.replace("coalesce(a.filename, '')", UNSEEN, "")
    each = {"extensions": f"lower({q.extract(seen, last)})", "inner_extensions": f"lower({q.extract(seen, before)})", "filenames": "coalesce(a.filename, '')"}
    if q is SPARK:
        files = "attachments" if BOUNDS.attachments is None else f"slice(attachments, 1, {BOUNDS.attachments})"
        return {k: f"transform(coalesce({files}, array()), a -> {v})" for k, v in each.items()}
    files = "attachments" if BOUNDS.attachments is None else f"attachments[1:{BOUNDS.attachments}]"
    return {k: f"[{v} for a in coalesce({files}, [])]" for k, v in each.items()}


def link_columns(q: Dialect) -> dict[str, str]:
    """Name -> expression over the columns of ``message_links``."""
    shown = rf"^\s*(?:https?://)?((?:[a-z0-9-]+\.)+[a-z]{{2,}})(?:[:/?#]\S*)?\s*$"
    return {
        "msg_id": "msg_id",
        "link_index": "link_index",
        "anchor": q.head("coalesce(text, '')", BOUNDS.anchor),
        "anchor_words": q.words(q.head("coalesce(text, '')", BOUNDS.anchor)),
        "url": "coalesce(href, '')",
        "shown_host": f"coalesce({q.extract('lower(text)', shown)}, '')",
    }


def hop_columns(q: Dialect) -> dict[str, str]:
    """Of each address on a link's way, entry first: its parts, and where the way ends."""
    host = q.host("address")
    return {
        "scheme": f"coalesce(lower({q.extract('address', r'^\s*([A-Za-z][A-Za-z0-9+.-]*):')}), '')",
        "host": f"coalesce({host}, '')",
        "host_registrable": f"coalesce({q.registrable(host)}, '')",
        "path": f"coalesce({q.extract('address', r'^[^:]*:[/\\]{2}[^/?#]*([^?#]*)')}, '')",
        "query": f"coalesce({q.extract('address', r'[?]([^#]*)')}, '')",
        "end_registrable": f"coalesce({q.registrable(q.host('destination'))}, '')",
    }


def link_derived(q: Dialect) -> dict[str, str]:
    suffix = lambda names: "|".join(n.replace(".", r"\.") for n in names)
    return {
        "shown_registrable": q.registrable("shown_host"),
        "subdomain_labels": "CASE WHEN host_registrable = '' OR host = host_registrable THEN 0 ELSE length(host) - length(replace(host, '.', '')) - (length(host_registrable) - length(replace(host_registrable, '.', ''))) END",
        "shortener": q.one_of("host", SHORTENERS),
        "tracker": q.one_of("host", TRACKERS),
        "open_hosting": q.match("host", rf"(^|\.)({suffix(OPEN_HOSTING)})$"),
        "web": "scheme IN ('http', 'https')",
        "host_core": q.extract("host_registrable", r"^([^.]+)"),
    }


def _selected(df: DataFrame, first: dict[str, str], then: dict[str, str], *keep: str) -> DataFrame:
    made = df.select(*[F.expr(v).alias(k) for k, v in first.items()], *keep)
    return made.select("*", *[F.expr(v).alias(k) for k, v in then.items()])


#: What the sender line and its verdicts say: the columns of a message that need neither body nor attachments.
SENDER_FIELDS = ["name", "sender_name", "sender_email", "reply_to", "recipient_email", "subject", "auth"]
BODY_COLUMNS = {"readable", "body_words", "said", "wallet", "form_lines", "echoes_reader", "long_form_value", "body_chars", "hidden_chars", "prior_senders"}


def message_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = delivered_once(scan(spark, sf_dir, "messages"))
    return _selected(once, message_columns(SPARK) | attachment_columns(SPARK), derived_columns(SPARK))


def sender_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``message_context`` that come of the sender line; bodies are not read."""
    once = delivered_once(scan(spark, sf_dir, "messages"), *SENDER_FIELDS)
    return _selected(once, {k: v for k, v in message_columns(SPARK).items() if k not in BODY_COLUMNS}, {k: v for k, v in derived_columns(SPARK).items() if k != "text_words"})


def link_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per link and address on its way (``hop`` from 0): the link's own, then what it redirects to."""
    rows = distinct_links(scan(spark, sf_dir, "message_links"))
    for step in (link_columns(SPARK), *hop_steps(SPARK)):
        rows = rows.select(*([] if "anchor" in step else ["*"]), *[F.expr(v).alias(k) for k, v in step.items()])
    hops = [c for c in rows.columns if c.startswith("hop") and c != "hops"]
    rows = rows.select(*[c for c in rows.columns if c not in hops], F.posexplode(F.array_compact(F.array("url", *hops))).alias("hop", "address"))
    for step in (hop_columns(SPARK), link_derived(SPARK)):
        rows = rows.select("*", *[F.expr(v).alias(k) for k, v in step.items()])
    return rows


def _sql(first: dict[str, str], source: str, *then: dict[str, str]) -> str:
    out = f"SELECT {', '.join(v if k == '*' else f'{v} AS {k}' for k, v in first.items())} FROM {source}"
    for step in then:
        out = f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in step.items())} FROM ({out})"
    return out


def context_sql(q: Dialect) -> str:
    """The common table expressions of both contexts, for the checking engine."""
    once = "(SELECT * FROM messages WHERE msg_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY received_at) = 1)"
    links = "(SELECT DISTINCT msg_id, link_index, text, href, normalized_domain FROM message_links WHERE msg_id IS NOT NULL)"
    hops = f"[a for a in [url, {', '.join(f'hop{k}' for k in range(1, BOUNDS.hops + 1))}] if a IS NOT NULL]"
    way = f"(SELECT *, unnest(range(len({hops}))) AS hop, unnest({hops}) AS address FROM ({_sql(link_columns(q), links, *hop_steps(q))}))"
    return f"ctx AS ({_sql(message_columns(q) | attachment_columns(q), once, derived_columns(q))}), lnk AS (SELECT * EXCLUDE ({', '.join(f'hop{k}' for k in range(1, BOUNDS.hops + 1))}) FROM ({_sql({'*': '*'}, way, hop_columns(q), link_derived(q))}))"
