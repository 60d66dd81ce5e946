"""Mail from files: single messages, mailboxes, CSV corpora and JSON fixtures become rows of one schema.

Messages are read as binary or text by Spark and parsed by the standard library in Arrow batches; a mailbox is split
into messages by the reader itself, so one large file is read by many tasks."""

from __future__ import annotations

import base64
import email
import email.policy
import hashlib
import quopri
import re
from email.message import EmailMessage
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BOUNDS
from ..functions.html import page_of

PARSED = (
    "sender_name string, sender_email string, reply_to string, recipient_email string, subject string, body_text string, message_id string, labels string, sent_at timestamp, "
    "hidden_text struct<chars: int, techniques: array<string>>, links array<struct<text: string, href: string>>, attachments array<struct<filename: string>>, auth struct<spf: string, dkim: string, dmarc: string, signed_by: string>"
)
FIXTURE = (
    "name string, description string, email struct<senderName: string, senderEmail: string, replyTo: string, recipientEmail: string, subject: string, bodyText: string, "
    "hiddenText: struct<chars: int, techniques: array<string>>, links: array<struct<text: string, href: string>>, attachments: array<struct<filename: string>>, "
    "auth: struct<spf: string, dkim: string, dmarc: string, signedBy: string, mailedBy: string, via: string, gmailWarning: string, unauthenticatedIndicator: boolean>, "
    "thread: struct<priorSenders: array<struct<email: string, name: string>>>>"
)
#: Parts of a message that are looked at, and how deep they may nest.
PARTS, DEPTH = 50, 8
_plain_url = re.compile(r"https?://[^\s<>\"')\]]+")
_verdict = re.compile(r"\b(spf|dkim|dmarc)\s*=\s*(\w+)", re.I)
_signer = re.compile(r"header\.(?:d|i)\s*=\s*@?([\w.-]+)", re.I)


def _parts(message: EmailMessage, depth: int = 0):
    if depth > DEPTH:
        return
    if message.is_multipart():
        for part in message.get_payload():
            yield from _parts(part, depth + 1)
    else:
        yield message


def _text(part: EmailMessage) -> str:
    raw = part.get_payload(decode=True) or b""
    charset = part.get_content_charset() or "utf-8"
    try:
        return raw.decode(charset)
    except (LookupError, UnicodeDecodeError):
        return raw.decode("utf-8", "replace")


def _header(message: EmailMessage, name: str) -> str | None:
    try:
        value = message.get(name)
        return None if value is None else re.sub(r"\s+", " ", str(value)).strip()
    except Exception:  # noqa: BLE001 - a header that the parser rejects is no header
        return None


def _address(value: str | None) -> tuple[str | None, str | None]:
    if not value:
        return None, None
    m = re.match(r"^(.*)<([^<>]*)>\s*$", value, re.S)
    return (m[1].strip().strip('"') or None, m[2].strip().lower() or None) if m else (None, value.strip().lower())


def message_of(raw: bytes | str | None) -> dict:
    """One message as a row of PARSED; what can't be read is null, never an error."""
    empty = dict.fromkeys(re.findall(r"(?:^|, )(\w+) ", re.sub(r"<.*?>(?=,|$)", "", PARSED)))
    keys = "sender_name sender_email reply_to recipient_email subject body_text message_id labels sent_at hidden_text links attachments auth".split()
    row = dict.fromkeys(keys) | {k: v for k, v in empty.items() if k in keys}
    if raw is None or not raw:
        return row
    parse = email.message_from_bytes if isinstance(raw, bytes) else email.message_from_string
    message = parse(raw, policy=email.policy.default)
    plain, pages, files = [], [], []
    for k, part in enumerate(_parts(message)):
        if k >= PARTS:
            break
        try:
            name = part.get_filename()
        except Exception:  # noqa: BLE001
            name = None
        if name or part.get_content_disposition() == "attachment":
            files.append({"filename": name or ""})
        elif part.get_content_type() == "text/html":
            pages.append(page_of(_text(part)))
        elif part.get_content_maintype() == "text":
            plain.append(_text(part))
    body = pages[0]["body"] if pages and pages[0]["body"] else "\n".join(plain)
    found = pages[0]["links"] if pages else [{"text": u, "href": u} for u in dict.fromkeys(_plain_url.findall(body))]
    results = _header(message, "Authentication-Results") or ""
    verdicts = {k.lower(): v.lower() for k, v in reversed(_verdict.findall(results))}
    signer = _signer.search(results)
    name, sender = _address(_header(message, "From"))
    date = pd.to_datetime(_header(message, "Date"), errors="coerce", utc=True)
    return row | {
        "sender_name": name, "sender_email": sender, "reply_to": _address(_header(message, "Reply-To"))[1], "recipient_email": _address(_header(message, "To"))[1], "subject": _header(message, "Subject"),
        "body_text": body[: BOUNDS.body], "message_id": _header(message, "Message-ID"), "labels": _header(message, "X-Gmail-Labels"), "sent_at": None if pd.isna(date) else date.tz_localize(None).to_pydatetime(),
        "hidden_text": {"chars": pages[0]["hidden_chars"], "techniques": pages[0]["techniques"]} if pages else None, "links": found[: BOUNDS.links], "attachments": files[: BOUNDS.attachments],
        "auth": {k: verdicts.get(k, "unknown") for k in ("spf", "dkim", "dmarc")} | {"signed_by": signer[1].lower() if signer else None} if results else None,
    }


def written(headers: Column, text: Column, html: Column, attachments: Column) -> Column:
    """RFC 822 messages of parsed parts: each text, page and named attachment a part of its own, in turn as 8bit, quoted
    printable and base64; headers as they are, but for those that describe the one body there was."""

    @F.pandas_udf("binary")
    def apply(headers: pd.Series, text: pd.Series, html: pd.Series, attachments: pd.Series) -> pd.Series:
        return pd.Series([_written(dict(h) if h is not None else {}, *([] if x is None else list(x) for x in (t, p, a))) for h, t, p, a in zip(headers, text, html, attachments)])

    return apply(headers, text, html, attachments)


def _written(headers: dict, text: list, html: list, attachments: list) -> bytes:
    lines = [f"{k}: {re.sub(r'[\r\n]+', ' ', v)}" for k, vs in headers.items() if k.lower() not in ("content-type", "content-transfer-encoding", "mime-version") for v in (() if vs is None else vs) if v is not None]
    parts = [(x, "text/plain", None) for x in text if x is not None] + [(x, "text/html", None) for x in html if x is not None] + [(f"content of {x}", "application/octet-stream", x) for x in attachments if x is not None]
    bodies = []
    for k, (content, kind, name) in enumerate(parts):
        raw = content.encode("utf-8", "replace")
        how = ("8bit", "quoted-printable", "base64")[k % 3] if name is None else "base64"
        coded = raw if how == "8bit" else quopri.encodestring(raw) if how == "quoted-printable" else base64.encodebytes(raw)
        file = "" if name is None else f"\nContent-Disposition: attachment; filename*=utf-8''{quote(name, safe='')}"
        bodies.append(f"Content-Type: {kind}; charset=utf-8\nContent-Transfer-Encoding: {how}{file}\n\n".encode() + coded)
    edge = "part-" + hashlib.sha256(b"".join(bodies)).hexdigest()[:32]
    head = "\n".join([*lines, "MIME-Version: 1.0", f'Content-Type: multipart/mixed; boundary="{edge}"', "", ""]).encode("utf-8", "replace")
    return head + b"".join(f"--{edge}\n".encode() + b + b"\n" for b in bodies) + f"--{edge}--\n".encode()


def parsed(c: Column) -> Column:
    """struct of PARSED of a binary or text column of RFC 822 messages."""

    @F.pandas_udf(PARSED)
    def apply(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([message_of(v) for v in values]).astype({"sent_at": "datetime64[us]"})

    return apply(c)


def read_eml(spark: SparkSession, path: str) -> DataFrame:
    """Single messages: one per file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", parsed(F.col("content")).alias("m")).select("path", "m.*")


def read_mbox(spark: SparkSession, path: str, most: int | None = 3_000_000) -> DataFrame:
    """Mailboxes: messages begin at a line "From " after an empty line. Of a message longer than ``most`` only the headers
    are parsed, and ``status`` says so; None parses all of every message."""
    raw = spark.read.option("lineSep", "\n\nFrom ").text(path)
    body = F.regexp_replace(F.col("value"), r"^(From )?[^\n]*\n", "")
    long = F.lit(False) if most is None else F.length(body) > most
    kept = F.when(long, F.concat(F.regexp_extract(body, r"(?s)^(.*?)\r?\n\r?\n", 1), F.lit("\n\n"))).otherwise(body)
    return raw.select(parsed(kept).alias("m"), F.when(long, "too long: headers only").otherwise("read").alias("status")).select("m.*", "status")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Messages from a folder or file, each file by its ending: .mbox as mailboxes, all others as single messages; a
    mailbox under another ending is known by its first line. Adds ``status``; rows have the columns of PARSED."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    box = F.lower("path").endswith(".mbox") | F.startswith(F.substring(F.col("content"), 1, 5).cast("string"), F.lit("From "))
    text = F.regexp_replace(F.decode("content", "ISO-8859-1"), "\r\n", "\n")
    each = F.explode(F.when(box, F.transform(F.split(text, "\n\nFrom "), lambda m: F.encode(F.regexp_replace(m, r"^(From )?[^\n]*\n", ""), "ISO-8859-1"))).otherwise(F.array("content")))
    return files.select("path", each.alias("raw")).select("path", parsed(F.col("raw")).alias("m")).select("path", "m.*", F.lit("read").alias("status"))


def outbound(df: DataFrame, account: Column) -> DataFrame:
    """Without what the account itself sent to others; mail to oneself stays."""
    own = F.lower("sender_email") == F.lower(account)
    return df.where(~F.coalesce(own & (F.lower("recipient_email") != F.lower(account)), F.lit(False)))


def received(df: DataFrame) -> DataFrame:
    """Mail that was received: chats and what was only sent are left out; ``mail_group`` is spam or mail."""
    labels = F.split(F.coalesce("labels", F.lit("")), r"\s*,\s*")
    has = lambda x: F.array_contains(labels, x)
    return df.where(~has("Chat") & ~(has("Sent") & ~has("Inbox"))).withColumn("mail_group", F.when(has("Spam"), "spam").otherwise("mail"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A corpus with the columns sender, sender_domain, receiver_domain, subject, body, urls, source, label; ragged rows
    are dropped. ``mail_group`` is honest for labels that begin with 0."""
    schema = "sender string, sender_domain string, receiver_domain string, subject string, body string, urls string, source string, label string"
    rows = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', mode="DROPMALFORMED")
    links = F.transform(F.filter(F.split(F.coalesce("urls", F.lit("")), r"[\s,]+"), lambda u: u != ""), lambda u: F.struct(u.alias("text"), u.alias("href")))
    return rows.select(F.lower("sender").alias("sender_email"), "subject", F.col("body").alias("body_text"), links.alias("links"), "source", F.when(F.col("label").startswith("0"), "honest").otherwise("malicious").alias("mail_group"))


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """JSON fixtures, one object per file or an array of them; names in snake case, the sender lower-cased."""
    rows = spark.read.schema(FIXTURE).json(path, multiLine=True)
    e = F.col("email")
    return rows.select(
        "name", e["senderName"].alias("sender_name"), F.lower(e["senderEmail"]).alias("sender_email"), e["replyTo"].alias("reply_to"), e["recipientEmail"].alias("recipient_email"),
        F.trim(F.regexp_replace(e["subject"], r"\s+", " ")).alias("subject"), e["bodyText"].alias("body_text"), e["hiddenText"].alias("hidden_text"), e["links"].alias("links"), e["attachments"].alias("attachments"), e["auth"].alias("auth"), e["thread"].alias("thread"),
    )


def extraction_quality(df: DataFrame, *fields: str) -> DataFrame:
    """How many rows lack each field: what a source silently stopped giving."""
    return df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(f).isNull()).alias(f"no_{f}") for f in fields])
