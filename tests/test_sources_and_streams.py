import json
from email.message import EmailMessage

from pyspark.sql import functions as F

from mailsieve import catalog
from mailsieve.operators import semantic
from mailsieve.plans.context import delivered_once
from mailsieve.sources import mail
from mailsieve.streaming import events


def message(subject="Grüße", labels=None):
    m = EmailMessage()
    m["From"] = "Ann B <Ann@shop.example>"
    m["To"] = "me@home.example"
    m["Subject"] = subject
    m["Date"] = "Tue, 02 Jan 2024 10:00:00 +0000"
    m["Authentication-Results"] = "mx.example; spf=pass; dkim=FAIL header.d=shop.example; dmarc=none"
    if labels:
        m["X-Gmail-Labels"] = labels
    m.set_content("plain text https://t.example/x")
    m.add_alternative('<p>rich <a href="https://r.example/y">text</a></p>', subtype="html")
    m.add_attachment(b"x", maintype="application", subtype="pdf", filename="a.pdf")
    return m


def test_single_messages(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "one.eml").write_bytes(bytes(message()))
    (tmp_path / "two.eml").write_bytes(b"\xff\xfe not a message")
    rows = {r.path.rsplit("/", 1)[1]: r for r in mail.read_eml(spark, str(tmp_path)).collect()}
    r = rows["one.eml"]
    assert (r.sender_name, r.sender_email, r.recipient_email, r.subject) == ("Ann B", "ann@shop.example", "me@home.example", "Grüße")
    assert r.body_text == "rich text" and r.links[0].href == "https://r.example/y" and r.attachments[0].filename == "a.pdf"
    assert (r.auth.spf, r.auth.dkim, r.auth.dmarc, r.auth.signed_by) == ("pass", "fail", "none", "shop.example")
    assert len(rows) == 2


def test_mailbox(spark, tmp_path):
    parts = [b"From x@y Tue Jan  2 10:00:00 2024\n" + bytes(message(f"s{k}", labels)) for k, labels in enumerate(["Inbox", "Sent", "Chat", "Inbox,Spam"])]
    (tmp_path / "box.mbox").write_bytes(b"\n".join(parts))
    rows = mail.read_mbox(spark, str(tmp_path / "box.mbox"))
    assert sorted(r.subject for r in rows.collect()) == ["s0", "s1", "s2", "s3"]
    assert sorted((r.subject, r.mail_group) for r in mail.received(rows).collect()) == [("s0", "mail"), ("s3", "spam")]


def test_csv_and_fixtures(spark, tmp_path):
    (tmp_path / "c.csv").write_text('sender,sender_domain,receiver_domain,subject,body,urls,source,label\nA@B.example,b.example,c.example,"Hi, you","two\nlines",http://a.example http://b.example,s,0\n')
    r = mail.read_csv(spark, str(tmp_path / "c.csv")).first()
    assert (r.sender_email, r.subject, r.body_text, len(r.links), r.mail_group) == ("a@b.example", "Hi, you", "two\nlines", 2, "honest")
    (tmp_path / "f.json").write_text(json.dumps({"name": "n", "email": {"senderEmail": "A@B.example", "subject": " a  b ", "bodyText": "x", "links": [{"text": "t", "href": "h"}]}}))
    r = mail.read_fixtures(spark, str(tmp_path / "f.json")).first()
    assert (r.name, r.sender_email, r.subject, r.links[0].href, r.auth) == ("n", "a@b.example", "a b", "h", None)


def test_parsed_parts_are_written_and_read_again(spark, sf_dir):
    got = {r.parsed_id: r for r in catalog.QUERIES["mime_parse"](spark, sf_dir).collect()}
    stored = spark.read.parquet(f"{sf_dir}/parsed_messages.parquet").collect()
    assert any(r.attachments for r in stored) and any(r.html for r in stored)
    assert all(got[r.parsed_id].attachments == len(r.attachments or []) for r in stored)
    linked = [r for r in stored if r.html and "<a href=" in r.html[0]]
    assert linked and all(got[r.parsed_id].links > 0 for r in linked)
    raw = mail._written({"from": ["A <a@b.example>"]}, ["Gr\u00fc\u00dfe \u20ac", "caf\u00e9 = b", "\u041f\u0440\u0438\u0432\u0435\u0442"], [], ["\u00fc \"x\".pdf"])
    r = mail.message_of(raw)
    assert (r["sender_email"], r["body_text"].split("\n"), r["attachments"]) == ("a@b.example", ["Gr\u00fc\u00dfe \u20ac", "caf\u00e9 = b", "\u041f\u0440\u0438\u0432\u0435\u0442"], [{"filename": "\u00fc \"x\".pdf"}])


def stream_of(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def test_duplicates_in_streams(spark, tmp_path):
    stream = stream_of(spark, tmp_path, [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:10"), (2, "2024-01-01 00:00:20")], "k int, t string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r.k for r in events.drained(events.deduplicated(stream, ["k"], "t")).collect()) == [1, 2]


def test_bursts_are_joined(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", "x"), ("a", "2024-01-01 00:00:01", "y"), ("a", "2024-01-01 01:00:00", "z"), ("b", "2024-01-02 00:00:00", "w")]
    stream = stream_of(spark, tmp_path, rows, "k string, t string, v string").withColumn("t", F.to_timestamp("t"))
    out = {(r.k, r.v, r.events) for r in events.drained(events.debounced(stream, "k", "t", "v", "10 seconds", "1 minute")).collect()}
    assert ("a", "y", 2) in out and ("a", "z", 1) in out  # the last burst stays open until the watermark passes it


def test_the_last_windows_and_bursts_are_written(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", "x"), ("a", "2024-01-01 23:59:59", "y"), ("a", "2024-01-02 00:00:00", "z"), ("b", "2024-01-02 00:00:01", "v"), (None, "2024-01-02 00:00:02", "w"), ("a", None, "u")]
    stream = stream_of(spark, tmp_path, rows, "k string, t string, v string").withColumn("t", F.to_timestamp("t"))
    out = sorted(((str(r.began), r.k, r.events) for r in events.drained_to_the_end(stream, "t", lambda s: events.windowed(s, "k", "t", "1 day")).collect()), key=repr)
    assert out == sorted([("2024-01-01 00:00:00", "a", 2), ("2024-01-02 00:00:00", "a", 1), ("2024-01-02 00:00:00", "b", 1), ("2024-01-02 00:00:00", None, 1)], key=repr)
    bursts = {(r.k, r.v, r.events) for r in events.drained_to_the_end(stream, "t", lambda s: events.debounced(s, "k", "t", "v", "10 seconds")).collect()}
    assert bursts == {("a", "x", 1), ("a", "z", 2), ("b", "v", 1), (None, "w", 1)}


def test_only_changes_pass(spark, tmp_path):
    stream = stream_of(spark, tmp_path, [("a", "s1", 1), ("a", "s2", 2), ("b", "s1", 1)], "k string, s string, o int")
    assert sorted((r.k, r.s, r.change) for r in events.drained(events.changes(stream, "k", "s", "o")).collect()) == [("a", "s2", "changed"), ("b", "s1", "changed")]


def test_readings(spark):
    answers = ['```json\n{"risk": 80, "categories": ["malware", "odd"], "reasons": ["r"], "confidence": 0.9}\n```', '{"risk": 180, "reasons": ["r"], "confidence": 0.9}', "no json", None, '{"risk": 80, "categories": ["benign"], "reasons": ["r"], "confidence": 0.9}']
    rows = spark.createDataFrame([(a,) for a in answers], "a string").select(semantic.parsed(F.col("a")).alias("r")).select("r.kinds", semantic.points(F.col("r"), F.lit(True)).alias("p"), semantic.points(F.col("r"), F.lit(False)).alias("q")).collect()
    assert [r.p for r in rows] == [17, 0, 0, 0, 0] and {r.q for r in rows} == {0} and rows[0].kinds == ["malware"]


def test_equal_prompts_are_read_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def counting(prompts):
        calls.add(len(prompts))
        return semantic.stub(prompts)

    semantic.SCORERS["counting"] = counting
    df = spark.createDataFrame([(k, "verify your password" if k < 9 else None) for k in range(10)], "k int, t string")
    read = semantic.readings(df, "t", "counting").collect()
    assert len(read) == 10 and calls.value == 1 and sum(r.reading is None for r in read) == 1


def test_payloads_have_extensions_shapes_and_reply_domains(spark, sf_dir):
    names = ["", "  Jane  Okonkwo ", "ACME TEAM", "a b c d e f", "J\u00f6rg <x@y.example>", "Helpdesk"]
    shapes = [r.s for r in spark.createDataFrame([(n,) for n in names], "n string").select(semantic.name_shape(F.col("n")).alias("s")).collect()]
    assert shapes == ["empty", "two-words", "two-words-all-caps-role-account", "many-words", "two-words-contains-address-non-ascii", "one-word-role-account"]
    files = [[("a.PDF",), ("b.pdf",), ("c.tar.gz. ",), (".exe",), ("none",), (None,), ("x.e\u200bxe",)], None, [(f"f{k}.x{k}",) for k in range(70)]]
    found = [r.e for r in spark.createDataFrame([(f,) for f in files], "f array<struct<filename: string>>").select(semantic.extensions(F.col("f")).alias("e")).collect()]
    assert found[:2] == [["pdf", "gz", "exe"], []] and len(found[2]) == 70
    made = {r.msg_id: json.loads(r.payload) for r in catalog.QUERIES["cloud_payload"](spark, sf_dir).collect()}
    spark.catalog.clearCache()
    stored = delivered_once(spark.read.parquet(f"{sf_dir}/messages.parquet"), "sender_email", "reply_to", "attachments").collect()
    with_files = {r.msg_id: r.attachments[0].filename.rpartition(".")[2].lower() for r in stored if r.attachments and len(r.attachments) == 1}
    assert with_files and all(made[k]["extensions"] == [e] for k, e in with_files.items())
    domain = lambda a: (a or "").rpartition("@")[2].lower()
    elsewhere = {r.msg_id: domain(r.reply_to) for r in stored if r.reply_to and domain(r.reply_to) != domain(r.sender_email)}
    assert elsewhere and {k: p["reply_to_domain"] for k, p in made.items() if "reply_to_domain" in p} == elsewhere
