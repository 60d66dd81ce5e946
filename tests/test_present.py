"""What is shown of results, the model's part in a score, and further sources."""

from pyspark.sql import functions as F

from mailsieve.functions import text
from mailsieve.operators import present, scoring, semantic
from mailsieve.sources import mail

BAG = "msg_id long, family string, readable boolean, signals array<struct<id: string, category: string, severity: string, score: int, dampened: boolean>>"


def test_unreadable_mail_is_not_checked(spark):
    df = spark.createDataFrame([(1, "f", False, []), (2, "f", True, [("link.x", "link", "high", 30, False)])], BAG)
    got = {r.msg_id: (r.score, r.classification) for r in scoring.scored(df).collect()}
    assert got == {1: (None, "not checked"), 2: (50, "suspicious")}


def test_readings_add_to_corroborated_messages_only(spark):
    df = spark.createDataFrame([(1, "f", True, [("content.x", "content", "medium", 20, False)]), (2, "f", True, []), (3, "f", True, [("content.x", "content", "medium", 20, False)])], BAG)
    prompts = spark.createDataFrame([(1, "verify your account password, urgent: bank details suspended"), (2, "verify your account password, urgent"), (3, None)], "msg_id long, prompt string")
    got = {r.msg_id: [(s.id, s.score > 0) for s in r.signals if s.category == "llm"] for r in semantic.with_readings(df, prompts).collect()}
    assert got == {1: [("llm.assessment", True)], 2: [], 3: []}


def test_payloads_are_checked_again(spark):
    schema = "p struct<subject: string, excerpt: string, sender_domain: string, sender_name_shape: string, reply_to_domain: string, link_domains: array<string>, extensions: array<string>, signal_ids: array<string>>"
    df = spark.createDataFrame([(("a@b.example", "x", "NOT A DOMAIN", "Ann Smith", "r.example", ["a.example", "a.example", "<b>"], ["pdf", "../x"], ["link.x", "no id!"]),), (None,)], schema)
    a, b = df.select(semantic.sanitized(F.col("p")).alias("s")).collect()
    assert a.s.asDict() == {"subject": "<address@b.example>", "excerpt": "x", "sender_domain": "", "sender_name_shape": "unknown", "reply_to_domain": "r.example", "link_domains": ["a.example"], "extensions": ["pdf"], "signal_ids": ["link.x"]} and b.s is None


def test_shown(spark):
    df = spark.createDataFrame([("high-risk", 20, 75, 75, 'It says "pay now" and “today”', "Please  pay\nnow or never", "pay now or never")], "c string, total int, floor int, score int, reason string, body string, evidence string")
    r = df.select(present.badge(F.col("c")).alias("b"), present.score_summary(F.col("total"), F.col("floor"), F.col("score")).alias("s"), present.quoted_parts(F.col("reason")).alias("q"), present.located(F.col("body"), F.col("evidence")).alias("l"), text.first_match(F.col("body"), "pay").alias("m")).first()
    assert tuple(r.b) == ("!", "red") and "raised to 75" in r.s and r.q == ["pay now", "today"] and tuple(r.l) == (9, 24) and tuple(r.m) == ("pay", 9)
    row = ", ".join(f"{n} as {c}_score" for n, c in zip((0, 5, 9, 0, 0, 0), ("authentication", "identity", "link", "content", "attachment", "llm")))
    assert [tuple(x) for x in spark.sql(f"SELECT {row}").select(present.contributions().alias("x")).first().x] == [("link", 9), ("identity", 5)]
    marks = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1)], "g string, n int")
    assert present.limited(marks, "g", "n", 2).count() == 3 and present.skipped(marks, F.when(F.col("n") > 1, "late")).first().messages == 2
    assert present.health(spark.createDataFrame([("ok", 5.0), ("error", 7.0)], "status string, milliseconds double")).first().failed == 1


def test_names_and_times(spark):
    r = spark.sql("SELECT 'pаypal' AS a, 'paypal' AS b").select(text.is_confusable(F.col("a"), F.col("b")).alias("c"), text.fingerprint(F.col("a")).alias("f"), text.fingerprint(F.col("b")).alias("g"), text.duration(F.lit(340)).alias("d"), text.duration(F.lit(2400)).alias("e"), text.duration(F.lit(65_000)).alias("h")).first()
    assert r.c and r.f != r.g and (r.d, r.e, r.h) == ("340 ms", "2.4 s", "1 min 05 s")


def test_any_source(spark, tmp_path):
    (tmp_path / "a.eml").write_text("From: Ann <a@b.example>\nSubject: One\n\nbody")
    (tmp_path / "box").write_text("From x\nFrom: Bo <b@b.example>\nSubject: Two\n\nbody\n\nFrom y\nFrom: Cy <c@b.example>\nSubject: Three\n\nbody")
    assert sorted(r.subject for r in mail.read_any(spark, str(tmp_path)).collect()) == ["One", "Three", "Two"]
    (tmp_path / "m.mbox").write_text("From x\nFrom: Bo <b@b.example>\nSubject: Long\n\n" + "y" * 500)
    r = mail.read_mbox(spark, str(tmp_path / "m.mbox"), 100).first()
    assert r.subject == "Long" and r.status == "too long: headers only"
    sent = spark.createDataFrame([("me@x.example", "you@x.example"), ("me@x.example", "me@x.example"), ("you@x.example", "me@x.example"), (None, None)], "sender_email string, recipient_email string")
    assert mail.outbound(sent, F.lit("ME@x.example")).count() == 3
