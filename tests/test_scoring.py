"""The scoring algebra on signals made by hand, and the sender-only view."""

import pytest
from pyspark.sql import functions as F

from mailsieve.operators import scoring, triage

SCHEMA = "msg_id long, family string, registrable string, recipient_registrable string, freemail boolean, disposable boolean, proven boolean, claim_id int, claim_domain string, sender_brand int, web_links long, strange_links long, signals " + scoring.SIGNAL


def bag(spark, signals, **over):
    row = {"msg_id": 1, "family": "f", "registrable": "a.example", "recipient_registrable": "b.example", "freemail": False, "disposable": False, "proven": False, "claim_id": None, "claim_domain": None, "sender_brand": None, "web_links": 0, "strange_links": 0} | over
    made = [(i, i.partition(".")[0], s, n) for i, s, n in signals]
    return spark.createDataFrame([(*row.values(), made)], SCHEMA)


@pytest.mark.parametrize(
    ("signals", "score", "basis", "name"),
    [
        ([], 0, "none", "low"),
        ([("identity.x", "low", 10)], 10, "none", "low"),
        ([("identity.x", "low", 99)], 15, "none", "low"),  # a low finding counts 15 at most
        ([("identity.x", "medium", 20), ("identity.y", "medium", 20)], 21, "none", "low"),  # the category's weight
        ([("identity.x", "high", 30)], 50, "finding", "suspicious"),
        ([("identity.x", "critical", 40)], 75, "finding", "high-risk"),
        ([("identity.x", "high", 30), ("link.y", "high", 30)], 75, "convergence", "high-risk"),
        ([("identity.x", "high", 30), ("identity.y", "high", 30)], 50, "finding", "suspicious"),
        ([("authentication.gmail_warning", "high", 30)], 14, "none", "low"),  # never a floor
        ([("llm.x", "high", 60)], 15, "none", "low"),
        ([("link.x", "high", 0)], 0, "none", "low"),
    ],
)
def test_scores(spark, signals, score, basis, name):
    r = scoring.scored(scoring.refined(bag(spark, signals))).first()
    assert (r.score, r.floor_basis, r.classification) == (score, basis, name)


def softened(spark, signals, **over):
    r = scoring.refined(bag(spark, signals, **({"proven": True, "claim_domain": "a.example", "claim_id": 1} | over))).first()
    return [(s.id, s.severity, s.score, s.dampened) for s in r.signals]


def test_proven_senders_are_softened(spark):
    assert softened(spark, [("content.a", "medium", 20), ("content.b", "low", 10), ("content.c", "high", 30)]) == [("content.a", "low", 5, True), ("content.b", "info", 3, True), ("content.c", "high", 30, False)]
    assert softened(spark, [("content.combo.urgent_credential_request", "high", 30)]) == [("content.combo.urgent_credential_request", "info", 0, True)]


@pytest.mark.parametrize("over", [{"proven": False}, {"freemail": True}, {"web_links": 3, "strange_links": 1}, {"claim_domain": "other.example"}])
def test_others_are_not(spark, over):
    assert softened(spark, [("content.a", "medium", 20)], **over) == [("content.a", "medium", 20, False)]


def test_technical_findings_block_softening(spark):
    assert softened(spark, [("content.a", "medium", 20), ("link.x", "medium", 0)])[0] == ("content.a", "medium", 20, False)


def test_triage_takes_the_worst(spark):
    found = triage.worst(bag(spark, [("identity.disposable_sender_domain", "high", 26), ("identity.lookalike_sender_domain", "critical", 45), ("link.x", "critical", 90)])).collect()
    assert [(r.severity, r.id) for r in found] == [("critical", "identity.lookalike_sender_domain")]
    assert triage.worst(bag(spark, [("identity.sender_deep_subdomain", "low", 10)])).count() == 0


def test_trust(spark):
    from mailsieve.operators import trust

    rows = [(1, "gmail.com", "gmail.com", "Ann@gmail.com", True), (2, "gmail.com", "gmail.com", "bob@gmail.com", True), (3, "shop.example", "mail.shop.example", "x@mail.shop.example", True), (4, "shop.example", "shop.example", "x@shop.example", False), (5, "", "", "x", True), (6, "mailinator.com", "mailinator.com", "a@mailinator.com", True)]
    ctx = spark.createDataFrame(rows, "msg_id int, registrable string, sender_domain string, raw_email string, proven boolean")
    listed = spark.createDataFrame([(e,) for e in trust.normalized_list([" ANN@gmail.com ", "shop.example", "shop.example", "mailinator.com", "no dot", ""])], "entry string")
    got = {r.msg_id: r.s for r in trust.with_trust(ctx, listed).select("msg_id", trust.state(F.col("trusted"), F.col("proven")).alias("s")).collect()}
    assert got == {1: "trusted", 2: "none", 3: "trusted", 4: "unproven", 5: "none", 6: "none"}


def test_trust_softens_but_refutes_nothing(spark):
    b = bag(spark, [("content.a", "medium", 20), ("content.combo.urgent_credential_request", "high", 30)], proven=True).withColumn("trusted", F.lit(True))
    assert [(s.id, s.severity, s.score) for s in scoring.refined(b).first().signals] == [("content.a", "low", 5), ("content.combo.urgent_credential_request", "high", 30)]
