import time

import pytest
from pyspark.sql import functions as F

from mailsieve.functions import html, text, url


def one(spark, value, column, name="c", kind="string"):
    return spark.createDataFrame([(value,)], f"{name} {kind}").select(column).first()[0]


@pytest.mark.parametrize(("a", "b", "d"), [("paypal", "payapl", 1), ("ca", "abc", 3), ("same", "same", 0), ("", "ab", 2), ("short", "a much longer one", 3)])
def test_alignment_distance(a, b, d):
    assert text.edit_distance(a, b) == d


@pytest.mark.parametrize(("a", "b"), [("pаypаl", "paypal"), ("rnicrosoft", "microsoft"), ("PayPa1", "paypal"), ("goog1e", "google"), ("modern", "modem")])
def test_skeletons_meet(a, b):
    assert text.skeleton_of(a) == text.skeleton_of(b)


def test_skeleton_keeps_different_words_apart():
    assert text.skeleton_of("paypal") != text.skeleton_of("payroll")


def test_hosts_are_decoded():
    assert text.decoded_host("xn--pypal-4ve.com") == "pаypal.com"
    assert text.decoded_host("xn--99999999999.com") == "xn--99999999999.com"


def test_columns(spark):
    assert one(spark, "Ann <A@B.example>", text.mailbox(F.col("c"))).asDict() == {"name": "Ann", "address": "a@b.example"}
    assert one(spark, "a@b.example", text.mailbox(F.col("c"))).asDict() == {"name": "", "address": "a@b.example"}
    assert one(spark, "invoice.pdf.EXE..", text.extension_chain(F.col("c"))) == ["pdf", "exe"]
    assert one(spark, ["a", "b", "c", "d"], text.format_list(F.col("c")), kind="array<string>") == "a, b, c and 1 more"
    assert one(spark, ["a", "b"], text.format_list(F.col("c")), kind="array<string>") == "a and b"
    assert one(spark, "write to x.y@z.example now", text.redacted_addresses(F.col("c"))) == "write to <address@z.example> now"
    assert one(spark, "Paypаl", text.suspicious_mixture(F.col("c"))) is True
    assert one(spark, "東京 Tower", text.suspicious_mixture(F.col("c"))) is False
    assert one(spark, "xx needle yy", text.excerpt(F.col("c"), "needle", 1)) == "… needle …"
    assert one(spark, None, text.skeleton(F.col("c"))) is None


def test_negation(spark):
    pattern = r"\bsend\b[^.!?]{0,30}\bcode\b"
    assert one(spark, "We will never ask you to send the code.", text.unnegated(F.col("c"), pattern)) is None
    assert one(spark, "Please send us the code.", text.unnegated(F.col("c"), pattern)) == "send us the code"
    assert one(spark, "Never send a code. But now send the code!", text.unnegated(F.col("c"), pattern)) == "send the code"


def test_hosts(spark):
    assert one(spark, "HTTPS://user@WWW.Shop.co.uk.:8443/p?q=1#x", url.host("c")) == "shop.co.uk"
    df = spark.createDataFrame([("a.b.shop.co.uk",), ("x.example.com",), ("10.0.0.1",), ("localhost",)], "h string")
    assert [r[0] for r in df.select(url.registrable("h")).collect()] == ["shop.co.uk", "example.com", "10.0.0.1", ""]
    assert one(spark, "a.b.c", url.suffixes(F.col("c"))) == ["a.b.c", "b.c", "c"]
    assert one(spark, "192.168.1.9", url.is_private_ip(F.col("c"))) is True
    assert one(spark, "8.8.8.8", url.is_private_ip(F.col("c"))) is False
    assert one(spark, "-bad.example", url.is_malformed(F.col("c"))) is True
    assert one(spark, "ok.example", url.is_malformed(F.col("c"))) is False
    assert one(spark, "x.notatld", url.unknown_tld("c")) is True
    assert one(spark, "honest.bank", url.unknown_tld("c")) is False


@pytest.mark.parametrize(
    ("link", "hosts"),
    [
        ("https://g.example/url?q=https%3A%2F%2Fa.example%2Fr%3Fto%3D//b.test/x", ["g.example", "a.example", "b.test"]),
        ("https://t.example/aHR0cHM6Ly9ldmlsLmV4YW1wbGUvbG9naW4", ["t.example", "evil.example"]),
        ("https://t.example/L0/https:%2F%2Fx.example%2Fp", ["t.example", "x.example"]),
        ("https://s.example/?q=invoice", ["s.example"]),
    ],
)
def test_redirects(spark, link, hosts):
    assert url.unwrapped(spark.createDataFrame([(link,)], "u string"), "u").first()["hosts"] == hosts


def test_odd_redirects(spark):
    links = [("https://s.example/?url=https%3A%2F%2F",), (None,), ("",), ("mailto:a@b.example",), ("https://a.example/?u=%zz&next=//b.example/x",), ("https://a.example/?url=https://b.example/?url=https://c.example/?url=https://d.example/?url=https://e.example/",)]
    got = url.unwrapped(spark.createDataFrame(links, "u string"), "u").collect()
    assert [(r.hops, r.opaque, r.hosts) for r in got[:5]] == [(0, True, ["s.example"]), (0, False, []), (0, False, []), (0, False, []), (1, False, ["a.example", "b.example"])]
    assert got[5].hosts == ["a.example", "b.example", "c.example", "d.example"] and not got[5].opaque


STYLES = {
    "display: none !important": "display:none", "DISPLAY:NONE": "display:none", "visibility: collapse": "visibility:hidden", "opacity:.02": "opacity:0", "opacity: 4%": "opacity:0", "opacity:0.5": None, "opacity: 50%": None,
    "font-size:0": "font-size:0", "font-size: 1.5pt": "font-size:0", "font-size:0.1em": "font-size:0", "font-size:3px": None, "font-size:large": None, "height:0": None, "height:0;overflow:hidden": "height:0", "max-height:0px; overflow-y: clip": "height:0",
    "width: 0em; overflow:hidden": "width:0", "height:10px;overflow:hidden": None, "clip: rect(0, 0, 0, 0)": "clipped", "clip:rect(0 0 1px 1px)": None, "clip-path: inset(50%)": "clipped", "clip-path:inset(5%)": None, "text-indent:-9999px": "moved off screen",
    "margin-left:-20px": None, "left: -120em": "moved off screen", "color:red": None, "": None, "display:none;display:block": None, "opacity:0 /* x */": "opacity:0",
}


@pytest.mark.parametrize("style", list(STYLES))
def test_concealment(style):
    assert html.concealment(html.declared(style)) == STYLES[style]


def test_choices_among_nodes(spark):
    df = spark.createDataFrame([("", "b", [(1, 9), (2, 3), (10, 12)], [(10, 12), (4, 20)])], "x string, y string, a array<struct<begin: int, end: int>>, b array<struct<begin: int, end: int>>")
    r = df.select(html.first_answer(F.col("x"), F.col("y")), html.first_nonempty(F.array(), F.col("a")), html.in_order(F.col("a"), F.col("b")), html.outermost(F.col("a"))).first()
    assert r[0] == "b" and len(r[1]) == 3 and [tuple(n) for n in r[2]] == [(1, 9), (2, 3), (4, 20), (10, 12)] and [tuple(n) for n in r[3]] == [(1, 9), (10, 12)]


def test_pages():
    made = html.page_of('<p>Hello<div style="display:none">secret 123</div> <a href="https://x.example/a">go  now</a></p><a href="#top">up</a><div style="font-size:0">gone<span style="font-size:12px">seen</span></div><script>no()</script><div style="height:0">shown</div>')
    assert "Hello" in made["body"] and "seen" in made["body"] and "shown" in made["body"]
    assert "secret" not in made["body"] and "gone" not in made["body"] and "no()" not in made["body"]
    assert made["links"] == [{"text": "go now", "href": "https://x.example/a"}]
    assert made["hidden_chars"] == len("secret123") + len("gone") and made["techniques"] == ["display:none", "font-size:0"]
    assert html.page_of("<blockquote>only a quote</blockquote>")["body"] == "only a quote"
    assert html.page_of("")["body"] == ""


def test_hostile_inputs_end_soon():
    began = time.perf_counter()
    html.page_of("<div>" * 3_000 + "x")
    for _ in range(200):
        text.edit_distance("a" * 253, "b" * 253)
    assert time.perf_counter() - began < 10
