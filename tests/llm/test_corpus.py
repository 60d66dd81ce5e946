"""The corpus operators: against brute force where there is one, on held-out cases else, and in every odd case."""

import cProfile
import itertools
import pstats
import random
import re

import pytest
from pyspark.sql import functions as F

from mailsieve.llm import encodings, languages, leakage, lookalikes, mixture, near_duplicates, personal, personal_table, quality, quoted_history
from mailsieve.llm.common import some_rows


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---- near duplicates


def grams(text, n):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def brute_groups(texts, n, threshold):
    sets = {k: grams(t, n) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) >= threshold * len(x | y):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {frozenset(k for k in texts if find(k) == r) for r in set(map(find, texts))}


def edited(rng, words, vocabulary):
    out = list(words)
    for _ in range(rng.randint(0, 3)):
        k = rng.randrange(len(out))
        rng.choice([lambda: out.__setitem__(k, rng.choice(vocabulary)), lambda: out.insert(k, rng.choice(vocabulary)), lambda: out.pop(k)])()
    return out


@pytest.mark.parametrize(("n", "threshold", "block"), [(3, 0.5, 2_000), (3, 0.5, 3), (5, 0.8, 2_000), (2, 0.6, 4)])
def test_groups_equal_brute_force(spark, monkeypatch, n, threshold, block):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)  # small blocks: hot n-grams are split
    rng = random.Random(n * 10 + block)
    vocabulary = [f"w{k}" for k in range(40)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 30))] for _ in range(12)]
    texts = {k: " ".join(edited(rng, rng.choice(bases), vocabulary)) for k in range(90)} | {200: None, 201: "", 202: "one two", 203: "one two", 204: "É é " * 9, 205: "é É " * 9}
    df = table(spark, list(texts.items()), "id long, t string")
    got = near_duplicates.near_duplicates(df, "id", F.col("t"), n, threshold).collect()
    assert len(got) == len(texts)
    made = {frozenset(r.id for r in got if r.group_id == g) for g in {r.group_id for r in got}}
    assert made == brute_groups(texts, n, threshold)
    pairs = {(r.id_a, r.id_b) for r in near_duplicates.group_pairs(near_duplicates.near_duplicates(df, "id", F.col("t"), n, threshold), "id").collect()}
    assert pairs == {p for g in made for p in itertools.combinations(sorted(g), 2)}


def test_near_duplicates_of_nothing_and_clashing_names(spark):
    schema = "id long, t string, grams string, cid long, n int, root string"
    assert near_duplicates.near_duplicates(table(spark, [], schema), "id", F.col("t")).count() == 0
    rows = [(1, "a b c d e f g", "x", 1, 1, "r"), (2, "a b c d e f g", None, None, None, None), (None, "a b c d e f g", None, None, None, None), (3, "b " * 20_000, None, None, None, None)]
    got = {r.id: (r.class_id, r.group_id) for r in near_duplicates.near_duplicates(table(spark, rows, schema), "id", F.col("t")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 3)}


def test_components(spark):
    chain = [(k, k + 1) for k in range(30)] + [(100, 101), (102, 101), (5, 5)]
    roots = {r.node: r.root for r in near_duplicates.components(table(spark, chain, "a long, b long")).collect()}
    assert {roots[k] for k in range(31)} == {0} and {roots[k] for k in (100, 101, 102)} == {100}
    assert near_duplicates.components(table(spark, [], "a long, b long")).count() == 0


# ---- quoted history

BODIES = [
    ("Hi Ann,\n\nnew line.\n\nBest,\nBob\nSales, Firm\n\nOn Tue, 1 Mar 2023 at 17:24, Ann A <a@x.example> wrote:\n> old\n> older", [1, 3]),
    ("Am 01.02.2024 um 10:00 schrieb Ann:\n> old\n\nanswer one\n\n> more old\n\nanswer two", [4, 8]),
    ("Text.\n\n-----Original Message-----\nFrom: A\nSent: today\nold text\nKind of old", [1]),
    ("To: be agreed, the price.\nSent from Lund by road, it takes 2 days.\n\nSent from my phone, please excuse typos", [1, 2]),
    ("Dear all,\nx\n\n-- \nAnn\n\nPS: one more thing\n\nCONFIDENTIALITY NOTICE: the contents may be privileged.", [1, 2, 7]),
    ("Le 10/02/2025 à 13:41, Ann A a écrit :\n| vieux\n|\n\nréponse", [5]),
    ("Ann wrote (8 August):\n\told\n\told too\n\nnew", [5]),
    ("With count>86 we are above plan.\n- 3 boxes at 5.00\n\nAnn B | Sales | Firm Ltd | 01 99 00 12 34", [1, 2]),
    ("JD> old text\nnew text", [2]),
    ("See below.\n\nFrom: Ann <a@x.example>\nSent: Monday\n\nCan you come?\n[Anna] Yes I can come.\nOr not?", [1, 7]),
    ("We need:\n\nParis\nLondon\nNew York", [1, 3, 4, 5]),
    ("All is well.\nThanks again for the help\nJohn Smith\nSales Manager", [1]),
    ("Thanks for the help.\n\nMore text follows here.", [1, 3]),
    ("x\n\nOn Tuesday the first of March of the year two thousand and twenty three, at four\no'clock in the afternoon, the very long winded and rather talkative gentleman\nby the name of Theodore Maximilian Featherstonehaugh the Third of that family\n<t@x.example> wrote:\n> old", [1]),
    ("", []),
    (None, []),
    ("\n \n", []),
    ("> only\n> quoted", []),
]


@pytest.mark.parametrize(("body", "lines"), BODIES)
def test_new_lines(body, lines):
    assert quoted_history.new_lines(body) == lines


def test_newly_written_table(spark):
    got = quoted_history.newly_written(table(spark, [(k, b, "x") for k, (b, _) in enumerate(BODIES)] + [(None, "a", "x"), (0, BODIES[0][0], "y")], "id long, body string, lines string"), "id", "body").collect()
    assert len(got) == len(BODIES) + 2 and {r.id: r.lines for r in got if r.id == 1} == {1: BODIES[1][1]}
    assert quoted_history.newly_written(table(spark, [], "id long, body string"), "id", "body").count() == 0


# ---- languages


def test_codewords_are_far_apart():
    for a, b in itertools.combinations(languages.CODES, 2):
        assert (a != b).sum() >= 8


@pytest.mark.parametrize(("label", "language"), [("EN", "en"), ("pt_BR", "pt"), ("deu", "de"), ("Spanish", "es"), ("hi-Latn", "hi-latn"), ("Hinglish", "hi-latn"), ("hi-IN", "hi"), ("n/a", None), ("", None), (None, None), ("xx", None), ("?", None), ("sv", "sv"), (" fr-CA ", "fr")])
def test_labels(spark, label, language):
    assert table(spark, [(label,)], "l string").select(languages.declared_language(F.col("l"))).first()[0] == language


HELD_OUT = [("en", "Could you please send me the report before the meeting starts?"), ("de", "Könnten Sie mir bitte den Bericht vor der Sitzung schicken?"), ("fr", "Pourriez-vous m'envoyer le rapport avant la réunion ?"), ("es", "¿Podrías enviarme el informe antes de la reunión?"), ("pt", "Você poderia me enviar o relatório antes da reunião?"), ("it", "Potresti mandarmi la relazione prima della riunione?"), ("nl", "Kunt u mij het verslag voor de vergadering sturen?"), ("hi", "क्या आप बैठक से पहले मुझे रिपोर्ट भेज सकते हैं?"), ("hi-latn", "Kya aap meeting se pehle mujhe report bhej sakte hain?")]


def test_languages_of_documents(spark):
    rows = [(f"r{k}", t, "en", "x") for k, (_, t) in enumerate(HELD_OUT)] + [("two", HELD_OUT[0][1] + "\n \n" + HELD_OUT[1][1] * 3, "de", None), ("none", None, None, None), ("blank", " \n ", "xx", None), ("long", HELD_OUT[2][1] * 3_000, None, None)]
    df = table(spark, rows, "id string, body string, label string, lang string")
    got = {(r.id, r.seg_no): r for r in languages.document_languages(df.select("id", "body", "label"), ["id"], "body", "label").collect()}
    assert [got[f"r{k}", 1].lang for k in range(9)] == [k for k, _ in HELD_OUT]
    assert (got["two", 0].lang, got["two", 1].lang, got["two", 2].lang, got["two", 0].declared) == ("de", "en", "de", "de")
    assert got["none", 0].lang is None and got["none", 0].confidence == 0 and got["blank", 0].declared is None and ("blank", 1) not in got
    assert got["long", 0].lang == "fr" and all(0 <= r.confidence <= 1 for r in got.values())
    assert languages.document_languages(df.where("false"), ["id"], "body", "label").count() == 0


def test_fitting_sees_whole_paragraphs(spark, monkeypatch):
    long = " ".join([languages.SEEDS["en"].strip()] * 12)
    seen, fit = [], languages.fit
    monkeypatch.setattr(languages, "fit", lambda texts, labels: (seen.extend(texts), fit(texts, labels))[1])
    languages.fit_on(table(spark, [(long, "en")], "t string, l string"), "t", "l")
    assert len(long) > 4_000 and long in seen


# ---- look-alikes


def test_one_form(spark):
    values = ["Paypal Bank", "PAYPAL", "Pаypаl Bаnk", "Ｐａｙｐａｌ Bank", "Pay​pal Bank", "Crédit", "Crédit", "Волна Paypal", "Paypal Волна", "", None, "рау", "x" * 50_000 + "а"]
    df = table(spark, [(k, v, "z") for k, v in enumerate(values)] + [(99, "Pаypаl Bаnk", "z")], "id int, v string, word string")
    got = {r.id: r.form for r in lookalikes.one_form(df, "v", table(spark, [("Paypal Bank",)], "w string")).collect()}
    assert len(got) == len(values) + 1
    assert {got[2], got[3], got[4], got[99]} == {"Paypal Bank"} and got[5] == "Crédit" and got[7] == "Волна Paypal" and got[9] == "" and got[10] is None
    assert got[11] == "рау"  # one script throughout, and no word of the corpus
    assert lookalikes.one_form(df.where("false"), "v").count() == 0


def test_repair_goes_to_the_script_of_the_token(spark):
    values = ["Москва", "Мoсква", "Moсква вечером", "ПОЧТА", "ПОЧТA", "Αθήνα", "Aθήνα", "xкx"]
    got = [r.form for r in lookalikes.one_form(table(spark, list(enumerate(values)), "id int, v string"), "v").orderBy("id").collect()]
    assert got == ["Москва", "Москва", "Москва вечером", "ПОЧТА", "ПОЧТА", "Αθήνα", "Αθήνα", "xкx"]


def test_same_face(spark):
    known = table(spark, [("n", 1, "Crédit Bank")], "field string, entry_id int, written string")
    values = ["Crédit Bank", "CRéDIT BANK", "Credit Bank", "Crédit Bаnk", "Crédit Bank", "Crédit Bank", "Crédit Bamk", "Čredit Bank"]
    df = table(spark, [(k, "n", v) for k, v in enumerate(values)], "id int, field string, value string")
    assert sorted(r.id for r in lookalikes.same_face(lookalikes.one_form(df, "value", known.select("written")), known).collect()) == [3, 4, 5]


# ---- personal information


def test_tagger_on_held_out_mails():
    tagger = personal.trained()
    right = wrong = missed = 0
    mails = [personal_table.mail(seed) for seed in range(70_000, 70_120)]
    for pieces, spans in zip(mails, tagger.decode(["".join(t for t, _ in p) for p in mails])):
        text = "".join(t for t, _ in pieces)
        want = {(k, t) for t, k in pieces if k}
        got = {(k, text[a:b]) for k, a, b in spans}
        right, wrong, missed = right + len(want & got), wrong + len(got - want), missed + len(want - got)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95


#: Mails of other wording, kinds and names than the table's, values marked.
MARKED = """
Dear [name:Siobhan Okonkwo-Reilly], please call [name:Wei Zhang] on [phone:020 7946 0018].
Madame [name:Élodie Lefèvre], [address:12 rue de la Paix, 75002 Paris]
[name:Jürgen Schäfer], [address:Hauptstraße 5, 10115 Berlin]
Hi [name:Priyanka],|[name:Oluwaseun] asked about the Toyota.|Thanks|[name:Oluwaseun]
We bought a Toyota and a Volvo in Paris.
Regards,|[name:Wei Zhang]|Office Manager, Brightwater Media Ltd|[email:wei.zhang@brightwater.example]|[address:14 Long Lane, Oxford OX1 2AB]
The nurse will see you on Tuesday at 09:45. If you can't come, ring us on [phone:(503) 555-0142] or write to [email:front.desk@clinic.example].
Minutes of 12 May: [name:Hannah Weiss] opened the meeting, [name:Tomasz Kowalski] took notes. Budget 2024: 12,500.00.
Your parcel 40321-99871-22010 is delayed in Leeds. Order QX-88120 follows.
Please courier the lease to [address:Flat 7, 21 Harbour Road, Bristol, BS1 4QA] by Friday.
Applicant [name:Fatima Haddad], passport number [id_number:XB1234567], arrives in March.
Her social security number [id_number:123-45-6789] is on the second page.
Best wishes,|[name:Chinedu]||On 3 Jun 2024 at 08:12, [name:Ingrid Hansen] <[email:ingrid@hansen-garden.example]> wrote:|> The roses are ready.
You can reach the caretaker under [email:caretaker (at) block-nine (dot) example] all week.
Lieber [name:Klaus],|der Zug nach Hamburg fährt um 10:15.|Viele Grüße|[name:Petra]
Acme Widgets Inc confirmed the price of 1,250.00 for 40 lamps from Dresden.
To: [name:Marta Lopes] <[email:marta.lopes@correio.example]>
"""  # fmt: skip


def test_tagger_on_other_wording():
    lines = [x.replace("|", "\n") for x in MARKED.strip().split("\n")]
    texts = [re.sub(r"\[\w+:([^\]]*)\]", r"\1", x) for x in lines]
    wanted = [set(re.findall(r"\[(\w+):([^\]]*)\]", x)) for x in lines]
    found = [{(k, t[a:b]) for k, a, b in spans} for t, spans in zip(texts, personal.trained().decode(texts))]
    right, given, got = sum(len(w & f) for w, f in zip(wanted, found)), sum(map(len, wanted)), sum(map(len, found))
    assert right / given >= 0.9 and right / got >= 0.9, [(w - f, f - w) for w, f in zip(wanted, found) if w != f]


def _joined(seeds: range) -> list[str]:
    return ["".join(t for t, _ in personal_table.mail(seed)) for seed in seeds]


def test_tagger_tags_batches_at_few_calls_a_text():
    """Counted calls stand for time, which no test can rely on: work is done by the row of texts, not by the text."""
    tagger, texts = personal.trained(), _joined(range(71_000, 71_256))
    apart = [tagger.decode([t])[0] for t in texts]
    profile = cProfile.Profile()
    assert profile.runcall(tagger.decode, texts) == apart
    assert pstats.Stats(profile).total_calls < 250 * len(texts)


def test_tagger_tries_forms_and_lines_wherever_they_can_begin():
    parts = "a@b.ex A@B.EX AB12@x.ex +44 (0 020 7946 0018 (503) 555-0142 503.555.0142 AB 12 34 56 C OX1 2AB 1234 12345 123456-1234 12:30 1.5.24 1,250.00 12AB3 É1 ² ٣٤٥٦٧ Thanks, Anna Mr Hi _ / # - -- > \n \n> \n\n \t \xa0 \r".split(" ")
    deal = random.Random(7)
    odd = [deal.choice(["", " "]).join(deal.choice(parts) for _ in range(deal.randint(1, 50))) for _ in range(600)]
    texts = [" \t", "\n", " Thanks,\nBest regards\n\n>  Anna\n", *odd, *(x.replace("|", "\n") for x in MARKED.split("\n") if x), *_joined(range(71_256, 71_300))]
    lexicon, cut = personal.Lexicon(), [personal.pieces_of(t) for t in texts]
    row = personal.Row(lexicon, texts, [lead for lead, _ in cut], [lexicon.ids([*xs, *personal.GAP])[0] for _, xs in cut])
    marked, tried = personal.marks(row), [set(x.tolist()) for x in personal._may_begin(row)]
    for k, text in enumerate(texts):
        places = range(row.first[k], row.first[k] + row.sizes[k])
        spans = personal.tokenize(text)
        assert spans == [(row.begins[p] - row.origin[k], row.ends[p] - row.origin[k]) for p in places]
        for p, (a, b) in zip(places, spans):
            plain = "@" not in text[a:b]
            assert all(p in at for form, at in zip(personal.FORMS, tried) if plain and form.match(text, a))
        for column, pattern in ((4, personal._after_closing), (5, personal._salutes)):
            found = [m.span(1) for m in pattern.finditer(text)]
            assert [marked[p, column] for p in places] == [any(x <= a < y for x, y in found) for a, _ in spans]


def test_redaction(spark):
    rows = [(1, "Re", "Hi Anna,\n\nAnna Berger (anna.berger@firm.example) will collect it.\nIf in doubt ring Anna on 01632 960345.", "x"), (2, None, "", "x"), (3, None, None, "x"), (1, "Re", "Nothing to see in Lowbridge, order AB-12345.", "x")]
    df = table(spark, rows, "id long, subject string, body string, found string")
    got = personal.personal_information(df, ["id"], ["subject", "body"]).collect()
    assert len(got) == 5  # null fields give no row
    first = next(r for r in got if r.field == "body" and "collect" in r.redacted)
    assert "anna.berger@firm.example" not in first.redacted and "[EMAIL]" in first.redacted and "[PHONE]" in first.redacted and "collect it" in first.redacted
    text = rows[0][2]
    assert all(text[f.start : f.start + len(f.value)] == f.value for f in first.found)
    assert next(r for r in got if "Lowbridge" in r.redacted).found == []
    assert personal.personal_information(df.where("false"), ["id"], ["body"]).count() == 0


# ---- encodings

CLEAN = ["El año del café en la ciudad", "Größer und schöner für alle", "L’été à la mer : des idées", "Não perca as histórias de hoje", "Crème brûlée — “first” choice, £15", "Привет всем друзьям", "plain text only"]


def test_damage_is_found_and_undone(spark):
    damaged = [c.encode("utf-8").decode("cp1252", "ignore") if k % 2 else c.encode("utf-8").decode("latin-1") for k, c in enumerate(CLEAN) if not c.isascii() and "Привет" not in c]
    rows = [(k, c) for k, c in enumerate(CLEAN * 40)] + [(1_000 + k, d) for k, d in enumerate(damaged)] + [(2_000, "El a�o"), (2_001, None), (2_002, ""), (2_003, "Größer und schöner für alle".encode().decode("mac_roman")), (2_004, "año " * 5_000)]
    got = {r.id: r for r in encodings.damaged_texts(table(spark, rows, "id int, t string"), ["id"], "t").collect()}
    assert not [k for k in got if k < 1_000] and not {2_001, 2_002, 2_004} & set(got)
    assert {1_000 + k for k in range(len(damaged))} | {2_000, 2_003} <= set(got)
    assert got[1_000].restored == CLEAN[0] and got[2_003].restored == "Größer und schöner für alle" and not got[2_000].whole
    assert encodings.damaged_texts(table(spark, [], "id int, t string"), ["id"], "t").count() == 0


@pytest.mark.parametrize("encoding", ["cp1252", "cp437", "mac_roman", "cp1251"])
def test_round_trips(encoding):
    table_ = {b: bytes([b]).decode(encoding, "ignore") or chr(b) for b in range(256)}
    for token in ("année", "größer", "história", "“first”"):
        broken = "".join(table_[b] for b in token.encode())
        assert token in encodings.rewritings(broken)


def test_margin_is_validated_on_all_clean_tokens(spark, monkeypatch):
    words = [f"caf\u00e9{a}{b}{c}" for a in "abcdefghijklm" for b in "abcdefghijklm" for c in "abcdefghijklm"] + ["\u00fcber" + "lang" * 12]
    df = table(spark, [(w,) for w in words * 3], "t string")
    asked, validated = [], encodings.validated_margin
    monkeypatch.setattr(encodings, "validated_margin", lambda model, clean: (asked.append((model, {r.w for r in clean.collect()})), validated(model, clean))[1])
    margin = encodings.fit(df, "t").margin
    (model, clean) = asked[0]
    assert clean == set(words) and len(clean) == 2_198
    damaged = {b for w in words for b in encodings.broken(w)} - clean
    model.best([*clean, *damaged])
    low, high = ([model.known[w][2] for w in kind if model.known[w][2] > -1e9] for kind in (clean, damaged))
    wrong = [sum(g > m for g in low) / max(1, len(low)) + sum(g <= m for g in high) / len(high) for m in encodings.MARGINS]
    best = [m for m, x in zip(encodings.MARGINS, wrong) if abs(x - min(wrong)) < 1e-6]
    assert margin == best[len(best) // 2]


# ---- leakage


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"v{k}" for k in range(60)] + ["the"] * 30
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40)))) for k in range(25)] + [(90, None), (91, "")]
    docs = []
    for k in range(120):
        words = [rng.choice(vocabulary) for _ in range(50)]
        if k % 3 == 0:
            source = rng.choice(items[:25])[1].split()
            size = rng.choice([11, 12, 13, 20])
            words[10:10] = source[:size]
        docs.append((k, (", " if k % 2 else " \n").join(words).upper()))
    docs += [(500, None), (501, ""), (None, items[3][1]), (502, "x " * 30_000)]
    windows = {}
    for k, t in items:
        w = (t or "").split()
        for i in range(len(w) - 11):
            windows.setdefault(tuple(w[i : i + 12]), set()).add(k)
    want = {(d, i) for d, t in docs if d is not None for w in [re.findall(r"[^\W_]+", (t or "").lower())] for at in range(len(w) - 11) for i in windows.get(tuple(w[at : at + 12]), ())}
    d, i = table(spark, docs, "doc_id long, text string"), table(spark, items, "item_id long, text string")
    got = leakage.leaked_items(d, "doc_id", "text", i, "item_id", "text").where("kind = 'phrase'").collect()
    assert want and {(r.doc_id, r.item_id) for r in got} == want
    assert leakage.leaked_items(d.where("false"), "doc_id", "text", i, "item_id", "text").count() == 0
    assert leakage.leaked_items(d, "doc_id", "text", i.where("false"), "item_id", "text").count() == 0


def test_proximity(spark):
    words = [f"u{k}" for k in range(30)]
    spread = words[:11] + ["zz"] + words[11:22] + ["yy"] + words[22:]
    r = leakage.leaked_items(table(spark, [(1, " ".join(spread))], "d long, text string"), "d", "text", table(spark, [(7, " ".join(words))], "i long, text string"), "i", "text").first()
    assert (r.kind, r.longest_run, r.near_words) == ("proximity", 11, 30)


def test_proximity_equals_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"v{k}" for k in range(40)] + ["the"] * 15
    items = [(k, [f"name{k}x{j}" if j % 6 == 0 else rng.choice(vocabulary) for j in range(rng.randint(12, 40))]) for k in range(12)]
    docs = []
    for k in range(90):
        source = items[k % 12][1]
        copy = [f"other{k}" if w.startswith("name") else w for w in source]  # the rarest words, two to a window, were changed
        for _ in range(rng.randint(0, 5)):
            copy.insert(rng.randrange(len(copy)), rng.choice(vocabulary))
        docs.append((k, [rng.choice(vocabulary) for _ in range(20)] + copy + [rng.choice(vocabulary) for _ in range(20)]))
    want = {}
    for d, w in docs:
        for i, ws in items:
            exact = {(p - o, o) for o, x in enumerate(ws) for p, y in enumerate(w) if x == y}
            near = max((len({o for q, o in exact if abs(q - place) <= leakage.SLOP}) for place, _ in exact), default=0)
            run = max((next(n for n in itertools.count() if (place, o + n) not in exact) for place, o in exact), default=0)
            if run >= 12 or near >= 12 and 10 * near >= 6 * len(ws):
                want[d, i] = (run, near, "phrase" if run >= 12 else "proximity")
    table_of = lambda rows, k: table(spark, [(i, " ".join(ws)) for i, ws in rows], f"{k} long, text string")
    d, i = table_of(docs, "doc_id"), table_of(items, "item_id")
    got = {(r.doc_id, r.item_id): (r.longest_run, r.near_words, r.kind) for r in leakage.leaked_items(d, "doc_id", "text", i, "item_id", "text").collect()}
    assert got == want and sum(v[2] == "proximity" for v in want.values()) > 20
    phrases = {tuple(r) for r in leakage.leaked_phrases(d, "doc_id", "text", i, "item_id", "text").collect()}
    assert phrases == {k for k, v in want.items() if v[2] == "phrase"}


# ---- mixture


@pytest.mark.parametrize("bucket", [20_000, 7])
def test_mixture_reaches_its_shares(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixture, "BUCKET", bucket)
    docs = [(k, "word " * (1 + k % 30), [" A", "b", "B ", "c", None, "other"][k % 6]) for k in range(1_200)] + [(5_000, None, "a"), (5_001, "", "b"), (None, "x", "a")]
    df = table(spark, docs, "id long, text string, source string")
    targets = table(spark, [("a", 0.5, 1), ("b", 0.3, 1), ("c", 0.2, 3), ("empty", 0.1, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = mixture.mix(df, "id", "text", "source", targets).collect()
    per = {}
    for r in mixed:
        per.setdefault(r.source, []).append(r)
    assert set(per) == {"a", "b", "c"}
    total = sum(r.tokens for r in mixed)
    for source, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(sum(r.tokens for r in per[source]) - share * total) < 40
    uses = {}
    for r in mixed:
        uses[r.source, r.id] = uses.get((r.source, r.id), 0) + 1
    assert all(n <= (3 if s == "c" else 1) for (s, _), n in uses.items())
    again = {(r.id, r.epoch) for r in mixture.mix(df.repartition(7), "id", "text", "source", targets).collect()}
    assert again == {(r.id, r.epoch) for r in mixed}  # the same however the table is partitioned
    assert mixture.mix(df.where("false"), "id", "text", "source", targets).count() == 0
    reported = {r.source: r for r in mixture.shares(mixture.mix(df, "id", "text", "source", targets), "id", targets).collect()}
    assert abs(reported["a"].actual_share - 0.5) < 0.01 and reported["empty"].tokens == 0


# ---- quality

PROSE = "When the office moved last spring, nobody thought of the old rules. The notice that we received on Monday asked for a card, and she said that it felt familiar. We do not know who wrote it, but the wording is close to what they saw last year. If the page is real, a call to the number on the letter will confirm it."


def test_lines_of_lists_tables_and_wrapped_prose():
    import textwrap

    assert quality.line_shares("\n".join(textwrap.wrap(PROSE, 30)))[1] == 0
    assert quality.line_shares("> " + "\n> ".join(textwrap.wrap(PROSE, 40)))[1] == 0
    assert quality.line_shares("To do\n- call the bank\n* 3 boxes\n1. pay\n[ ] reply")[1] == 1
    assert quality.line_shares("Body: a note\nHeader: 3 boxes\nhttps://a.example/x\ncall facilities\nMonday 17:45")[1] == 1
    for sep in (";", "\t", " | "):
        assert quality.line_shares("\n".join(sep.join(["a", str(k), "c"]) for k in range(9)))[2] == 1
    assert quality.line_shares("\n".join(f"{f'x{k}':<16}{'town':<16}{k}" for k in range(9)))[2] == 1


def test_kinds(spark):
    rng = random.Random(2)
    sentences = re.split(r"(?<=\.) ", PROSE)
    docs = [(k, " ".join(rng.sample(sentences, len(sentences))) + f" It took {k} days.", "en") for k in range(300)]
    odd = {1_000: ("list", "\n".join(f"- item {k} from town" for k in range(14))), 1_001: ("table", "\n".join(f"{k};abc;{k * 7}" for k in range(14))), 1_002: ("junk", "free " * 80), 1_003: ("junk", "$%^&*!@ #~ " * 30), 1_004: ("junk", " ".join("".join(rng.choice("bcdfghjklmnp") for _ in range(7)) for _ in range(60))), 1_005: ("prose", PROSE.upper()), 1_006: ("prose", None), 1_007: ("prose", " \n")}
    rows = docs + [(k, t, None if k == 1_005 else "en") for k, (_, t) in odd.items()]
    got = {r.id: r for r in quality.text_quality(table(spark, rows, "id long, text string, lang string"), "id", "text", "lang").collect()}
    assert {k: got[k].kind for k in odd} == {k: v for k, (v, _) in odd.items()}
    assert sum(got[k].kind != "prose" for k in range(300)) == 0
    r = got[1_002]
    assert abs(sum(r.contributions.values()) - r.distance) < 1e-6 and set(r.contributions) == set(quality.STATISTICS)
    assert quality.text_quality(table(spark, [], "id long, text string, lang string"), "id", "text", "lang").count() == 0


def test_every_labelled_document_validates_the_threshold(spark):
    import numpy as np

    rng = random.Random(0)
    sentences = re.split(r"(?<=\.) ", PROSE)
    rows = [(k, " ".join(rng.sample(sentences, 2)) + " #" * (4 * rng.randrange(40) if k % 4 == 0 else 0), "en") for k in range(6_000)]
    rng = random.Random(0)
    judged = [(k, "junk" if rng.random() < t.count("#") / 640 else "prose") for k, t, _ in rows]  # errors on both sides of every distance
    judged += [judged[7], (8, "junk"), (8, "prose"), (9, "junk"), (9, "table"), (10, None), (None, "junk"), (7_000, "junk")]  # repeated, both ways, of nothing
    got = quality.text_quality(table(spark, rows, "id long, text string, lang string"), "id", "text", "lang", table(spark, judged, "id long, kind string")).collect()
    distance = {r.id: r.distance for r in got}
    sides = {(k, kind == "prose") for k, kind in judged if kind and k in distance}
    prose, rest = (np.array([distance[k] for k, p in sides if p is side]) for side in (True, False))
    candidates = np.exp(np.linspace(np.log(15), np.log(400), 60))
    wrong = np.array([(prose > t).mean() + (rest <= t).mean() for t in candidates])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    threshold = candidates[best[len(best) // 2]]
    assert len(prose) + len(rest) > 6_000
    assert all((r.kind == "prose") == (r.distance <= threshold) for r in got)


def test_samples_don_t_depend_on_partitions(spark):
    df = spark.range(5_000).select(F.col("id"), (F.col("id") * 7).alias("x"))
    a, b = some_rows(df, 50), some_rows(df.repartition(13), 50)
    assert len(a) == 50 and a == b and len(some_rows(df.limit(20), 50)) == 20
