"""Personal information in free text: a linear-chain conditional random field, decoded by Viterbi in numpy batches.

Features are word shapes, affixes, a few word lists and the words of the small labelled table itself, of the token and
of its two neighbours on each side; and, of the token and its two next neighbours, marks that depend on the text: line
ends, forms of values (where a run of characters that could be a mail address, a phone number and so on begins, goes on
and has ended), cues nearby, and words that the text itself shows to be names. All features of a token type are summed once into
its emission scores at the five window positions, so decoding a token costs five table rows and one small product.

The spans are those of the best path; what is not part of a value is left out by the labels that the table gives.

Texts are read as pieces, a token with the blanks after it, which a dictionary numbers; all that depends on a piece alone is
computed once, positions are sums of lengths, and texts of like length lie in a row, some empty places apart, for numpy."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread
from .personal_table import DAYS, FIRM_NOUNS, GIVEN, MONTHS, labelled

KINDS = ("email", "phone", "id_number", "address", "name")
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
#: Mails in the labelled table, passes of training.
TABLE, STEPS = 1_000, 60
#: Tokens that lie in one sequence in training, about.
STRETCH = 64
#: Weight of the squared weights in training.
PENALTY = 1e-4
#: A word of the table counts as known from so many places on.
KNOWN = 20
WINDOW = (-2, -1, 0, 1, 2)
#: Empty places after each text; no feature looks further.
GAP = [""] * 6
#: Pieces that a tagger remembers; texts, and places, that lie side by side in one row; places scored at a time.
REMEMBERED, ABREAST, PLACES, BLOCK = 200_000, 128, 1 << 16, 1 << 12

# Words that say what stands beside them.
CUES = {
    "title": "mr ms mrs miss mx dr prof herr frau mme m sr sra madame monsieur señor señora",
    "street": "lane street road close mews hill gardens terrace court drive place way row square crescent st ave avenue blvd run rd ln rue quai boulevard chemin allée flat apt apartment unit suite calle avenida plaza via viale corso piazza rua weg allee straße bis",
    "phone": "tel t mobile mob phone call ring fax m ext x telephone cell handy direct",
    "id": "passport insurance ssn security licence license identity permit id ni national personal social",
    "firm": "ltd sons co daughters gmbh inc works llc plc bv ag sa",
    "greeting": "hi hello dear hallo hey hola ciao bonjour olá",
    "preposition": "in to from for at near via",
    "company": "with by and",
}
FOREIGN = frozenset("rue avenue quai place boulevard chemin allée calle via straße weg".split())
# Phrases that close a letter, a name following.
CLOSING = (
    r"(?:all the |all )?best(?: regards| wishes)?|(?:kind|kindest|warm|with kind) regards|regards|yours(?: sincerely| faithfully| truly)?|sincerely|cheers|(?:many |with )?thanks|thank you|br|rgds|warmly|take care|"
    r"(?:bien )?cordialement|bien à vous|merci|mit (?:freundlichen|besten) grüßen|(?:viele|beste|liebe|herzliche) grüße|gruß|vg|lg|mfg|saludos(?: cordiales)?|un (?:abrazo|saludo)|atentamente|gracias|cumprimentos|obrigad[oa]|"
    r"cordiali saluti|distinti saluti|grazie|met vriendelijke groet(?:en)?|groet(?:en|jes)?|bedankt|--"
)
_mail, _plain_token = r"(?<![\w.%+-])[\w.%+-]++@[\w-]+(?:\.[\w-]+)+", r"[^\W\d_]+|\d+|\n|[^\w\s]|_"
_token = re.compile(rf"{_mail}|{_plain_token}")
_piece, _mail_piece = re.compile(rf"(?:{_plain_token})[^\S\n]*+|[^\S\n]++"), re.compile(rf"(?:{_mail}|{_plain_token})[^\S\n]*+|[^\S\n]++")
_gap = r"(?: ?\n[>| \t]*| )?"  # values may be broken at a space, with the marks of a quotation
_spelled = rf"(?<![\w.%+-])[\w.%+-]++(?:{_gap}[(\[{{]at[)\]}}]{_gap}[\w-]++(?:(?:\.|{_gap}[(\[{{]dot[)\]}}]{_gap})[\w-]++)+|{_gap}\bat\b{_gap}[\w-]++(?:{_gap}\bdot\b{_gap}[\w-]++)+)"
SPELLED = re.compile(_spelled, re.I)
_at = re.compile(r"[(\[{]at[)\]}]|\bdot\b", re.I)
#: What a value may look like, several forms for one kind; none decides, each is a feature.
FORMS = [
    re.compile(_mail),
    re.compile(rf"(?<![\w./-])(?:\+|\(0|00?(?=[1-9]))\(?\d(?:[().\-/]|{_gap}[\d(]){{5,}}(?<=\d)(?:{_gap}(?:ext\.?|x){_gap}\d+)?(?!-?\w)", re.I),
    re.compile(rf"(?<![\w./-])\(?\d{{3}}\)?[.\- ]{_gap}\d{{3}}[.-]\d{{4}}(?:{_gap}(?:ext\.?|x){_gap}\d+)?(?!-?\w)", re.I),
    re.compile(rf"(?<![\w/#-])(?:[A-Z]{{2}}{_gap}\d{{2}}{_gap}\d{{2}}{_gap}\d{{2}}{_gap}[A-D]|[A-Z]{{0,5}}\d[A-Z0-9]{{4,}}(?:-[A-Z0-9]+)*|\d{{3}}[- ]{_gap}\d{{2}}[- ]{_gap}\d{{4}}|\d{{6}}[- ]{_gap}\d{{4}})(?!-?\w)"),
    re.compile(rf"(?<![\w/#-])(?:[A-Z]{{1,2}}\d{{1,2}}[A-Z]?{_gap}\d[A-Z]{{2}}|[A-Z]{{2}}{_gap}\d{{5}}|\d{{5}}|\d{{4}}{_gap}[A-Z]{{2}}|\d{{4}}-\d{{3}})(?![\w-])"),
    re.compile(r"\d{4,5}(?:-\d{3,5}){2,}|\d[\d,]*\.\d{2}\b|\d{1,2}:\d{2}|\d{1,2}[./-]\d{1,2}[./-]\d{2,4}"),
]
_case_lists = {"given": frozenset(g.lower() for g in GIVEN), "month": frozenset(m.lower() for m in MONTHS), "day": frozenset(d.lower() for d in DAYS), "trade": frozenset(t.lower() for t in FIRM_NOUNS)}
_cue = {w: k for k, v in CUES.items() for w in v.split()}


_span = re.Match.span


def tokenize(text: str) -> list[tuple[int, int]]:
    return list(map(_span, _token.finditer(text)))


def pieces_of(text: str) -> tuple[int, list[str]]:
    """How many blanks a text begins with, and its tokens, each with the blanks after it. Addresses are looked for only in
    lines with an @."""
    out: list[str] = []
    at = 0
    while (mail := text.find("@", at)) >= 0:
        begin, end = max(text.rfind("\n", at, mail), at), text.find("\n", mail)
        if begin > at:
            out += _piece.findall(text, at, begin)
        at = end if end >= 0 else len(text)
        out += _mail_piece.findall(text, begin, at)
    out += _piece.findall(text, at)
    if out and out[0].isspace() and out[0][0] != "\n":
        return len(out[0]), out[1:]
    return 0, out


def _shape(token: str) -> str:
    if "@" in token and len(token) > 1:
        return "mail"
    if token.isdigit():
        return f"d{min(len(token), 9)}"
    if token.isalpha():
        return "X" if len(token) == 1 and token.isupper() else "XX" if token.isupper() else "Xx" if token[0].isupper() else "x"
    return token


def features(token: str, known: frozenset[str]) -> list[str]:
    """Features of a token type; words themselves count only if the table has them outside its values."""
    low = token.lower()
    names = [f"s={_shape(token)}"]
    if token.isalpha():
        names.append(f"s2={low[-2:]}|{_shape(token)}")
        if token[0].isupper():
            names.append(f"given={low in _case_lists['given']}")
        if low.endswith(("weg", "straße", "allee", "gasse", "platz", "straat", "laan", "gracht", "plein")):
            names.append("streetend")
    if low in known or len(token) == 1:
        names.append(f"w={low}")
    elif token.isalpha():
        names.append(f"rare={_shape(token)}")
    names += [k for k in ("month", "day", "trade") if low in _case_lists[k]]
    if low in _cue:
        names.append(f"cue={_cue[low]}")
    return names


@lru_cache(100_000)
def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower().replace("ø", "o").replace("ß", "ss").replace("æ", "ae")) if not unicodedata.combining(c))


_spelled_local = re.compile(r"(?<![\w.%+-])([\w.%+-]++)\s?[(\[{]at[)\]}]", re.I)
_split = re.compile(r"[.+_%-]")
_xx = r"[^\W\d_a-zß-öø-ÿ][^\W\d_]+"
_lines = re.compile(
    rf"(?m)^[>| \t]*(?:(?:[Hh]i|[Hh]ello|[Dd]ear|[Hh]allo|[Hh]ey|[Bb]onjour|[Hh]ola|[Cc]iao|[Oo]lá)[ ]+(?:(?:Mr|Mrs|Ms|Mx|Dr|Prof)\.?[ ]+)?|(?:From|To|Von|An|De|À|Van|Aan|Cc):[ ])((?:{_xx}[ ]?){{1,3}})[,:]?$"
)
_named_before = re.compile(r"<|\[mailto|\((?=[\w.+%-]+@)|wrote\b|a écrit|escribió|ha scritto|escreveu|schreef\b")
_named_after = re.compile(rf"(?:schrieb|schreef)[ ]+((?:{_xx}[ ]?){{1,3}}):")
_last_words = re.compile(rf"(?:{_xx}[ ]+){{1,3}}$")
#: A text with none of them, and no bracket beside an @, has no match of the pattern.
_NAMED_BEFORE = ("<", "[mailto", "wrote", "a écrit", "escribió", "ha scritto", "escreveu", "schreef")


def shown_names(text: str, lines: list[str]) -> set[str]:
    """Words that a text itself shows to be names: beside an address, after a greeting, before "wrote", in a header;
    ``lines`` are those of the greetings and headers."""
    found = lines + [m[1] for m in _named_after.finditer(text)]
    if "(" in text and "@" in text or any(x in text for x in _NAMED_BEFORE):
        found += [w[0] for m in _named_before.finditer(text) if (w := _last_words.search(text, max(0, m.start() - 80), m.start()))]
    return {w.lower() for x in found for w in _word.findall(x) if len(w) > 1}


_word = re.compile(r"[^\W\d_]+")
_after_closing = re.compile(rf"(?im)^[>| \t]*(?:{CLOSING})[ ]*[,.!]?[ ]*\n(?:[>| \t]*\n)*([^\n]+)$")
_salutes = re.compile(rf"(?m)^[>| \t]*((?:{_xx}[ ]?){{1,2}})[,:]?[ ]*$")
#: Marks of a token; they count at the token and at its two neighbours.
MARKS = ["starts", "ends", "mailed", "shown", "after_closing", "salutes", *(f"{p}{k}" for k in range(len(FORMS)) for p in "bie"), "id_before", "street_near", "in_firm", "title_before"]
BESIDE = WINDOW


#: Properties of a token type, as bits.
NEWLINE, QUOTE, CAPITAL, STREET, FIRM, ID, TITLE, JOINS, LETTERS, OPENING, ZERO, DIGITS, LONG, CAPS, POINT, HEAD, AFTER_WORD, AFTER_HASH = (1 << k for k in range(18))
#: Bit of a token that, by itself, may begin the form.
BEGINS = [1 << (18 + k) for k in range(len(FORMS))]
_begins = [re.compile(p) for p in (r"(?!)", r"[+(]|0\d*", r"\(|\d{3}", r"[A-Z]{1,5}|\d+", r"[A-Z]{1,2}|\d{4,5}", r"\d+")]
_long = re.compile(r"\d{3}|\d{5,}")
STREET_ENDS = ("straße", "gasse", "allee", "straat", "laan", "gracht", "weg", "platz", "plein")
#: Tokens of the longest line that closes, greets, salutes or heads (a greeting, a title and its point, three names, a mark).
SHORT_LINE = 7


def properties(token: str) -> int:
    low, capital = token.lower(), token[0].isupper()
    cue = _cue.get(low, "")
    street = cue == "street" and (low in FOREIGN or capital and not (len(token) > 1 and token.isupper())) or low.endswith(STREET_ENDS)
    firm = capital and (cue == "firm" or low in _case_lists["trade"])
    mail, last = "@" in token and len(token) > 1, token[-1]
    word = last.isalnum() or last == "_"
    flags = {
        NEWLINE: token == "\n", QUOTE: token in ">|", CAPITAL: capital, STREET: street, FIRM: firm, ID: cue == "id", TITLE: cue == "title", JOINS: token in "&-",
        LETTERS: not mail and _word.match(token), OPENING: token == "(", ZERO: token[0] == "0", DIGITS: token.isdecimal(), LONG: _long.fullmatch(token),
        CAPS: token.isupper(), POINT: token in "-,.:/", HEAD: _word.match(token) or token == "-", AFTER_WORD: word or last in "./-", AFTER_HASH: word or last in "/#-",
    }
    # an address in capitals or after digits may begin with another form
    other = mail and (token[0].isdigit() or token.isupper())
    begins = [mail, *(other and form.match(token) or begin.fullmatch(token) for form, begin in zip(FORMS[1:], _begins[1:]))]
    return sum(bit for bit, so in [*flags.items(), *zip(BEGINS, begins)] if so)


class Lexicon:
    """Numbers of pieces, and of each number the properties and the sizes of token and piece; 0 is an empty place."""

    def __init__(self) -> None:
        self.index: defaultdict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.index[""]
        self.kinds, self.sizes = np.array([NEWLINE], np.int32), np.array([[0, 1]])

    def ids(self, cut: list[str]) -> tuple[np.ndarray, list[str]]:
        """The numbers of the pieces, and the tokens of those that are new."""
        ids = np.fromiter(map(self.index.__getitem__, cut), np.int64, len(cut))
        new = list(self.index)[len(self.kinds) :] if len(self.index) > len(self.kinds) else []
        tokens = [p.rstrip() or "\n" for p in new]
        if new:
            self.kinds = np.concatenate([self.kinds, np.array([properties(t) for t in tokens], np.int32)])
            self.sizes = np.concatenate([self.sizes, np.array([(len(t), len(p)) for t, p in zip(tokens, new)])])
        return ids, tokens


class Row:
    """Texts in a row, each with empty places after it: numbers and positions of their tokens. ``begins`` and ``ends`` count
    through the whole row, the k-th text's characters from ``origin[k]``."""

    def __init__(self, lexicon: Lexicon, texts: list[str], leads: list[int], ids: list[np.ndarray]):
        self.texts, self.ids = texts, np.concatenate(ids)
        self.sizes = np.array([len(i) - len(GAP) for i in ids])
        self.first = np.cumsum(self.sizes + len(GAP)) - self.sizes - len(GAP)
        self.owner = np.repeat(np.arange(len(texts)), self.sizes + len(GAP))
        self.kinds = lexicon.kinds[self.ids]
        token, whole = lexicon.sizes[self.ids].T
        self.begins = np.cumsum(whole) - whole
        self.ends = self.begins + token
        self.origin = self.begins[self.first] - leads


def _near(flag: np.ndarray, before: int, after: int) -> np.ndarray:
    """Whether one of so many tokens before or after has the flag."""
    total = np.zeros(len(flag) + 1, np.int32)
    np.cumsum(flag, out=total[1:])
    at = np.arange(len(flag))
    return total[np.minimum(at + after + 1, len(flag))] > total[np.maximum(at - before, 0)]


def _may_begin(row: Row) -> list[np.ndarray]:
    """For each form, the places where it can match at all: tokens that may begin it, beside what it needs there."""
    kinds = row.kinds
    touches = row.ends[:-1] == row.begins[1:]
    then, joined = np.append(kinds[1:], 0), np.append(np.where(touches, kinds[1:], 0), 0)
    behind = np.append(0, np.where(touches, kinds[:-1], 0))
    letters, digits = (kinds & LETTERS) > 0, (kinds & DIGITS) > 0
    bare = letters & ((then & (DIGITS | NEWLINE)) == 0)
    in_word, in_hash = (behind & AFTER_WORD) > 0, (behind & AFTER_HASH) > 0
    out_of_place = [
        np.zeros(len(kinds), bool),
        in_word | ((kinds & OPENING) > 0) & ((joined & ZERO) == 0),
        in_word,
        in_hash | bare | digits & ((kinds & LONG) == 0) & ((joined & CAPS) == 0),
        in_hash | bare,
        digits & ((joined & POINT) == 0),
    ]
    return [np.flatnonzero(((kinds & bit) > 0) & ~x) for bit, x in zip(BEGINS, out_of_place)]


def marks(row: Row) -> np.ndarray:
    """The marks of each token of a row of texts: starts a line (quotation marks apart) or ends one; recurs in a mail
    address or where the text shows a name; begins, goes on or follows a form; has cues nearby."""
    kinds, texts, origin = row.kinds, row.texts, row.origin
    n = len(kinds)
    out = np.zeros((n, len(MARKS)), np.float32)
    newline = (kinds & NEWLINE) > 0
    solid = (kinds & (NEWLINE | QUOTE)) == 0
    before = np.cumsum(solid) - solid
    out[:, 0] = before == np.maximum.accumulate(np.where(newline, before, 0))
    out[:-1, 1] = newline[1:]

    # stretches of the texts by column: closings and salutations, and the forms of values
    found: list[tuple[int, int, int]] = []
    lines: dict[int, list[str]] = {}
    breaks = np.flatnonzero(newline)
    heads = np.flatnonzero((out[:, 0] > 0) & ((kinds & HEAD) > 0))
    heads = heads[breaks[np.searchsorted(breaks, heads)] - heads <= SHORT_LINE]
    last = np.searchsorted(breaks, heads) - 1
    owner = row.owner[heads]
    line = np.where((last >= 0) & (breaks[last] >= row.first[owner]), row.begins[breaks[last]] + 1 - origin[owner], 0)
    closed = (-1, 0)
    for k, at, base in zip(owner.tolist(), line.tolist(), origin[owner].tolist()):
        text = texts[k]
        if (k, at) >= closed and (m := _after_closing.match(text, at)):
            closed = (k, m.end())
            found.append((0, base + m.start(1), base + m.end(1)))
        if m := _salutes.match(text, at):
            found.append((1, base + m.start(1), base + m.end(1)))
        if m := _lines.match(text, at):
            lines.setdefault(k, []).append(m[1])
    locals_: dict[int, list[str]] = {}
    for column, (form, places) in enumerate(zip(FORMS, _may_begin(row)), 2):
        end = 0
        owner = row.owner[places]
        for k, at, base in zip(owner.tolist(), row.begins[places].tolist(), origin[owner].tolist()):
            if at >= end and (m := form.match(texts[k], at - base)):
                end = base + m.end()
                found.append((column, at, end))
                if column == 2:
                    locals_.setdefault(k, []).append(m[0].partition("@")[0])
    for k, (text, base) in enumerate(zip(texts, origin.tolist())):
        low = text.lower()
        if ("dot" in low or "(at" in low or "[at" in low or "{at" in low) and _at.search(text):
            spelled = list(SPELLED.finditer(text))
            found += [(2, base + m.start(), base + m.end()) for m in spelled]
            locals_[k] = locals_.get(k, []) + [m[0].partition("@")[0] for m in spelled] + _spelled_local.findall(text)
    if found:
        column, begins, ends = np.array(found).T
        first, last = np.searchsorted(row.begins, begins), np.searchsorted(row.begins, ends)
        inside = np.zeros((n + 2, len(FORMS) + 2), np.int32)
        form = column > 1
        some = first < last
        np.add.at(inside, ((first + form)[some], column[some]), 1)
        np.add.at(inside, (last[some], column[some]), -1)
        covered = np.cumsum(inside[:n], axis=0, dtype=np.int32) > 0
        out[:, 4:6] = covered[:, :2]
        out[:, 7 : 6 + 3 * len(FORMS) : 3] = covered[:, 2:]
        out[first[some & form], 6 + 3 * (column[some & form] - 2)] = 1
        after = some & form
        out[last[after], 8 + 3 * (column[after] - 2)] = 1

    capital = (kinds & CAPITAL) > 0
    capitals = np.flatnonzero(capital)
    cuts = np.searchsorted(capitals, row.first).tolist() + [len(capitals)]
    for k, text in enumerate(texts):
        parts = {p for x in locals_.get(k, ()) for p in _split.split(x.lower()) if len(p) > 2}
        parts |= {p[1:] for p in parts}
        shown = shown_names(text, lines.get(k, []))
        if parts or shown:
            here = capitals[cuts[k] : cuts[k + 1]]
            named = [(at, text[a:b]) for at, a, b in zip(here.tolist(), (row.begins[here] - origin[k]).tolist(), (row.ends[here] - origin[k]).tolist())]
            out[[at for at, t in named if len(t) > 2 and _plain(t) in parts], 2] = 1
            out[[at for at, t in named if t.lower() in shown], 3] = 1
    runs = capital | ((kinds & JOINS) > 0)
    for k in np.flatnonzero(kinds & FIRM).tolist():
        out[k, -2] = 1
        while k and runs[k - 1]:  # the run of words that ends in it
            k -= 1
            out[k, -2] = 1
    for column, kind, back, ahead in ((-4, ID, 6, -1), (-3, STREET, 6, 4), (-1, TITLE, 2, -1)):
        out[:, column] = _near((kinds & kind) > 0, back, ahead)
    out[row.ids == 0] = 0
    return out


def beside(out: np.ndarray) -> np.ndarray:
    """Marks of each token and of its neighbours side by side."""
    n, width = out.shape
    wide = np.zeros((n, len(BESIDE) * width), np.float32)
    for k, shift in enumerate(BESIDE):
        m = n - abs(shift)
        if m > 0:
            to, at = (slice(0, m), slice(shift, None)) if shift >= 0 else (slice(-shift, None), slice(0, m))
            wide[to, k * width : (k + 1) * width] = out[at]
    return wide


class Tagger:
    """Weights of the field; ``rows`` remembers the emission scores of pieces, about 200,000 at a time."""

    def __init__(self, numbers: dict[str, int], weights: np.ndarray, flag_weights: np.ndarray, step: np.ndarray, known: frozenset[str]):
        self.numbers, self.weights, self.flag_weights, self.step, self.known = numbers, weights, flag_weights, step, known
        self._reset()

    def _reset(self) -> None:
        self.lexicon = Lexicon()
        self.rows = np.zeros((1, len(WINDOW), len(TAGS)), np.float32)

    def __getstate__(self) -> dict:
        return {"numbers": self.numbers, "weights": self.weights, "flag_weights": self.flag_weights, "step": self.step, "known": self.known}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._reset()

    def types(self, cut: list[str]) -> np.ndarray:
        ids, new = self.lexicon.ids(cut)
        if new:
            # a feature that the table lacks says nothing
            made = np.stack([self.weights[:, [n for x in features(t, self.known) if (n := self.numbers.get(x)) is not None]].sum(1) for t in new]).astype(np.float32)
            self.rows = np.concatenate([self.rows, made])
        return ids

    def emissions(self, row: Row) -> np.ndarray:
        """Scores of the tags at each place: what each token and its marks say of the places around it, added up."""
        n, marked = len(row.ids), marks(row)
        weights = self.flag_weights.reshape(len(BESIDE), len(MARKS), len(TAGS)).transpose(1, 0, 2).reshape(len(MARKS), -1)
        out = np.zeros((n, len(TAGS)), np.float32)
        for a in range(0, n, BLOCK):
            said = self.rows[row.ids[a : a + BLOCK]]
            said += (marked[a : a + BLOCK] @ weights).reshape(said.shape)
            for k, shift in enumerate(WINDOW):
                first, last = max(a, shift), min(a + len(said), n + shift)
                if first < last:
                    out[first - shift : last - shift] += said[first - a : last - a, k]
        return out

    def decode(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Spans (kind, start, end) of each text: the best path of tags, texts of like length side by side."""
        if len(self.lexicon.index) > REMEMBERED:
            self._reset()
        cut = [pieces_of(t) for t in texts]
        flat = self.types([x for _, xs in cut for x in (*xs, *GAP)])
        sizes = [len(xs) for _, xs in cut]
        cuts = np.cumsum([0, *(n + len(GAP) for n in sizes)])
        found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        order = sorted((i for i in range(len(texts)) if sizes[i]), key=sizes.__getitem__)
        at = 0
        while at < len(order):
            part = order[at : at + ABREAST]
            while len(part) > 1 and len(part) * sizes[part[-1]] > PLACES:
                part = part[: len(part) // 2]
            at += len(part)
            row = Row(self.lexicon, [texts[i] for i in part], [cut[i][0] for i in part], [flat[cuts[i] : cuts[i + 1]] for i in part])
            for k, kind, begin, end in _spans(self._best(self.emissions(row), row), row):
                found[part[k]].append((kind, begin, end))
        return found

    def _best(self, score: np.ndarray, row: Row) -> np.ndarray:
        """The best path of tags of each text, by place; texts lie by length, so those still going at a step are the last ones."""
        count, longest = len(row.sizes), int(row.sizes[-1])
        place = np.flatnonzero(row.ids)
        step_at, text = place - row.first[row.owner[place]], row.owner[place]
        best = np.zeros((longest, len(TAGS), count), np.float32)
        best[step_at, :, text] = score[place]
        best[0] += self.step[-1][:, None]
        going = np.searchsorted(row.sizes, np.arange(longest + 1), side="right").tolist()
        steps = self.step[:-1, :, None]
        for t in range(1, longest):
            best[t, :, going[t] :] += (best[t - 1, :, None, going[t] :] + steps).max(0)
        path = np.zeros((longest, count), np.int8)
        for t in range(longest - 1, -1, -1):
            ends, on = going[t], going[t + 1]
            if on > ends:
                path[t, ends:on] = best[t, :, ends:on].argmax(0)
            if on < count:
                path[t, on:] = (best[t, :, on:] + self.step[:-1][:, path[t + 1, on:]]).argmax(0)
        out = np.zeros(len(score), np.int8)
        out[place] = path[step_at, text]
        return out


def _spans(path: np.ndarray, row: Row) -> Iterator[tuple[int, str, int, int]]:
    """Text, kind, start and end of each value: a token goes on with the value before if that has its kind."""
    kind = np.where(path > 0, (path - 1) // 2, -1)
    goes_on = (path > 0) & (path % 2 == 0) & (kind == np.append(-1, kind[:-1]))
    first = np.flatnonzero((path > 0) & ~goes_on)
    last = np.flatnonzero((path > 0) & ~np.append(goes_on[1:], False))
    text = row.owner[first]
    origin = row.origin[text]
    return zip(text.tolist(), map(KINDS.__getitem__, kind[first].tolist()), (row.begins[first] - origin).tolist(), (row.ends[last] - origin).tolist())


@cache
def trained(table: int = TABLE, steps: int = STEPS) -> Tagger:
    """Fits the field to the labelled table by Adam on its log-likelihood; gradients by forward and backward passes
    over all sentences at once."""
    texts, tags = [], []
    known: dict[str, int] = {}
    for pieces in labelled(table):
        text = "".join(t for t, _ in pieces)
        mark = np.zeros(len(text), np.int8)
        at = 0
        for t, kind in pieces:
            if kind:
                mark[at : at + len(t)] = 2 * KINDS.index(kind) + 2
                mark[at] -= 1
            else:
                for m in _token.finditer(t):
                    known[m[0].lower()] = known.get(m[0].lower(), 0) + 1
            at += len(t)
        spans = tokenize(text)
        texts.append((text, spans))
        tags.append([int(mark[a]) for a, _ in spans])
    words = frozenset(w for w, n in known.items() if n >= KNOWN and w.isalpha())
    types: dict[str, int] = {}
    ids = [np.array([types.setdefault(t[a:b], len(types)) for a, b in ss]) for t, ss in texts]
    listed = [features(t, words) for t in types]
    owner = np.repeat(np.arange(len(listed)), [len(x) for x in listed])
    numbers: dict[str, int] = {}
    feature = np.array([numbers.setdefault(x, len(numbers)) for xs in listed for x in xs])
    firsts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    by_feature = np.argsort(feature, kind="stable")
    live, begins = np.unique(feature[by_feature], return_index=True)
    width = len(TAGS)

    # all tokens in a row, then cut into stretches of about STRETCH tokens, never within a value, that lie side by side
    pairs = np.zeros((width + 1, width), np.float32)
    cuts, sides, every_mark = [], [], []
    lexicon, cut = Lexicon(), [pieces_of(text) for text, _ in texts]
    row = Row(lexicon, [text for text, _ in texts], [lead for lead, _ in cut], [lexicon.ids([*xs, *GAP])[0] for _, xs in cut])
    marks_of = marks(row)
    at = 0
    for i, tag, start in zip(ids, tags, row.first):
        n = len(i)
        for k in WINDOW:
            moved = np.full(n, -1)
            to, of = (slice(0, max(0, n - k)), slice(k, None)) if k >= 0 else (slice(-k, None), slice(0, max(0, n + k)))
            moved[to] = i[of]
            sides.append(moved)
        every_mark.append(beside(marks_of[start : start + n]))
        begin = 0
        while begin < n:
            end = min(n, begin + STRETCH)
            while end < n and tag[end] and tag[end] % 2 == 0:
                end += 1
            cuts.append((at + begin, at + end))
            begin = end
        at += n
    moved_ids = np.stack([np.concatenate(sides[k :: len(WINDOW)]) for k in range(len(WINDOW))])
    marked, tagged = np.concatenate(every_mark), np.concatenate([np.array(t, np.int64) for t in tags])
    sizes = np.array([b - a for a, b in cuts])
    groups = []
    for part in np.array_split(np.argsort(sizes, kind="stable"), 8):
        longest = sizes[part].max()
        place = np.array([cuts[k][0] for k in part])[:, None] + np.arange(longest)
        real = np.arange(longest)[None] < sizes[part][:, None]
        place = np.where(real, place, 0)
        gold = tagged[place]
        np.add.at(pairs, (gold[:, :-1][real[:, 1:]], gold[:, 1:][real[:, 1:]]), 1)
        np.add.at(pairs[-1], gold[:, 0], 1)
        shifted = np.where(real[None], moved_ids[:, place], -1)
        groups.append((shifted, marked[place] * real[..., None], np.eye(width, dtype=np.float32)[gold], real[..., None].astype(np.float32), sizes[part]))
    parameters = [np.zeros((len(WINDOW), len(numbers), width), np.float32), np.zeros((len(BESIDE) * len(MARKS), width), np.float32), np.zeros((width + 1, width), np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    total = float(sum(len(i) for i in ids))
    for turn in range(1, steps + 1):
        w, f, step = parameters
        rows = [np.concatenate([np.add.reduceat(w[k][feature], firsts), np.zeros((1, width), np.float32)]) for k in range(len(WINDOW))]
        by_type = np.zeros((len(WINDOW), len(types) + 1, width), np.float32)
        grads = [np.zeros_like(w), np.zeros_like(f), -pairs]
        for shifted, given, target, real, sizes in groups:
            score = given @ f
            for k, moved in enumerate(shifted):
                score += rows[k][moved]
            expected, between = _expectations(score, step, sizes)
            off = (expected - target) * real
            grads[1] += given.reshape(-1, given.shape[2]).T @ off.reshape(-1, width)
            grads[2] = grads[2] + between
            for k, moved in enumerate(shifted):
                for tag in range(width):
                    by_type[k, :, tag] += np.bincount(moved.ravel() + 1, off[..., tag].ravel(), len(types) + 1)
        for k in range(len(WINDOW)):
            grads[0][k][live] = np.add.reduceat(by_type[k, 1:][owner[by_feature]], begins)  # row 0 stands for no token
        rate = 0.12 * min(1.0, 2.0 * (1 - turn / (steps + 1)) + 0.05)
        for p, g, (m, v) in zip(parameters, grads, moments):
            g = g / total + PENALTY * p
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            p -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.98**turn)) + 1e-7)
    return Tagger(numbers, *parameters, words)


def _expectations(score: np.ndarray, step: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of tags per token, and expected transitions (last row: starts), of sentences side by side."""
    count, longest, width = score.shape
    jump = np.exp(step[:-1] - step[:-1].max())
    local = np.exp(score - score.max(2, keepdims=True))
    ahead = np.empty_like(local)
    ahead[:, 0] = local[:, 0] * np.exp(step[-1] - step[-1].max())
    ahead[:, 0] /= ahead[:, 0].sum(1, keepdims=True)
    for t in range(1, longest):
        x = (ahead[:, t - 1] @ jump) * local[:, t] + 1e-30
        ahead[:, t] = x / x.sum(1, keepdims=True)
    behind = np.ones_like(local)
    inside = np.arange(longest)[None] < sizes[:, None]
    for t in range(longest - 2, -1, -1):
        x = (local[:, t + 1] * behind[:, t + 1]) @ jump.T + 1e-30
        behind[:, t] = np.where(inside[:, t + 1, None], x / x.sum(1, keepdims=True), 1.0)
    tags = ahead * behind
    tags /= tags.sum(2, keepdims=True)
    here, then = ahead[:, :-1][inside[:, 1:]], (local * behind)[:, 1:][inside[:, 1:]]
    mass = ((here @ jump) * then).sum(1, keepdims=True)
    return tags, np.concatenate([jump * ((here / mass).T @ then), tags[:, 0].sum(0)[None]])


def personal_information(df: DataFrame, keys: list[str], fields: list[str], tagger: Tagger | None = None) -> DataFrame:
    """Per row and field: keys, field, ``found`` (array of kind, value, start; start counted from 0) and ``redacted``,
    the text with every value replaced by its typed placeholder.

    Null texts give no row; empty ones a row without findings. Repeated rows are kept. Whole texts are tagged."""
    made = tagger or trained()
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["_text"].tolist()
            found, redacted = [], []
            for text, spans in zip(texts, made.decode(texts)):
                found.append([{"kind": k, "value": text[a:b], "start": a} for k, a, b in spans])
                out, at = [], 0
                for k, a, b in spans:
                    out += [text[at:a], PLACEHOLDERS[k]]
                    at = b
                redacted.append("".join([*out, text[at:]]))
            yield batch.drop(columns="_text").assign(found=found, redacted=redacted)

    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("_text")) for f in fields])).alias("x")).select(*keys, "x.*").where("_text IS NOT NULL")
    return spread(long).mapInPandas(run, f"{kinds}, field string, found array<struct<kind: string, value: string, start: int>>, redacted string")
