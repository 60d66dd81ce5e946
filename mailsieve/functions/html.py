"""What a reader sees of an HTML body: hidden parts removed, blocks apart, links listed. One pass of the standard parser
per document, in an Arrow UDF over whole batches.

Styles are read as declarations; whether one hides its element is decided on numbers: lengths in pixels, shares of one."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BOUNDS

# Elements that begin a line, that hold no text, that have no end.
BLOCKS = set("address article aside blockquote br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SILENT = set("script style head title template noscript".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: Pixels of a unit; relative ones at the usual text size of 16.
PIXELS = {"": 1.0, "px": 1.0, "pt": 4 / 3, "pc": 16.0, "in": 96.0, "cm": 37.8, "mm": 3.78, "em": 16.0, "rem": 16.0, "ex": 8.0, "ch": 8.0, "vw": 12.8, "vh": 7.2, "%": 0.16}
#: Opacity and text size (pixels) below which nothing can be read; pixels beyond which a place is off the screen.
FAINT, TINY, FAR = 0.05, 3.0, 100.0
PLACES = ("text-indent", "left", "right", "top", "margin-left", "margin-top")
_amount = re.compile(r"([+-]?(?:\d+\.?\d*|\.\d+))(%|[a-z]*)")


def declared(style: str) -> dict[str, str]:
    """The declarations of a style attribute by property, lower-cased, the last of each property; comments and
    importance left out."""
    out = {}
    for part in re.sub(r"/\*.*?\*/", "", style.lower(), flags=re.S).split(";"):
        name, colon, value = part.partition(":")
        if colon and value.strip():
            out[name.strip()] = value.replace("!important", "").replace("! important", "").strip()
    return out


def amounts(value: str) -> list[tuple[float, str]]:
    return [(float(n), unit) for n, unit in _amount.findall(value)]


def pixels(value: str | None) -> float | None:
    """The first length of a value in pixels; null without one."""
    found = amounts(value or "")
    return found[0][0] * PIXELS.get(found[0][1], 1.0) if found else None


def _clipped_away(style: dict[str, str]) -> bool:
    if style.get("clip", "").startswith("rect"):
        sides = [n for n, _ in amounts(style["clip"])]
        return len(sides) == 4 and not any(sides)
    path = style.get("clip-path", "")
    return path.startswith("inset") and any(unit == "%" and n >= 50 for n, unit in amounts(path))


def _opacity(style: dict[str, str]) -> float:
    found = amounts(style.get("opacity", ""))
    return found[0][0] / (100 if found[0][1] == "%" else 1) if found else 1.0


def concealment(style: dict[str, str]) -> str | None:
    """The technique by which declarations hide their element, None if they don't. An element without height or width
    hides its text only if it also clips what overflows."""
    if style.get("display") == "none":
        return "display:none"
    if style.get("visibility") in ("hidden", "collapse"):
        return "visibility:hidden"
    if _opacity(style) < FAINT:
        return "opacity:0"
    size = pixels(style.get("font-size"))
    if size is not None and size < TINY:
        return "font-size:0"
    if any(style.get(o, "").split()[:1] in (["hidden"], ["clip"]) for o in ("overflow", "overflow-x", "overflow-y")):
        for side in ("height", "width"):
            if 0.0 in (pixels(style.get(side)), pixels(style.get(f"max-{side}"))):
                return f"{side}:0"
    if _clipped_away(style):
        return "clipped"
    if any((pixels(style.get(p)) or 0.0) <= -FAR for p in PLACES):
        return "moved off screen"
    return None


def reappears(technique: str | None, style: dict[str, str]) -> bool:
    """Whether an element inside a hidden one shows itself again: visibility and an absolute text size are its own."""
    if technique == "visibility:hidden":
        return style.get("visibility") == "visible"
    if technique == "font-size:0":
        found = amounts(style.get("font-size", ""))
        return bool(found) and found[0][1] not in ("em", "ex", "ch", "%") and pixels(style["font-size"]) >= TINY
    return False


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str | None, bool]] = []  # element, technique that hides here, quoted
        self.silent = 0
        self.seen: list[str] = []
        self.quoted: list[str] = []
        self.hidden = 0
        self.techniques: list[str] = []
        self.links: dict[tuple[str, str], None] = {}
        self.anchor: list | None = None

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        _, hides, quote = self.open[-1] if self.open else ("", None, False)
        style = declared(values.get("style") or "")
        if reappears(hides, style):
            hides = None
        if hides is None and (own := "hidden" if "hidden" in values else concealment(style)):
            hides = own
            if own not in self.techniques:
                self.techniques.append(own)
        if tag in BLOCKS:
            self._out("\n")
        if tag == "a" and values.get("href") and not values["href"].startswith("#"):
            self.anchor = [values["href"], []]
        if tag not in VOID:
            self.silent += tag in SILENT
            self.open.append((tag, hides, quote or tag == "blockquote" or "gmail_quote" in (values.get("class") or "")))

    def handle_endtag(self, tag):
        if tag == "a" and self.anchor:
            self.links[(" ".join("".join(self.anchor[1]).split()), self.anchor[0])] = None
            self.anchor = None
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.silent -= sum(t in SILENT for t, _, _ in self.open[k:])
                del self.open[k:]
                break
        if tag in BLOCKS:
            self._out("\n")

    def _out(self, text: str) -> None:
        (self.quoted if self.open and self.open[-1][2] else self.seen).append(text)

    def handle_data(self, data):
        if self.silent:
            return
        if self.open and self.open[-1][1]:
            self.hidden += sum(c.isalnum() for c in data)
            return
        self._out(data)
        if self.anchor:
            self.anchor[1].append(data)


def tidied(parts: list[str]) -> str:
    """Lines without blanks at their ends, none of them empty; runs of blanks within are one."""
    lines = (" ".join(x.split()) for x in "".join(parts).replace("\xa0", " ").split("\n"))
    return "\n".join(x for x in lines if x)


def page_of(html: str) -> dict:
    page = _Page()
    page.feed(html)
    page.close()
    body = tidied(page.seen) or tidied(page.quoted)
    return {"body": body[: BOUNDS.body], "hidden_chars": page.hidden, "techniques": page.techniques, "links": [{"text": t, "href": h} for t, h in page.links][: BOUNDS.links]}


def page(c: Column) -> Column:
    """struct(body, hidden_chars, techniques, links) of an HTML text; null for null."""

    @F.pandas_udf("body string, hidden_chars int, techniques array<string>, links array<struct<text: string, href: string>>")
    def apply(values: pd.Series) -> pd.DataFrame:
        empty = {"body": None, "hidden_chars": None, "techniques": None, "links": None}
        return pd.DataFrame([page_of(v) if isinstance(v, str) else empty for v in values], columns=list(empty))

    return apply(c)


# ---- choices among extractions, as expressions over arrays of nodes


def first_answer(*candidates: Column) -> Column:
    """The first of several extractions that gives something: not null and not empty."""
    return F.coalesce(*[F.when(F.length(c) > 0, c) for c in candidates])


def first_nonempty(*lists: Column) -> Column:
    """The first of several arrays that has an element."""
    return F.coalesce(*[F.when(F.size(c) > 0, c) for c in lists], F.array())


def in_order(nodes: Column, *others: Column) -> Column:
    """Nodes (struct with ``begin`` and ``end``) of one or more arrays, each once, in the order of the document."""
    for other in others:
        nodes = F.array_union(nodes, other)
    return F.array_sort(F.array_distinct(nodes))


def outermost(nodes: Column) -> Column:
    """Those nodes (struct with ``begin`` and ``end``) that no other one contains."""
    return F.filter(nodes, lambda n: ~F.exists(nodes, lambda m: (m["begin"] <= n["begin"]) & (m["end"] >= n["end"]) & ((m["begin"] < n["begin"]) | (m["end"] > n["end"]))))
