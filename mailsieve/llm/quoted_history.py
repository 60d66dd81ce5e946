"""What a sender newly wrote in an e-mail: line rules that set aside quoted and forwarded mail, signatures, closing
phrases and notices, in nine languages.

The rules run in order over the lines of one body. (1) Quoted mail: an attribution ("On ... wrote:", over up to
three lines), a separator, a block of header lines, or a quote mark. A marked quotation ends where the mark ends, so
answers between quotations stay; mail quoted without marks after a header block runs to the end, but for answers signed in brackets. (2) In each stretch
that is left: notices, then a signature, begun by its delimiter, a closing phrase, or found from the end by the
shape of its lines. A postscript after a signature is new again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

# Wording by language (en, de, fr, es, pt, it, nl, hi, hi-latn), in that order within each list.
WROTE = "wrote|schrieb|a écrit|escribió|escreveu|ha scritto|schreef|ने लिखा|ne likha"
SEPARATORS = (
    "original message|forwarded message|ursprüngliche nachricht|weitergeleitete nachricht|message d.origine|message transféré|mensaje original|"
    "mensaje reenviado|mensagem original|mensagem encaminhada|messaggio originale|messaggio inoltrato|oorspronkelijk bericht|doorgestuurd bericht|मूल संदेश"
)
BEGIN_FORWARD = "begin forwarded message|anfang der weitergeleiteten nachricht|début du message réexpédié|inicio del mensaje reenviado|início da mensagem reencaminhada|inizio messaggio inoltrato|begin doorgestuurd bericht"
FROM_HEADERS = "from|von|de|da|van|प्रेषक"
OTHER_HEADERS = (
    "sent|date|to|cc|bcc|subject|reply-to|gesendet|datum|an|betreff|envoyé|envoyé le|à|objet|enviado|enviado el|fecha|para|asunto|data|enviada em|assunto|"
    "inviato|a|oggetto|verzonden|aan|onderwerp|दिनांक|को|विषय"
)
CLOSINGS = (
    "best|all the best|best regards|best wishes|kind regards|kindest regards|warm regards|warmly|regards|with regards|many thanks|thanks|thanks again|thanks and regards|thank you|with thanks|"
    "cheers|br|kr|rgds|sincerely|yours|yours sincerely|yours faithfully|yours truly|respectfully|cordially|take care|"
    "mit freundlichen grüßen|mit freundlichem gruß|freundliche grüße|viele grüße|beste grüße|liebe grüße|schöne grüße|herzliche grüße|mit besten grüßen|grüße|gruß|mfg|vg|lg|danke|vielen dank|hochachtungsvoll|"
    "cordialement|bien cordialement|très cordialement|bien à vous|meilleures salutations|salutations|sincères salutations|merci|amicalement|"
    "saludos|un saludo|saludos cordiales|un cordial saludo|cordialmente|atentamente|muchas gracias|gracias|un abrazo|"
    "cumprimentos|com os melhores cumprimentos|melhores cumprimentos|atenciosamente|obrigado|obrigada|abraços|um abraço|"
    "cordiali saluti|distinti saluti|saluti|un saluto|grazie|a presto|"
    "met vriendelijke groet|met vriendelijke groeten|vriendelijke groet|hartelijke groet|groeten|groet|mvg|bedankt|"
    "सादर|धन्यवाद|शुभकामनाएँ|saadar|dhanyavaad|dhanyawad|shukriya"
)
DEVICES = (
    r"sent from my [\w ’'-]{1,30}|sent from (?:outlook|mail|yahoo mail|proton mail)\b[\w ]{0,20}|sent (?:via|with|using) [\w ]{1,30}|get [\w-]+ for [\w ]{1,20}|"
    r"von meinem [\w ]{1,30} gesendet|gesendet (?:von|mit) [\w ]{1,30}|envoyé (?:de|depuis) (?:mon|ma) [\w ]{1,30}|enviado desde mi [\w ]{1,30}|"
    r"enviado (?:do|a partir do) meu [\w ]{1,30}|inviato dal? mi[oa] [\w ]{1,30}|verzonden (?:vanaf|met) mijn [\w ]{1,30}|मेरे \S+ से भेजा गया"
)
NOTICES = (
    r"confidentiality notice|is registered in .{0,60}company (?:number|no)|the views above are those|views .{0,40}of the (?:writer|author|sender)\b|this e-?mail and any files|disclaimer\b|this (?:e-?mail|message)\b.{0,80}\b(?:confidential|privileged|intended|virus)|the contents may be privileged|if you are not the intended|"
    r"accept no liability|accepts? no (?:liability|responsibility)|scanned (?:on|by|for|with)\b.{0,60}(?:leaving|virus|malware|arrival|\.\w)|checked for viruses|no contract is formed|not legally binding|please consider the environment|think before you print|"
    r"nachricht ist vertraulich|vertraulichkeitshinweis|diese e-?mail .{0,60}vertraulich|ce (?:message|courriel|mail) .{0,60}confidentiel|avis de confidentialité|"
    r"este (?:mensaje|correo) .{0,60}confidencial|aviso legal|aviso de confidencialidad|esta mensagem .{0,60}confidencial|"
    r"questo messaggio .{0,60}riservat|avviso di riservatezza|dit bericht .{0,60}vertrouwelijk|यह संदेश गोपनीय"
)
GREETINGS = (
    "hi|hello|hey|dear|good (?:morning|afternoon|evening|day)|greetings|hallo|guten (?:tag|morgen|abend)|liebe[rs]?|sehr geehrte[rs]?|moin|bonjour|bonsoir|salut|chère?s?|"
    "hola|buenos días|buenas tardes|estimad[oa]s?|querid[oa]s?|olá|bom dia|boa tarde|prezad[oa]s?|car[oaie]|caríssim[oa]|ciao|buongiorno|buonasera|gentile|egregio|beste|geachte|dag|goedemorgen|goedemiddag|नमस्ते|प्रिय|namaste|priya"
)
POSTSCRIPT = r"(?:p\.?\s?p?\.?s\.?|n\.?b\.?)\s*[:.)–-]?\s+\S|(?:ps|p\.s\.)[:.]\S"

_attribution_end = re.compile(rf"(?:\b(?:{WROTE})\b|{WROTE.split('|')[7]}).*[:：]\s*$", re.I)
_evidence = re.compile(r"\d|@")
_separator = re.compile(rf"^\s*[-_=*]{{2,}}\s*(?:{SEPARATORS})\s*[-_=*]*\s*$|^\s*(?:{BEGIN_FORWARD})\s*[:：]\s*$", re.I)
_from_header = re.compile(rf"^\s*\*?(?:{FROM_HEADERS})\*?\s?[:：]\*?\s*\S", re.I)
_other_header = re.compile(rf"^\s*\*?(?:{OTHER_HEADERS})\*?\s?[:：]", re.I)
_rule = re.compile(r"^\s*([_*=#~-])\1{4,}\s*$")
_mark = re.compile(r"^ {0,3}(?:>|[A-Z][A-Za-z]{0,3}> )")  # also with the initials of who is quoted
#: An answer within a quotation that has no marks, signed in brackets where it begins.
_answer = re.compile(r"^\s*(?:\[[A-Z][\w.’'-]*(?: [A-Z][\w.’'-]*){0,2}\]|<[A-Z][\w.’'-]*>|\*{2,}[A-Z][\w ]*\*{2,})[:,]?\s+\S")
_bar = re.compile(r"^ {0,3}[|│»](?=\s|$)")
_indent = re.compile(r"^(?: {4,}|\t)")
_delimiter = re.compile(r"^-- ?$|^—\s?$")
#: Thanks that end a letter; they do so only right above a name.
_thanks = re.compile(r"^\s*(?:(?:many )?thanks|thank you|cheers|(?:vielen )?dank|danke|merci|(?:muchas )?gracias|grazie|obrigad[oa]|bedankt|dhanyavaad|धन्यवाद)\b[^.?!:]*[,!]?\s*$", re.I)
_name = re.compile(r"^\s*[A-ZÀ-ÞŁŚŽŠ][\w.’'-]*(?: [A-ZÀ-ÞŁŚŽŠ][\w.’'-]*){0,3}\s*$")
_closing = re.compile(rf"^\s*(?:{CLOSINGS})\s*[,.!–-]*\s*$", re.I)
_device = re.compile(rf"^\s*(?:{DEVICES})\s*(?:[,;–-] .{{0,60}})?\.?\s*$", re.I)
_notice = re.compile(NOTICES, re.I)
_postscript = re.compile(rf"^\s*(?:{POSTSCRIPT})", re.I)
_greeting = re.compile(rf"(?:{GREETINGS})(?!\w)", re.I)
_contact = re.compile(r"^\s*(?:(?:t|tel|phone|mobile|mob|cell|fax|e-?mail|web|m|office|handy|telefon|tél|portable|móvil|telefono|telefoon)\b\.?\s*[:.]?\s*)?(?:\+?[\d (][\d ().\-/]{5,}(?:\s*(?:ext|x|poste|durchwahl)\.?\s*\d+)?|\S+\s?(?:@|\[at\]|\(at\))\s?\S+|(?:https?://|www\.)\S+)\s*$", re.I)
_barred = re.compile(r"^\s*[^|.?!:]{3,40} \| [^|]{2,60} \| [^|]{2,60}(?: \| [^|]*)*$")
_postcode = re.compile(r"\b\d{4,5}\b|\b[A-Z]{1,2}\d{1,2}[A-Z]?\s?\d[A-Z]{2}\b")
_cased = re.compile(r"^[A-ZÀ-ÞŁŚŽŠ]")


def _attributions(lines: list[str], taken: list[bool]) -> dict[int, int]:
    """First line of each attribution -> its last line; an attribution may be wrapped within its paragraph."""
    found = {}
    for end, line in enumerate(lines):
        if taken[end] or not _attribution_end.search(line):
            continue
        for start in range(end, -1, -1):
            if taken[start] or not lines[start].strip():
                break
            joined = " ".join(x.strip() for x in lines[start : end + 1])
            opens = re.match(r"(?:on|am|le|el|em|il|op)\s+\S", joined, re.I)
            named = re.match(r"[^\s<]+(?:\s+[^\s<]+){0,3}(?:\s*<[^<>]*>)?\s+(?:" + WROTE + r")\b", joined, re.I)
            if _evidence.search(joined) and (opens or named):
                found[start] = end
                break
    return found


def _quoted(lines: list[str]) -> list[bool]:
    n = len(lines)
    quoted = [bool(_mark.match(x)) for x in lines]
    starts = _attributions(lines, quoted)
    at, style = 0, None
    while at < n:
        line = lines[at]
        if at in starts:
            for k in range(at, starts[at] + 1):
                quoted[k] = True
            at = starts[at] + 1
            ahead = next((x for x in lines[at : at + 3] if x.strip()), "")
            style = next((s for s in (_mark, _bar, _indent) if s.match(ahead)), None)
            continue
        if _separator.match(line) or (_rule.match(line) and any(_from_header.match(x) for x in lines[at + 1 : at + 3])) or _header_block(lines, at):
            return quoted[:at] + [not x for x in _answers(lines, at)]
        if _bar.match(line) and (style is _bar or (at + 1 < n and _bar.match(lines[at + 1])) or (at and quoted[at - 1])):
            quoted[at], style = True, _bar
        elif style is _indent and _indent.match(line):
            quoted[at] = True
        at += 1
    # the line of a quotation that lost its mark: blank lines between marked ones
    for k in range(1, n - 1):
        if not lines[k].strip() and quoted[k - 1]:
            quoted[k] = True
    return quoted


def _answers(lines: list[str], first: int) -> list[bool]:
    """Which lines of an unmarked quotation from ``first`` on are answers signed in brackets, with what they wrap into."""
    out, width = [], max(map(len, lines[first:]))
    for k in range(first, len(lines)):
        wrapped = bool(out) and out[-1] and lines[k].strip() and width >= 50 and len(lines[k - 1]) + 1 + len(lines[k].split()[0]) > width
        out.append(bool(_answer.match(lines[k])) or bool(wrapped))
    return out


def _header_block(lines: list[str], at: int) -> bool:
    """A From line followed by at least one more header line; one alone may be a sentence."""
    return bool(_from_header.match(lines[at])) and at + 1 < len(lines) and bool(_other_header.match(lines[at + 1])) and (at == 0 or not lines[at - 1].strip() or bool(_rule.match(lines[at - 1])))


def _looks_signed(line: str, last: bool) -> bool:
    """A line that a signature block can hold: name, role and firm, phone, address, device."""
    text = line.strip()
    if not text or len(text) > 110:
        return False
    if _device.match(text) or (_contact.match(text) and text[-1] not in ".,;") or text.count(" | ") >= 2:
        return True
    if text[-1] in ".?!:;," or _greeting.match(text) or text.lstrip("-*• ") != text:
        return False
    words = [w for w in re.split(r"[\s,/&|]+", text) if w]
    lead = sum(bool(_cased.match(w)) or w in ("de", "des", "du", "von", "van", "of", "and", "la", "und") for w in words)
    named = len(words) <= 9 and lead == len(words)
    if named and not any(ch.isdigit() for ch in text):
        return True
    return bool(_postcode.search(text)) and sum(w.islower() for w in words) <= 3 and len(words) <= 12 and any(ch.isdigit() for ch in text.split(",")[0])


def _kept(lines: list[str], first: int, end: int) -> list[int]:
    """Of the unquoted lines first..end-1, the new ones."""
    drop = set()
    signed = False
    k = first
    while k < end:
        line = lines[k]
        blank = not line.strip()
        if not blank and _postscript.match(line):
            signed = False
            while k < end and lines[k].strip():
                k += 1
            continue
        if signed:
            drop.add(k)
            k += 1
            continue
        thanks = k + 1 < end and _thanks.match(line) and _name.match(lines[k + 1])
        if _delimiter.match(line) or _closing.match(line) or _device.match(line) or thanks:
            signed = True
            continue
        if _barred.match(line):  # a signature in one line, whatever follows it
            drop.add(k)
            k += 1
            continue
        notice = not blank and (_notice.search(line) or (k + 1 < end and _notice.search(line + " " + lines[k + 1]) and not _notice.search(lines[k + 1]) and (k == first or not lines[k - 1].strip())))
        if notice or (_rule.match(line) and not lines[k].strip("-_*=#~ ")):
            while k < end and lines[k].strip():
                drop.add(k)
                k += 1
            continue
        k += 1
    kept = [k for k in range(first, end) if k not in drop and lines[k].strip()]
    return _unsigned(lines, kept, first)


def _unsigned(lines: list[str], kept: list[int], first: int) -> list[int]:
    """Without a signature that has no delimiter and no closing phrase: the last block, if all of it is shaped so."""
    if not kept:
        return kept
    cut = len(kept)
    while cut and _looks_signed(lines[kept[cut - 1]], cut == len(kept)):
        cut -= 1
        if kept[cut] == first or not lines[kept[cut] - 1].strip():
            break
    block = kept[cut:]
    whole = bool(block) and (block[0] == first or not lines[block[0] - 1].strip()) and not (cut and lines[kept[cut - 1]].rstrip().endswith(":"))
    if not whole:  # lines that end a paragraph: only what is unmistakable
        cut = len(kept)
        while cut and (_device.match(lines[kept[cut - 1]].strip()) or (_contact.match(lines[kept[cut - 1]].strip()) and lines[kept[cut - 1]].rstrip()[-1] not in ".,;") or lines[kept[cut - 1]].count(" | ") >= 2):
            cut -= 1
    return kept[:cut] if cut < len(kept) else kept


def new_lines(body: str | None) -> list[int]:
    """Numbers, from 1, of the non-blank lines that the sender newly wrote; none for a null or blank body."""
    if not body:
        return []
    lines = [x.rstrip("\r") for x in body.split("\n")]
    quoted = _quoted(lines)
    out: list[int] = []
    at = 0
    while at < len(lines):
        if quoted[at]:
            at += 1
            continue
        end = at
        while end < len(lines) and not quoted[end]:
            end += 1
        out += _kept(lines, at, end)
        at = end
    return [k + 1 for k in out]


def newly_written(df: DataFrame, key: str, body: str) -> DataFrame:
    """Per row: key, ``lines`` (numbers of the new lines) and ``new_text`` (those lines joined by newlines; empty if
    none). Null and blank bodies have no new line; null keys and repeated rows are kept as they are; other columns
    are ignored. Whole bodies are read, whatever their length."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [new_lines(b) for b in batch["b"]]
            texts = ["\n".join(b.split("\n")[k - 1].rstrip("\r") for k in ks) if ks else "" for b, ks in zip(batch["b"], found)]
            yield pd.DataFrame({"k": batch["k"], "lines": found, "new_text": texts})

    rows = spread(df.select(F.col(key).alias("k"), F.col(body).alias("b")))
    return rows.mapInPandas(run, f"k {key_type}, lines array<int>, new_text string").withColumnRenamed("k", key)
