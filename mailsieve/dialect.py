"""Rule conditions are written once, as SQL text, for Spark and for the engine that checks it."""

from __future__ import annotations

from collections.abc import Callable

from .functions.text import LOOKS, PAIRS
from .refdata import MULTI_SUFFIXES
from .suffixes import delegated

HOST = r"^\s*[A-Za-z][A-Za-z0-9+.-]*:[/\\]{2}(?:[^/?#@]*@)?([^/?#:]+)"
_suffixes = "|".join(s.replace(".", r"\.") for s in MULTI_SUFFIXES)
REGISTRABLE = rf"([^.]+\.(?:{_suffixes})|[^.]+\.[^.]+)$"
IPV4 = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"
PRIVATE_IPV4 = r"^(10\.|127\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.)"
#: Letters in other forms, full-width and mathematical, and the plain ones; and all that folding changes.
_forms = {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)} | {chr(0x1D400 + k): chr((65 if k % 52 < 26 else 71) + k % 52) for k in range(13 * 52)} | {chr(0x1D7CE + k): str(k % 10) for k in range(50)}
UNSEEN = r"[\x{AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}]"
UNUSUAL = r"[\x{AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}\x{FF01}-\x{FF5E}\x{1D400}-\x{1D7FF}]"


class Dialect:
    """What differs between the two. Text columns given to a method are SQL expressions."""

    def literal(self, text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def match(self, column: str, pattern: str) -> str:
        raise NotImplementedError

    def extract(self, column: str, pattern: str, group: int = 1) -> str:
        raise NotImplementedError

    def replace(self, column: str, pattern: str, by: str) -> str:
        raise NotImplementedError

    def strings(self, values) -> str:
        raise NotImplementedError

    def overlap(self, column: str, values) -> str:
        raise NotImplementedError

    def one_of(self, column: str, values) -> str:
        return f"({column} IN ({', '.join(self.literal(v) for v in values)}))"

    def common(self, words: str, markers) -> str:
        """How many of the markers are among the words of a text."""
        raise NotImplementedError

    def count(self, column: str, pattern: str) -> str:
        raise NotImplementedError

    def starts(self, text: str, beginning: str) -> str:
        raise NotImplementedError

    def decoded(self, text: str) -> str:
        """Percent-decoded; what is not well formed is null or as it was."""
        raise NotImplementedError

    def from_base64(self, text: str) -> str:
        """The text that base64, in either alphabet and without padding, stands for; null if it stands for none."""
        raise NotImplementedError

    def parameter(self, query: str, names: list[str], read: Callable[[str], str]) -> str:
        """What ``read`` makes of the value of the first listed parameter of which it makes something."""
        raise NotImplementedError

    def within(self, part: str, text: str) -> str:
        """Whether a text contains another, both expressions."""
        return f"({part} <> '' AND length(replace({text}, {part}, '')) < length({text}))"

    def any_of(self, parts: str, holds: Callable[[str], str]) -> str:
        """Whether a condition holds for an element of an array of texts."""
        raise NotImplementedError

    def split(self, text: str, mark: str) -> str:
        raise NotImplementedError

    # the same in both, given the above
    def folded(self, text: str) -> str:
        """Without hidden characters, and letters in their plain form; most texts are so already."""
        plain = f"translate({self.replace(text, UNSEEN, '')}, {self.literal(''.join(_forms))}, {self.literal(''.join(_forms.values()))})"
        return f"CASE WHEN {self.match(text, UNUSUAL)} THEN {plain} ELSE {text} END"

    def skeleton(self, name: str) -> str:
        """What a name looks like: look-alike letters and pairs as the plain letter, i as l, without separators."""
        out = f"translate(lower({name}), {self.literal(''.join(LOOKS))}, {self.literal(''.join(LOOKS.values()))})"
        for pair, one in PAIRS:
            out = f"replace({out}, {self.literal(pair)}, {self.literal(one)})"
        return self.replace(f"replace({out}, 'i', 'l')", "[-._ ]", "")

    def sentences(self, text: str) -> str:
        """Words as ``words`` gives them, with a full stop between sentences."""
        stops = self.replace(f"lower({self.folded(text)})", r"[.!?।\n]+", " . ")
        return f"concat(' ', {self.replace(stops, r'[^\p{L}\p{M}\p{N}.]+', ' ')}, ' ')"

    def head(self, text: str, most: int | None) -> str:
        """The first characters of a text, all of them if ``most`` is None."""
        return text if most is None else f"substring({text}, 1, {most})"

    def padded(self, text: str) -> str:
        plain = f"translate({text}, '-_', '+/')"
        return f"rpad({plain}, {self.whole(f'ceil(length({text}) / 4.0) * 4')}, '=')"

    def whole(self, number: str) -> str:
        return f"CAST({number} AS INT)"

    def delegated(self, host: str) -> str:
        """Whether a host's last label is a delegated or reserved top-level domain."""
        label = self.extract(host, r"([^.]+)$")
        return f"({self.match(label, '^(xn--[a-z0-9-]+)$')} OR {self.one_of(label, delegated())})"

    def words(self, column: str) -> str:
        """Lower-cased words apart by single spaces, a space at either end."""
        return f"concat(' ', trim({self.replace(f'lower({self.folded(column)})', r'[^\p{L}\p{M}\p{N}]+', ' ')}), ' ')"

    def host(self, url: str) -> str:
        return self.replace(f"lower({self.extract(url, HOST)})", r"^www\.|\.+$", "")

    def domain(self, address: str) -> str:
        return self.replace(f"lower({self.extract(address, r'@([^@\s<>]+)>?\s*$')})", r"\.+$", "")

    def registrable(self, host: str) -> str:
        return f"CASE WHEN {self.match(host, IPV4)} THEN {host} ELSE {self.extract(host, REGISTRABLE)} END"


class Spark(Dialect):
    def literal(self, text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def match(self, column: str, pattern: str) -> str:
        return f"rlike({column}, {self.literal(pattern)})"

    def extract(self, column: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({column}, {self.literal(pattern)}, {group})"

    def replace(self, column: str, pattern: str, by: str) -> str:
        return f"regexp_replace({column}, {self.literal(pattern)}, {self.literal(by)})"

    def strings(self, values) -> str:
        return f"array({', '.join(self.literal(v) for v in values)})"

    def overlap(self, column: str, values) -> str:
        return f"arrays_overlap({column}, {self.strings(values)})"

    def common(self, words: str, markers) -> str:
        return f"size(array_intersect(split({words}, ' '), {self.strings(markers)}))"

    def count(self, column: str, pattern: str) -> str:
        return f"regexp_count({column}, {self.literal(pattern)})"

    def any_of(self, parts: str, holds: Callable[[str], str]) -> str:
        return f"exists({parts}, s -> {holds('s')})"

    def split(self, text: str, mark: str) -> str:
        return f"split({text}, {self.literal(mark)})"

    def starts(self, text: str, beginning: str) -> str:
        return f"startswith({text}, {self.literal(beginning)})"

    def decoded(self, text: str) -> str:
        return f"try_url_decode(replace({text}, '+', '%2B'))"

    def from_base64(self, text: str) -> str:
        return f"CAST(try_to_binary({self.padded(text)}, 'base64') AS STRING)"

    def parameter(self, query: str, names: list[str], read: Callable[[str], str]) -> str:
        at = f"array_position({self.strings(names)}, lower(substring_index(p, '=', 1)))"
        value = "substring(p, instr(p, '=') + 1)"
        each = f"transform(split({query}, '&'), (p, i) -> named_struct('rank', {at}, 'at', i, 'value', {read(value)}))"
        return f"array_min(filter({each}, x -> x.rank > 0 AND x.value IS NOT NULL)).value"


class Duck(Dialect):
    def match(self, column: str, pattern: str) -> str:
        return f"regexp_matches({column}, {self.literal(pattern)})"

    def extract(self, column: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({column}, {self.literal(pattern)}, {group})"

    def replace(self, column: str, pattern: str, by: str) -> str:
        return f"regexp_replace({column}, {self.literal(pattern)}, {self.literal(by)}, 'g')"

    def strings(self, values) -> str:
        return f"[{', '.join(self.literal(v) for v in values)}]::VARCHAR[]"

    def overlap(self, column: str, values) -> str:
        return f"list_has_any({column}, {self.strings(values)})"

    def common(self, words: str, markers) -> str:
        return f"len(list_distinct(list_intersect(string_split({words}, ' '), {self.strings(markers)})))"

    def count(self, column: str, pattern: str) -> str:
        return f"len(regexp_extract_all({column}, {self.literal(pattern)}))"

    def any_of(self, parts: str, holds: Callable[[str], str]) -> str:
        return f"(len(list_filter({parts}, lambda s: {holds('s')})) > 0)"

    def split(self, text: str, mark: str) -> str:
        return f"regexp_split_to_array({text}, {self.literal(mark)})"

    def starts(self, text: str, beginning: str) -> str:
        return f"starts_with({text}, {self.literal(beginning)})"

    def decoded(self, text: str) -> str:
        return f"url_decode({text})"

    def from_base64(self, text: str) -> str:
        return f"TRY(decode(from_base64({self.padded(text)})))"

    def parameter(self, query: str, names: list[str], read: Callable[[str], str]) -> str:
        at = f"list_position({self.strings(names)}, lower(split_part(p, '=', 1)))"
        each = f"[{{'rank': {at}, 'at': i, 'value': {read('substring(p, instr(p, chr(61)) + 1)')}}} for p, i in string_split({query}, '&')]"
        return f"list_sort(list_filter({each}, lambda x: x.rank > 0 AND x.value IS NOT NULL))[1].value"


SPARK, DUCK = Spark(), Duck()
