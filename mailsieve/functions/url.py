"""URL functions, all of them expressions: splitting, kinds of hosts and schemes, and the peeling of redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BOUNDS
from ..dialect import IPV4, PRIVATE_IPV4, SPARK, Dialect
from ..refdata import DANGEROUS_SCHEMES, OTHER_SCHEMES, REDIRECT_PARAMETERS, WEB_SCHEMES


def host(url: str) -> Column:
    """The host of the URL in a named column: lower-cased, without one www. and trailing dots."""
    return F.expr(SPARK.host(url))


def registrable(host_column: str) -> Column:
    return F.expr(SPARK.registrable(host_column))


def suffixes(c: Column) -> Column:
    """Every suffix of a host, the whole first: what a table of suffixes is joined on."""
    labels = F.split(c, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def is_ip(c: Column) -> Column:
    """Dotted, decimal, hexadecimal or bracketed addresses."""
    return c.rlike(IPV4) | c.rlike(r"^(0x[0-9a-f]{1,8}|[0-9]{8,10})$") | c.rlike(r"^\[[0-9a-f:.]+\]$")


def is_private_ip(c: Column) -> Column:
    return (c.rlike(IPV4) & c.rlike(PRIVATE_IPV4)) | c.rlike(r"^\[(::1|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)\]$")


def is_malformed(c: Column) -> Column:
    """Empty, without a dot, over long, or with a label or ending that no host has."""
    return ~is_ip(c) & ((c == "") | ~c.contains(".") | (F.length(c) > 253) | c.rlike(r"(^|\.)(-[^.]*|[^.]*-|[^.]{64,})?(\.|$)") | ~c.rlike(r"\.([a-z]{2,63}|xn--[a-z0-9-]+)$"))


def unknown_tld(c: str) -> Column:
    """Whether the ASCII host in a named column ends in a label that is not delegated."""
    return F.expr(SPARK.match(c, r"^[\x00-\x7F]+\.[a-z0-9-]+$")) & ~F.expr(SPARK.delegated(c)) & ~is_ip(F.col(c))


def scheme_class(scheme: Column) -> Column:
    return F.when(scheme.isin(WEB_SCHEMES), "web").when(scheme.isin(DANGEROUS_SCHEMES), "dangerous").when(scheme.isin(OTHER_SCHEMES), "other").when(scheme == "", "none").otherwise("unknown")


# ---- redirects

#: What a URL must hold somewhere behind its host if it is to redirect: the begin of another one, encoded or not.
CARRIES = r"(?i)[=/](https?(:|%(25)*3a)|[/\\]{2}|%(25)*2f)|aHR0c"
#: A web address with a host.
ADDRESS = r"^(?i:https?):[/\\]{2}(?:[^/?#@\s]*@)?[^/?#:@\s]+"
#: A parameter's value that begins as an address does, whether or not it is one.
BEGINS = r"^(?i:(https?(:|%3a)|//|%2f%2f))"
#: Times that a value may have been percent-encoded.
ENCODED = 3


def settled(q: Dialect, value: str) -> str:
    """The first percent-decoding of a value, itself included, that reads as a web address; null if none does."""
    cases = []
    for _ in range(ENCODED + 1):
        whole = f"CASE WHEN {q.starts(value, '//')} THEN concat('https:', {value}) ELSE {value} END"
        cases.append(f"WHEN {q.match(whole, ADDRESS)} THEN {whole}")
        value = q.decoded(value)
    return f"CASE {' '.join(cases)} END"


def behind(q: Dialect, url: str) -> str:
    """Where the URL in a column redirects to: the value of a listed parameter, the first of the list before others; an
    address within the path; or one that stands there in base64. Null if it redirects nowhere."""
    path, query = q.extract(url, r"^[^:]*:[/\\]{2}[^/?#]*([^?#]*)"), q.extract(url, r"[?]([^#]*)")
    inside = q.extract(url, r"(?i)^[^:]*:[/\\]{2}[^/?#]*(?:/[^?#]*?)?/(https?(?::|%(?:25)*3a)(?:[/\\]|%(?:25)*2f)[^#]*)")
    packed = q.extract(f"concat({path}, '?', {query})", r"(?:^|[^A-Za-z0-9+_-])(aHR0c[A-Za-z0-9+_-]{7,})")
    found = f"coalesce({q.parameter(query, REDIRECT_PARAMETERS, lambda v: settled(q, v))}, {settled(q, inside)}, {settled(q, q.from_base64(packed))})"
    return f"CASE WHEN {q.match(url, CARRIES)} THEN {found} END"


def withheld(q: Dialect, url: str) -> str:
    """Whether a listed parameter's value begins as an address, though nothing behind the URL can be read."""
    query = q.extract(url, r"[?]([^#]*)")
    shown = q.parameter(query, REDIRECT_PARAMETERS, lambda v: f"CASE WHEN {q.match(v, BEGINS)} THEN {v} END")
    return f"CASE WHEN {q.match(url, CARRIES)} THEN {shown} IS NOT NULL ELSE false END"


def hop_steps(q: Dialect) -> list[dict[str, str]]:
    """Columns to be added one step after another to rows with ``url``: hop1 and so on, null from where it ends, then
    ``destination``, ``hops`` and ``opaque``."""
    names = ["url", *(f"hop{k}" for k in range(1, BOUNDS.hops + 1))]
    steps = [{to: behind(q, of)} for of, to in zip(names, names[1:])]
    count = " + ".join(f"CASE WHEN {n} IS NULL THEN 0 ELSE 1 END" for n in names[1:])
    last = {"destination": f"coalesce({', '.join(reversed(names))})", "hops": count}
    return [*steps, last, {"opaque": withheld(q, "destination") + f" AND hops < {BOUNDS.hops}"}]


def unwrapped(df: DataFrame, column: str) -> DataFrame:
    """df with destination, hops, hosts (entry first) and opaque: up to three redirects peeled off the URL in ``column``.
    A null URL has null destination and no hosts. Columns hop1 to hop3 and url must not be there."""
    out = df.withColumn("url", F.col(column))
    for step in hop_steps(SPARK):
        out = out.select("*", *[F.expr(v).alias(k) for k, v in step.items()])
    names = ["url", *(f"hop{k}" for k in range(1, BOUNDS.hops + 1))]
    hosts = F.array_compact(F.array(*[F.nullif(host(n), F.lit("")) for n in names]))
    kept = [c for c in df.columns if c != "url"] + (["url"] if column == "url" else [])
    return out.select(*kept, "destination", "hops", hosts.alias("hosts"), "opaque")
