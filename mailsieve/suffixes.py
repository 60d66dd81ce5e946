"""Delegated top-level domains, from the public suffix list that comes with Spark's own HTTP client.

The list is data of that library, read where it lies: it is neither copied into this package nor written down here.
Another list in the same format may be named by the environment variable MAILSIEVE_SUFFIX_LIST."""

from __future__ import annotations

import os
import zipfile
from functools import cache
from pathlib import Path

import pyspark

from .refdata import PRIVATE_TLDS, WIDE_TLDS

MEMBER = "mozilla/public-suffix-list.txt"


def _listed() -> str:
    named = os.environ.get("MAILSIEVE_SUFFIX_LIST")
    if named:
        return Path(named).read_text("utf-8")
    homes = [Path(pyspark.__file__).parent / "jars", *([Path(os.environ["SPARK_HOME"]) / "jars"] if "SPARK_HOME" in os.environ else [])]
    for jar in sorted(j for home in homes for j in home.glob("httpclient-*.jar")):
        with zipfile.ZipFile(jar) as z:
            if MEMBER in z.namelist():
                return z.read(MEMBER).decode("utf-8")
    return ""


@cache
def delegated() -> tuple[str, ...]:
    """All ASCII top-level domains of the list with the reserved ones, sorted; those in wide use and all codes of two
    letters if there is no list. Labels in other scripts stand in hosts as xn-- and count as delegated anyway."""
    rules = (line.split()[0] for line in _listed().splitlines() if line.strip() and not line.startswith("//"))
    found = {r.lstrip("*.!").rpartition(".")[2].lower() for r in rules}
    letters = "abcdefghijklmnopqrstuvwxyz"
    known = {t for t in found if t.isascii()} or {*WIDE_TLDS, *(a + b for a in letters for b in letters)}
    return tuple(sorted(known | set(PRIVATE_TLDS)))
