"""One place for regular-expression dialects.

White space means the same set everywhere: ASCII spaces and the Unicode ones,
with the no-break space and the byte-order mark. Java's ``\\s`` knows only the
former, so the set is spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White-space characters, for use inside a bracket expression (Java).
SPACES = r" \t\n\x0B\f\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
S = f"[{SPACES}]"
NOT_S = f"[^{SPACES}]"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{S}+|{S}+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return trim(F.regexp_replace(c, f"{S}+", " "))


def rewrite(c: Column, *steps: tuple[str, str]) -> Column:
    """Ordered replacements."""
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")
