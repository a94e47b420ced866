"""HTML and URL scalars: entities, tag stripping, entry URLs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillion.functions.regex import S, rewrite, squeeze, trim

#: Named entities in the order of replacing; the ampersand comes before the angle brackets.
ENTITIES = [("nbsp", " "), ("ndash", "–"), ("mdash", "—"), ("hellip", "…"), ("ldquo", "“"), ("rdquo", "”"), ("lsquo", "‘"), ("rsquo", "’"), ("quot", '"'), ("amp", "&"), ("lt", "<"), ("gt", ">")]
#: What tags become, in order.
TAGS = [(r"(?i)<script[\s\S]*?</script>", " "), (r"(?i)<style[\s\S]*?</style>", " "), (rf"(?i)<br{S}*/?>", " "), (r"(?i)</p>", " "), (r"<[^>]+>", " "), (rf"{S}+([,.;:!?])", "$1")]
ENTRY_HOST = "plato.stanford.edu"
_NUMBER = re.compile(r"&#(?:x([0-9a-f]+)|([0-9]+));", re.IGNORECASE)


def _character(m: re.Match) -> str:
    point = int(m[1], 16) if m[1] else int(m[2])
    return chr(point) if 0 < point < 0x110000 else ""


@F.pandas_udf(StringType())
def numeric_entities(texts: pd.Series) -> pd.Series:
    """Numeric character references as characters; Spark has no function from a matched number to a character."""
    return texts.map(lambda t: _NUMBER.sub(_character, t) if t and "&#" in t else t)


def decode_entities(c: Column) -> Column:
    return rewrite(numeric_entities(F.coalesce(c, F.lit(""))), *[(f"(?i)&{name};", to) for name, to in ENTITIES])


def strip_html(c: Column) -> Column:
    """Plain text; entities are decoded first, so escaped tags vanish too."""
    return squeeze(rewrite(decode_entities(c), *TAGS))


def first_capture(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), pattern, group)


def entry_url(c: Column, host: str = ENTRY_HOST) -> Column:
    """Origin and path of an entry's URL, without query and fragment; empty for any other URL."""
    url = trim(F.coalesce(c, F.lit("")))
    path = F.regexp_extract(url, rf"(?i)^https://{re.escape(host)}(?::443)?(/[^?#]*)", 1)
    return F.when(path.rlike("^/entries/.+/$"), F.concat(F.lit(f"https://{host}"), path)).otherwise("")


def canonical_url(shown: Column, href: Column, host: str = ENTRY_HOST) -> Column:
    """The shown URL if it is an entry's, else the entry named in the link's query."""
    entry = F.url_decode(F.regexp_extract(F.coalesce(href, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^?#]*\?(?:[^#]*&)?entry=([^&#]*)", 1))
    named = F.when(entry.rlike("^/entries/.+/$"), F.concat(F.lit(f"https://{host}"), entry)).otherwise("")
    return F.coalesce(F.nullif(entry_url(shown, host), F.lit("")), named)


def url_slug(c: Column) -> Column:
    """Words of an entry's path."""
    path = F.regexp_extract(F.coalesce(c, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return rewrite(path, ("^/+|/+$", ""), ("^entries/", ""), ("/", " "))


def contains_all_words(hay: Column, needle: Column) -> Column:
    """Whether each word of an already normalised needle occurs somewhere in hay; false without words."""
    words = F.filter(F.split(needle, " "), lambda w: w != "")
    return (F.size(words) > 0) & F.forall(words, lambda w: F.contains(hay, w))
