"""Scans of fetched HTML: search-result pages and entry pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillion.functions import html
from quillion.functions.regex import S, trim
from quillion.functions.text import normalize_term

_RESULT = r'(?s)<div class="result_listing">.*?</div><!-- end result_listing -->'
_TITLE = rf'(?is)<div class="result_title">{S}*<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>'
_URL = rf'(?is)<div class="result_url">{S}*<a[^>]*>(.*?)</a>'
_SNIPPET = rf'(?is)<div class="result_snippet">{S}*(.*?)</div><!-- end result_snippet -->'


def search_results(pages: DataFrame, key: str, html_col: str = "html", host: str = html.ENTRY_HOST) -> DataFrame:
    """(key, nth, title, url, snippet, normalized_title) of every result with a title and an entry's URL."""
    found = pages.where(~F.contains(html_col, F.lit("No documents found"))).select(key, F.posexplode(F.regexp_extract_all(html_col, F.lit(f"({_RESULT})"), 1)).alias("nth", "block"))
    block = F.col("block")
    rows = found.select(
        key, "nth", html.strip_html(html.first_capture(block, _TITLE, 2)).alias("title"),
        html.canonical_url(html.strip_html(html.first_capture(block, _URL)), html.first_capture(block, _TITLE, 1), host).alias("url"), html.strip_html(html.first_capture(block, _SNIPPET)).alias("snippet"),
    )
    return rows.where("title <> '' and url <> ''").withColumn("normalized_title", normalize_term(F.col("title")))


def entries(pages: DataFrame, key: str, html_col: str = "html", url_col: str = "url", host: str = html.ENTRY_HOST) -> DataFrame:
    """(key, title, source_url, revised, paragraphs, preamble, excerpt) of entry pages."""
    page = F.col(html_col)
    within = html.first_capture(page, r'(?is)<div id="preamble">(.*?)</div>\s*(?:<div id="toc">|</div>\s*<div id="toc">)')
    preamble = F.coalesce(F.nullif(within, F.lit("")), html.first_capture(page, r'(?is)<div id="preamble">(.*?)</div>'))
    revised = F.coalesce(F.nullif(html.first_capture(page, r'(?i)<meta name="DCTERMS\.modified" content="([^"]+)"'), F.lit("")), html.first_capture(page, r'(?i)<meta property="citation_publication_date" content="([^"]+)"'))
    # The marks stripping needs Python for numeric entities: they are decoded once, for the whole preamble.
    rows = pages.select(key, html.strip_html(html.first_capture(page, r"(?is)<h1[^>]*>(.*?)</h1>")).alias("title"), html.entry_url(F.col(url_col), host).alias("source_url"), revised.alias("revised"), html.numeric_entities(preamble).alias("p"))
    named = [(f"(?i)&{n};", to) for n, to in html.ENTITIES]
    plain = F.transform(F.regexp_extract_all("p", F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), 1), lambda x: trim(F.regexp_replace(html.rewrite(html.rewrite(x, *named), *html.TAGS), f"{S}+", " ")))
    rows = rows.withColumn("paragraphs", F.filter(plain, lambda x: x != "")).drop("p")
    preamble = F.array_join("paragraphs", "\n\n")
    return rows.withColumns({"preamble": preamble, "excerpt": F.array_join(F.slice("paragraphs", 1, 2), "\n\n")})


def page_texts(pages: DataFrame, key: str, html_col: str = "html") -> DataFrame:
    """(key, heading, paragraphs, text) of any page: its first heading, what stands between ``<p>`` and ``</p>``, and all its text."""
    page = F.col(html_col)
    rows = pages.select(key, html.numeric_entities(F.coalesce(page, F.lit(""))).alias("page"))
    named = [(f"(?i)&{n};", to) for n, to in html.ENTITIES]
    strip = lambda x: html.squeeze(html.rewrite(html.rewrite(x, *named), *html.TAGS))
    return rows.select(key, strip(html.first_capture(F.col("page"), r"(?is)<h1[^>]*>(.*?)</h1>")).alias("heading"), F.filter(F.transform(F.regexp_extract_all("page", F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), 1), strip), lambda x: x != "").alias("paragraphs"), strip(F.col("page")).alias("text"))
