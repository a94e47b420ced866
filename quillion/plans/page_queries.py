"""Queries of HTML pages and of choosing entries.

``pages`` has no search results and no preambles: the declared input views wrap
each page's heading and snippets in both.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillion.functions import html
from quillion.operators import entries
from quillion.plans import sql
from quillion.plans.registry import query
from quillion.session import table
from quillion.sources import html_pages

S = sql.S


def _entities(x: str) -> str:
    for name, to in html.ENTITIES:
        x = f"regexp_replace({x}, '(?i)&{name};', {sql.quoted(to)}, 'g')"
    return x


def _strip(x: str) -> str:
    steps = [(r"(?i)<script[\s\S]*?</script>", " "), (r"(?i)<style[\s\S]*?</style>", " "), (rf"(?i)<br{S}*/?>", " "), (r"(?i)</p>", " "), (r"<[^>]+>", " "), (rf"{S}+([,.;:!?])", r"\1"), (f"{S}+", " ")]
    return sql.trimmed(sql.replaced(_entities(f"coalesce({x}, '')"), *steps))


@query("f10_f11_strip_html", f"select page_id, {_entities('html')} as decoded, {_strip('html')} as plain from pages")
def f10_f11_strip_html(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", html.decode_entities(F.col("html")).alias("decoded"), html.strip_html(F.col("html")).alias("plain"))


@query(
    "s13_page_texts",
    f"""select page_id, {_strip("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} as heading, array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?is)<p\\b[^>]*>(.*?)</p>', 1), lambda x: {_strip("x")}), lambda x: x <> ''), '|') as paragraphs from pages""",
)
def s13_page_texts(spark, sf_dir):
    return html_pages.page_texts(table(spark, sf_dir, "pages"), "page_id").select("page_id", "heading", F.array_join("paragraphs", "|").alias("paragraphs"))


# An entry page made of each page: its paragraphs in a preamble, its id in the URL and the date.
_ENTRY_SPARK = "concat('<meta name=\"', if(page_id % 2 = 0, 'DCTERMS.modified', 'x'), '\" content=\"2020-01-0', page_id % 9 + 1, '\"><meta property=\"citation_publication_date\" content=\"1999\"><div id=\"preamble\"><p>', url, '</p>', html, '</div><div id=\"toc\">')"
_ENTRY_SQL = "('<meta name=\"' || case when page_id % 2 = 0 then 'DCTERMS.modified' else 'x' end || '\" content=\"2020-01-0' || (page_id % 9 + 1) || '\"><meta property=\"citation_publication_date\" content=\"1999\"><div id=\"preamble\"><p>' || url || '</p>' || html || '</div><div id=\"toc\">')"
_WITHIN = "regexp_extract(page, '(?is)<div id=\"preamble\">(.*?)</div>\\s*(?:<div id=\"toc\">|</div>\\s*<div id=\"toc\">)', 1)"


@query(
    "s13_entries",
    f"""select page_id, title, source_url, coalesce(nullif(regexp_extract(page, '(?i)<meta name="DCTERMS\\.modified" content="([^"]+)"', 1), ''), regexp_extract(page, '(?i)<meta property="citation_publication_date" content="([^"]+)"', 1)) as revised,
array_to_string(ps, chr(10) || chr(10)) as preamble, array_to_string(ps[1:2], chr(10) || chr(10)) as excerpt from (
select page_id, page, {_strip("regexp_extract(page, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} as title, 'https://plato.stanford.edu/entries/e' || page_id || '/' as source_url,
list_filter(list_transform(regexp_extract_all(coalesce(nullif({_WITHIN}, ''), regexp_extract(page, '(?is)<div id="preamble">(.*?)</div>', 1)), '(?is)<p\\b[^>]*>(.*?)</p>', 1), lambda x: {_strip("x")}), lambda x: x <> '') as ps
from (select page_id, {_ENTRY_SQL} as page from pages))""",
)
def s13_entries(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").selectExpr("page_id", f"{_ENTRY_SPARK} as html", "concat(' https://plato.stanford.edu/entries/e', page_id, '/?q=1#x ') as url")
    return html_pages.entries(pages, "page_id").drop("paragraphs")


URLS = [
    (1, "https://plato.stanford.edu/entries/form/", ""), (2, " https://plato.stanford.edu/entries/a/b/?x=1#y ", ""), (3, "http://plato.stanford.edu/entries/form/", ""), (4, "https://plato.stanford.edu/about/", "https://x.y/s?q=1&entry=%2Fentries%2Fmind%2F&z=2"),
    (5, "", "https://x.y/s?entry=/entries/qualia/"), (6, "nonsense", "s?entry=/entries/qualia/"), (7, None, None), (8, "https://plato.stanford.edu/entries//", "https://x.y/s?entry=/other/"),
]


@query(
    "f12_f14_entry_urls",
    f"""with t as (select id, {sql.trimmed("coalesce(u, '')")} as u, coalesce(h, '') as h from {sql.values(URLS, "id, u, h")}),
p as (select *, regexp_extract(u, '(?i)^https://plato\\.stanford\\.edu(?::443)?(/[^?#]*)', 1) as path, url_decode(regexp_extract(h, '^[A-Za-z][A-Za-z0-9+.-]*://[^?#]*\\?(?:[^#]*&)?entry=([^&#]*)', 1)) as entry from t),
q as (select *, case when regexp_matches(path, '^/entries/.+/$') then 'https://plato.stanford.edu' || path else '' end as clean from p)
select id, clean, coalesce(nullif(clean, ''), case when regexp_matches(entry, '^/entries/.+/$') then 'https://plato.stanford.edu' || entry else '' end) as canonical,
replace(regexp_replace(regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g'), '^entries/', ''), '/', ' ') as slug from q""",
)
def f12_f14_entry_urls(spark, sf_dir):
    t = sql.frame(spark, URLS, "id int, u string, h string")
    return t.select("id", html.entry_url(F.col("u")).alias("clean"), html.canonical_url(F.col("u"), F.col("h")).alias("canonical"), html.url_slug(html.trim(F.coalesce("u", F.lit("")))).alias("slug"))


# A search page made of each page: two results for its heading.
_HEAD_SPARK = "regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)"
_SEARCH_SPARK = f"""concat('<div class="result_listing"><div class="result_title"> <a href="https://x.y/s?entry=/entries/p', page_id, '/">', {_HEAD_SPARK}, '</a></div><div class="result_url"><a>bad</a></div><div class="result_snippet"> about <b>', substring({_HEAD_SPARK}, 1, 10), '</b></div><!-- end result_snippet --></div><!-- end result_listing --> x <div class="result_listing"><div class="result_title"><a href="u">Other ', page_id % 7, '</a></div><div class="result_url"><a>https://plato.stanford.edu/entries/other-', page_id % 7, '/</a></div><div class="result_snippet">s</div><!-- end result_snippet --></div><!-- end result_listing --><div class="result_listing"><div class="result_title"><a href="u">No url</a></div></div><!-- end result_listing -->')"""
_HEAD_SQL = "regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)"
_FOUND_SQL = f"""(select page_id, 0 as nth, {_strip(_HEAD_SQL)} as title, 'https://plato.stanford.edu/entries/p' || page_id || '/' as url, {_strip(f"'about <b>' || substr({_HEAD_SQL}, 1, 10) || '</b>'")} as snippet from pages
union all select page_id, 1, 'Other ' || page_id % 7, 'https://plato.stanford.edu/entries/other-' || page_id % 7 || '/', 's' from pages)"""


def _found(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return html_pages.search_results(pages.selectExpr("page_id", f"{_SEARCH_SPARK} as html"), "page_id")


@query("s12_search_results", f"select page_id, nth, title, url, snippet, {sql.normalize_term('title')} as normalized_title from {_FOUND_SQL} where title <> ''")
def s12_search_results(spark, sf_dir):
    return _found(spark, sf_dir)


# Each page asks for the first two words of its heading, or "other n".
_TERM_SPARK = f"if(page_id % 3 = 0, concat('Other ', page_id % 7), concat_ws(' ', slice(split({_HEAD_SPARK}, ' '), 1, 2)))"
_TERM_SQL = f"case when page_id % 3 = 0 then 'Other ' || page_id % 7 else array_to_string(string_split({_HEAD_SQL}, ' ')[1:2], ' ') end"


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "pages").selectExpr("page_id", f"{_TERM_SPARK} as term", "array('the', concat('p', page_id)) as aliases")


_SLUG = "replace(regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g'), '^entries/', ''), '/', ' ')"


def _rungs(q: str) -> str:
    words = f"string_split({q}, ' ')"
    has = lambda hay: f"len(list_filter({words}, lambda w: w <> '' and not contains({hay}, w))) = 0"
    return f"""case when t = {q} then 120 when starts_with(t, {q} || ' ') or ends_with(t, ' ' || {q}) then 100 when contains(t, {q}) then 90 when u = {q} or contains(u, regexp_replace({q}, '\\s+', '-', 'g')) then 88
when {has("t")} then 78 when {has("u")} then 72 when {has("s")} then 62 else 0 end"""


_RANKED = f"""with c as (select f.*, {sql.normalize_term("title")} as t, {sql.normalize_term("snippet")} as s, {sql.normalize_term(_SLUG)} as u, q from {_FOUND_SQL} f join (select page_id, {sql.normalize_term(_TERM_SQL)} as q from pages) p using (page_id) where title <> ''),
scored as (select page_id, title, url, greatest(case when q = '' then 0 else {_rungs("q")} end, {_rungs("'the'")}, {_rungs("('p' || page_id)")}) as score, (q <> '' and t = q) or t = 'the' or t = 'p' || page_id as exact from c),
ranked as (select *, row_number() over (partition by page_id order by score desc, lower(title), title, url) as rank from scored)"""


@query("o2_o4_rank_entries", f"{_RANKED} select page_id, title, url, score::int as score, exact, rank::int as rank from ranked")
def o2_o4_rank_entries(spark, sf_dir):
    return entries.rank(_found(spark, sf_dir), _asked(spark, sf_dir), "page_id").select("page_id", "title", "url", "score", "exact", "rank")


@query(
    "o3_pick_entry",
    f"""{_RANKED} select page_id, title, url, score::int as score, exact or (score >= 90 and (second is null or score - second >= 15)) as picked
from (select *, lead(score) over (partition by page_id order by rank) as second from ranked) where rank = 1""",
)
def o3_pick_entry(spark, sf_dir):
    return entries.pick(entries.rank(_found(spark, sf_dir), _asked(spark, sf_dir), "page_id"), "page_id")


@query(
    "o7_first_answered",
    f"""with r as (select page_id % 50 as term_id, page_id // 50 as query_nth, nth + 10 * page_id as nth, title from {_FOUND_SQL} where title <> '')
select term_id, query_nth, nth, title from (select *, row_number() over (partition by term_id order by nth) as k from (select *, min(query_nth) over (partition by term_id) as m from r) where query_nth = m) where k <= 5""",
)
def o7_first_answered(spark, sf_dir):
    found = _found(spark, sf_dir).selectExpr("page_id % 50 as term_id", "page_id div 50 as query_nth", "nth + 10 * page_id as nth", "title")
    return entries.first_answered(found, "term_id")


@query(
    "p4_targets",
    f"""with e as (select page_id, case page_id % 5 when 0 then 'matched' when 1 then 'not_found' when 2 then 'failed' when 3 then null else 'odd' end as status, url from pages)
select page_id, status from e where url like '%/e%' and coalesce(status, '') not in ('matched', 'not_found')""",
)
def p4_targets(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    e = pages.selectExpr("page_id", "case page_id % 5 when 0 then 'matched' when 1 then 'not_found' when 2 then 'failed' when 3 then null else 'odd' end as status")
    return entries.targets(e, pages.where("url like '%/e%'"), "page_id")


@query(
    "a18_run_summary",
    """select count(*) filter (status = 'matched') as matched, count(*) filter (status = 'not_found') as not_found, count(*) filter (status = 'failed') as failed, count(*) filter (coalesce(status, '') not in ('matched', 'not_found', 'failed')) as skipped
from (select case page_id % 5 when 0 then 'matched' when 1 then 'not_found' when 2 then 'failed' when 3 then null else 'odd' end as status from pages)""",
)
def a18_run_summary(spark, sf_dir):
    e = table(spark, sf_dir, "pages").selectExpr("case page_id % 5 when 0 then 'matched' when 1 then 'not_found' when 2 then 'failed' when 3 then null else 'odd' end as status")
    return entries.run_summary(e)


@query(
    "j8_resolve_choice",
    f"""with f as (select * from {_FOUND_SQL} where title <> ''), c as (select page_id, case page_id % 4 when 0 then 'https://plato.stanford.edu/entries/p' || page_id || '/?x' when 1 then '' when 2 then 'https://plato.stanford.edu/entries/new/' else 'bad' end as u, case page_id % 4 when 1 then 'OTHER ' || page_id % 7 else 'Nothing like it' end as t from pages),
d as (select page_id, t, case when regexp_matches(u, '^https://plato.stanford.edu/entries/') then regexp_replace(u, '\\?.*', '') else '' end as u from c),
m as (select d.*, (select min(title) from f where f.page_id = d.page_id and f.url = d.u) as tu, (select min(title) from f where f.page_id = d.page_id and {sql.normalize_term("f.title")} = {sql.normalize_term("d.t")}) as tt, (select arg_min(url, title) from f where f.page_id = d.page_id and {sql.normalize_term("f.title")} = {sql.normalize_term("d.t")}) as ut from d)
select page_id, case when tu is not null then u when ut is not null then ut when u <> '' then u end as url, case when tu is not null then tu when ut is not null then tt when u <> '' then t end as title from m""",
)
def j8_resolve_choice(spark, sf_dir):
    choices = table(spark, sf_dir, "pages").selectExpr("page_id", "case page_id % 4 when 0 then concat('https://plato.stanford.edu/entries/p', page_id, '/?x') when 1 then '' when 2 then 'https://plato.stanford.edu/entries/new/' else 'bad' end as chosen_url", "case page_id % 4 when 1 then concat('OTHER ', page_id % 7) else 'Nothing like it' end as chosen_title")
    return entries.resolve(choices, _found(spark, sf_dir), "page_id")
