"""Queries of the layout engine.

No table has page geometry: the declared input view makes each line of a
document's text, whole, a line on a page of 12, with boxes and sizes by
arithmetic. The first of the 12 is not the document's: it has the page's number.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillion.operators import layout
from quillion.plans import sql
from quillion.plans.registry import query
from quillion.plans.text_queries import _repair_sql
from quillion.session import table

_COLUMNS = """doc_id, cast(1 + floor(pos / 12) as int) as page, cast(pos as int) as line, cast(600 as double) as width, cast(800 as double) as height,
cast(40 + (pos % 12) * 60 as double) + (doc_id % 3) * cast(0.5 as double) as y0, cast(50 + (pos % 12) * 60 as double) + (doc_id % 3) * cast(0.5 as double) as y1,
cast(case when doc_id % 4 = 0 then (case when pos % 2 = 0 then 60 else 320 end) when pos % 5 = 0 then 80 else 60 end as double) as x0,
cast(case when doc_id % 4 = 0 then (case when pos % 2 = 0 then 280 else 540 end) when pos % 5 = 0 then 470 else 460 + (pos % 7) * 12 end as double) as x1,
case when pos % 12 >= 10 then cast(8 as double) else cast(10 + pos % 3 as double) end as size, pos % 6 = 0 as bold,
case when pos % 12 >= 10 then 'footnote' when pos % 12 = 9 then 'figure' when pos % 12 = 0 then 'header' else 'body' end as region,
concat(case pos % 9 when 1 then '1. ' when 2 then '(a) ' when 3 then '• ' when 4 then '(3′) ' when 5 then 'x A ' when 6 then '12) ' when 8 then '[12] ' else '' end, case when pos % 12 = 0 then concat('Page ', cast(1 + floor(pos / 12) as int)) else x end) as text"""
_LINES = f"cut as (select doc_id, unnest(l) as x, generate_subscripts(l, 1) - 1 as nth from (select doc_id, string_split(text, chr(10)) as l from documents)), lines as (select {_COLUMNS} from (select doc_id, x, nth + nth // 11 + 1 as pos from cut union all select doc_id, '', nth + nth // 11 from cut where nth % 11 = 0))"


def _lines(spark, sf_dir):
    cut = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("nth", "x"))
    own = "named_struct('pos', nth + nth div 11 + 1, 'x', x)"
    return cut.selectExpr("doc_id", f"inline(if(nth % 11 = 0, array(named_struct('pos', nth + nth div 11, 'x', ''), {own}), array({own})))").selectExpr(*_split_columns(_COLUMNS))


def _split_columns(text: str) -> list[str]:
    out, depth, quote, last = [], 0, False, 0
    for i, ch in enumerate(text):
        quote ^= ch == "'"
        if not quote:
            depth += (ch == "(") - (ch == ")")
            if ch == "," and not depth:
                out.append(text[last:i])
                last = i + 1
    return [x.strip() for x in [*out, text[last:]]]


_CLEAN = f"regexp_replace(regexp_replace({_repair_sql('text')}, '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


@query(
    "a11_f21_lines_of_spans",
    """with spans as (select doc_id, line, k, word as text, 60.0::double + 40 * k as x0, 60.0::double + 40 * k + (case k % 3 when 0 then 38 when 1 then 39.5 else 40 end)::double as x1, (10 + k % 2)::double as size from
(select doc_id, line, unnest(w) as word, generate_subscripts(w, 1) - 1 as k from (select doc_id, line, string_split(x, ' ') as w from (select doc_id, unnest(l) as x, generate_subscripts(l, 1) - 1 as line from (select doc_id, string_split(text, chr(10)) as l from documents)))) where word <> ''),
j as (select *, lag(x1) over w as px, lag(size) over w as ps from spans window w as (partition by doc_id, line order by x0))
select doc_id, line::int as line, string_agg(case when x0 - px > greatest(1.2, least(ps, size) * 0.18) and not regexp_matches(text, '^[,.;:!?)\\]}]') then ' ' || text else text end, '' order by x0) as text, min(x0) as x0, max(x1) as x1, median(size) as size from j group by doc_id, line""",
)
def a11_f21_lines_of_spans(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "x"))
    words = lines.select("doc_id", F.lit(1).alias("page"), "line", F.posexplode(F.split("x", " ")).alias("k", "text"))
    spans = words.selectExpr("doc_id", "page", "line", "text", "60D + 40 * k as x0", "0D as y0", "60D + 40 * k + (case k % 3 when 0 then 38D when 1 then 39.5D else 40D end) as x1", "10D as y1", "cast(10 + k % 2 as double) as size", "false as bold")
    return layout.lines_of(spans).select("doc_id", "line", "text", "x0", "x1", "size")


@query(
    "a6_a7_body_size",
    f"""with {_LINES}, s as (select doc_id, page, line, round_even(size / 0.25, 0) * 0.25 as s from lines where 64 < y0 and y0 < 704 and size > 0),
c as (select doc_id, page, s, count(*) as n, min(line) as f from s group by all), m as (select doc_id, page, arg_max(s, n * 1000000 - f) as mode, max(n) as most from c group by all)
select doc_id, page, coalesce(max(case when s > mode + 0.75 and n >= greatest(3, most * 0.25) then s end), any_value(mode))::double as body_size from c join m using (doc_id, page) group by doc_id, page""",
)
def a6_a7_body_size(spark, sf_dir):
    return layout.body_sizes(_lines(spark, sf_dir).withColumn("seq", F.col("line")))


_KEY = f"case when length(k) <= 1 then '' else k end from (select *, regexp_replace(lower({_CLEAN}), '[0-9]+', '#', 'g') as k from lines)"


@query(
    "a5_f29_marginalia",
    f"""with {_LINES}, keyed as (select doc_id, page, y0, y1, {_KEY.replace("case", "case", 1).replace(" from (select", " as key from (select", 1)}),
c as (select doc_id, key, 'header' as place, count(*) as n from keyed where key <> '' and y0 < 96 group by all union all select doc_id, key, 'footer', count(*) from keyed where key <> '' and y1 > 720 group by all),
p as (select doc_id, count(distinct page) as pages from lines group by all) select doc_id, key, place, n from c join p using (doc_id) where n >= greatest(2, floor(pages * 0.35))""",
)
def a5_f29_marginalia(spark, sf_dir):
    return layout.repeated_marginalia(_lines(spark, sf_dir))


_COLS = f"""with {_LINES}, e as (select *, 96 < y0 and y0 < 656 and x1 - x0 < 348 as ok, (x0 + x1) / 2 as mid from lines),
pg as (select doc_id, page, count(*) filter (ok and mid < 282) as l, count(*) filter (ok and mid > 318) as r, median(x0) filter (ok and mid > 318) - median(x1) filter (ok and mid < 282) as g from e group by all),
cols as (select e.*, case when l >= 2 and r >= 2 and g > 30 then 2 else 1 end as columns, case when not (l >= 2 and r >= 2 and coalesce(g, 0) > 30) then 0 when x1 - x0 > 372 then -1 when mid < 300 then 0 else 1 end as "column" from e join pg using (doc_id, page))"""


@query("a12_columns", f'{_COLS} select doc_id, page, line, columns, "column" from cols')
def a12_columns(spark, sf_dir):
    return layout.with_columns(_lines(spark, sf_dir)).select("doc_id", "page", "line", "columns", "column")


@query(
    "o8_reading_order",
    f"""{_COLS}, z as (select *, region in ('header', 'footer', 'footnote') as margin, min(case when region not in ('header', 'footer', 'footnote') and "column" in (0, 1) then y0 end) over (partition by doc_id, page) as first from cols),
k as (select *, case when columns <> 2 then 0 when margin then 4 when "column" = -1 and y0 <= coalesce(first, 0) + greatest(24, size * 3) then 0 when "column" = 0 then 1 when "column" = 1 then 2 else 3 end as zone,
case when columns <> 2 or margin then (case region when 'header' then 0 when 'footnote' then 2 when 'footer' then 3 else 1 end) else 0 end as rank from z)
select doc_id, page, line, row_number() over (partition by doc_id, page order by zone, rank, round_even(y0 / 2.0, 0) * 2.0, x0, line)::int as reading from k""",
)
def o8_reading_order(spark, sf_dir):
    return layout.reading_order(layout.with_columns(_lines(spark, sf_dir))).select("doc_id", "page", "line", "reading")


@query("a13_separator", f"with {_LINES} select doc_id, page, min(y0) as separator from lines where y0 > 440 and x1 - x0 < 330 group by all")
def a13_separator(spark, sf_dir):
    return layout.footnote_separator(_lines(spark, sf_dir))


@query(
    "a14_footnote_starts",
    f"""{_COLS} select doc_id, page, "column", arg_min(y0, y0) as start from (select *, {_CLEAN} as c from cols) where size < 9.2 and y0 >= 416 and x0 < 168
and (regexp_matches(c, '^\\s*(?:\\d{{1,3}}(?:[.)]\\s*|\\s+[A-Z“"''(]|[A-Z“"''(])|[*†‡§](?:\\s+|[.)])?)') or (page = 1 and regexp_matches(c, '(?i)^\\s*(?:date|received|accepted|published)\\b'))) group by all""",
)
def a14_footnote_starts(spark, sf_dir):
    cols = layout.with_columns(_lines(spark, sf_dir)).withColumn("body_size", F.lit(10.0))
    return layout.footnote_starts(cols)


@query(
    "w4_merged_fragments",
    """with f as (select doc_id, 1 as page, k as line, word as text, (60 + 50 * (k % 8) + case when k % 5 = 0 then 30 else 0 end)::double as x0, (105 + 50 * (k % 8))::double as x1, (100 + 14 * (k // 8))::double as y0, (110 + 14 * (k // 8))::double as y1, (10 + case when k % 7 = 0 then 2 else 0 end)::double as size
from (select doc_id, unnest(w) as word, generate_subscripts(w, 1) - 1 as k from (select doc_id, string_split(replace(text, chr(10), ' '), ' ') as w from documents))),
o as (select *, lag(x1) over w as px1, lag(y0) over w as py0, lag(y1) over w as py1, lag(size) over w as ps from f window w as (partition by doc_id order by round_even(y0 / 2.0, 0) * 2.0, x0, line)),
j as (select *, coalesce(abs(ps - size) <= greatest(0.35, ps * 0.04) and abs((py0 + py1) / 2 - (y0 + y1) / 2) <= greatest(1.6, greatest(ps, size, 1) * 0.22) and least(py1, y1) - greatest(py0, y0) >= least(py1 - py0, y1 - y0) * 0.55 and x0 - px1 between -1 and greatest(22, greatest(ps, size, 1) * 3.2), false) as joins from o),
s as (select *, sum(case when joins then 0 else 1 end) over (partition by doc_id order by round_even(y0 / 2.0, 0) * 2.0, x0, line) as session from j)
select doc_id, min(line)::int as line, string_agg(text, ' ' order by x0, round_even(y0 / 2.0, 0), line) as text, min(x0) as x0, max(x1) as x1 from s group by doc_id, session""",
)
def w4_merged_fragments(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("k", "text"))
    frag = words.selectExpr("doc_id", "1 as page", "k as line", "text", "cast(60 + 50 * (k % 8) + if(k % 5 = 0, 30, 0) as double) as x0", "cast(105 + 50 * (k % 8) as double) as x1", "cast(100 + 14 * (k div 8) as double) as y0", "cast(110 + 14 * (k div 8) as double) as y1", "cast(10 + if(k % 7 = 0, 2, 0) as double) as size")
    return layout.merged_fragments(frag).select("doc_id", "line", "text", "x0", "x1")


_HEAD = "(length({0}) <= 160 and (regexp_matches({0}, '^\\d+(?:\\.\\d+)*\\.\\s+\\S') or regexp_matches({0}, '(?i)^[IVXLCDM]+[.)]\\s+\\S')))"
_TAIL = "[:.;!?][”\"'')\\]]?$"
_BREAKS = f"""{_COLS}, c as (select *, {_CLEAN} as t from cols), o as (select *, lag(page) over w as p_page, lag("column") over w as p_col, lag(size) over w as ps, lag(x0) over w as px0, lag(x1) over w as px1, lag(y0) over w as py0, lag(y1) over w as py1, lag(t) over w as pt, lag(region) over w as pr from c window w as (partition by doc_id order by line)),
g as (select *, greatest(ps, size, py1 - py0, y1 - y0, 1) as h, y0 - py1 as gap, x0 - px0 as indent, {_HEAD.format("pt")} as ph, {_HEAD.format("t")} as th from o),
b as (select *, pr = 'body' and region = 'body' and not ph and not th and pt <> '' and t <> '' and not regexp_matches(pt, '{_TAIL}') as body, regexp_matches(t, '^[a-zà-öø-ÿ(“"''∼∀∃]') as lower_ from g),
st as (select *, case when p_page is null then true when p_page <> page then not (body and not regexp_matches(t, '^(?:[•·∙]|[-*]\\s+|\\d{{1,3}}[.)]\\s+)') and (abs(indent) <= greatest(18, size * 2.2) or lower_))
 when p_col <> "column" then not (body and p_col = 0 and "column" = 1 and not regexp_matches(t, '^(?:[•·∙]|[-*]\\s+|\\(\\d{{1,3}}[′'']\\)\\s+|\\d{{1,3}}[.)]\\s+)') and py0 - y0 > greatest(120, greatest(ps, size, 1) * 12) and lower_)
 when ph and gap > h * 0.25 then true when th and gap > h * 0.35 then true when gap > h * 1.35 then true
 when pt <> '' and t <> '' and regexp_matches(pt, '^(?:\\(\\d{{1,3}}\\)\\s+)?\\([a-z]\\)\\s+\\S') and gap between -h * 0.2 and h * 0.75 and x0 > px0 + greatest(12, size) then false
 when pt <> '' and t <> '' and regexp_matches(rtrim(regexp_replace(pt, '(?:\\d{{1,3}}|[*†‡§])$', '')), '{_TAIL}') and regexp_matches(t, '^[A-ZÀ-ÖØ-Þ“"''‘(]') and gap between -h * 0.2 and h * 1.35 and indent >= greatest(6, size * 0.65) then true
 else px1 - px0 < greatest(x1 - x0, px1 - px0) * 0.68 and x0 > px0 + greatest(12, size) end as starts from b),
para as (select *, sum(case when starts then 1 else 0 end) over (partition by doc_id order by line) as paragraph from st)"""


def _tight(lines):
    """The view with lines 14 points apart, so that paragraphs have several lines."""
    return lines.withColumns({"y0": F.col("y0") * 0.25, "y1": F.col("y0") * 0.25 + 10})


@query("w3_paragraph_breaks", f"{_BREAKS.replace('(select *, {_CLEAN} as t from cols)', '')} select doc_id, line, paragraph::bigint as paragraph from para".replace(f"c as (select *, {_CLEAN} as t from cols)", f"c as (select * replace (y0 * 0.25 as y0, y0 * 0.25 + 10 as y1), {_CLEAN} as t from cols)"))
def w3_paragraph_breaks(spark, sf_dir):
    lines = _tight(layout.with_columns(_lines(spark, sf_dir)))
    return layout.paragraph_breaks(lines, ["line"]).select("doc_id", "line", "paragraph")


@query(
    "f48_a17_joined_paragraphs",
    f"""{_BREAKS}, r as (select doc_id, paragraph, string_agg(t, chr(10) order by line) filter (t <> '') as raw, count(*) filter (p_page <> page and not starts) as merges from para group by all)
select doc_id, paragraph::bigint as paragraph, array_to_string(list_filter(list_transform(string_split(regexp_replace(coalesce(raw, ''), '([A-Za-zΑ-Ωα-ωÀ-ÖØ-öø-ÿ])-\\n([A-Za-zΑ-Ωα-ωÀ-ÖØ-öø-ÿ])', '\\1\\2', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ') as text, merges::bigint as merges from r""".replace(
        f"c as (select *, {_CLEAN} as t from cols)", f"c as (select * replace (y0 * 0.25 as y0, y0 * 0.25 + 10 as y1), {_CLEAN} as t from cols)"
    ),
)
def f48_a17_joined_paragraphs(spark, sf_dir):
    lines = layout.paragraph_breaks(_tight(layout.with_columns(_lines(spark, sf_dir))), ["line"])
    return layout.joined(lines, ["line"])


_RANK = "list_sort(list({0}))[round_even((count(*) - 1) * {1}, 0)::int + 1]"


@query(
    "a9_j14_text_edges",
    f"""with {_LINES}, p as (select doc_id, page, {_RANK.format("x0", 0.1)} as l, {_RANK.format("x1", 0.9)} as r from lines where region = 'body' and trim(text) <> '' and x1 - x0 >= 252 and y0 > 64 and y1 < 720 group by all),
w as (select doc_id, {_RANK.format("l", 0.1)} as dl, {_RANK.format("r", 0.9)} as dr from p group by all)
select doc_id, page, coalesce(l, dl) as "left", coalesce(r, dr) as "right" from (select distinct doc_id, page from lines) left join p using (doc_id, page) join w using (doc_id)""",
)
def a9_j14_text_edges(spark, sf_dir):
    return layout.text_edges(_lines(spark, sf_dir))


@query(
    "p11_list_markers",
    f"""with {_LINES}, c as (select doc_id, line, x0, {_CLEAN} as t from lines), m as (select *, regexp_extract(t, '^\\((\\d{{1,3}})[′'']\\)\\s+', 1) as prime, regexp_extract(t, '^(\\d{{1,3}})[.)]\\s+', 1) as num, regexp_extract(t, '^\\(?([a-z])\\)[\\s.]+', 1) as letter, regexp_extract(t, '^([xyz{{])\\s+(?:∴|[A-Z]\\b|\\$?[A-Z])', 1) as broken,
regexp_matches(t, '^\\d+(?:\\.\\d+)*\\.\\s+\\S') and length(t) <= 120 as heading, regexp_matches(t, '^(?:[•·∙]|[-*]\\s+)') as bullet from c)
select doc_id, line, case when bullet then 'unordered' else 'ordered' end as kind, (case when bullet or prime <> '' or num <> '' then 0 when letter <> '' then 1 else 0 end)::int as level,
(case when bullet then 0 when prime <> '' then prime::int when num <> '' then num::int when letter <> '' then ascii(letter) - 96 else instr('xyz{{', broken) end)::int as index, case when bullet then '' when prime <> '' then prime || '′' when num <> '' then '' when letter <> '' then regexp_extract(t, '^(\\(?[a-z]\\))', 1) else '' end as marker,
not bullet and prime = '' and num = '' and letter = '' as recovered from m where not heading and (bullet or prime <> '' or num <> '' or letter <> '' or (broken <> '' and x0 > 70))""",
)
def p11_list_markers(spark, sf_dir):
    from quillion.functions.text import clean_text

    lines = _lines(spark, sf_dir).withColumn("m", layout.list_marker(clean_text(F.col("text")), F.col("x0"))).where("m is not null")
    return lines.select("doc_id", "line", "m.*")


@query(
    "p9_a19_f46_levels_and_anchors",
    f"""with {_LINES} select doc_id, line, (case when size >= 10 + 5 then 1 when size >= 8 + 3 then 2 else 3 end)::int as level, (doc_id % 4 = 0 or count(*) over (partition by doc_id, line % 5) > 1) as twice,
'fn-' || lpad((line % 5)::varchar, 3, '0') || case when count(*) over (partition by doc_id, line % 5) > 1 then '-p' || lpad(page::varchar, 3, '0') else '' end as anchor, case when line % 2 = 0 then (line % 5)::varchar else 'Page ' || page || ' note' end as label from lines""",
)
def p9_a19_f46_levels_and_anchors(spark, sf_dir):
    from pyspark.sql import Window

    lines = _lines(spark, sf_dir).withColumns({"marker": (F.col("line") % 5).cast("string"), "linked": F.col("line") % 2 == 0})
    out = layout.anchored_notes(lines)
    twice = (F.col("doc_id") % 4 == 0) | (F.count("*").over(Window.partitionBy("doc_id", "marker")) > 1)
    return out.select("doc_id", "line", layout.heading_level(F.col("size"), F.when(F.col("size") >= 15, 10).otherwise(8)).alias("level"), twice.alias("twice"), "anchor", "label")


@query(
    "w5_footnote_groups",
    f"""with {_LINES}, c as (select *, {_CLEAN} as t from lines where region = 'footnote'), o as (select *, regexp_matches(t, '^\\s*(?:\\d{{1,3}}(?:[.)]\\s*|\\s+[A-Z“"''(]|[A-Z“"''(])|[*†‡§](?:\\s+|[.)])?)') and regexp_matches(t, '^[\\d*†‡§]') as opens, row_number() over (partition by doc_id, page order by y0, x0, line) as nth from c)
select doc_id, page, line, sum(case when opens or nth = 1 then 1 else 0 end) over (partition by doc_id, page order by y0, x0, line)::bigint as entry from o""",
)
def w5_footnote_groups(spark, sf_dir):
    notes = _lines(spark, sf_dir).where("region = 'footnote'").withColumn("column", F.lit(0))
    return layout.footnote_groups(notes).select("doc_id", "page", "line", "entry")


@query(
    "a15_w6_note_profile",
    f"""with {_LINES}, c as (select *, case when line = 20 then 'References ' else '' end || {_CLEAN} as t from lines), s as (select *, bool_or(regexp_matches(t, '(?i)^references\\b')) over (partition by doc_id order by line) as seen, regexp_extract_all(t, '\\[(\\d{{1,4}})\\]', 1) as found from c)
select doc_id, coalesce(bool_or(seen and len(found) > 0), false) or (bool_or(seen) and coalesce(sum(len(found)) filter (not seen and 96 < y0 and y0 < 720), 0) > 0) as bibliography, count(*) filter (region = 'footnote') > 0 as footnotes, bool_or(seen) and count(*) filter (region = 'footnote') = 0 as endnotes,
coalesce(array_to_string(list_sort(list_distinct(flatten(list(found) filter (seen)))), ','), '') as markers from s group by doc_id""",
)
def a15_w6_note_profile(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("text", F.when(F.col("line") == 20, F.concat(F.lit("References "), "text")).otherwise(F.col("text")))
    return layout.note_profile(lines).withColumn("markers", F.array_join("markers", ","))


@query("t8_reference_entries")
def t8_reference_entries(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("text", F.when(F.col("line") == 0, "References").otherwise(F.col("text")))
    return layout.reference_entries(lines)
