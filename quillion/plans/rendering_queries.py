"""Queries of headings, quotes, figures, notes and rendering, on the layout view."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillion.operators import layout, rendering
from quillion.plans import sql
from quillion.plans.layout_queries import _CLEAN, _LINES, _RANK, _lines
from quillion.plans.registry import query
from quillion.session import table

_COMMON = sql.quoted(rendering.COMMON_HEADINGS)
_HEADINGS = f"""with {_LINES}, c as (select *, {_CLEAN} as t, case when line % 4 = 0 then upper({_CLEAN}) else {_CLEAN} end as u from lines),
h as (select *, regexp_replace(u, '[^A-Za-z]', '', 'g') as letters, regexp_extract(u, '^(\\S+)', 1) as first from c),
heads as (select *, case when (length(u) <= 160 and regexp_matches(u, '(?i)^[IVXLCDM]+[.)]\\s+\\S')) or list_contains({_COMMON}, regexp_replace(lower(u), '^[ .:]+|[ .:]+$', '', 'g')) then 2
 when u <> '' and size <= 11 * 0.95 and y0 <= 560 and length(u) <= 32 and len(regexp_split_to_array(trim(u), '\\s+')) <= 3 and letters <> '' and upper(letters) = letters then 3
 when regexp_matches(u, '^\\d+(?:\\.\\d+)*\\.\\s+\\S') and length(u) <= 120 then greatest(2, least(6, length(first) - length(replace(first, '.', '')) + 1))
 when bold and (size >= 15 or (size >= 13 and y0 < 280)) then case when size >= 16 then 1 when size >= 14 then 2 else 3 end end as heading from h)"""


def _heads(spark, sf_dir):
    from quillion.functions.text import clean_text, upper

    c = clean_text(F.col("text"))
    lines = _lines(spark, sf_dir).withColumn("text", F.when(F.col("line") % 4 == 0, upper(c)).otherwise(F.col("text")))
    return rendering.headings(lines.withColumn("body_size", F.lit(11.0)))


@query("p8_p9_headings", f"{_HEADINGS} select doc_id, line, heading::int as heading from heads where heading is not null")
def p8_p9_headings(spark, sf_dir):
    return _heads(spark, sf_dir).where("heading is not null").select("doc_id", "line", "heading")


@query(
    "p10_display_quotes",
    f"""with {_LINES}, p as (select doc_id, page, {_RANK.format("x0", 0.1)} as l, {_RANK.format("x1", 0.9)} as r from lines where region = 'body' and trim(text) <> '' and x1 - x0 >= 252 and y0 > 64 and y1 < 720 group by all),
w as (select doc_id, {_RANK.format("l", 0.1)} as dl, {_RANK.format("r", 0.9)} as dr from p group by all), e as (select doc_id, page, coalesce(l, dl) as l, coalesce(r, dr) as r from (select distinct doc_id, page from lines) left join p using (doc_id, page) join w using (doc_id)),
j as (select lines.*, line // 2 as paragraph, {_CLEAN} as t, coalesce(x0 >= l + greatest(7, size * 0.65) and x1 <= r - greatest(7, size * 0.65), false) as inside from lines left join e using (doc_id, page))
select doc_id, paragraph::bigint as paragraph, (count(*) > 1 or bool_or(regexp_matches(t, '^\\[\\d{{1,3}}\\]\\s+\\S'))) and count(*) filter (t <> '') > 0 and coalesce(bool_and(inside) filter (t <> ''), false) as quote from j group by doc_id, paragraph""",
)
def p10_display_quotes(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return rendering.display_quotes(lines.withColumn("paragraph", F.floor(F.col("line") / 2)), layout.text_edges(lines))


@query(
    "j15_p13_figure_lines",
    f"""with {_LINES}, v as (select * replace (line * 2 as line) from lines union all select * replace (line * 2 + 1 as line, '(ABC)' as text) from lines where line % 3 = 0), c as (select doc_id, page, line as c_line, greatest(y0 - 180, 0) as top, y0 + greatest(12, size * 1.5) as low from v where region = 'figure')
select doc_id, page, line from v where region = 'figure' union select v.doc_id, v.page, v.line from v join c using (doc_id, page) where line <> c_line and y0 >= top and y1 <= low and text <> '' and length({_CLEAN}) <= 90
and (regexp_matches({_CLEAN}, '^\\(?[A-Z]{{1,6}}[0-9]?\\)?$') or regexp_matches({_CLEAN}, '[&=↑⇑⇕→↔⊃≡∀∃]') or regexp_matches({_CLEAN}, '^\\([A-Z]{{1,8}}\\)$'))""",
)
def j15_p13_figure_lines(spark, sf_dir):
    """A short label beside every third line."""
    lines = _lines(spark, sf_dir)
    labels = lines.where("line % 3 = 0").withColumns({"line": F.col("line") * 2 + 1, "text": F.lit("(ABC)")})
    return rendering.figure_lines(lines.withColumn("line", F.col("line") * 2).unionByName(labels))


_NODES_SQL = """nodes as (select doc_id, pos, x as text, case pos % 5 when 0 then 'heading' when 1 then 'list_item' when 2 then 'list_item' when 3 then 'blockquote' else 'paragraph' end as kind, pos % 8 as level, case when pos % 3 = 0 then 'ordered' else 'unordered' end as list_kind, pos % 2 as list_level, pos % 4 as list_index, case when pos % 7 = 6 then '(3′)' else '' end as list_marker
from (select doc_id, unnest(l) as x, generate_subscripts(l, 1) - 1 as pos from (select doc_id, string_split(text, chr(10)) as l from documents)))"""


def _nodes(spark, sf_dir):
    cut = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return cut.selectExpr("doc_id", "pos", "text", "case pos % 5 when 0 then 'heading' when 1 then 'list_item' when 2 then 'list_item' when 3 then 'blockquote' else 'paragraph' end as kind", "pos % 8 as level", "if(pos % 3 = 0, 'ordered', 'unordered') as list_kind", "pos % 2 as list_level", "pos % 4 as list_index", "if(pos % 7 = 6, '(3′)', '') as list_marker")


_BODY = f"trim(regexp_replace({_CLEAN}, '^(?:[•·∙]|[-*]|\\(\\d{{1,3}}[′'']\\)|\\d{{1,3}}[′''][.]?|\\d{{1,3}}[.)]|\\(?[a-z]\\)|[xyz{{])[\\s.]*', ''))"
_PREFIX = "repeat('  ', list_level) || case when list_kind = 'ordered' then case when list_marker <> '' then '3′.' when list_level = 1 then chr((96 + case when list_index = 0 then 1 else list_index end)::int) || '.' else (case when list_index = 0 then 1 else list_index end) || '.' end || ' ' else '- ' end"


@query(
    "k10_k14_w14_render",
    f"""with {_NODES_SQL}, o as (select *, lead(kind) over (partition by doc_id order by pos) as nxt, case kind when 'heading' then repeat('#', greatest(1, least(6, case when level = 0 then 2 else level end))::int) || ' ' || {_CLEAN} when 'blockquote' then case when {_CLEAN} = '' then '>' else '> ' || {_CLEAN} end
when 'list_item' then case when {_BODY} = '' then rtrim({_PREFIX}) else {_PREFIX} || {_BODY} end else {_CLEAN} end as out from nodes),
b as (select doc_id, string_agg(case when out = '' then '' else out || case when kind = 'list_item' and coalesce(nxt, '') = 'list_item' then chr(10) else chr(10) || chr(10) end end, '' order by pos) as body from o group by doc_id)
select doc_id, regexp_replace(regexp_replace(regexp_replace('---' || chr(10) || 'title: "Doc ' || doc_id || ' \\"q\\""' || chr(10) || '---' || chr(10) || chr(10) || body, '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '\\s+$', '') || chr(10) as markdown from b""",
)
def k10_k14_w14_render(spark, sf_dir):
    return rendering.render(_nodes(spark, sf_dir), F.concat(F.lit("Doc "), F.col("doc_id").cast("string"), F.lit(' "q"')))


@query("a16_plan_statistics", f"with {_NODES_SQL} select doc_id, count(*) as nodes, count(*) filter (kind = 'heading') as n_heading, count(*) filter (kind = 'paragraph') as n_paragraph, count(*) filter (kind = 'blockquote') as n_blockquote, count(*) filter (kind = 'list_item') as n_list_item, count(*) filter (kind = 'figure') as n_figure from nodes group by doc_id")
def a16_plan_statistics(spark, sf_dir):
    return rendering.plan_statistics(_nodes(spark, sf_dir))


_NOTES_SQL = "notes as (select conv_id as doc_id, turn as pos, (turn % 3)::varchar as marker, (turn // 2)::int as page, role = 'assistant' as linked, text as content, 'fn-' || turn as anchor from conversations)"


def _notes(spark, sf_dir):
    return table(spark, sf_dir, "conversations").selectExpr("conv_id as doc_id", "turn as pos", "cast(turn % 3 as string) as marker", "cast(turn div 2 as int) as page", "role = 'assistant' as linked", "text as content", "concat('fn-', turn) as anchor", "concat('note ', turn) as label")


@query("j13_note_targets", f"""with {_NOTES_SQL}, refs as (select conv_id as doc_id, turn as seq, (turn % 4)::varchar as marker, (turn // 3)::int as page from conversations),
e as (select doc_id, marker, page, arg_max(anchor, pos) as a from notes where linked group by all), f as (select doc_id, marker, arg_min(anchor, pos) as a from notes where linked group by all)
select doc_id, seq, marker, page, coalesce(e.a, f.a) as anchor from refs left join e using (doc_id, marker, page) left join f using (doc_id, marker)""")
def j13_note_targets(spark, sf_dir):
    refs = table(spark, sf_dir, "conversations").selectExpr("conv_id as doc_id", "turn as seq", "cast(turn % 4 as string) as marker", "cast(turn div 3 as int) as page")
    return rendering.note_targets(refs, _notes(spark, sf_dir))


@query("j12_u6_unresolved", f"with {_NOTES_SQL} select doc_id, seq, marker from (select conv_id as doc_id, turn as seq, (turn % 4)::varchar as marker from conversations) r where not exists (select 1 from notes n where linked and n.doc_id = r.doc_id and n.marker = r.marker)")
def j12_u6_unresolved(spark, sf_dir):
    refs = table(spark, sf_dir, "conversations").selectExpr("conv_id as doc_id", "turn as seq", "cast(turn % 4 as string) as marker")
    return rendering.unresolved(refs, _notes(spark, sf_dir)).select("doc_id", "seq", "marker")


@query("k16_u4_notes")
def k16_u4_notes(spark, sf_dir):
    return rendering.render_notes(_notes(spark, sf_dir))


@query("k17_references")
def k17_references(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("text", F.when(F.col("line") == 0, "References").otherwise(F.col("text")))
    return rendering.render_references(layout.reference_entries(lines))


@query(
    "k8_l7_n6_texts",
    """select doc_id, '---' || chr(10) || 'title: ' || to_json(source)::varchar || chr(10) || 'source_pdf: "a.pdf"' || chr(10) || 'imported_at: "2020"' || chr(10) || 'imported_paper: true' || chr(10) || '---' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10) as note,
'Say one. Use ' || lang || '.' as prompt, case when doc_id % 2 = 0 then source || chr(10) || lang else null end as answer from documents""",
)
def k8_l7_n6_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    md = F.concat(F.lit("---\nold: 1\n---\n\n"), F.col("text"))
    parts = F.expr("if(doc_id % 2 = 0, array(named_struct('type', 'text', 'text', source), named_struct('type', 'tool', 'text', 'x'), named_struct('type', 'output_text', 'text', lang)), array(named_struct('type', 'text', 'text', '')))")
    return docs.select("doc_id", rendering.imported_note(md, F.col("source"), F.lit("a.pdf"), F.lit("2020")).alias("note"), rendering.prompt(F.lit("Say {{DEFINITION_REQUIREMENT}} Use {{CLUSTER_REQUIREMENT}}."), F.lit("one."), F.col("lang")).alias("prompt"), rendering.answer_text(parts).alias("answer"))


@query(
    "p5_a24_regions",
    f"""with {_LINES}, c as (select *, {_CLEAN} as t, size < 9.2 as small, y0 > 500 as below from lines),
f as (select *, case when (y0 < 96 or y1 > 704) and regexp_matches(t, '^[-–—]?\\s*\\d{{1,4}}\\s*[-–—]?$') then 'page number' when y0 < 96 and line % 24 = 0 then 'header' when y1 >= 720 and (line % 36 = 35 or regexp_matches(t, '^[-–—]?\\s*\\d+\\s*[-–—]?$')) then 'footer' end as margin,
not (below and not small) and (below or (y0 > 576 and small)) as may, regexp_matches(t, '^\\s*(?:\\d{{1,3}}(?:[.)]\\s*|\\s+[A-Z“"''(]|[A-Z“"''(])|[*†‡§](?:\\s+|[.)])?)') or (page = 1 and y0 > 576 and small and regexp_matches(t, '(?i)^\\s*(?:date|received|accepted|published|copyright)\\b')) as mark from c),
z as (select *, coalesce(bool_or(margin is null and may and mark) over (partition by doc_id, page order by round_even(y0 / 2.0, 0) * 2.0, x0, line rows between unbounded preceding and 1 preceding), false) as zone from f),
r as (select *, coalesce(margin, case when may and (mark or zone) then 'footnote' when regexp_matches(t, '(?i)^\\s*(?:(fig(?:ure)?|table)\\s+\\d+\\s*[:.])') then 'figure' when line % 7 = 5 then 'formula' else 'body' end) as rule from z)
select doc_id, line, case when rule = 'page number' then 'footer' else rule end as region, (case rule when 'page number' then 0.9 when 'header' then 0.95 when 'footer' then 0.92 when 'footnote' then 0.82 when 'figure' then 0.78 when 'formula' then 0.84 else 1.0 end)::double as confidence from r""",
)
def p5_a24_regions(spark, sf_dir):
    flags = {"column": F.lit(0), "body_size": F.lit(10.0), "separator": F.lit(500.0), "start": F.lit(None).cast("double"), "is_header": F.col("line") % 24 == 0, "is_footer": F.col("line") % 36 == 35, "is_formula": F.col("line") % 7 == 5}
    return rendering.regions(_lines(spark, sf_dir).drop("region").withColumns(flags)).select("doc_id", "line", "region", "confidence")


@query("a23_p15_inline_markers")
def a23_p15_inline_markers(spark, sf_dir):
    words = _lines(spark, sf_dir).select("doc_id", "page", "line", F.posexplode(F.split(F.concat("text", F.lit(" [12] 3 H 2 )")), " ")).alias("k", "text"))
    raised = F.col("text") == "3"
    lowered = F.col("text") == "2"
    spans = words.withColumns({"size": F.when(raised | lowered, 6.0).otherwise(10.0), "y0": F.when(lowered, 104.0).otherwise(100.0), "y1": F.when(raised, 105.0).otherwise(110.0), "line_size": F.lit(10.0), "line_y0": F.lit(100.0), "line_y1": F.lit(110.0), "body_size": F.lit(10.0), "region": F.lit("body"), "role": F.lit(""), "density": F.lit(0.0)})
    return rendering.inline_markers(spans, F.col("doc_id") % 2 == 0)


@query(
    "p12_list_continuations",
    f"""with {_LINES}, c as (select *, case when doc_id % 4 = 0 then (x0 > 300)::int else 0 end as col from lines), j as (select *, lag(x0, 2) over w as fx, lag(col, 2) over w as fc, lag(y1) over w as py, lag(size) over w as ps, lag(y1 - y0) over w as ph from c window w as (partition by doc_id, page order by line))
select doc_id, line, fc = col and y0 - py <= greatest(ps, size, ph, y1 - y0, 1) * 1.7 and x0 >= fx - greatest(3, size * 0.35) and not (length(text) <= 160 and (regexp_matches(text, '{layout.NUMBERED}') or regexp_matches(text, '{layout.ROMAN}'))) as goes_on from j where fx is not null""",
)
def p12_list_continuations(spark, sf_dir):
    """Each line against the line two before it as the item's first."""
    lines = _lines(spark, sf_dir).withColumn("column", F.when(F.col("doc_id") % 4 == 0, (F.col("x0") > 300).cast("int")).otherwise(0)).withColumn("height", F.col("y1") - F.col("y0"))
    w = Window.partitionBy("doc_id", "page").orderBy("line")
    lag = lambda c, n: F.lag(c, n).over(w)
    own = {n: F.col(n) for n in ("size", "height", "x0", "column", "text")}
    goes_on = rendering.continues_list(lag("x0", 2), lag("column", 2), F.col("y0") - lag("y1", 1), own, {"size": lag("size", 1), "height": lag("height", 1)})
    return lines.select("doc_id", "line", goes_on.alias("goes_on"), lag("x0", 2).alias("first")).where("first is not null").drop("first")
