"""Queries of definitions, linked notes, marginal lines and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillion.operators import definitions, layout
from quillion.plans.layout_queries import _COLS, _KEY, _LINES, _lines
from quillion.plans.registry import query
from quillion.session import table

_SIDES = "case when line % 2 = 0 then '(E' || line || ') ' || {x} else '[' || {x} || ']' end"


def _pairs(spark, sf_dir):
    """Every other line of a text as a named formula, the next as its gloss; some too near, too low or in another region."""
    cut = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "x"))
    right = F.col("line") % 2 == 1
    said = F.when(right, F.concat(F.lit("["), "x", F.lit("]"))).otherwise(F.concat(F.lit("(E"), F.col("line").cast("string"), F.lit(") "), "x"))
    return cut.select(
        "doc_id", F.lit(1).alias("page"), "line", said.alias("text"), F.when(F.col("line") % 6 == 4, "formula").when(F.col("line") % 10 == 9, "footnote").otherwise("body").alias("region"),
        F.when(right, F.when(F.col("line") % 14 == 5, 210.0).otherwise(300.0)).otherwise(60.0).alias("x0"), F.when(right, 500.0).otherwise(200.0).alias("x1"),
        (F.floor(F.col("line") / 2) * 20 + F.when(F.col("line") % 22 == 7, 9).otherwise(0)).cast("double").alias("y0"), (F.floor(F.col("line") / 2) * 20 + 10 + F.when(F.col("line") % 22 == 7, 9).otherwise(0)).cast("double").alias("y1"),
        F.lit(10.0).alias("size"), F.when(F.col("line") % 4 == 0, 0.8).otherwise(0.95).alias("confidence"),
    )


@query(
    "w7_k15_definitions",
    """with l as (select doc_id, unnest(l) as x, generate_subscripts(l, 1) - 1 as line from (select doc_id, string_split(text, chr(10)) as l from documents)), p as (select a.doc_id, a.line, regexp_replace('(E' || a.line || ') ' || a.x, '\\s+$', '') as text, '[' || b.x || ']' as gloss, case when a.line % 4 = 0 then 0.8 else 0.88 end as confidence
    from l a join l b on a.doc_id = b.doc_id and b.line = a.line + 1 where a.line % 2 = 0 and a.x <> '' and b.line % 10 <> 9 and b.line % 14 <> 5 and b.line % 22 <> 7) select doc_id, line::int as line, confidence::double as confidence, starts_with(text, '(E') as named, length(gloss)::bigint as gloss_length from p""",
)
def w7_k15_definitions(spark, sf_dir):
    found = definitions.gloss_pairs(_pairs(spark, sf_dir))
    item = definitions.definition_item(F.col("text"), F.col("gloss"))
    return found.select("doc_id", "line", "confidence", item.startswith("- $(E").alias("named"), (F.length("gloss")).cast("long").alias("gloss_length"))


@query(
    "j11_linked_notes",
    """with w as (select doc_id, line, k from (select doc_id, line, unnest(w) as x, generate_subscripts(w, 1) - 1 as k from (select doc_id, line, string_split(x, ' ') as w from (select doc_id, unnest(l) as x, generate_subscripts(l, 1) - 1 as line from (select doc_id, string_split(text, chr(10)) as l from documents))))),
    s as (select doc_id, line, k, case when line % 3 = 2 and k = 1 then '1' else '2' end as marker from w where (line % 3 = 2 and k = 1) or (k = 2 and line % 2 = 0)),
    f as (select doc_id, marker, line, k from (select *, row_number() over (partition by doc_id, marker order by line, k) as r from s) where r = 1)
    select doc_id, n.marker, line::int as source_line, k::int as source_span, line is not null as linked, case when line is not null then case n.marker when '1' then 0.94 else 0.9 end end::double as confidence, case when line is null then 'No superscript reference was linked on the source page.' end as warning
    from (select doc_id, marker from documents, (values ('1'), ('2'), ('3')) v(marker)) n left join f using (doc_id, marker)""",
)
def j11_linked_notes(spark, sf_dir):
    """Marks 1 by role, 2 by place, 3 too large."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "x")).select("doc_id", "line", F.posexplode(F.split("x", " ")).alias("span", "word"))
    role = F.when((F.col("line") % 3 == 2) & (F.col("span") == 1), "note_ref:1").otherwise("")
    small = (F.col("span") == 2) & (F.col("line") % 2 == 0)
    text = F.when(small, " 2 ").when(F.col("span") == 3, "3").otherwise(F.concat("word", F.lit("_")))
    spans = words.select(
        "doc_id", F.lit(1).alias("page"), "line", "span", text.alias("text"), role.alias("role"), F.when(small, 6.0).otherwise(10.0).alias("size"), F.lit(16.0).alias("y1"), F.lit(10.0).alias("line_size"), F.lit(10.0).alias("line_y0"), F.lit(10.0).alias("line_height"), F.lit("body").alias("region"),
    )
    notes = docs.select("doc_id", F.lit(1).alias("page"), F.explode(F.array(F.lit("1"), F.lit("2"), F.lit("3"))).alias("marker"))
    return definitions.linked_notes(notes, spans).drop("page")


@query(
    "j16_marginal_lines",
    f"""with {_LINES}, keyed as (select doc_id, page, line, y0, y1, {_KEY.replace(" from (select", " as key from (select", 1).replace("select doc_id, page, y0, y1", "select doc_id, page, line, y0, y1")}),
    c as (select doc_id, key, 'header' as place, count(*) as n from keyed where key <> '' and y0 < 96 group by all union all select doc_id, key, 'footer', count(*) from keyed where key <> '' and y1 > 720 group by all),
    p as (select doc_id, count(distinct page) as pages from lines group by all), r as (select doc_id, key, place from c join p using (doc_id) where n >= greatest(2, floor(pages * 0.35)))
    select doc_id, line, y0 < 96 and exists (select 1 from r where r.doc_id = k.doc_id and r.key = k.key and place = 'header') as repeated_header, y1 > 720 and exists (select 1 from r where r.doc_id = k.doc_id and r.key = k.key and place = 'footer') as repeated_footer from keyed k""",
)
def j16_marginal_lines(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return definitions.with_marginalia(lines, layout.repeated_marginalia(lines)).select("doc_id", "line", "repeated_header", "repeated_footer")


@query(
    "u5_k19_diagnostics",
    f"""{_COLS}, pg2 as (select doc_id, page, max(columns) as columns from cols group by all), ev as (select doc_id, 'page_layout' as kind, 'Detected ' || columns || ' column(s); body font size 10.50.' as message, 'info' as severity from pg2
    union all select doc_id, region, region || ' line: ' || substr(text, 1, 120), 'info' from lines where region in ('header', 'footer', 'formula', 'figure') union all select doc_id, 'warning', 'odd size', 'warning' from lines where size = 8
    union all select doc_id, case when doc_id % 2 = 0 then 'linked_note' else 'unlinked_note' end, 'Footnote 1: ' || substr(text, 1, 120), case when doc_id % 2 = 0 then 'info' else 'warning' end from documents union all select doc_id, 'polish_warning', 'unbalanced: 1', 'warning' from documents where doc_id % 3 = 0)
    select doc_id, kind, count(*) as n, min(message) as first, max(severity) as severity, (select count(*) from pg2 where pg2.doc_id = ev.doc_id) as pages, doc_id % 2 = 0 as linked from ev group by doc_id, kind""",
)
def u5_k19_diagnostics(spark, sf_dir):
    """Reports written as JSON and read again."""
    docs = table(spark, sf_dir, "documents")
    lines = layout.with_columns(_lines(spark, sf_dir)).withColumns({"confidence": F.lit(0.9), "warnings": F.when(F.col("size") == 8, F.array(F.lit("odd size"))).otherwise(F.array().cast("array<string>"))})
    pages = lines.groupBy("doc_id", "page").agg(F.max("columns").alias("columns"), F.first("width").alias("width"), F.first("height").alias("height")).withColumn("body_size", F.lit(10.5))
    notes = docs.select("doc_id", F.lit(1).alias("page"), F.lit("1").alias("marker"), F.col("text").alias("content"), (F.col("doc_id") % 2 == 0).alias("linked"), F.lit(0.9).alias("confidence"), F.when(F.col("doc_id") % 2 == 1, "lost").alias("warning"))
    polish = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("unbalanced: 1"))).otherwise(F.array().cast("array<string>")).alias("warnings"))
    reports = definitions.diagnostics(docs.select("doc_id", "source"), pages, definitions.events(pages, lines, notes, polish))
    schema = "schema_version int, source_pdf string, summary struct<linked_notes: long, unlinked_notes: long>, pages array<struct<page: int>>, events array<struct<page: int, kind: string, message: string, severity: string>>"
    read = reports.select("doc_id", F.from_json("json", schema).alias("r")).select("doc_id", F.size("r.pages").cast("long").alias("pages"), (F.col("r.summary.linked_notes") == 1).alias("linked"), F.explode("r.events").alias("e"))
    return read.groupBy("doc_id", "e.kind", "pages", "linked").agg(F.count("*").alias("n"), F.min("e.message").alias("first"), F.max("e.severity").alias("severity"))
