"""Queries of paragraphs, sentences, windows, terms and contexts.

``documents`` has no blank lines and no headings: the declared input view takes
each line as a paragraph, and puts a heading in front of documents of even id
and another in front of their second line.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillion.operators import paragraphs, terms
from quillion.plans import sql
from quillion.plans.registry import query
from quillion.session import table

_MD_SPARK = "concat(if(doc_id % 2 = 0, concat('# ', source, '\\n\\n'), ''), regexp_replace(replace(text, '\\n', '\\n\\n'), '\\\\A([^\\n]*\\n)', if(doc_id % 2 = 0, '$1\\n## Part two\\n', '$1')))"
_MD_SQL = "(case when doc_id % 2 = 0 then '# ' || source || chr(10) || chr(10) else '' end || regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '\\A([^\\n]*\\n)', case when doc_id % 2 = 0 then '\\1' || chr(10) || '## Part two' || chr(10) else '\\1' end))"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_MD_SPARK} as markdown")


S = sql.S
_DOCS = f"docs as (select doc_id, {_MD_SQL} as md from documents)"
_BLOCKS = f"""{_DOCS},
pieces as (select doc_id, unnest(l) as piece, generate_subscripts(l, 1) as pos from (select doc_id, regexp_extract_all(md, '\\n*[^\\n]+(?:\\n[^\\n]+)*') as l from docs)),
placed as (select doc_id, pos, regexp_replace(piece, '\\A\\n+', '') as raw, coalesce(sum(length(piece)) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) + length(piece) - length(regexp_replace(piece, '\\A\\n+', '')) as start from pieces),
blocks as (select *, start + length(raw) as "end", {sql.trimmed("raw")} as trimmed from placed),
headed as (select *, case when instr(trimmed, chr(10)) = 0 and regexp_matches(trimmed, '^#{{1,6}}{S}+.') then {sql.strip_markdown(f"regexp_extract(trimmed, '^#{{1,6}}{S}+(.+)$', 1)")} end as h from blocks),
running as (select *, coalesce(last_value(h ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and current row), '') as heading, {sql.strip_markdown("replace(raw, chr(10), ' ')")} as text from headed),
pars as (select doc_id, (row_number() over (partition by doc_id order by pos) - 1)::int as index, start::bigint as start, "end"::bigint as "end", raw, text, heading from running where h is null and trimmed <> '' and not regexp_matches(trimmed, '^(```|~~~)') and length(text) >= 20)"""


@query("t1_paragraphs", f"with {_BLOCKS} select * from pars")
def t1_paragraphs(spark, sf_dir):
    p = paragraphs.paragraphs(_docs(spark, sf_dir))
    return p.withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")})


_WINDOWS = f"""with {_BLOCKS},
counts as (select *, count(*) over (partition by doc_id) as n from pars),
inside as (select *, unnest(range(greatest(ceil((index - 3) / 3.0), 0)::int, least(floor(index / 3.0), ceil(greatest(n - 4, 0) / 3.0))::int + 1)) as w from counts),
wins as (select doc_id, (w + 1)::bigint as "window", list(index order by index) as indexes, min(start) as start, max("end") as "end", string_agg('[' || index || '] ' || text, chr(10) || chr(10) order by index) as text from inside group by doc_id, w)"""


@query("w1_windows", f"{_WINDOWS} select doc_id, \"window\", array_to_string(indexes, ',') as indexes, start, \"end\", text from wins")
def w1_windows(spark, sf_dir):
    w = paragraphs.windows(paragraphs.paragraphs(_docs(spark, sf_dir)))
    return w.select("doc_id", F.col("window").cast("long").alias("window"), F.array_join(F.transform("indexes", lambda i: i.cast("string")), ",").alias("indexes"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "text")


_SENTENCES = f"""with {_BLOCKS},
segs as (select doc_id, index as paragraph, start as "from", unnest(l) as seg, generate_subscripts(l, 1) as pos from (select *, list_filter(string_split(regexp_replace(raw, '([.!?](?:==|["''\\)\\]])*{S}+)', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as l from pars)),
ats as (select *, "from" + coalesce(sum(length(seg)) over (partition by doc_id, paragraph order by pos rows between unbounded preceding and 1 preceding), 0) + length(seg) - length(regexp_replace(seg, '^{S}+', '')) as start, {sql.trimmed("seg")} as raw from segs),
sents as (select doc_id, paragraph, row_number() over (partition by doc_id, paragraph order by pos) as nth, start::bigint as start, (start + length(raw))::bigint as "end", raw, text from (select *, {sql.strip_markdown("raw")} as text from ats) where length(text) >= 20)"""


@query("t2_t3_sentences", f"{_SENTENCES} select * from sents")
def t2_t3_sentences(spark, sf_dir):
    s = paragraphs.sentences(paragraphs.paragraphs(_docs(spark, sf_dir)))
    return s.withColumns({"nth": F.col("nth").cast("long"), "start": F.col("start").cast("long"), "end": F.col("end").cast("long")})


@query(
    "p2_key_sentence_candidates",
    f"""{_SENTENCES} select s.doc_id, s.paragraph, p.heading, count(*) as n, string_agg(s.text, '|' order by nth) as texts from sents s join pars p on p.doc_id = s.doc_id and p.index = s.paragraph
where length(p.text) >= 80 and not contains(s.raw, '==') group by all having count(*) >= 2""",
)
def p2_key_sentence_candidates(spark, sf_dir):
    c = paragraphs.key_sentence_candidates(paragraphs.paragraphs(_docs(spark, sf_dir)))
    return c.select("doc_id", "paragraph", "heading", "n", F.array_join(F.transform("sentences", lambda s: s["text"]), "|").alias("texts"))


@query(
    "t7_batches",
    f"{_SENTENCES} select doc_id, batch, count(*) as n, min(paragraph) as lo, max(paragraph) as hi from (select *, floor((row_number() over (partition by doc_id order by paragraph, nth) - 1) / 6)::bigint as batch from sents) group by all",
)
def t7_batches(spark, sf_dir):
    b = paragraphs.batches(paragraphs.sentences(paragraphs.paragraphs(_docs(spark, sf_dir))), ["doc_id"], ["paragraph", "nth"], 6)
    return b.groupBy("doc_id", "batch").agg(F.count("*").alias("n"), F.min("paragraph").alias("lo"), F.max("paragraph").alias("hi"))


# ---- discovery, merging, ranking (L2 stand-in, U1, A1, O1, P3)

_MERGED = f"""{_WINDOWS},
words as (select doc_id, "window", indexes, unnest(regexp_extract_all(text, '[A-Za-z]{{5,}}')) as term from wins),
ranked as (select *, row_number() over (partition by doc_id, "window" order by n desc, term) as r from (select doc_id, "window", indexes, term, count(*) as n from words group by all)),
found as (select doc_id, "window" * 100 + r as seq, term, least(n, 5)::double as importance, 'seen ' || n || ' times' as reason, indexes from ranked where r <= 10),
keyed as (select *, {sql.normalize_term("term")} as key from found),
merged as (select doc_id, key, arg_min(term, seq) as term, max(importance) as importance, count(*) as frequency, arg_min(reason, seq) as reason, list_sort(list_distinct(flatten(list(indexes)))) as indexes from keyed where length(key) >= 3 group by doc_id, key),
others as (select doc_id, key, string_agg(a, ',' order by s) as aliases from (select doc_id, key, term || 's' as a, min(seq) as s from keyed where length(key) >= 3 group by all) group by doc_id, key),
scored as (select *, importance * 10 + frequency * 2 + len(indexes) as score from merged left join others using (doc_id, key)),
top as (select * from (select *, row_number() over (partition by doc_id order by score desc, lower(term), term) as rank from scored) where rank <= 40)"""


def _top(spark, sf_dir):
    found = terms.discover(paragraphs.windows(paragraphs.paragraphs(_docs(spark, sf_dir))))
    found = found.withColumn("aliases", F.array(F.upper("term"), F.concat("term", F.lit("s"))))
    return terms.merge_candidates(found.withColumn("seq", F.col("window") * 100 + F.col("rank")))


@query("a1_o1_merge_terms", f"{_MERGED} select doc_id, key, term, importance, frequency, reason, array_to_string(indexes, ',') as indexes, score::double as score, rank, aliases from top")
def a1_o1_merge_terms(spark, sf_dir):
    t = _top(spark, sf_dir)
    return t.withColumns({"indexes": F.array_join(F.transform("indexes", lambda i: i.cast("string")), ","), "rank": F.col("rank").cast("long"), "aliases": F.array_join("aliases", ",")})


@query("p3_pending_terms", f"{_MERGED} select doc_id, key, rank from top where key not in (select distinct {sql.normalize_term('split_part(text, chr(32), 1)')} from benchmark union all select {sql.normalize_term('split_part(text, chr(32), 2)')} from benchmark)")
def p3_pending_terms(spark, sf_dir):
    """Every document has the benchmark's first words as cached terms, with the second ones as aliases."""
    top = _top(spark, sf_dir)
    entries = table(spark, sf_dir, "benchmark").selectExpr("0 as doc_id", "split(text, ' ')[0] as term", "array(split(text, ' ')[1]) as aliases")
    cached = top.join(terms.cached_keys(entries).select("key").distinct(), "key", "left_semi").select("doc_id", "key")
    return terms.pending(top, cached).select("doc_id", "key", F.col("rank").cast("long").alias("rank"))


# ---- occurrences, contexts, look-up

TERMS = [("the", ["The", "of the"]), ("that", []), ("que", ["de la"]), ("und", ["und"]), ("zzz", [])]


def _terms(docs):
    """Every document asks for the same few terms; an array in the plan, not a cross join."""
    asked = F.array(*[F.struct(F.lit(t).alias("term"), F.array(*map(F.lit, a)).cast("array<string>").alias("aliases")) for t, a in TERMS])
    return docs.select("doc_id", F.explode(asked).alias("t")).select("doc_id", "t.*")


_OCC = f"""with {_BLOCKS},
asked(term, nth, spelling) as (values ('the', 0, 'the'), ('the', 1, 'The'), ('the', 2, 'of the'), ('that', 0, 'that'), ('que', 0, 'que'), ('que', 1, 'de la'), ('und', 0, 'und'), ('zzz', 0, 'zzz')),
cut as (select doc_id, term, nth, spelling, unnest(l) as piece, generate_subscripts(l, 1) as pos, length(spelling) as k, lower(md) as hay from (select *, string_split(lower(md), lower(spelling)) as l from docs, asked)),
ats as (select *, sum(length(piece)) over (partition by doc_id, term, nth order by pos) + (pos - 1) * k as start, lead(pos) over (partition by doc_id, term, nth order by pos) as more from cut),
occ as (select doc_id, term, spelling, start::bigint as start, (start + k)::bigint as "end" from (select *, row_number() over (partition by doc_id, term, start, start + k order by nth) as r from ats
  where more is not null and not regexp_matches(substr(hay, start::int, case when start = 0 then 0 else 1 end), '[A-Za-z0-9_-]') and not regexp_matches(substr(hay, (start + k + 1)::int, 1), '[A-Za-z0-9_-]')) where r = 1)"""


@query("t5_occurrences", f"{_OCC} select * from occ")
def t5_occurrences(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    o = terms.occurrences(docs, _terms(docs))
    return o.withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")})


@query("o6_first_occurrences", f"{_OCC} select doc_id, term, start, r from (select *, row_number() over (partition by doc_id, term order by start) as r from occ) where r <= 5")
def o6_first_occurrences(spark, sf_dir):
    from pyspark.sql import Window

    docs = _docs(spark, sf_dir)
    r = F.row_number().over(Window.partitionBy("doc_id", "term").orderBy("start")).cast("long")
    return terms.occurrences(docs, _terms(docs)).select("doc_id", "term", F.col("start").cast("long").alias("start"), r.alias("r")).where("r <= 5")


_HITS = f"""{_OCC},
hits as (select o.doc_id, o.term, o.start, o."end", min(p.index) as index from occ o join pars p on p.doc_id = o.doc_id and p.start <= o.start and o.start <= p."end" group by all),
placed_hits as (select h.*, p.heading from hits h join pars p using (doc_id, index))"""


@query("j1_in_paragraph", f"{_HITS} select doc_id, term, start, index from placed_hits")
def j1_in_paragraph(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return terms.in_paragraph(terms.occurrences(docs, _terms(docs)), paragraphs.paragraphs(docs)).select("doc_id", "term", F.col("start").cast("long").alias("start"), "index")


_CLUSTERS = f"""{_HITS},
grouped as (select doc_id, term, case when heading <> '' then 'heading:' || heading else 'paragraph:' || index end as g, any_value(heading) as heading, min(index) as index, count(*) as n, min(start) as o_start, max("end") as o_end from placed_hits group by 1, 2, 3),
related as (select g.doc_id, g.term, g.g, g.heading, g.index, g.n, least(g.o_start, min(p.start)) as start, greatest(g.o_end, max(p."end")) as "end", list(p.index order by p.index) as indexes
  from grouped g join pars p on p.doc_id = g.doc_id and (case when g.heading <> '' then p.heading = g.heading else abs(p.index - g.index) <= 1 end) group by g.doc_id, g.term, g.g, g.heading, g.index, g.n, g.o_start, g.o_end),
best as (select * from (select *, row_number() over (partition by doc_id, term order by n desc, start) as r from related) where r <= 5),
found_clusters as (select doc_id, term, case when heading <> '' then heading else 'Paragraphs ' || greatest(index - 1, 0) || '-' || (index + 1) end as label, indexes, n as count, start, "end", substr({sql.strip_markdown("substr(md, greatest(start - 800, 0)::int + 1, (least(\"end\" + 800, length(md)) - greatest(start - 800, 0))::int)")}, 1, 1600) as excerpt from best join docs using (doc_id)),
three as (select doc_id, list(index order by index) as indexes, min(start) as start, case when count(*) = 3 then max("end") else min("end") end as "end", string_agg(text, chr(10) || chr(10) order by index) as excerpt from pars where index < 3 group by doc_id),
lost as (select d.doc_id, a.term, 'Paper context' as label, coalesce(t.indexes, []) as indexes, 0::bigint as count, coalesce(t.start, 0) as start, coalesce(t."end", 0) as "end", coalesce(t.excerpt, '') as excerpt from docs d cross join (select distinct term from asked) a left join three t using (doc_id)
  where not exists (select 1 from hits h where h.doc_id = d.doc_id and h.term = a.term)),
clusters as (select *, row_number() over (partition by doc_id, term order by start, label) as nth from (select * from found_clusters union all select * from lost))"""


def _clusters(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return terms.clusters(docs, paragraphs.paragraphs(docs), _terms(docs))


@query("a2_clusters", f"{_CLUSTERS} select doc_id, term, nth, label, array_to_string(indexes, ',') as indexes, count, start::bigint as start, \"end\"::bigint as \"end\", excerpt from clusters")
def a2_clusters(spark, sf_dir):
    c = _clusters(spark, sf_dir)
    return c.select("doc_id", "term", F.col("nth").cast("long").alias("nth"), "label", F.array_join(F.transform("indexes", lambda i: i.cast("string")), ",").alias("indexes"), "count", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "excerpt")


@query(
    "j3_choose_cluster",
    f"""{_CLUSTERS} select doc_id, term, position, label, start::bigint as start from (select c.*, q.position, row_number() over (partition by c.doc_id, c.term order by case when c.start <= position and position <= c."end" then 0 else 1 end,
case when c.start <= position and position <= c."end" then 0 else abs(c.start - position) end, nth) as r from clusters c join (select doc_id, (length(text) // 2)::bigint as position from documents) q using (doc_id)) where r = 1""",
)
def j3_choose_cluster(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "cast(length(text) div 2 as long) as position")
    clusters = _clusters(spark, sf_dir)
    asked = clusters.select("doc_id", "term").distinct().join(docs, "doc_id")
    return terms.choose_cluster(asked, clusters).select("doc_id", "term", "position", "label", F.col("start").cast("long").alias("start"))


@query(
    "j4_term_at",
    f"""with {_DOCS}, lines as (select doc_id, replace(text, chr(10), ' ') as md, (length(text) * (doc_id % 30) // 30)::bigint as position from documents),
asked(term, nth, spelling) as (values ('the', 0, 'the'), ('the', 1, 'The'), ('the', 2, 'of the'), ('that', 0, 'that'), ('que', 0, 'que'), ('que', 1, 'de la'), ('und', 0, 'und'), ('zzz', 0, 'zzz')),
cut as (select doc_id, position, term, nth, spelling, unnest(l) as piece, generate_subscripts(l, 1) as pos, length(spelling) as k, lower(md) as hay from (select *, string_split(lower(md), lower(spelling)) as l from lines, asked)),
ats as (select *, sum(length(piece)) over (partition by doc_id, term, nth order by pos) + (pos - 1) * k as start, lead(pos) over (partition by doc_id, term, nth order by pos) as more from cut),
occ as (select * from ats where more is not null and not regexp_matches(substr(hay, start::int, case when start = 0 then 0 else 1 end), '[A-Za-z0-9_-]') and not regexp_matches(substr(hay, (start + k + 1)::int, 1), '[A-Za-z0-9_-]') and start <= position and position <= start + k)
select doc_id, term, spelling, start::bigint as start from (select *, row_number() over (partition by doc_id order by k desc, term, start, nth) as r from occ) where r = 1""",
)
def j4_term_at(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").selectExpr("doc_id", "replace(text, '\n', ' ') as line", "cast(length(text) * (doc_id % 30) div 30 as long) as position")
    return terms.term_at(lines, _terms(lines)).select("doc_id", "term", "spelling", F.col("start").cast("long").alias("start"))


@query(
    "h2_hover",
    f"""with {_DOCS}, lines as (select doc_id, replace(text, chr(10), ' ') as md, (length(text) // 2)::bigint as position from documents),
asked(term, nth, spelling) as (values ('the', 0, 'the'), ('the', 1, 'The'), ('the', 2, 'of the'), ('that', 0, 'that'), ('que', 0, 'que'), ('que', 1, 'de la'), ('und', 0, 'und'), ('zzz', 0, 'zzz')),
cut as (select doc_id, position, term, nth, spelling, unnest(l) as piece, generate_subscripts(l, 1) as pos, length(spelling) as k, lower(md) as hay from (select *, string_split(lower(md), lower(spelling)) as l from lines, asked)),
ats as (select *, sum(length(piece)) over (partition by doc_id, term, nth order by pos) + (pos - 1) * k as start, lead(pos) over (partition by doc_id, term, nth order by pos) as more from cut),
occ as (select * from ats where more is not null and not regexp_matches(substr(hay, start::int, case when start = 0 then 0 else 1 end), '[A-Za-z0-9_-]') and not regexp_matches(substr(hay, (start + k + 1)::int, 1), '[A-Za-z0-9_-]') and start <= position and position <= start + k),
best as (select doc_id, spelling, start::bigint as start from (select *, row_number() over (partition by doc_id order by k desc, term, start, nth) as r from occ) where r = 1),
w as (select doc_id, position, regexp_extract(left(md, position), '[A-Za-z-]*$') as b, regexp_extract(substr(md, position + 1), '^[A-Za-z-]*') as a from lines)
select doc_id, case when spelling is not null then 'prepared' else 'word' end as kind, coalesce(spelling, b || a) as text, coalesce(start, position - length(b)) as start, case when spelling is not null then case when doc_id % 2 = 0 then 'first' else 'second' end end as label
from w left join best using (doc_id) where spelling is not null or length(b || a) >= 5""",
)
def h2_hover(spark, sf_dir):
    """The middle of each whole text; the first context of every other document is all of it."""
    lines = table(spark, sf_dir, "documents").selectExpr("doc_id", "replace(text, '\n', ' ') as line", "cast(length(text) div 2 as long) as position")
    asked = _terms(lines)
    whole = F.col("position") * 2 + 2
    first = F.struct(F.lit(1).alias("nth"), F.lit("first").alias("label"), F.lit(0).cast("long").alias("start"), F.when(F.col("doc_id") % 2 == 0, whole).otherwise(F.lit(-1)).cast("long").alias("end"))
    second = F.struct(F.lit(2).alias("nth"), F.lit("second").alias("label"), F.col("position").alias("start"), whole.alias("end"))
    found = asked.join(lines.select("doc_id", "position"), "doc_id").select("doc_id", "term", F.explode(F.array(first, second)).alias("c")).select("doc_id", "term", "c.*")
    return terms.hovered(lines, asked, found)
