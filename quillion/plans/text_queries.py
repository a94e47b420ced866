"""Queries of scalar text functions and quality counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillion.functions import quality, text
from quillion.plans import sql
from quillion.plans.registry import query
from quillion.session import table

# ---- quality

_RE2 = {n: p.replace("(?<![A-Za-z0-9_])6=", r"\b6=").replace("\ufffd", r"\x{fffd}") for n, p in quality.COUNTERS.items()}


def _counts_sql(x: str, patterns: dict[str, str]) -> str:
    full = f"list_filter(regexp_split_to_array({x}, '\\r?\\n'), lambda l: regexp_matches(l, '[^{sql.SPACES}]'))"
    lines = f"regexp_split_to_array({x}, '\\r?\\n')"
    return ", ".join(
        [f"{sql.count(x, p)} as {n}" for n, p in patterns.items()]
        + [
            f"length({x})::bigint as chars",
            f"(case when {x} = '' then 0 else len({lines}) end)::bigint as lines",
            f"len(list_filter({lines}, lambda l: regexp_matches(l, '^{sql.S}*\\|.*\\|{sql.S}*$')))::bigint as markdown_table_lines",
            f"coalesce(floor(list_sum(list_transform({full}, lambda l: length(l))) / nullif(len({full}), 0) + 0.5), 0)::bigint as avg_line_length",
        ]
    )


CASES = [
    (1, "Plain text."),
    (2, "(cid:3) and (cid:44) \\boxed { x }\nsecond line"),
    (3, "a\x01b\x0bc\x7f"),
    (4, "âx Ãy Âz ð Ñ ă ĺ ď § ¶ \ufffd\ufffd"),
    (5, "6= ConT p gp( Ñ ðñ"),
    (6, "∀x ∃y (x ≤ y) → λ"),
    (7, "abcdefghijklmnopqrstuvwxyzabcdef"),
    (8, "\n".join(f"| a{i} | b |" for i in range(33))),
    (9, ""),
    (10, "\r\nab\r\n\r\nabcd  \n"),
    (11, "Ñ" * 30),
]
_WITH_CASES = f"(select doc_id, text from documents union all select -id, text from {sql.values(CASES, 'id, text')})"


def _with_cases(spark, sf_dir):
    cases = sql.frame(spark, [(-i, t) for i, t in CASES], "doc_id long, text string")
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(cases)


_SCORE = "cid_refs * 4 + boxed_formula_marks * 3 + control_chars * 4 + mojibake_marks * 2 + replacement_chars * 4 + suspicious_formula_marks * 2 + least(long_alpha_runs, 50) + least(markdown_table_lines, 100)"
_WARNINGS = """list_filter([
  case when cid_refs > 0 then cid_refs || ' PDF CID placeholder(s), often failed math or symbol extraction.' end,
  case when boxed_formula_marks > 0 then boxed_formula_marks || ' \\boxed{...} expression(s); verify modal boxes were not misread as boxing notation.' end,
  case when control_chars > 0 then control_chars || ' control character(s), often failed TeX symbol extraction.' end,
  case when mojibake_marks + replacement_chars > 0 then (mojibake_marks + replacement_chars) || ' encoding anomaly marker(s).' end,
  case when long_alpha_runs > 0 then long_alpha_runs || ' long unspaced alphabetic run(s), often layout or word-boundary loss.' end,
  case when markdown_table_lines > 30 then markdown_table_lines || ' Markdown table-like line(s), often layout fragments in prose PDFs.' end], lambda w: w is not null)"""
_QUALITY_SQL = f"""select *, case when risk_score >= 80 then 'high' when risk_score >= 20 then 'medium' when len(warnings) > 0 then 'low' else 'ok' end as risk_level
from (select *, ({_SCORE})::bigint as risk_score, {_WARNINGS} as warnings from (select doc_id, {_counts_sql("text", _RE2)} from {_WITH_CASES}))"""


@query("a3_quality_report", f"select * replace (array_to_string(warnings, ' / ') as warnings) from ({_QUALITY_SQL})")
def a3_quality_report(spark, sf_dir):
    report = quality.quality_report(_with_cases(spark, sf_dir), "text").drop("text")
    return report.withColumn("warnings", F.array_join("warnings", " / "))


@query(
    "a3_quality_by_lang",
    f"""select lang, risk_level, count(*) as n_docs, sum(risk_score)::bigint as risk_score, sum(chars)::bigint as chars
from (select d.lang, q.* from documents d join ({_QUALITY_SQL}) q using (doc_id)) group by lang, risk_level""",
)
def a3_quality_by_lang(spark, sf_dir):
    report = quality.quality_report(table(spark, sf_dir, "documents").select("lang", "text"), "text")
    return report.groupBy("lang", "risk_level").agg(F.count("*").alias("n_docs"), F.sum("risk_score").alias("risk_score"), F.sum("chars").alias("chars"))


_SUMMARY = {n: p for n, p in _RE2.items() if n != "boxed_formula_marks"} | {"suspicious_formula_marks": r"\b6=|ConT p|gp\(|Ñ|ðñ|\x03|\(cid:\d+\)"}


@query("a4_text_summary", f"select doc_id, {_counts_sql('text', _SUMMARY)} from {_WITH_CASES}")
def a4_text_summary(spark, sf_dir):
    return quality.text_summary(_with_cases(spark, sf_dir), "text").drop("text")


@query("p16_readable_gate", f"select doc_id, length({sql.replaced('text', (sql.S + '+', ''))}) >= 800 as readable, case when length(text) > 4000 then substr(text, 1, 4000) || '...' else text end as cut from documents")
def p16_readable_gate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", quality.readable(F.col("text")).alias("readable"), text.truncate(F.col("text")).alias("cut"))


# ---- Markdown and term keys

_MARKED_SPARK = "concat('---\\ntitle: doc\\nn: ', doc_id, '\\n---\\n## ', lang, '\\n![img](x.png) [', source, '](http://a.b) [[Target|label]] `code` **', text, '** > ~end~')"
_MARKED_SQL = "('---' || chr(10) || 'title: doc' || chr(10) || 'n: ' || doc_id || chr(10) || '---' || chr(10) || '## ' || lang || chr(10) || '![img](x.png) [' || source || '](http://a.b) [[Target|label]] `code` **' || text || '** > ~end~')"


@query(
    "f1_strip_frontmatter",
    f"""select doc_id, substr(md, o + 1) as content, o as "offset" from (select doc_id, md, length(regexp_extract(md, '(?s)\\A(---\\n.*?\\n---[^\\n]*(?:\\n|\\z))', 1))::bigint as o
from (select doc_id, {_MARKED_SQL} as md from documents union all select -doc_id - 1, text from documents))""",
)
def f1_strip_frontmatter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    md = docs.selectExpr("doc_id", f"{_MARKED_SPARK} as md").unionByName(docs.selectExpr("-doc_id - 1 as doc_id", "text as md"))
    cut = md.withColumn("s", text.strip_frontmatter(F.col("md")))
    return cut.select("doc_id", "s.content", F.col("s.offset").cast("long").alias("offset"))


@query("f2_strip_markdown", f"select doc_id, {sql.strip_markdown('md')} as plain, lower({sql.strip_markdown('md')}) as sentence_key from (select doc_id, {_MARKED_SQL} as md from documents)")
def f2_strip_markdown(spark, sf_dir):
    md = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_MARKED_SPARK} as md")
    return md.select("doc_id", text.strip_markdown(F.col("md")).alias("plain"), text.normalize_sentence(F.col("md")).alias("sentence_key"))


TERMS = [(1, "  Transcendental   Idealism. "), (2, "**Éclat** & “Élan”"), (3, "[[Form|forms]]"), (4, "Ünïcode—term!"), (5, "..."), (6, "It’s ‘so’"), (7, "a" * 100), (8, None)]


@query(
    "f3_f4_term_keys",
    f"select id, {sql.normalize_term('x')} as term_key, {sql.slugify('x')} as slug from (select doc_id as id, text as x from documents union all select -id, x from {sql.values(TERMS, 'id, x')})",
)
def f3_f4_term_keys(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("x"))
    both = docs.unionByName(sql.frame(spark, [(-i, t) for i, t in TERMS], "id long, x string"))
    return both.select("id", text.normalize_term(F.col("x")).alias("term_key"), text.slugify(F.col("x")).alias("slug"))


@query(
    "f5_paths",
    """select page_id, coalesce(regexp_extract(replace(url, '\\', '/'), '(?s)\\A(.*)/', 1), '') as parent, regexp_replace(list_extract(string_split(url, '/'), -1), '\\.[^.]+$', '') as base from pages""",
)
def f5_paths(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text.parent_path(F.col("url")).alias("parent"), text.base_name(F.col("url")).alias("base"))


@query(
    "f7_excerpt",
    f"select doc_id, substr({sql.strip_markdown('substr(md, greatest(300 - 50, 0) + 1, least(320 + 50, length(md)) - greatest(300 - 50, 0))')}, 1, 100) as excerpt from (select doc_id, {_MARKED_SQL} as md from documents)",
)
def f7_excerpt(spark, sf_dir):
    md = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_MARKED_SPARK} as md")
    return md.select("doc_id", text.excerpt_around(F.col("md"), F.lit(300), F.lit(320), 50).alias("excerpt"))


@query(
    "f9_word_at",
    """select doc_id, b || a as word, (p - length(b))::bigint as word_from, (p + length(a))::bigint as word_to from
(select doc_id, p, regexp_extract(substr(text, 1, p), '[A-Za-z-]*$') as b, regexp_extract(substr(text, p + 1), '^[A-Za-z-]*') as a from (select doc_id, text, least(doc_id % 40, length(text)) as p from documents)) where length(b || a) >= 5""",
)
def f9_word_at(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", text.word_at(F.col("text"), (F.col("doc_id") % 40).cast("int")).alias("w")).where("w is not null")
    return found.select("doc_id", "w.word", F.col("w.from").cast("long").alias("word_from"), F.col("w.to").cast("long").alias("word_to"))


# ---- Unicode repair, de-hyphenation

UNICODE = [(1, "ﬁnding â€™quotedâ€œ Â text"), (2, "philoso-\nphy and well-\n known"), (3, "e\u0301cole \t x\x02"), (4, "naïve-\nté ﬀ ﬃ â€¦")]


def _repair_sql(x: str) -> str:
    for bad, good in (*text.MOJIBAKE, *text.LIGATURES):
        x = f"replace({x}, {sql.quoted(bad)}, {sql.quoted(good)})"
    return f"nfc_normalize(regexp_replace({x}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'))"


_UNI = f"(select doc_id, text from documents union all select -id, text from {sql.values(UNICODE, 'id, text')})"


@query(
    "f18_f20_unicode_repair",
    f"""select doc_id, {_repair_sql("text")} as repaired, regexp_replace(regexp_replace({_repair_sql("text")}, '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') as cleaned,
regexp_replace(text, '([{text.LETTERS}])-\\n([{text.LETTERS}])', '\\1\\2', 'g') as joined from {_UNI}""",
)
def f18_f20_unicode_repair(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(sql.frame(spark, [(-i, t) for i, t in UNICODE], "doc_id long, text string"))
    c = F.col("text")
    return docs.select("doc_id", text.repair_unicode(c).alias("repaired"), text.clean_text(c).alias("cleaned"), text.merge_hyphenated(c).alias("joined"))


# ---- occurrences (T4 counts, F8)

_DOUBLED = "regexp_replace(lower(text), '([^A-Za-z0-9_-])', '\\1\\1', 'g')"


@query(
    "t4_occurrence_counts",
    "select doc_id, " + ", ".join(f"len(regexp_extract_all({_DOUBLED}, '(?:^|[^A-Za-z0-9_-]){t.replace(' ', '  ')}(?:[^A-Za-z0-9_-]|$)'))::bigint as {n}" for t, n in (("the", "n_the"), ("of the", "n_of_the"), ("que", "n_que"))) + " from documents",
)
def t4_occurrence_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    c = F.col("text")
    return docs.select("doc_id", *[text.occurrence_count(c, t).alias(n) for t, n in (("the", "n_the"), ("of the", "n_of_the"), ("que", "n_que"))])
