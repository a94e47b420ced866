"""Literal cases of the text functions."""

import pytest
from pyspark.sql import functions as F

from quillion.functions import html, quality, text
from quillion.operators import conversion, layout, paragraphs, terms
from quillion.sources import html_pages


def one(spark, expr, value, schema="string"):
    return spark.createDataFrame([(value,)], f"x {schema}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("fn", "value", "want"),
    [
        (text.normalize_term, "  Transcendental   Idealism. ", "transcendental idealism"),
        (text.normalize_term, "“Éclat”", "eclat"),
        (text.normalize_term, None, ""),
        (text.slugify, "Form & Matter", "form-and-matter"),
        (text.slugify, "...", "item"),
        (text.strip_markdown, "![i](x) [a](b) [[T|l]] `c` **d**", "a T c d"),
        (text.repair_unicode, "ﬁnding â€™x", "finding ’x"),
        (text.merge_hyphenated, "philoso-\nphy well-\n known", "philosophy well-\n known"),
        (text.parent_path, "a\\b/c.md", "a/b"),
        (text.base_name, "a/b.c.md", "b.c"),
        (html.strip_html, "A&nbsp;b &#65;&#x42; <br> , <script>x</script>&lt;b&gt;c", "A b AB, c"),
        (html.entry_url, "https://plato.stanford.edu/entries/form/?x#y", "https://plato.stanford.edu/entries/form/"),
        (html.entry_url, "https://plato.stanford.edu/about/", ""),
        (layout.clean_reference, "A  , b ( c ) .", "A, b (c)."),
        (conversion.safe_name, 'a/b:c?"<d>', "a_b_c___d_"),
    ],
)
def test_scalars(spark, fn, value, want):
    assert one(spark, fn, value) == want


def test_word_at(spark):
    got = one(spark, lambda c: text.word_at(c, F.lit(5)), "the concept of form")
    assert (got["word"], got["from"], got["to"]) == ("concept", 4, 11)
    assert one(spark, lambda c: text.word_at(c, F.lit(1)), "the concept") is None


def test_frontmatter(spark):
    got = one(spark, text.strip_frontmatter, "---\na: 1\n---\nbody\n")
    assert (got.content, got.offset) == ("body\n", 13)
    assert one(spark, text.strip_frontmatter, "---\nno end").offset == 0


def test_quality(spark):
    r = quality.quality_report(spark.createDataFrame([("(cid:3)\n\\boxed { x }",), (None,)], "t string"), "t").collect()
    assert (r[0].cid_refs, r[0].boxed_formula_marks, r[0].risk_score, r[0].risk_level) == (1, 1, 11, "low")
    assert (r[1].chars, r[1].lines, r[1].risk_level) == (0, 0, "ok")


MARKDOWN = "---\ntitle: x\n---\n# One\n\nThe first paragraph of the text is here.\n\n## Two\n\nshort\n\nThe second one says more. It has two sentences, both long enough.\n\n```\ncode that is long enough to count\n```\n"


def test_paragraphs_and_sentences(spark):
    docs = spark.createDataFrame([(1, MARKDOWN)], "doc_id long, markdown string")
    pars = paragraphs.paragraphs(docs)
    rows = pars.orderBy("index").collect()
    assert [(r["index"], r.heading) for r in rows] == [(0, "One"), (1, "Two")]
    assert all(MARKDOWN[r.start : r.end] == r.raw for r in rows)
    sents = paragraphs.sentences(pars).orderBy("start").collect()
    assert [s.text for s in sents] == ["The first paragraph of the text is here.", "The second one says more.", "It has two sentences, both long enough."]
    assert all(MARKDOWN[s.start : s.end] == s.raw for s in sents)
    assert paragraphs.key_sentence_candidates(pars, 40).count() == 1


def test_windows(spark):
    pars = spark.createDataFrame([(1, i, 10 * i, 10 * i + 9, f"p{i}") for i in range(7)], "doc_id long, index int, start int, end int, text string")
    got = paragraphs.windows(pars, 3, 1).orderBy("window").collect()
    assert [list(r.indexes) for r in got] == [[0, 1, 2], [2, 3, 4], [4, 5, 6]]
    assert got[0].text == "[0] p0\n\n[1] p1\n\n[2] p2"


def test_occurrences_keep_word_bounds(spark):
    docs = spark.createDataFrame([(1, "Idealism and anti-idealism; idealism, xa a a")], "doc_id long, markdown string")
    asked = spark.createDataFrame([(1, "idealism", ["Idealism"]), (1, "a a", None)], "doc_id long, term string, aliases array<string>")
    got = terms.occurrences(docs, asked).orderBy("term", "start").collect()
    assert [(r.term, r.start, r.end) for r in got] == [("idealism", 0, 8), ("idealism", 28, 36)]


def test_merge_candidates(spark):
    rows = [(1, 1, " Form ", 3.0, "", [0]), (1, 2, "form", 5.0, "why", [2, 0]), (1, 3, "ab", 9.0, "", [1]), (1, 4, "Matter", 0.0, "", [1])]
    got = terms.merge_candidates(spark.createDataFrame(rows, "doc_id long, seq int, term string, importance double, reason string, indexes array<int>")).orderBy("rank").collect()
    assert [(r.term, r.importance, r.frequency, r.reason, list(r.indexes), r.score) for r in got] == [("Form", 5.0, 2, "why", [0, 2], 56.0), ("Matter", 1.0, 1, "", [1], 13.0)]


def test_search_results(spark):
    block = '<div class="result_listing"><div class="result_title"><a href="https://x/s?entry=/entries/mind/">The <b>Mind</b></a></div><div class="result_url"><a>no</a></div><div class="result_snippet"> A &amp; b </div><!-- end result_snippet --></div><!-- end result_listing -->'
    got = html_pages.search_results(spark.createDataFrame([(1, block), (2, "No documents found")], "id int, html string"), "id").collect()
    assert [(r.title, r.url, r.snippet, r.normalized_title) for r in got] == [("The Mind", "https://plato.stanford.edu/entries/mind/", "A & b", "the mind")]


def test_two_columns_and_fragments(spark):
    at = [("Title", 90, 40, 510, 60), ("R1", 320, 110, 520, 120), ("L1", 60, 110, 260, 120), ("R2", 320, 140, 520, 150), ("L2", 60, 140, 260, 150)]
    lines = spark.createDataFrame([(1, 1, i, t, float(a), float(b), float(c), float(d), 10.0, 600.0, 800.0, "body") for i, (t, a, b, c, d) in enumerate(at)], "doc_id long, page int, line int, text string, x0 double, y0 double, x1 double, y1 double, size double, width double, height double, region string")
    got = layout.reading_order(layout.with_columns(lines)).orderBy("reading").collect()
    assert [r.text for r in got] == ["Title", "L1", "L2", "R1", "R2"] and got[0].columns == 2
    words = spark.createDataFrame([(1, 1, i, w, 60.0 + 30 * i, 136.0, 85.0 + 30 * i, 146.0, 10.0) for i, w in enumerate("a line in eight small parts of it".split())], "doc_id long, page int, line int, text string, x0 double, y0 double, x1 double, y1 double, size double")
    assert [r.text for r in layout.merged_fragments(words).collect()] == ["a line in eight small parts of it"]


def test_nearest_rank(spark):
    df = spark.createDataFrame([([6.0, 1.0, 2.0, 3.0, 4.0, 5.0],)], "v array<double>")
    assert tuple(df.select(layout.nearest_rank(F.col("v"), 0.1), layout.nearest_rank(F.col("v"), 0.9)).first()) == (1.0, 5.0)


def test_references(spark):
    lines = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(["References", "[17] First, A title .", "goes on", "[25] Second ."])], "doc_id long, page int, line int, text string")
    got = layout.reference_entries(lines).orderBy("nth").collect()
    assert [(r.marker, r.text, r.anchor) for r in got] == [("17", "First, A title. goes on", "ref-017"), ("25", "Second.", "ref-025")]
