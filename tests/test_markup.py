"""Literal cases of the clean-up functions, and of highlights, notes and stitching."""

import pytest
from pyspark.sql import functions as F

from quillion.functions import markup
from quillion.operators import glossary, stitching


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Kant [12] and Hume [3; 4] agree", r"Kant \[12\] and Hume \[3; 4\] agree"),
        ("an [unclosed bracket", r"an \[unclosed bracket"),
        ("closed] only", r"closed\] only"),
        ("outer [inner [x] y](u) end", r"outer [inner \[x\] y\](u) end".replace(r"\](u)", "](u)")),
        ("already \\[7\\] done", "already \\[7\\] done"),
        ("a [[wiki link]] b [^fn3] c", "a [[wiki link]] b [^fn3] c"),
        ("line one [a]\r\nline two [b]\r\n", "line one \\[a\\]\r\nline two \\[b\\]\r\n"),
        ("`x[0]` [y] `open [z]", r"`x[0]` \[y\] `open [z]"),
        ("~ $u[1]$ [v] $$w[2]$$", r"~ $u[1]$ \[v\] $$w[2]$$"),
        ("```\nm[0]\n``` [n]\n```\nnever closed [o]", "```\nm[0]\n``` \\[n\\]\n```\nnever closed [o]"),
        ("---\nkeys: [p, q]\n---\n[r]", "---\nkeys: [p, q]\n---\n\\[r\\]"),
        ("", ""),
    ],
)
def test_prose_brackets(text, want):
    assert markup.escape_prose_brackets(text) == want


def test_formula_brackets():
    assert markup.unescape_formula_brackets(r"\[a\] $\[b\]$ `\[c\]` $$\[d\]$$ \[e\]") == r"\[a\] $[b]$ `\[c\]` $$[d]$$ \[e\]"
    assert markup.unescape_formula_brackets(r"$never closed \[f\]") == "$never closed [f]"


@pytest.fixture(scope="module")
def of(spark):
    return lambda fn, *values: spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(fn(*[F.col(f"c{i}") for i in range(len(values))]).alias("y")).first().y


def test_footnotes_come_together(of):
    md = "One[^fn2] two[^fn10].\n\n## Footnotes\n\n[^fn10]: Ten. ^fn-10\n[^fn2]: Old two\n\n## Rest\n\nMore.\n\n[^fn2]: New two ^fn-2\n"
    out = of(stitching.consolidated, md)
    assert out.count("## Footnotes") == 1 and out.endswith("\n\n## Footnotes\n\n[^fn2]: New two ^fn-2\n[^fn10]: Ten. ^fn-10")
    assert out.startswith("One[^fn2] two[^fn10].") and "## Rest\n\nMore." in out and "Old two" not in out
    assert of(stitching.consolidated, "no notes here \n") == "no notes here"
    assert of(markup.wikilinks, r"a[^fn4] b\[^fn5\] [^fn6]: c [^x]") == "a[[#^fn-4|4]] b[[#^fn-5|5]] [^fn6]: c [^x]"


@pytest.mark.parametrize(("before", "after", "want"), [("lake and river", "river and sea", 5), ("abcd", "abcd", 0), ("abcde", "abcde", 5), ("x" * 300, "x" * 300, 200), ("one", "two", 0), ("", "anything", 0)])
def test_common_edge(of, before, after, want):
    assert of(stitching.common_edge, before, after) == want


@pytest.mark.parametrize(("before", "after", "want"), [("it went", " on and on", True), ("it ended.", "on", False), ("it went", "On", False), ("it went", "- item", False), ("it went", "", False), ("", "on", False), ("so! \n", "on", False), ("so", "7 of", False)])
def test_broken_sentences(of, before, after, want):
    assert of(stitching.goes_on, before, after) is want


def test_chunks_become_one_text(spark):
    chunks = [
        (1, 0, "Hills[^fn1] rise over the[^fn2]\n\n## Footnotes\n\n[^fn1]: High. ^fn-1\n[^fn2]: Wide."),
        (1, 1, "green plain[^fn1] below[^fn9].\n\n## Footnotes\n\n[^fn1]: Flat.\n"),
        (1, 2, "plain[^fn3] below[^fn9]. Rivers run.\n"),
        (1, 3, "Rivers run. Down to the sea."),
        (2, 0, None),
        (3, 1, "second part"),
        (3, 0, "First part, and the"),
        (4, 0, "x[^fn1]\n\n## Footnotes\n\n[^fn1]: early\n[^fn1]: late"),
    ]
    made = {r.d: r for r in stitching.stitched(spark.createDataFrame(chunks, "d int, i int, t string"), ["d"], "i", "t").collect()}
    head = "Hills[^fn1] rise over the[^fn2] green plain[^fn3] below[^fn9]."
    assert made[1].text == head + "\n\n Rivers run.\n\n Down to the sea.\n\n## Footnotes\n\n[^fn1]: High. ^fn-1\n[^fn2]: Wide. ^fn-2\n[^fn3]: Flat. ^fn-3"
    assert (made[2].text, made[2].chunks) == ("", 1)
    assert made[3].text == "First part, and the second part"
    assert made[4].text == "x[^fn2]\n\n## Footnotes\n\n[^fn1]: early ^fn-1\n[^fn2]: late ^fn-2"


@pytest.mark.parametrize(("text", "want"), [("$p$  $q$ r $s$\n$t$", "$p q$ r $s t$"), ("$" + "a" * 41 + "$ $b$", "$" + "a" * 41 + "$ $b$"), ("$a$", "$a$"), (" ".join(["$x$"] * 60), None)])
def test_inline_formulas_merge(of, text, want):
    import re

    if want is None:  # until nothing changes, whatever the number of rounds
        want, n = text, 1
        while n:
            want, n = re.subn(r"\$([^$\n]{1,40})\$\s+\$([^$\n]{1,40})\$", r"$\1 \2$", want)
    assert of(markup.merged_formulas, text) == want


def test_highlights_come_off(spark):
    md = "Sheep may safely graze by night. Sheep may safely graze by night.\n\nThen ==one mark== that was there before us all."
    docs = spark.createDataFrame([(1, md)], "doc_id long, markdown string")
    spans = spark.createDataFrame([(1, 0, 32), (1, 0, 32), (1, 67, 113)], "doc_id long, start int, end int")
    marked = glossary.highlight(docs, spans)
    assert marked.first().markdown.startswith("==Sheep may safely graze by night.== Sheep may") and marked.first().markdown.count("==") == 4
    records = spark.createDataFrame([(1, 0, "Sheep may safely graze by night."), (1, 5, "x")], "doc_id long, paragraph int, text string")
    assert glossary.unhighlight(marked, records).first().markdown == md


@pytest.mark.parametrize(
    ("text", "want", "told"),
    [
        ("a [remark on it] b [[wiki]] c![alt] d [t](u) e\\[f\\]", "a \\[remark on it\\] b [[wiki]] c![alt] d [t](u) e\\[f\\]", {"literal_square_bracket_escape": 1}),
        ("[x = y + z] and [the x = y + z] and [$u$] [$u$ so]", "[x = y + z] and \\[the x = y + z\\] and [$u$] \\[$u$ so\\]", {"literal_square_bracket_escape": 2}),
        ("[a <= b [c d] e", "\\[a <= b [c d\\] e", {"literal_square_bracket_escape": 1}),
        ("[" + "q " * 120 + "[inner one]", None, {"literal_square_bracket_escape": 1}),
        ("> [!note] kept [so]\nnot [kept]", "> [!note] kept [so]\nnot \\[kept\\]", {"literal_square_bracket_escape": 1}),
        ("## 2.1. On Rain. It falls\n\ndown here.", "## 2.1. On Rain.\n\nIt falls down here.", {"numbered_heading_body_split": 1}),
        ("### 3.2.1. On Snow. It melts inter-\n\nmittently.", "### 3.2.1. On Snow.\n\nIt melts intermittently.", {"numbered_heading_body_split": 1}),
        ("see$ m $now, h$_{2}$o and $k$.", "see $m$ now, h$_{2}$o and $k$.", {"space_before_inline_math": 1, "space_after_inline_math": 1, "inline_math_inner_space": 1}),
        ("$a$ $b$\nc\n\n\n\nd", "$a b$\nc\n\nd", {"inline_math_fragments": 1, "blank_lines": 1}),
        ("cost is 5$ today", "cost is 5$ today", {"warnings": ["unbalanced_inline_math: 1"]}),
        ("", "", {"warnings": []}),
        (None, "", {"warnings": []}),
    ],
)
def test_polish(spark, text, want, told):
    row = markup.polish(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert (want is None or row.t == want + "\n") and {n: row[n] for n in told} == told, row
