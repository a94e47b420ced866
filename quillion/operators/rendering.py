"""Headings, quotes, figures and notes of laid-out documents, and their rendering as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillion.functions import text as tx
from quillion.functions.regex import rewrite
from quillion.operators import layout

PAGE = ["doc_id", "page"]
#: Headings that most papers have.
COMMON_HEADINGS = ["abstract", "acknowledgements", "acknowledgments", "appendix", "bibliography", "conclusion", "concluding remarks", "introduction", "notes", "references"]
#: List markers as they stand at the start of an item.
LIST_MARKER = r"^(?:[•·∙]|[-*]|\(\d{1,3}[′']\)|\d{1,3}[′'][.]?|\d{1,3}[.)]|\(?[a-z]\)|[xyz{])[\s.]*"

#: How far below, in lines, and how far left, in points and in sizes, a line may stand that goes on with a list item.
CONTINUATION_GAP, CONTINUATION_LEFT, CONTINUATION_LEFT_SIZES = 1.7, 3.0, 0.35


def is_common_heading(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "^[ .:]+|[ .:]+$", "").isin(COMMON_HEADINGS)


def is_section_label(c: Column, size: Column, y0: Column, body: Column, height: Column) -> Column:
    """A short line in capitals, no larger than the body, not at the foot of a page."""
    letters = F.regexp_replace(c, "[^A-Za-z]", "")
    return (body > 0) & (c != "") & (size <= body * 0.95) & (y0 <= height * 0.7) & (F.length(c) <= 32) & (F.size(F.split(F.trim(c), r"\s+")) <= 3) & (letters != "") & (F.upper(letters) == letters)


def headings(lines: DataFrame) -> DataFrame:
    """``lines`` (with body_size) with ``heading``: its level, or null. Bold large lines, numbered, roman and common ones, and labels."""
    c = tx.clean_text(F.col("text"))
    numbered = c.rlike(layout.NUMBERED) & (F.length(c) <= 120)
    roman = (F.length(c) <= 160) & c.rlike(layout.ROMAN)
    label = is_section_label(c, F.col("size"), F.col("y0"), F.col("body_size"), F.col("height"))
    large = F.col("bold") & (F.col("body_size") > 0) & ((F.col("size") >= F.col("body_size") + 4) | ((F.col("size") >= F.col("body_size") + 2) & (F.col("y0") < F.col("height") * 0.35)))
    level = F.when(roman | is_common_heading(c), 2).when(label, 3).when(numbered, layout.numbered_level(c)).when(large, layout.heading_level(F.col("size"), F.col("body_size")))
    return lines.withColumn("heading", level)


def display_quotes(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, paragraph, quote): paragraphs of which every line with text is set in from both edges; single lines only if they begin with a bracketed number."""
    inset = F.greatest(F.lit(7.0), F.col("size") * 0.65)
    inside = F.coalesce((F.col("x0") >= F.col("left") + inset) & (F.col("x1") <= F.col("right") - inset), F.lit(False))
    c = tx.clean_text(F.col("text"))
    rows = lines.join(edges, PAGE, "left").withColumns({"full": c != "", "inside": inside, "alone": c.rlike(r"^\[\d{1,3}\]\s+\S")})
    per = rows.groupBy("doc_id", "paragraph").agg(F.count("*").alias("n"), F.count_if("full").alias("checked"), F.bool_and(F.when(F.col("full"), F.col("inside"))).alias("all_in"), F.bool_or("alone").alias("alone"))
    return per.select("doc_id", "paragraph", (((F.col("n") > 1) | F.col("alone")) & (F.col("checked") > 0) & F.coalesce("all_in", F.lit(False))).alias("quote"))


def is_figure_label(c: Column) -> Column:
    return (c != "") & (F.length(c) <= 90) & (c.rlike(r"^\(?[A-Z]{1,6}[0-9]?\)?$") | c.rlike("[&=↑⇑⇕→↔⊃≡∀∃]") | c.rlike(r"^\([A-Z]{1,8}\)$"))


def figure_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, page, line) of captions, and of labels and formulas from 180 points above them to a line and a half below."""
    captions = lines.where("region = 'figure'").select(*PAGE, F.col("line").alias("c_line"), F.greatest(F.col("y0") - 180, F.lit(0.0)).alias("top"), (F.col("y0") + F.greatest(F.lit(12.0), F.col("size") * 1.5)).alias("low"))
    near = lines.join(captions, PAGE).where("line <> c_line and y0 >= top and y1 <= low").where((F.col("region") == "formula") | is_figure_label(tx.clean_text(F.col("text"))))
    return lines.where("region = 'figure'").select(*PAGE, "line").unionByName(near.select(*PAGE, "line")).distinct()


def is_footnote(lines: DataFrame) -> Column:
    """The stateless part of the footnote rule: ``lines`` have body_size, separator and start (either may be null)."""
    c = tx.clean_text(F.col("text"))
    small = (F.col("body_size") > 0) & (F.col("size") < F.col("body_size") * 0.92)
    below = F.coalesce(F.col("y0") > F.col("separator"), F.lit(False))
    zone = F.coalesce(F.col("y0") >= F.col("start") - 1.0, F.lit(False))
    foot = (F.col("y0") > F.col("height") * 0.72) & small
    author = (F.col("page") == 1) & foot & c.rlike(layout.AUTHOR_NOTE)
    return (zone & small) | (~(below & ~small) & (below | foot) & (c.rlike(layout.FOOTNOTE) | author))


def citation(c: Column, escaped: bool = True) -> Column:
    c = tx.clean_text(c)
    return F.regexp_replace(c, r"^\[(\d{1,4})\]$", r"\\[$1\\]") if escaped else c


def strip_list_marker(c: Column) -> Column:
    return F.trim(F.regexp_replace(tx.clean_text(c), LIST_MARKER, ""))


def list_prefix(kind: Column, level: Column, index: Column, marker: Column) -> Column:
    indent = F.repeat(F.lit("  "), F.greatest(F.coalesce(level, F.lit(0)), F.lit(0)))
    n = F.coalesce(F.nullif(index, F.lit(0)), F.lit(1))
    kept = F.trim(F.coalesce(marker, F.lit("")))
    shown = F.when(kept.rlike(r"^\(?\d{1,3}[′']\)?$"), F.concat(F.regexp_extract(kept, r"(\d{1,3})", 1), F.lit("′."))).when(kept.rlike(r"[.)]$"), kept).otherwise(F.concat(kept, F.lit(".")))
    number = F.when(kept != "", shown).when(level == 1, F.concat(F.char(96 + n), F.lit("."))).otherwise(F.concat(n.cast("string"), F.lit(".")))
    return F.concat(indent, F.when(kind == "ordered", F.concat(number, F.lit(" "))).otherwise("- "))


def render_node() -> Column:
    """Markdown of a node (kind, text, level, list_kind, list_level, list_index, list_marker)."""
    c = tx.clean_text(F.col("text"))
    quoted = F.array_join(F.transform(F.split(c, "\n"), lambda x: F.when(x == "", ">").otherwise(F.concat(F.lit("> "), x))), "\n")
    prefix = list_prefix(F.col("list_kind"), F.col("list_level"), F.col("list_index"), F.col("list_marker"))
    body = strip_list_marker(F.col("text"))
    return (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(F.nullif("level", F.lit(0)), F.lit(2))))), F.lit(" "), c))
        .when(F.col("kind") == "blockquote", quoted).when(F.col("kind") == "list_item", F.when(body == "", F.rtrim(prefix)).otherwise(F.concat(prefix, body)))
        .when(F.col("kind") == "latex_display_formula", F.when(c == "", "").otherwise(F.concat(F.lit("$$\n"), c, F.lit("\n$$")))).when(F.col("kind") == "figure", F.when(c == "", "> [!figure]").otherwise(F.concat(F.lit("> [!figure] "), c))).otherwise(c)
    )


def render(nodes: DataFrame, title: Column) -> DataFrame:
    """(doc_id, markdown): front matter with the title, then nodes in order; a blank line after each, but between list items."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = nodes.withColumns({"out": render_node(), "next": F.lead("kind").over(w), "title": title})
    together = (F.col("kind") == "list_item") & F.coalesce(F.col("next") == "list_item", F.lit(False))
    piece = F.when(F.col("out") == "", "").otherwise(F.concat("out", F.when(together, "\n").otherwise("\n\n")))
    per = rows.withColumn("piece", piece).groupBy("doc_id").agg(F.first("title").alias("title"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "piece"))), lambda p: p["piece"]), "").alias("body"))
    front = F.concat(F.lit('---\ntitle: "'), F.replace("title", F.lit('"'), F.lit('\\"')), F.lit('"\n---\n\n'))
    return per.select("doc_id", F.concat(F.rtrim(trim_blank_lines(F.concat(front, "body"))), F.lit("\n")).alias("markdown"))


def trim_blank_lines(c: Column) -> Column:
    """No white space at line ends, and one blank line at most in a row."""
    return rewrite(c, (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"\s+\z", ""))


def render_notes(notes: DataFrame) -> DataFrame:
    """(doc_id, markdown) of notes (pos, linked, label, content, anchor): linked ones first, each as a folded block with its anchor."""
    lines = F.array_join(F.transform(F.split(tx.clean_text(F.col("content")), "\n"), lambda x: F.when(x == "", ">").otherwise(F.concat(F.lit("> "), x))), "\n")
    block = F.concat(F.lit("> [!note]- "), tx.clean_text(F.col("label")), F.lit("\n"), lines, F.lit("\n\n^"), F.col("anchor"), F.lit("\n\n"))
    part = lambda linked: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("linked") == linked, F.struct("pos", "block")))), lambda p: p["block"]), "")
    per = notes.withColumn("block", block).groupBy("doc_id").agg(part(True).alias("a"), part(False).alias("b"))
    titled = lambda name, c: F.when(F.col(c) == "", "").otherwise(F.concat(F.lit(f"## {name}\n\n"), F.col(c)))
    return per.select("doc_id", F.concat(F.rtrim(rewrite(F.concat(titled("Notes", "a"), titled("Unlinked Notes", "b")), (r"\s+\z", ""))), F.lit("\n")).alias("markdown"))


def render_references(entries: DataFrame, anchors: bool = True) -> DataFrame:
    """(doc_id, markdown) of reference entries."""
    line = F.concat(citation(F.concat(F.lit("["), "marker", F.lit("]"))), F.lit(" "), tx.clean_text(F.col("text")), F.concat(F.lit(" ^"), "anchor") if anchors else F.lit(""), F.lit("\n"))
    per = entries.withColumn("out", line).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "out"))), lambda p: p["out"]), "\n").alias("body"))
    return per.select("doc_id", F.concat(F.lit("## References\n\n"), "body").alias("markdown"))


def note_targets(refs: DataFrame, notes: DataFrame) -> DataFrame:
    """Each reference (doc_id, seq, marker, page) with the anchor of the linked note of its marker: its page's last one, else the document's first."""
    linked = notes.where("linked")
    exact = linked.groupBy("doc_id", "marker", "page").agg(F.max_by("anchor", "pos").alias("here"))
    any_ = linked.groupBy("doc_id", "marker").agg(F.min_by("anchor", "pos").alias("anywhere"))
    return refs.join(exact, ["doc_id", "marker", "page"], "left").join(any_, ["doc_id", "marker"], "left").select("doc_id", "seq", "marker", "page", F.coalesce("here", "anywhere").alias("anchor"))


def unresolved(refs: DataFrame, notes: DataFrame) -> DataFrame:
    """References whose marker no linked note of the document has."""
    return refs.join(notes.where("linked").select("doc_id", "marker"), ["doc_id", "marker"], "left_anti")


def plan_statistics(nodes: DataFrame) -> DataFrame:
    """Counts of each kind of node by document, in one pass."""
    kinds = ("heading", "paragraph", "blockquote", "list_item", "figure")
    return nodes.groupBy("doc_id").agg(F.count("*").alias("nodes"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])


def imported_note(md: Column, title: Column, source: Column, at: Column) -> Column:
    """A paper's Markdown under new front matter."""
    from quillion.operators.glossary import scalar

    body = rewrite(md, (r"(?s)\A---\n.*?\n---\n*", ""), (r"^\s+|\s+\z", ""))
    return F.concat(F.lit("---\ntitle: "), scalar(title), F.lit("\nsource_pdf: "), scalar(source), F.lit("\nimported_at: "), scalar(at), F.lit("\nimported_paper: true\n---\n"), body, F.lit("\n"))


def answer_text(parts: Column) -> Column:
    """Text of a model's content array<struct<type, text>>, null if there is none."""
    found = F.filter(parts, lambda p: p["type"].isin("text", "output_text") & (F.coalesce(p["text"], F.lit("")) != ""))
    return F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda p: p["text"]), "\n"))


def prompt(template: Column, definition: Column, cluster: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{{DEFINITION_REQUIREMENT}}"), definition), F.lit("{{CLUSTER_REQUIREMENT}}"), cluster)


#: How sure a region is.
CONFIDENCE = {"page number": 0.9, "header": 0.95, "footer": 0.92, "footnote": 0.82, "figure": 0.78, "formula": 0.84, "body": 1.0}


def regions(lines: DataFrame) -> DataFrame:
    """``lines`` with ``region`` and ``confidence``, by the first rule that holds.

    ``lines``: geometry, column, body_size, separator and start (either may be
    null), and flags is_header, is_footer (repeated marginalia) and is_formula.
    Once a column has a footnote, later small lines there need no marker; only a
    line that is a footnote by itself can be the first, so the zone is a running
    maximum, not a loop.
    """
    c = tx.clean_text(F.col("text"))
    number = layout.is_page_number(lines)
    header = (F.col("y0") < F.col("height") * 0.12) & F.col("is_header")
    footer = (F.col("y1") >= F.col("height") * 0.9) & (F.col("is_footer") | c.rlike(layout.FOOTER_NUMBER))
    small = (F.col("body_size") > 0) & (F.col("size") < F.col("body_size") * 0.92)
    below = F.coalesce(F.col("y0") > F.col("separator"), F.lit(False))
    may = ~(below & ~small) & (below | ((F.col("y0") > F.col("height") * 0.72) & small))
    side = F.when(F.col("column").isin(0, 1), F.col("column")).otherwise(-1)
    rows = lines.withColumns({"margin": F.when(number, "page number").when(header, "header").when(footer, "footer"), "alone": is_footnote(lines), "may": may, "side": side})
    before = Window.partitionBy(*PAGE, "side").orderBy(layout.y_key(F.col("y0")), "x0", "line").rowsBetween(Window.unboundedPreceding, -1)
    zone = F.coalesce(F.max(F.col("margin").isNull() & F.col("alone")).over(before), F.lit(False))
    rows = rows.withColumn("zone", zone)
    rule = F.coalesce("margin", F.when(F.col("alone") | (F.col("may") & F.col("zone")), "footnote").when(c.rlike(layout.CAPTION), "figure").when(F.col("is_formula"), "formula").otherwise("body"))
    sure = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    rows = rows.withColumn("rule", rule)
    return rows.withColumns({"region": F.when(F.col("rule") == "page number", "footer").otherwise(F.col("rule")), "confidence": sure[F.col("rule")]}).drop("margin", "alone", "may", "side", "zone", "rule")


def inline_markers(spans: DataFrame, numeric_bibliography: Column) -> DataFrame:
    """(…, kind, marker, confidence) of spans that are citations, note references, indexes or plain numbers.

    ``spans``: doc_id, page, line, k, text, size, y0, y1, line_size, line_y0, line_y1, body_size, region, role, density. The neighbours are the
    spans with text before and after on the line.
    """
    c = tx.clean_text(F.col("text"))
    w = Window.partitionBy("doc_id", "page", "line").orderBy("k")
    full = lambda x: F.when(c != "", x)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    rows = spans.withColumns(
        {
            "c": c, "p": F.last(full(c), ignorenulls=True).over(before), "p_y0": F.last(full(F.col("y0")), ignorenulls=True).over(before), "p_role": F.last(full(F.coalesce("role", F.lit(""))), ignorenulls=True).over(before), "n": F.first(full(c), ignorenulls=True).over(after),
        }
    )
    c, height = F.col("c"), F.col("line_y1") - F.col("line_y0")
    bracket = F.regexp_extract(c, r"^\[(\d{1,4})\]$", 1)
    level = ((F.col("size") == 0) | (F.col("line_size") == 0) | (F.abs(F.col("size") - F.col("line_size")) <= F.col("line_size") * 0.12)) & (F.col("y1") >= F.col("line_y0") + height * 0.7)
    note = c.rlike(r"^\d{1,3}$|^[*†‡§]$")
    lower = F.col("p").isNotNull() & (F.col("size") < F.col("line_size") * 0.9) & (F.col("y0") > F.col("p_y0") + F.greatest(F.lit(0.8), height * 0.08))
    index = lower & ((F.col("p_role") == "math") | F.col("p").rlike(r"(?:[A-Z]|\bPr|\(NC|\bNC)$") | F.col("p").isin("H", "E", "K", "Pr", "c", "r", "l", "∼H") | F.coalesce(F.col("n").rlike(r"^[)\]]"), F.lit(False)))
    raised = (F.col("region") == "body") & (F.coalesce("role", F.lit("")) != "math") & (F.col("density") <= 0.18) & ~F.coalesce(index, F.lit(False)) & (F.col("size") < F.col("line_size") * 0.88) & ((F.col("body_size") == 0) | (F.col("size") < F.col("body_size") * 0.88)) & (F.col("y1") <= F.col("line_y0") + height * 0.72)
    made = lambda kind, marker, sure: F.struct(F.lit(kind).alias("kind"), marker.alias("marker"), sure.cast("double").alias("confidence"))
    found = (
        F.when((bracket != "") & level, made("bibliographic_citation", bracket, F.when(numeric_bibliography, 0.95).otherwise(0.75))).when(note & raised, made("note_ref", c, F.lit(0.9)))
        .when(note & F.coalesce(index, F.lit(False)), made("plain_number", c, F.lit(0.85))).when(c.rlike(r"^\d+$"), made("plain_number", c, F.lit(0.8)))
    )
    rows = rows.withColumn("found", found).where("found is not null")
    return rows.select("doc_id", "page", "line", "k", "found.*")


def is_references_heading(c: Column) -> Column:
    return tx.clean_text(c).rlike(r"(?i)^references\b")


def continues_list(first_x0: Column, first_column: Column, gap: Column, candidate: dict[str, Column], previous: dict[str, Column]) -> Column:
    """Whether a line goes on with the list item that began at ``first_x0``: same column, near the line before, not left of the item, no numbered heading.

    ``candidate`` and ``previous``: size and height, ``candidate`` also x0, column and text.
    """
    tall = F.greatest(previous["size"], candidate["size"], previous["height"], candidate["height"], F.lit(1.0))
    near = gap <= tall * CONTINUATION_GAP
    inside = candidate["x0"] >= first_x0 - F.greatest(F.lit(CONTINUATION_LEFT), candidate["size"] * CONTINUATION_LEFT_SIZES)
    return (first_column == candidate["column"]) & near & inside & ~layout.numbered_heading(candidate["text"])
