"""Definitions with their glosses, notes linked to the marks in the text, marginal lines, and what is told of a conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillion.functions import formula
from quillion.functions import text as tx
from quillion.operators import layout, rendering

PAGE = ["doc_id", "page"]
#: A named formula; how far apart, in lines and points, it and its gloss may stand; the pair's confidence.
NAMED_FORMULA = r"^\([A-Z][A-Za-z0-9]*\)\s+\S"
SAME_ROW, GLOSS_LEFT, GLOSS_LEFT_LINES, GLOSS_CONFIDENCE = 0.75, 20.0, 2.0, 0.88
#: A raised mark's size and lower edge against its line, and the confidence of a marked and of a found link.
MARK_SIZE, MARK_EDGE, MARKED, FOUND = 0.92, 0.72, 0.94, 0.9
#: Regions that are told as events, the characters shown of a line or note, and the confidence of a page's layout.
TOLD, SHOWN, LAYOUT_CONFIDENCE, POLISH_CONFIDENCE = ["header", "footer", "formula", "figure"], 120, 0.85, 0.75


def gloss_pairs(lines: DataFrame) -> DataFrame:
    """(doc_id, page, line, text, gloss, confidence) of named formulas whose gloss in brackets stands to the right on the same row.

    ``lines``: doc_id, page, line (their order), text, region, x0, x1, y0, y1, size, confidence. A line that is a gloss opens no pair.
    """
    w = Window.partitionBy(*PAGE).orderBy("line")
    named = lines.withColumn("text", tx.clean_text(F.col("text")))
    after = {c: F.lead(c).over(w) for c in ("text", "region", "x0", "y0", "y1", "size", "confidence")}
    tall = F.greatest("size", after["size"], F.col("y1") - F.col("y0"), after["y1"] - after["y0"], F.lit(1.0))
    bracketed = after["text"].startswith("[") & after["text"].endswith("]")
    beside = (F.abs(F.col("y0") - after["y0"]) <= tall * SAME_ROW) & (after["x0"] >= F.col("x1") + F.greatest(F.lit(GLOSS_LEFT), tall * GLOSS_LEFT_LINES))
    pair = F.col("region").isin("body", "formula") & (after["region"] == "body") & F.col("text").rlike(NAMED_FORMULA) & bracketed & beside
    found = named.withColumns({"pair": pair, "gloss": after["text"], "sure": F.least("confidence", after["confidence"], F.lit(GLOSS_CONFIDENCE))})
    # A gloss starts with a bracket, a named formula with a parenthesis: pairs never share a line.
    return found.where("pair").select(*PAGE, "line", "text", "gloss", F.col("sure").alias("confidence"))


def definition_item(text: Column, gloss: Column) -> Column:
    """A pair as a list item: the name and the formula as formulas, a dash, the gloss with its brackets escaped."""
    t, g = tx.clean_text(text), tx.clean_text(gloss)
    label, body = F.regexp_extract(t, r"^\(([^)]+)\)", 1), F.regexp_extract(t, r"^\([^)]+\)\s*(.*?)[.]?$", 1)
    name = formula.render(F.concat(F.lit("("), label, F.lit(")")))
    shown = F.when(label == "", formula.render(t)).when(body == "", name).otherwise(F.concat(name, F.lit(" "), formula.render(tx.clean_text(body))))
    escaped = F.when(g.startswith("[") & g.endswith("]"), F.concat(F.lit(r"\["), F.substring(g, F.lit(2), F.length(g) - 2), F.lit(r"\]"))).otherwise(g)
    return F.concat(F.lit("- "), shown, F.lit(" — "), escaped)


def linked_notes(notes: DataFrame, spans: DataFrame) -> DataFrame:
    """``notes`` (doc_id, page, marker, any others) with the line and span of the mark that refers to each, ``linked``, ``confidence`` and ``warning``.

    ``spans``: doc_id, page, line, span, text, role, size, y1, line_size, line_y0, line_height, region. A span whose role
    names the marker comes before one that is raised, small and says no more than the marker; then the first in order.
    """
    told = F.when(F.col("role").startswith("note_ref:"), F.substring("role", 10, 1 << 20))
    raised = ~((F.col("size") > 0) & (F.col("line_size") > 0) & (F.col("size") > F.col("line_size") * MARK_SIZE)) & (F.col("y1") <= F.col("line_y0") + F.col("line_height") * MARK_EDGE)
    body = spans.where("region = 'body'")
    marks = body.where(told.isNotNull()).select(*PAGE, told.alias("marker"), F.lit(0).alias("way"), "line", "span")
    marks = marks.unionByName(body.where(raised).select(*PAGE, tx.clean_text(F.col("text")).alias("marker"), F.lit(1).alias("way"), "line", "span"))
    first = marks.groupBy(*PAGE, "marker").agg(F.min(F.struct("way", "line", "span")).alias("m"))
    both = notes.join(first, [*PAGE, "marker"], "left")
    return both.withColumns(
        {
            "source_line": F.col("m.line"),
            "source_span": F.col("m.span"),
            "linked": F.col("m").isNotNull(),
            "confidence": F.when(F.col("m.way") == 0, MARKED).when(F.col("m.way") == 1, FOUND),
            "warning": F.when(F.col("m").isNull(), "No superscript reference was linked on the source page."),
        }
    ).drop("m")


def with_marginalia(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """``lines`` with ``repeated_header`` and ``repeated_footer``: whether a line's key comes back in that place of its document."""
    keyed = lines.withColumn("key", layout.marginalia_key(F.col("text")))
    places = repeated.groupBy("doc_id", "key").agg(F.collect_set("place").alias("places"))
    joined = keyed.join(places, ["doc_id", "key"], "left")
    is_ = lambda place: F.coalesce(F.array_contains("places", place), F.lit(False))
    top, low = F.col("y0") < F.col("height") * 0.12, F.col("y1") > F.col("height") * 0.9
    return joined.withColumns({"repeated_header": is_("header") & top, "repeated_footer": is_("footer") & low}).drop("places", "key")


def plain_span(text: Column, role: Column, anchor: Column, label: Column, notes: str = "obsidian-block", references: str = "wikilink", escaped: bool = True) -> Column:
    """A span that is no formula: a note's mark (as a link to ``anchor``, where there is one), a citation, or its words."""
    marker = tx.clean_text(F.substring(role, 10, 1 << 20))
    link = F.concat(F.lit("[[#^"), anchor, F.lit("|"), marker, F.lit("]]"))
    if notes == "markdown":
        link = F.concat(F.lit("[^"), F.coalesce(label, F.substring(role, 10, 1 << 20)), F.lit("]"))
    elif references == "html-sup":
        link = F.concat(F.lit("<sup>"), link, F.lit("</sup>"))
    mark = marker if references == "plain" else F.when(anchor.isNull(), marker).otherwise(link)
    words = F.regexp_replace(tx.repair_unicode(text), r"[ \t]+", " ")
    return F.when(role.startswith("note_ref:"), mark).when(role.startswith("bibliographic_citation:"), rendering.citation(text, escaped)).otherwise(words)


def events(pages: DataFrame, lines: DataFrame, notes: DataFrame, polish: DataFrame) -> DataFrame:
    """(doc_id, page, kind, message, confidence, severity) of all that is told of documents.

    ``pages``: doc_id, page, columns, body_size. ``lines``: doc_id, page, region, text, confidence, warnings. ``notes``:
    doc_id, page, marker, content, linked, confidence, warning. ``polish``: doc_id, warnings.
    """

    def told(df: DataFrame, kind: Column, message: Column, confidence: Column, severity: Column = F.lit("info"), page: Column | None = None) -> DataFrame:
        page = F.col("page") if page is None else page
        return df.select("doc_id", page.cast("int").alias("page"), kind.alias("kind"), message.alias("message"), confidence.cast("double").alias("confidence"), severity.alias("severity"))

    layouts = told(pages, F.lit("page_layout"), F.format_string("Detected %d column(s); body font size %.2f.", F.col("columns"), F.col("body_size")), F.lit(LAYOUT_CONFIDENCE))
    regions = told(lines.where(F.col("region").isin(TOLD)), F.col("region"), F.concat("region", F.lit(" line: "), F.left("text", F.lit(SHOWN))), F.col("confidence"))
    warned = told(lines.select("*", F.explode("warnings").alias("said")), F.lit("warning"), F.col("said"), F.col("confidence"), F.lit("warning"))
    state = F.when(F.col("linked"), "linked_note").otherwise("unlinked_note")
    noted = told(notes, state, F.concat(F.lit("Footnote "), "marker", F.lit(": "), F.left("content", F.lit(SHOWN))), F.col("confidence"), F.when(F.col("warning").isNull(), "info").otherwise("warning"))
    polished = told(polish.select("*", F.explode("warnings").alias("said")), F.lit("polish_warning"), F.col("said"), F.lit(POLISH_CONFIDENCE), F.lit("warning"), F.lit(None))
    return layouts.unionByName(regions).unionByName(warned).unionByName(noted).unionByName(polished)


def diagnostics(documents: DataFrame, pages: DataFrame, told: DataFrame) -> DataFrame:
    """(doc_id, json): one report for each document: its source, notes by state, pages and events. ``documents``: doc_id, source; ``pages`` also width, height."""
    listed = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", *[F.round(c, 2).alias(c) for c in ("width", "height")], "columns", F.round("body_size", 2).alias("body_size")))).alias("pages"))
    said = told.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("page", "kind", "message", "confidence", "severity"))).alias("events"),
        F.struct(F.count_if(F.col("kind") == "linked_note").alias("linked_notes"), F.count_if(F.col("kind") == "unlinked_note").alias("unlinked_notes")).alias("summary"),
    )
    every = documents.join(listed, "doc_id", "left").join(said, "doc_id", "left")
    return every.select("doc_id", F.to_json(F.struct(F.lit(1).alias("schema_version"), F.col("source").alias("source_pdf"), "summary", "pages", "events")).alias("json"))
