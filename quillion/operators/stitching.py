"""Footnotes of Markdown and the stitching of ordered chunks, as column expressions and one ordered aggregate.

A document's text is cut at its footnote references; the names between the
cuts are looked up in a map and put back. Chunks of a document meet only where
their numbers of notes are added up and where the result, one text, is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A footnote's definition (name, content), a reference to it, and the section's heading.
DEFINITION = r"(?m)^\\?\[\^(fn\d+)\\?\]:\s*(.*?)(\s*\^fn-\d+)?\s*$"
REFERENCE = r"\\?\[\^(fn\d+)\\?\](?!\s*:)"
SECTION = r"(?m)^##\s+Footnotes\s*\n((?:.*\n)*?)(?=\n##|\z)"
HEADING = r"(?m)^##\s+Footnotes\s*$"
#: Characters of a chunk's start in which the end of the one before is looked for, and the fewest that count.
WINDOW, LEAST = 200, 5
#: How a text ends that the next does not continue, how one begins, and the characters looked at.
STOPS, BEGINS, EDGE = "[.!?]$", r"^[A-Z#\-*\d]", 50


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _right_stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+$", "")


def definitions(md: Column) -> Column:
    """Array of (id, content) of all footnotes defined in a text, in order."""
    pair = lambda i, x: F.struct(i.alias("id"), _stripped(x).alias("content"))
    return F.zip_with(F.regexp_extract_all(md, F.lit(DEFINITION), F.lit(1)), F.regexp_extract_all(md, F.lit(DEFINITION), F.lit(2)), pair)


def consolidated(md: Column) -> Column:
    """All footnotes in one section at the end, by number; of several of one id the last counts."""
    found = definitions(md)
    later = lambda i: F.slice(found, i + 2, F.greatest(F.size(found), F.lit(1)))
    last = F.filter(found, lambda e, i: ~F.exists(later(i), lambda x: x.id == e.id))
    numbered = F.sort_array(F.transform(last, lambda e: F.struct(F.substring(e.id, 3, 18).cast("long").alias("n"), e.id.alias("id"), e.content.alias("content"))))
    lines = F.transform(numbered, lambda e: F.concat(F.lit("[^"), e.id, F.lit("]: "), e.content, F.lit(" ^fn-"), F.substring(e.id, 3, 18)))
    body = _right_stripped(F.regexp_replace(F.regexp_replace(md, SECTION, ""), DEFINITION, ""))
    return F.when(F.size(found) > 0, F.concat(body, F.lit("\n\n## Footnotes\n\n"), F.array_join(lines, "\n"))).otherwise(body)


def split_chunk(chunk: Column) -> tuple[Column, Column]:
    """A chunk's body, and the footnotes defined below the first heading of such."""
    parts = F.split(chunk, HEADING, 2)
    return _right_stripped(parts[0]), F.coalesce(definitions(F.get(parts, F.lit(1))), F.array().cast("array<struct<id:string,content:string>>"))


def renamed(body: Column, names: Column) -> Column:
    """``body`` with its references under the names of a map; those that are not in it stay as they are."""
    texts, refs = F.split(body, REFERENCE, -1), F.regexp_extract_all(body, F.lit(REFERENCE), F.lit(1))
    put = lambda t, r: F.concat(t, F.when(r.isNull(), "").otherwise(F.concat(F.lit("[^"), F.coalesce(F.element_at(names, r), r), F.lit("]"))))
    return F.array_join(F.zip_with(texts, refs, put), "")


def common_edge(before: Column, after: Column) -> Column:
    """Characters at the start of ``after`` that end ``before``: the most within the window, or 0."""
    most = F.least(F.length(before), F.length(after), F.lit(WINDOW))
    lengths = F.when(most >= LEAST, F.sequence(F.lit(LEAST), F.greatest(most, F.lit(LEAST))))
    return F.coalesce(F.array_max(F.filter(lengths, lambda n: F.endswith(before, F.substring(after, F.lit(1), n)))), F.lit(0))


def goes_on(before: Column, after: Column) -> Column:
    """Whether a sentence is broken between two texts."""
    end, start = _right_stripped(F.right(before, F.lit(EDGE))), F.regexp_replace(F.left(after, F.lit(EDGE)), r"^\s+", "")
    return (end != "") & (start != "") & ~end.rlike(STOPS) & ~start.rlike(BEGINS)


def renumbered(chunks: DataFrame, keys: list[str], order: str, text_col: str) -> DataFrame:
    """(keys, order, body, notes) of every chunk; its notes are numbered on from those of the chunks before it."""
    body, notes = split_chunk(F.coalesce(F.col(text_col), F.lit("")))
    cut = chunks.select(*keys, order, body.alias("body"), notes.alias("notes"))
    before = Window.partitionBy(*keys).orderBy(order, "body").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("before", F.coalesce(F.sum(F.size("notes")).over(before), F.lit(0)))
    name = lambda i: F.concat(F.lit("fn"), (F.col("before") + i + 1).cast("string"))
    # Of notes of one id the last gives the name: earlier ones are left out, since a map has each key once.
    own = F.filter("notes", lambda e, i: ~F.exists(F.slice("notes", i + 2, F.greatest(F.size("notes"), F.lit(1))), lambda x: x.id == e.id))
    at = lambda e: F.size("notes") - 1 - (F.array_position(F.reverse(F.transform("notes", lambda x: x.id)), e.id).cast("int") - 1)
    names = F.map_from_entries(F.transform(own, lambda e: F.struct(e.id, name(at(e)))))
    lines = F.transform("notes", lambda e, i: F.concat(F.lit("[^"), name(i), F.lit("]: "), e.content, F.lit(" ^fn-"), (F.col("before") + i + 1).cast("string")))
    return cut.select(*keys, order, _stripped(renamed(F.col("body"), names)).alias("body"), lines.alias("notes"))


def stitched(chunks: DataFrame, keys: list[str], order: str, text_col: str) -> DataFrame:
    """(keys, chunks, text): chunks in order as one text; what two neighbours share is kept once, broken sentences are joined."""
    each = F.sort_array(F.collect_list(F.struct(order, "body", "notes")))
    per = renumbered(chunks, keys, order, text_col).groupBy(*keys).agg(each.alias("parts"))
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("last"))

    def add(s, x):
        rest = F.substring(x.body, common_edge(s["last"], x.body) + 1, F.length(x.body))
        joined = F.struct(s.done.alias("done"), F.concat(_right_stripped(s["last"]), F.lit(" "), F.regexp_replace(rest, r"^\s+", "")).alias("last"))
        apart = F.struct(F.array_append(s.done, s["last"]).alias("done"), rest.alias("last"))
        first = F.struct(s.done.alias("done"), x.body.alias("last"))
        return F.when(s["last"].isNull(), first).when(goes_on(s["last"], rest), joined).otherwise(apart)

    made = F.aggregate("parts", state, add, lambda s: F.array_join(F.array_append(s.done, s["last"]), "\n\n"))
    notes = F.flatten(F.transform("parts", lambda p: p.notes))
    text = F.when(F.size(notes) > 0, F.concat(made, F.lit("\n\n## Footnotes\n\n"), F.array_join(notes, "\n"))).otherwise(made)
    return per.select(*keys, F.size("parts").cast("long").alias("chunks"), text.alias("text"))
