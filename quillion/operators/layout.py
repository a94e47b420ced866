"""Page layout: lines from spans, columns, margins, footnote zones, reading order, paragraphs.

``spans``: doc_id, page, line, x0, y0, x1, y1, size, text, bold. ``lines``: doc_id, page, line, text, x0, y0, x1, y1, size, with
the page's width and height on every row. All shuffles are on doc_id and page.
Numbers are rounded half to even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillion.functions import text as tx

PAGE = ["doc_id", "page"]

#: How footnotes, captions and notes about authors begin.
FOOTNOTE = r"^\s*(?:\d{1,3}(?:[.)]\s*|\s+(?=[A-Z“\"'(])|(?=[A-Z“\"'(]))|[*†‡§](?:\s+|[.)])?)"
CAPTION = r"(?i)^\s*(?:(fig(?:ure)?|table)\s+\d+\s*[:.])"
AUTHOR_NOTE = r"(?i)^\s*(?:date|received|accepted|published|penultimate draft|final version|correspondence address|copyright|©|i would like to thank|acknowledgements?)\b"
PAGE_NUMBER, FOOTER_NUMBER = r"^[-–—]?\s*\d{1,4}\s*[-–—]?$", r"^[-–—]?\s*\d+\s*[-–—]?$"
NUMBERED, ROMAN = r"^\d+(?:\.\d+)*\.\s+\S", r"(?i)^[IVXLCDM]+[.)]\s+\S"
SENTENCE_TAIL = r"[:.;!?][”\"')\]]?$"


def y_key(y: Column) -> Column:
    """Heights in steps of two points."""
    return F.bround(y / 2.0) * 2.0


def lines_of(spans: DataFrame) -> DataFrame:
    """One row for each line: text with a space where spans lie apart, union of boxes, median size, whether any span is bold."""
    w = Window.partitionBy(*PAGE, "line").orderBy("x0", "y0", "text")
    s = spans.where("text <> ''")
    before, before_x, before_size = (F.lag(c).over(w) for c in ("text", "x1", "size"))
    default = lambda c: F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(8.0))
    apart = F.col("x0") - before_x > F.greatest(F.lit(1.2), F.least(default(before_size), default(F.col("size"))) * 0.18)
    spaced = apart & ~F.col("text").rlike(r"^[ \n\t,.;:!?)\]}]") & ~before.rlike(r"[ \n\t]\z")
    s = s.withColumns({"piece": F.concat(F.when(spaced, " ").otherwise(""), F.col("text")), "k": F.row_number().over(w)})
    return s.groupBy(*PAGE, "line").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "piece"))), lambda p: p["piece"]), "").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.coalesce(F.median(F.when(F.col("size") > 0, F.col("size"))), F.lit(0.0)).alias("size"), F.bool_or("bold").alias("bold"),
    )


def body_sizes(spans: DataFrame) -> DataFrame:
    """(doc_id, page, body_size): the commonest size in the middle of a page in steps of a quarter, or the largest that is clearly larger and common enough.

    Of equally common sizes the one seen first counts; ``seq`` orders spans.
    """
    inside = spans.where((F.col("height") * 0.08 < F.col("y0")) & (F.col("y0") < F.col("height") * 0.88) & (F.col("size") > 0))
    counted = inside.withColumn("s", F.bround(F.col("size") / 0.25) * 0.25).groupBy(*PAGE, "s").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    top = F.struct(F.col("n"), (-F.col("first")).alias("f"))
    w = Window.partitionBy(*PAGE)
    counted = counted.withColumns({"mode": F.max_by("s", top).over(w), "most": F.max("n").over(w)})
    larger = F.when((F.col("s") > F.col("mode") + 0.75) & (F.col("n") >= F.greatest(F.lit(3.0), F.col("most") * 0.25)), F.col("s"))
    return counted.groupBy(*PAGE).agg(F.coalesce(F.max(larger), F.first("mode")).alias("body_size"))


def marginalia_key(c: Column) -> Column:
    key = F.regexp_replace(F.lower(tx.clean_text(c)), r"\d+", "#")
    return F.when(F.length(key) <= 1, "").otherwise(key)


def repeated_marginalia(lines: DataFrame) -> DataFrame:
    """(doc_id, key, place, n): keys of top and bottom lines that come back on enough lines of the document."""
    keyed = lines.withColumn("key", marginalia_key(F.col("text"))).where("key <> ''")
    place = F.array_compact(F.array(F.when(F.col("y0") < F.col("height") * 0.12, "header"), F.when(F.col("y1") > F.col("height") * 0.9, "footer")))
    counted = keyed.select("doc_id", "key", F.explode(place).alias("place")).groupBy("doc_id", "key", "place").agg(F.count("*").alias("n"))
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    return counted.join(pages, "doc_id").where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") * 0.35))).drop("pages")


def with_columns(lines: DataFrame) -> DataFrame:
    """``lines`` with ``columns`` of the page (1 or 2) and ``column``: 0 left or only, 1 right, -1 across both."""
    w, mid = F.col("x1") - F.col("x0"), (F.col("x0") + F.col("x1")) / 2
    eligible = (F.col("height") * 0.12 < F.col("y0")) & (F.col("y0") < F.col("height") * 0.82) & (w < F.col("width") * 0.58)
    left, right = eligible & (mid < F.col("width") * 0.47), eligible & (mid > F.col("width") * 0.53)
    page = lines.groupBy(*PAGE).agg(F.count_if(left).alias("l"), F.count_if(right).alias("r"), (F.median(F.when(right, F.col("x0"))) - F.median(F.when(left, F.col("x1")))).alias("gutter"), F.first("width").alias("pw"))
    two = (F.col("l") >= 2) & (F.col("r") >= 2) & (F.col("gutter") > F.col("pw") * 0.05)
    page = page.select(*PAGE, F.when(two, 2).otherwise(1).alias("columns"))
    column = F.when(F.col("columns") == 1, 0).when(w > F.col("width") * 0.62, -1).when(mid < F.col("width") * 0.5, 0).otherwise(1)
    return lines.join(page, PAGE).withColumn("column", column)


def footnote_separator(rules: DataFrame) -> DataFrame:
    """(doc_id, page, separator): the highest short rule in the lower part of a page."""
    low = (F.col("y0") > F.col("height") * 0.55) & (F.col("x1") - F.col("x0") < F.col("width") * 0.55)
    return rules.groupBy(*PAGE).agg(F.min(F.when(low, F.col("y0"))).alias("separator")).where("separator is not null")


def footnote_starts(lines: DataFrame) -> DataFrame:
    """(doc_id, page, column, start): where small text that begins like a note first stands in a column; lines have body_size and column."""
    c = tx.clean_text(F.col("text"))
    small = (F.col("body_size") > 0) & (F.col("size") < F.col("body_size") * 0.92)
    note = small & (F.col("y0") >= F.col("height") * 0.52) & (F.col("x0") < F.col("width") * 0.28) & (c.rlike(FOOTNOTE) | ((F.col("page") == 1) & c.rlike(AUTHOR_NOTE)))
    side = F.when(F.col("column").isin(0, 1), F.col("column")).otherwise(-1)
    return lines.where(note).groupBy(*PAGE, side.alias("column")).agg(F.min_by("y0", F.struct(y_key(F.col("y0")), "x0")).alias("start"))


def is_page_number(lines: DataFrame) -> Column:
    c = tx.clean_text(F.col("text"))
    return ((F.col("y0") < F.col("height") * 0.12) | (F.col("y1") > F.col("height") * 0.88)) & c.rlike(PAGE_NUMBER)


def reading_order(lines: DataFrame) -> DataFrame:
    """``lines`` (with column, columns, region) with ``reading``: full-width lines at the top, left, right, later full-width ones, then margins."""
    margin = F.col("region").isin("header", "footer", "footnote")
    first = F.min(F.when(~margin & F.col("column").isin(0, 1), F.col("y0"))).over(Window.partitionBy(*PAGE))
    rank = F.when(F.col("region") == "header", 0).when(F.col("region") == "footnote", 2).when(F.col("region") == "footer", 3).otherwise(1)
    top = (F.col("column") == -1) & (F.col("y0") <= F.coalesce(first, F.lit(0.0)) + F.greatest(F.lit(24.0), F.col("size") * 3))
    zone = F.when(margin, 4).when(top, 0).when(F.col("column") == 0, 1).when(F.col("column") == 1, 2).otherwise(3)
    keyed = lines.withColumns({"zone": F.when(F.col("columns") == 2, zone).otherwise(0), "rank": F.when((F.col("columns") != 2) | margin, rank).otherwise(0)})
    w = Window.partitionBy(*PAGE).orderBy("zone", "rank", y_key(F.col("y0")), "x0", "line")
    return keyed.withColumn("reading", F.row_number().over(w)).drop("zone", "rank")


def merged_fragments(lines: DataFrame) -> DataFrame:
    """(doc_id, page, line, text, x0, y0, x1, y1): fragments on one baseline, close to each other, become one line."""
    w = Window.partitionBy(*PAGE).orderBy(y_key(F.col("y0")), "x0", "line")
    p = {c: F.lag(c).over(w) for c in ("x1", "y0", "y1", "size")}
    big = F.greatest(p["size"], F.col("size"), F.lit(1.0))
    height, before = F.greatest(F.col("y1") - F.col("y0"), F.lit(0.0)), F.greatest(p["y1"] - p["y0"], F.lit(0.0))
    gap = F.col("x0") - p["x1"]
    joins = (
        (F.abs(p["size"] - F.col("size")) <= F.greatest(F.lit(0.35), p["size"] * 0.04))
        & (F.abs((p["y0"] + p["y1"]) / 2 - (F.col("y0") + F.col("y1")) / 2) <= F.greatest(F.lit(1.6), big * 0.22))
        & (F.least(p["y1"], F.col("y1")) - F.greatest(p["y0"], F.col("y0")) >= F.least(before, height) * 0.55)
        & gap.between(F.lit(-1.0), F.greatest(F.lit(22.0), big * 3.2))
    )
    marked = lines.withColumn("starts", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    marked = marked.withColumns({"session": F.sum("starts").over(w), "k": F.row_number().over(w)})
    return marked.groupBy(*PAGE, "session").agg(
        F.min("line").alias("line"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "k", "text"))), lambda s: s["text"]), " ").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    ).drop("session")


def numbered_heading(c: Column) -> Column:
    return (F.length(c) <= 160) & (c.rlike(NUMBERED) | c.rlike(ROMAN))


def paragraph_breaks(lines: DataFrame, order: list[str]) -> DataFrame:
    """``lines`` in reading order with ``paragraph``: numbers of the runs between breaks (page, column, gap, indent, headings)."""
    w = Window.partitionBy("doc_id").orderBy(*order)
    lines = lines.withColumn("t", tx.clean_text(F.col("text")))
    p = {c: F.lag(c).over(w) for c in ("page", "column", "size", "x0", "x1", "y0", "y1", "t", "region")}
    h = F.greatest(p["size"], F.col("size"), p["y1"] - p["y0"], F.col("y1") - F.col("y0"), F.lit(1.0))
    gap, indent = F.col("y0") - p["y1"], F.col("x0") - p["x0"]
    heading = numbered_heading(p["t"]) | numbered_heading(F.col("t"))
    body = (p["region"] == "body") & (F.col("region") == "body") & ~heading & (p["t"] != "") & (F.col("t") != "") & ~p["t"].rlike(SENTENCE_TAIL)
    lower = F.col("t").rlike(r"^[a-zà-öø-ÿ(“\"'∼∀∃]")
    over_page = body & ~F.col("t").rlike(r"^(?:[•·∙]|[-*]\s+|\d{1,3}[.)]\s+)") & ((F.abs(indent) <= F.greatest(F.lit(18.0), F.col("size") * 2.2)) | lower)
    over_column = body & (p["column"] == 0) & (F.col("column") == 1) & ~F.col("t").rlike(r"^(?:[•·∙]|[-*]\s+|\(\d{1,3}[′']\)\s+|\d{1,3}[.)]\s+)") & (p["y0"] - F.col("y0") > F.greatest(F.lit(120.0), F.greatest(p["size"], F.col("size"), F.lit(1.0)) * 12.0)) & lower
    label = (p["t"] != "") & (F.col("t") != "") & p["t"].rlike(r"^(?:\(\d{1,3}\)\s+)?\([a-z]\)\s+\S") & gap.between(-h * 0.2, h * 0.75) & (F.col("x0") > p["x0"] + F.greatest(F.lit(12.0), F.col("size")))
    tail = F.regexp_replace(p["t"], r"(?:\d{1,3}|[*†‡§])$", "")
    indented = (p["t"] != "") & (F.col("t") != "") & F.rtrim(tail).rlike(SENTENCE_TAIL) & F.col("t").rlike("^[A-ZÀ-ÖØ-Þ“\"'‘(]") & gap.between(-h * 0.2, h * 1.35) & (indent >= F.greatest(F.lit(6.0), F.col("size") * 0.65))
    short = (p["x1"] - p["x0"] < F.greatest(F.col("x1") - F.col("x0"), p["x1"] - p["x0"]) * 0.68) & (F.col("x0") > p["x0"] + F.greatest(F.lit(12.0), F.col("size")))
    starts = (
        F.when(p["page"].isNull(), True).when(p["page"] != F.col("page"), ~over_page).when(p["column"] != F.col("column"), ~over_column)
        .when(numbered_heading(p["t"]) & (gap > h * 0.25), True).when(numbered_heading(F.col("t")) & (gap > h * 0.35), True).when(gap > h * 1.35, True).when(label, False).when(indented, True).otherwise(short)
    )
    marked = lines.withColumn("starts", F.coalesce(starts, F.lit(False)).cast("int")).withColumn("paragraph", F.sum("starts").over(w))
    return marked.drop("starts", "t")


def joined(lines: DataFrame, order: list[str]) -> DataFrame:
    """(doc_id, paragraph, text, merges): a paragraph's lines as one text without broken words, and its page turns."""
    w = Window.partitionBy("doc_id", "paragraph").orderBy(*order)
    turned = (F.col("page") != F.lag("page").over(w)).cast("int")
    rows = lines.withColumns({"t": tx.clean_text(F.col("text")), "k": F.row_number().over(w), "turned": F.coalesce(turned, F.lit(0))})
    parts = F.transform(F.sort_array(F.collect_list(F.when(F.col("t") != "", F.struct("k", "t")))), lambda p: p["t"])
    out = rows.groupBy("doc_id", "paragraph").agg(F.array_join(parts, "\n").alias("raw"), F.sum("turned").alias("merges"))
    return out.select("doc_id", "paragraph", F.array_join(F.filter(F.transform(F.split(tx.merge_hyphenated(F.col("raw")), "\n"), lambda x: F.trim(x)), lambda x: x != ""), " ").alias("text"), "merges")


def nearest_rank(values: Column, fraction: float) -> Column:
    """The value whose place, from 0 and rounded half to even, is that fraction of the last place."""
    ordered = F.sort_array(values)
    return F.element_at(ordered, (F.bround((F.size(ordered) - 1) * F.lit(fraction)) + 1).cast("int"))


def text_edges(lines: DataFrame) -> DataFrame:
    """(doc_id, page, left, right) of every page: edges of its wide body lines, else those of the document."""
    wide = (F.col("region") == "body") & (F.trim("text") != "") & (F.col("x1") - F.col("x0") >= F.col("width") * 0.42) & (F.col("y0") > F.col("height") * 0.08) & (F.col("y1") < F.col("height") * 0.9)
    page = lines.where(wide).groupBy(*PAGE).agg(nearest_rank(F.collect_list("x0"), 0.1).alias("l"), nearest_rank(F.collect_list("x1"), 0.9).alias("r"))
    whole = page.groupBy("doc_id").agg(nearest_rank(F.collect_list("l"), 0.1).alias("dl"), nearest_rank(F.collect_list("r"), 0.9).alias("dr"))
    every = lines.select(*PAGE).distinct().join(page, PAGE, "left").join(whole, "doc_id")
    return every.select(*PAGE, F.coalesce("l", "dl").alias("left"), F.coalesce("r", "dr").alias("right"))


def list_marker(c: Column, x0: Column) -> Column:
    """struct(kind, level, index, marker, recovered) of a text that begins a list item, or null."""
    def made(kind, level, index, marker, recovered=False):
        return F.struct(F.lit(kind).alias("kind"), F.lit(level).alias("level"), index.cast("int").alias("index"), marker.alias("marker"), F.lit(recovered).alias("recovered"))

    none = F.lit("")
    prime, number, letter, broken = (F.regexp_extract(c, p, 1) for p in (r"^\((\d{1,3})[′']\)\s+", r"^(\d{1,3})[.)]\s+", r"^\(?([a-z])\)[\s.]+", r"^([xyz{])\s+(?:∴|[A-Z]\b|\$?[A-Z])"))
    heading = c.rlike(NUMBERED) & (F.length(c) <= 120)
    return (
        F.when(heading, None).when(c.rlike(r"^(?:[•·∙]|[-*]\s+)"), made("unordered", 0, F.lit(0), none)).when(prime != "", made("ordered", 0, prime, F.concat(prime, F.lit("′")))).when(number != "", made("ordered", 0, number, none))
        .when(letter != "", made("ordered", 1, F.ascii(letter) - 96, F.regexp_extract(c, r"^(\(?[a-z]\))", 1))).when((broken != "") & (x0 > 70), made("ordered", 0, F.instr(F.lit("xyz{"), broken), none, True))
    )


def heading_level(size: Column, body: Column) -> Column:
    return F.when(size >= body + 5, 1).when(size >= body + 3, 2).otherwise(3)


def numbered_level(c: Column) -> Column:
    first = F.regexp_extract(c, r"^(\S+)", 1)
    return F.greatest(F.lit(2), F.least(F.lit(6), F.length(first) - F.length(F.replace(first, F.lit("."), F.lit(""))) + 1))


def note_anchor(marker: Column, page: Column, duplicate: Column) -> Column:
    named = F.when(marker.rlike(r"^\d+$"), F.lpad(F.regexp_replace(marker, "^0+(?=.)", ""), 3, "0"))
    for sign, name in (("*", "asterisk"), ("†", "dagger"), ("‡", "double-dagger"), ("§", "section")):
        named = named.when(marker == sign, name)
    base = F.concat(F.lit("fn-"), named.otherwise("symbol"))
    return F.when(duplicate, F.concat(base, F.lit("-p"), F.lpad(page.cast("string"), 3, "0"))).otherwise(base)


def anchored_notes(notes: DataFrame) -> DataFrame:
    """``notes`` (doc_id, marker, page, linked) with anchor and label; numbers used twice get their page."""
    marker = F.trim("marker")
    twice = marker.rlike(r"^\d+$") & (F.count("*").over(Window.partitionBy("doc_id", "marker")) > 1)
    return notes.withColumns({"anchor": note_anchor(marker, F.col("page"), twice), "label": F.when(F.col("linked"), F.col("marker")).otherwise(F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(" note")))})


def footnote_groups(lines: DataFrame) -> DataFrame:
    """``lines`` of footnotes with ``entry``: a line that begins like a note opens the next one."""
    c = tx.clean_text(F.col("text"))
    w = Window.partitionBy(*PAGE, "column").orderBy("y0", "x0", "line")
    opens = c.rlike(FOOTNOTE) & c.rlike(r"^[\d*†‡§]")
    return lines.withColumns({"opens": opens.cast("int"), "nth": F.row_number().over(w)}).withColumn("entry", F.sum(F.greatest("opens", (F.col("nth") == 1).cast("int"))).over(w)).drop("opens", "nth")


def note_profile(lines: DataFrame) -> DataFrame:
    """(doc_id, bibliography, footnotes, endnotes, markers): what kinds of notes a document has, from its lines in order."""
    c = tx.clean_text(F.col("text"))
    w = Window.partitionBy("doc_id").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumns({"seen": F.max(c.rlike(r"(?i)^references\b")).over(w), "found": F.regexp_extract_all(c, F.lit(r"\[(\d{1,4})\]"), 1)})
    inside = (F.col("height") * 0.12 < F.col("y0")) & (F.col("y0") < F.col("height") * 0.9)
    per = rows.groupBy("doc_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("seen"), F.col("found")))))).alias("markers"), F.sum(F.when(~F.col("seen") & inside, F.size("found")).otherwise(0)).alias("cited"), F.count_if(F.col("region") == "footnote").alias("notes"), F.bool_or("seen").alias("seen")
    )
    return per.select("doc_id", ((F.size("markers") > 0) | (F.col("seen") & (F.col("cited") > 0))).alias("bibliography"), (F.col("notes") > 0).alias("footnotes"), (F.col("seen") & (F.col("notes") == 0)).alias("endnotes"), "markers")


def clean_reference(c: Column) -> Column:
    from quillion.functions.regex import rewrite

    return F.trim(rewrite(tx.clean_text(c), (r"\s+", " "), (r"\s+([,.;:])", "$1"), (r"\(\s+", "("), (r"\s+\)", ")")))


def reference_entries(lines: DataFrame) -> DataFrame:
    """(doc_id, nth, marker, text, anchor) of the numbered entries below a references heading; unnumbered chunks go to the entry before."""
    w = Window.partitionBy("doc_id").orderBy("page", "line")
    rows = lines.withColumns({"t": tx.clean_text(F.col("text")), "k": F.row_number().over(w)}).where("t <> ''")
    whole = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "t"))), lambda p: p["t"]), "\n").alias("all"))
    body = F.trim(F.regexp_replace("all", r"(?i)\Areferences\b", ""))
    chunks = whole.select("doc_id", F.posexplode(F.split(body, r"(?=\[\d{1,4}\]\s)")).alias("pos", "chunk")).withColumn("chunk", F.trim("chunk")).where("chunk <> ''")
    marker = F.regexp_extract("chunk", r"^\[(\d{1,4})\]", 1)
    o = Window.partitionBy("doc_id").orderBy("pos")
    chunks = chunks.withColumns({"marker": marker, "body": clean_reference(F.regexp_replace("chunk", r"^\[\d{1,4}\]\s*", ""))}).withColumn("nth", F.sum((F.col("marker") != "").cast("int")).over(o)).where("nth > 0")
    out = chunks.groupBy("doc_id", "nth").agg(F.max("marker").alias("marker"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "body"))), lambda p: p["body"]), " ").alias("text"))
    return out.withColumn("anchor", F.concat(F.lit("ref-"), F.lpad(F.regexp_replace("marker", "^0+(?=.)", ""), 3, "0")))
