"""Markdown clean-up that has to know whether it is inside code or formulas.

A text is cut into protected pieces (fences, inline code, display and inline
formulas) and prose by one pattern; rules then apply to one kind of piece. The
functions of strings serve Arrow batches and tests alike.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillion.operators import stitching

_PIECES = re.compile(r"(?P<fence>```.*?(?:```|\Z))|(?P<code>`[^`]*(?:`|\Z))|(?P<display>\$\$.*?(?:\$\$|\Z))|(?P<inline>\$[^$]*(?:\$|\Z))|(?P<prose>[^`$]+)", re.DOTALL)

def unescape_formula_brackets(md: str) -> str:
    """Escaped square brackets are plain inside formulas."""
    return "".join(m[0].replace(r"\[", "[").replace(r"\]", "]") if m.lastgroup in ("display", "inline") else m[0] for m in _PIECES.finditer(md))


#: Square brackets in prose: what is kept as it is comes first, a bracket to escape last.
_KEPT = re.compile(r"\\[\[\]]|\[\[.*?\]\]|\[\^[^\]]*\]?|\]\(|[\[\]]", re.DOTALL)


def _links(md: str) -> set[int]:
    """Where brackets open whose partner stands directly before a parenthesis; one pass with a stack."""
    waiting: list[int] = []
    found = set()
    for m in re.finditer(r"[\[\]]", md):
        if m[0] == "[":
            waiting.append(m.start())
        elif waiting:
            opened = waiting.pop()
            if md.startswith("(", m.end()):
                found.add(opened)
    return found


def escape_prose_brackets(md: str) -> str:
    """Square brackets in prose are escaped, but for links, wiki links, footnotes and front matter."""
    front = re.match(r"---.*?\n---", md, re.DOTALL)
    start = front.end() if front else 0
    out, links = [md[:start]], _links(md[start:])
    for m in _PIECES.finditer(md, start):
        if m.lastgroup != "prose":
            out.append(m[0])
            continue
        last = m.start()
        for b in _KEPT.finditer(md, m.start(), m.end()):
            out.append(md[last : b.start()])
            plain = b[0] in "[]" and not (b[0] == "[" and b.start() - start in links)
            out.append("\\" + b[0] if plain else b[0])
            last = b.end()
        out.append(md[last : m.end()])
    return "".join(out)


def _udf(fn):
    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fn(t))

    return run


unescape_formula_brackets_udf = _udf(unescape_formula_brackets)
escape_prose_brackets_udf = _udf(escape_prose_brackets)


def wikilinks(c: Column) -> Column:
    """Footnote references as wiki links, without Python."""
    return F.regexp_replace(c, r"\\?\[\^fn(\d+)\\?\](?!\s*:)", "[[#^fn-$1|$1]]")


def postprocessed(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with brackets set right in the text, then its footnotes in one section, then references as wiki links."""
    df = df.withColumn(text_col, escape_prose_brackets_udf(unescape_formula_brackets_udf(F.col(text_col))))
    return df.withColumn(text_col, wikilinks(stitching.consolidated(F.col(text_col))))


#: Passes of :func:`merged_formulas`. A formula that finds a partner at least doubles, and none above 40 characters is
#: merged, so after six passes only the odd ones of runs are left, and those are placed in the next.
MERGES = 8


def merged_formulas(c: Column) -> Column:
    """Neighbouring inline formulas of up to 40 characters become one, until none are left."""
    for _ in range(MERGES):
        c = F.regexp_replace(c, r"\$([^$\n]{1,40})\$\s+\$([^$\n]{1,40})\$", r"\$$1 $2\$")
    return c


#: Tidying steps in order, each with the name of its counter; those after the formulas are merged come last.
POLISH = [
    ("before_punctuation", r"[ \t]+([,.;:!?])", "$1"),
    ("after_punctuation_runs", r"([,.;:!?]) {2,}", "$1 "),
    ("open_paren_inner", r"([(\[{])\s+", "$1"),
    ("close_paren_inner", r"\s+([)\]}])", "$1"),
    ("hyphen_spacing", r"(?U)\b([A-Za-zÀ-ÖØ-öø-ÿ]+)\s+-\s*([A-Za-zÀ-ÖØ-öø-ÿ]+)\b", "$1-$2"),
    ("math_leading_bracket", r"\$\[", r"\$"),
    ("math_trailing_backslash", r"\\\$", r"\$"),
]
CITATION = ("numeric_bracket_citation_escape", r"(?<![\\\[])\[(\d{1,4})\](?!\])", r"\\[$1\\]")
BLANK_LINES = ("blank_lines", r"\n{3,}", "\n\n")
#: What is counted as a warning in the result.
BAD = [("math_open_bracket", r"\$\["), ("math_backslash_fragment", r"\$\\\$"), ("unbalanced_inline_math", r"(?m)^[^$]*\$[^$]*$"), ("double_space_after_comma", ", {2,}")]
#: A numbered heading with the beginning of its paragraph behind it, and the paragraph's rest.
HEADING_TAIL = r"(?m)^(#{{2,6}} \d+(?:\.\d+)+\. .+?\.) ([A-Z][^\n]*?){}\n\n([a-z][^\n]*)"
#: Inline formulas, those that are an index only, and characters that they are kept apart from.
INLINE, INDEX_ONLY, WORD, BEFORE = r"\$[^$\n]+\$", r"^\$_\{[^{}\n]+\}\$$", "[A-Za-zÀ-ÖØ-öø-ÿ0-9]", "[A-Za-zÀ-ÖØ-öø-ÿ0-9”’\"']"
LINE_ENDS = r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

#: Words of prose, and commands, signs and operators of formulas, by which a bracketed group is judged.
_PROSE = re.compile(r"\b(?:is|are|and|or|not|the|an|a|where|specifically|property|viz|i\.e|green|grue|emerald)\b", re.IGNORECASE)
_FORMAL = re.compile(r"\\(?:forall|exists|supset|sim|equiv|operatorname|frac|sum|int|prod|lim|infty|phi|psi|ddagger|dagger|wedge|vee|neg|rightarrow|leftrightarrow)\b|[∀∃⊃≡∼→↔≤≥∑∫∏√]")
_OPERATOR = re.compile(r"[&=<>+\-*/|~¬]|\\[A-Za-z]+")
_FORMULA = re.compile(r"\$[^$\n]*\$")
LONGEST_GROUP, OPERATORS, LETTERS = 220, 2, 12
#: What a line's scanner stops at: an escaped character, a wiki link, or a group up to the first bracket that closes one.
_GROUP = re.compile(r"\\.|\[\[.*?\]\]|(?<![!\\])\[(?!\[)(?P<inner>(?:\\.|[^\]\\])+)\](?![\](])", re.DOTALL)


def reads_as_formula(inner: str) -> bool:
    """Whether what stands in brackets is a formula rather than a remark."""
    outside = _FORMULA.sub(" ", inner)
    if _PROSE.search(outside):
        return False
    if _FORMAL.search(inner):
        return True
    if "$" in inner:
        return not outside.strip()
    return len(_OPERATOR.findall(inner)) >= OPERATORS and len(re.findall("[A-Za-z]", inner)) <= LETTERS


def escape_remarks(md: str) -> str:
    """Brackets around remarks are escaped, line by line; links, images, callouts and formulas keep theirs."""
    done = []
    for line in md.split("\n"):
        at = last = 0
        while not line.startswith("> [!") and (m := _GROUP.search(line, at)):
            inner = m["inner"]
            at = m.end()
            if inner is not None:
                if len(inner) <= LONGEST_GROUP and not reads_as_formula(inner):
                    done += [line[last : m.start()], "\\[", inner, "\\]"]
                    last = at
                else:
                    at = m.start() + 1  # groups that begin inside are judged by themselves
        done += [line[last:], "\n"]
    return "".join(done[:-1])


escape_remarks_udf = _udf(escape_remarks)


def as_lines(c: Column) -> Column:
    """All line ends as ``\n``, none at the end."""
    return F.regexp_replace(F.regexp_replace(c, LINE_ENDS, "\n"), r"\n\z", "")


def spaced_formulas(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with inline formulas apart from words around them and without spaces at their ends, and three counters."""
    df = df.withColumns({"__rest": F.split(text_col, INLINE, -1), "__own": F.regexp_extract_all(text_col, F.lit(INLINE), F.lit(0))})
    rest, own = F.col("__rest"), F.col("__own")
    inner = lambda m: F.substring(m, F.lit(2), F.length(m) - 2)
    bare = lambda m: F.regexp_replace(inner(m), r"(?U)^\s+|\s+$", "")
    each = F.transform(
        own,
        lambda m, i: F.struct(
            (F.right(F.get(rest, i), F.lit(1)).rlike(BEFORE) & ~m.rlike(INDEX_ONLY)).alias("before"),
            (F.left(F.get(rest, i + 1), F.lit(1)).rlike(WORD) & ~m.rlike(INDEX_ONLY)).alias("after"),
            (bare(m) != inner(m)).alias("inner"),
            bare(m).alias("bare"),
        ),
    )
    df = df.withColumn("__each", each)
    put = lambda e, i: F.concat(F.get(rest, i), F.when(e.before, " ").otherwise(""), F.lit("$"), e.bare, F.lit("$"), F.when(e.after, " ").otherwise(""))
    told = lambda name: F.size(F.filter("__each", lambda e: e[name])).cast("long")
    return df.withColumns(
        {
            text_col: F.concat(F.array_join(F.transform("__each", put), ""), F.element_at("__rest", -1)),
            "space_before_inline_math": told("before"),
            "space_after_inline_math": told("after"),
            "inline_math_inner_space": told("inner"),
        }
    ).drop("__rest", "__own", "__each")


def _counted(df: DataFrame, text_col: str, step: tuple[str, str, str]) -> DataFrame:
    name, pattern, to = step
    return df.withColumn(name, F.regexp_count(text_col, F.lit(pattern)).cast("long")).withColumn(text_col, F.regexp_replace(text_col, pattern, to))


def polish(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with the text tidied, one counter for each step, and ``warnings`` about what is left. A null text is empty."""
    df = df.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
    for step in POLISH:
        df = _counted(df, text_col, step)
    # Two formulas that become one lose two signs.
    signs = lambda: F.length(text_col) - F.length(F.replace(text_col, F.lit("$"), F.lit("")))
    df = df.withColumn("__signs", signs()).withColumn(text_col, merged_formulas(F.col(text_col)))
    df = df.withColumn("inline_math_fragments", ((F.col("__signs") - signs()) / 2).cast("long")).drop("__signs")
    df = _counted(df, text_col, CITATION)
    # Each remark gets two backslashes.
    df = df.withColumn(text_col, as_lines(F.col(text_col))).withColumn("__before", F.length(text_col)).withColumn(text_col, escape_remarks_udf(F.col(text_col)))
    df = df.withColumn("literal_square_bracket_escape", ((F.length(text_col) - F.col("__before")) / 2).cast("long")).drop("__before")
    broken, whole = HEADING_TAIL.format(r"-\s*"), HEADING_TAIL.format(r"\s*")
    df = df.withColumn("numbered_heading_body_split", F.regexp_count(text_col, F.lit(whole)).cast("long"))
    df = df.withColumn(text_col, F.regexp_replace(F.regexp_replace(text_col, broken, "$1\n\n$2$3"), whole, "$1\n\n$2 $3"))
    df = _counted(spaced_formulas(df, text_col), text_col, BLANK_LINES)
    found = [(name, F.regexp_count(text_col, F.lit(pattern))) for name, pattern in BAD]
    warnings = F.array_compact(F.array(*[F.when(n > 0, F.concat(F.lit(f"{name}: "), n.cast("string"))) for name, n in found]))
    return df.withColumn("warnings", warnings).withColumn(text_col, F.concat(F.regexp_replace(text_col, r"(?U)^\s+|\s+$", ""), F.lit("\n")))
