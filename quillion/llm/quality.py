"""Quality rules (operator 9): a threshold table compiled into Spark projections, without user functions.

Words are maximal runs of characters other than space and ``\\t``..``\\r``; a
line is a ``\\n``-separated piece that holds a word.

Defined results: a null text counts as empty (no words, so the base rule fails
and it is not kept); ties do not occur; repeated rows are judged one by one
with equal results; an empty table gives an empty table; other columns are
carried by :func:`keep_clean` and ignored by :func:`judge`, and may have any
name. Texts of any length are read whole; the
work for a text is linear in its words, or n log n where windows repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and to a in is that it was for on with as by this be are at from or an he they not".split(),
    "fr": "le la les de des du et un une en que qui dans pour par sur est au aux il elle ou".split(),
    "de": "der die das und in zu den von mit ist des dem ein eine nicht auf als auch es im".split(),
    "es": "el los las del y una con se su al lo como no es por para esta".split(),
}

SPACE = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
BASE_SYMBOLS = "#*$%&|<>"
OWN_SYMBOLS = "!{}~^=_\\"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Reject a text of at least ``min_words`` words whose ``metric`` lies outside [least, most]."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None
    min_words: int = 0


#: The production table. Metrics are those of :func:`_metrics`.
RULES = (
    Rule("mean_word_length", "chars_per_word", least=2.0, most=12.0),
    Rule("symbols", "symbols_per_word", most=0.1),
    Rule("own_symbols", "own_symbols_per_word", most=0.3),
    Rule("stop_words", "stop_word_ratio", least=0.01, min_words=50),
    Rule("repeated_lines", "dup_line_ratio", most=0.5),
    Rule("line_length", "chars_per_line", most=100_000.0),
    Rule("stutter", "adjacent_repeat_ratio", most=0.3),
)


def _occurrences(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _sliced(c: str, start: int, length: Column) -> Column:
    return F.slice(F.col(c), F.lit(start), F.greatest(length, F.lit(0)))


def _with_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds ``__q_`` columns with the base counts. Each step is its own projection, so that nothing is computed twice."""
    stop = sorted({w for ws in STOP_WORDS.values() for x in ws for w in (x, x.capitalize())})
    df = docs.withColumn("__q_t", F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumn("__q_trim", F.btrim("__q_t", F.lit(SPACE)))
    df = df.withColumns(
        {
            "__q_words": F.when(F.col("__q_trim") == "", F.array().cast("array<string>")).otherwise(F.split("__q_trim", SPLIT)),
            "__q_lines": F.filter(F.split("__q_t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""),
            "__q_word_chars": F.length(F.translate("__q_t", SPACE, "")).cast("long"),
            "__q_symbols": _occurrences(F.col("__q_t"), BASE_SYMBOLS).cast("long"),
            "__q_own": _occurrences(F.col("__q_t"), OWN_SYMBOLS).cast("long"),
        }
    ).drop("__q_trim", "__q_t")
    df = df.withColumns(
        {
            "__q_n": F.size("__q_words"),
            "__q_h1": F.transform("__q_words", lambda w: F.xxhash64(w)),
            "__q_stop": F.size(F.filter("__q_words", lambda w: w.isin(stop))),
            "__q_n_lines": F.size("__q_lines"),
            "__q_dup_lines": (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long"),
        }
    ).drop("__q_words", "__q_lines")
    n = F.col("__q_n")
    pair = lambda x, y: F.xxhash64(x, y)
    # Hash of every window of five words: pairs, then pairs of pairs, then one word more.
    df = df.withColumns(
        {
            "__q_h2": F.zip_with(_sliced("__q_h1", 1, n - 1), _sliced("__q_h1", 2, n - 1), pair),
            "__q_adjacent": F.size(F.filter(F.zip_with(_sliced("__q_h1", 1, n - 1), _sliced("__q_h1", 2, n - 1), lambda x, y: x == y), lambda e: e)),
        }
    )
    df = df.withColumn("__q_h4", F.zip_with(_sliced("__q_h2", 1, n - 3), _sliced("__q_h2", 3, n - 3), pair))
    df = df.withColumn("__q_h5", F.zip_with(_sliced("__q_h4", 1, n - 4), _sliced("__q_h1", 5, n - 4), pair)).drop("__q_h1", "__q_h2", "__q_h4")
    # Only texts with a repeated window are sorted.
    df = df.withColumn("__q_sorted", F.when(F.size(F.array_distinct("__q_h5")) < F.size("__q_h5"), F.sort_array(F.transform("__q_h5", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("__q_h5")
    df = df.withColumn("__q_same", F.filter(F.zip_with("__q_sorted", F.slice("__q_sorted", F.lit(2), F.size("__q_sorted")), lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i))), lambda p: p.isNotNull())).drop("__q_sorted")
    df = df.withColumn("__q_starts", F.sort_array(F.array_distinct(F.flatten("__q_same")))).drop("__q_same")
    gaps = F.zip_with("__q_starts", F.slice("__q_starts", F.lit(2), F.size("__q_starts")), lambda a, b: F.coalesce(F.least(F.lit(WINDOW), b - a), F.lit(WINDOW)))
    return df.withColumn("__q_repeat", F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long"))).drop("__q_starts")


def _metrics() -> dict[str, Column]:
    words = F.greatest(F.col("__q_n"), F.lit(1))
    lines = F.greatest(F.col("__q_n_lines"), F.lit(1))
    return {
        "chars_per_word": F.col("__q_word_chars") / words,
        "symbols_per_word": F.col("__q_symbols") / words,
        "own_symbols_per_word": F.col("__q_own") / words,
        "stop_word_ratio": F.col("__q_stop") / words,
        "dup_line_ratio": F.col("__q_dup_lines") / lines,
        "chars_per_line": F.col("__q_word_chars") / lines,
        "adjacent_repeat_ratio": F.col("__q_adjacent") / words,
    }


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a text breaks, as one array expression over the counts."""
    metrics = _metrics()
    checks = []
    for r in rules:
        outside = F.lit(False)
        if r.least is not None:
            outside = outside | (metrics[r.metric] < r.least)
        if r.most is not None:
            outside = outside | (metrics[r.metric] > r.most)
        checks.append(F.when(outside & (F.col("__q_n") >= r.min_words), F.lit(r.name)))
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def base_failed() -> Column:
    return (F.col("__q_n") < 10) | (100 * F.col("__q_repeat") > 20 * F.col("__q_n"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, broken rules and verdict of every row."""
    df = _with_counts(docs.select(F.col(f"`{id_col}`").alias("__q_id"), F.col(f"`{text_col}`").alias("__q_text")), "__q_text")
    df = df.withColumns({"__q_base": base_failed(), "__q_broken": compile_rules(rules)})
    return df.select(
        F.col("__q_id").alias(id_col),
        F.col("__q_n").cast("long").alias("n_words"),
        F.col("__q_word_chars").alias("word_chars"),
        F.col("__q_symbols").alias("n_symbols"),
        F.col("__q_dup_lines").alias("n_dup_lines"),
        F.col("__q_repeat").alias("n_repeat_words"),
        F.col("__q_base").alias("base_failed"),
        (~F.col("__q_base") & (F.size("__q_broken") == 0)).alias("kept"),
        F.col("__q_broken").alias("broken_rules"),
    )


def keep_clean(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that pass the base rule and the table, with their own columns only.

    Spark pushes filters below projections, where all counts would be computed
    again for each use in the condition. It pushes none below a column that is
    not deterministic, so the verdict is asked together with the task's number,
    which is never negative.
    """
    # The row's own columns stand in one struct, so that none clashes with the counts.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__q_row"), F.col(f"`{text_col}`").alias("__q_text"))
    df = _with_counts(rows, "__q_text").drop("__q_text").withColumn("__q_kept", ~base_failed() & (F.size(compile_rules(rules)) == 0))
    return df.withColumn("__q_task", F.spark_partition_id()).where("__q_kept and __q_task >= 0").select("__q_row.*")
