"""Extraction-quality counters of Markdown and the risk score made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillion.functions.regex import S, count

#: What each counter looks for, its weight in the risk score, and its cap.
COUNTERS = {
    "control_chars": r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]",
    "mojibake_marks": "â.|Ã.|Â.|ð|Ñ|ă|ĺ|ď|§|¶",
    "replacement_chars": "\ufffd",
    "cid_refs": r"\(cid:\d+\)",
    "boxed_formula_marks": r"\\boxed\s*\{",
    "math_symbols": "[□◇◻⊢⊨→↔¬∧∨∀∃λβηφψΓΣ≤≥≠∈∉⊂⊆⊥]",
    "suspicious_formula_marks": r"(?<![A-Za-z0-9_])6=|ConT p|gp\(|Ñ|ðñ|\(cid:\d+\)|\\boxed\s*\{",
    "long_alpha_runs": "[A-Za-z]{24,}",
}
#: The evaluation summary has no boxes and counts one control character as suspicious.
SUMMARY_SUSPICIOUS = r"(?<![A-Za-z0-9_])6=|ConT p|gp\(|Ñ|ðñ|\x03|\(cid:\d+\)"
WEIGHTS = {"cid_refs": 4, "boxed_formula_marks": 3, "control_chars": 4, "mojibake_marks": 2, "replacement_chars": 4, "suspicious_formula_marks": 2}
CAPS = {"long_alpha_runs": 50, "markdown_table_lines": 100}
HIGH, MEDIUM, MANY_TABLE_LINES = 80, 20, 30


def _lines(text: Column) -> Column:
    return F.split(text, "\r?\n")


def line_counts(text: Column) -> dict[str, Column]:
    lines = _lines(text)
    full = F.filter(lines, lambda x: x.rlike(f"[^{S[1:]}"))
    total = F.aggregate(full, F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    return {
        "chars": F.length(text).cast("long"),
        "lines": F.when(text == "", F.lit(0)).otherwise(F.size(lines)).cast("long"),
        "markdown_table_lines": F.size(F.filter(lines, lambda x: x.rlike(rf"^{S}*\|.*\|{S}*$"))).cast("long"),
        "avg_line_length": F.coalesce(F.floor(total / F.nullif(F.size(full), F.lit(0)) + 0.5), F.lit(0)).cast("long"),
    }


def quality_report(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with 13 numbers, the level of risk and warnings. A null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumns({name: count(text, pattern) for name, pattern in COUNTERS.items()} | line_counts(text))
    score = sum((F.col(n) * w for n, w in WEIGHTS.items()), F.lit(0)) + sum((F.least(F.col(n), F.lit(c)) for n, c in CAPS.items()), F.lit(0))
    said = lambda n, text: F.when(n > 0, F.concat(n.cast("string"), F.lit(text)))
    anomalies = F.col("mojibake_marks") + F.col("replacement_chars")
    warnings = F.array_compact(
        F.array(
            said(F.col("cid_refs"), " PDF CID placeholder(s), often failed math or symbol extraction."),
            said(F.col("boxed_formula_marks"), " \\boxed{...} expression(s); verify modal boxes were not misread as boxing notation."),
            said(F.col("control_chars"), " control character(s), often failed TeX symbol extraction."),
            said(anomalies, " encoding anomaly marker(s)."),
            said(F.col("long_alpha_runs"), " long unspaced alphabetic run(s), often layout or word-boundary loss."),
            F.when(F.col("markdown_table_lines") > MANY_TABLE_LINES, F.concat(F.col("markdown_table_lines").cast("string"), F.lit(" Markdown table-like line(s), often layout fragments in prose PDFs."))),
        )
    )
    df = df.withColumns({"risk_score": score.cast("long"), "warnings": warnings})
    level = F.when(F.col("risk_score") >= HIGH, "high").when(F.col("risk_score") >= MEDIUM, "medium").when(F.size("warnings") > 0, "low").otherwise("ok")
    return df.withColumn("risk_level", level)


def text_summary(df: DataFrame, text_col: str) -> DataFrame:
    """The evaluation harness's counters: no boxes, another pattern for suspicious formulas."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    patterns = {n: p for n, p in COUNTERS.items() if n != "boxed_formula_marks"} | {"suspicious_formula_marks": SUMMARY_SUSPICIOUS}
    return df.withColumns({name: count(text, pattern) for name, pattern in patterns.items()} | line_counts(text))


def readable(text: Column, least: int = 800) -> Column:
    """Whether a conversion has enough characters that are no white space."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"{S}+", "")) >= least
