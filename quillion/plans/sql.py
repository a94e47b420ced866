"""DuckDB forms of the scalar functions, for the oracles; fixtures that both engines can read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The white space of quillion.functions.regex, for RE2.
SPACES = r" \t\n\x0B\f\r\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
S = f"[{SPACES}]"


def quoted(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(quoted, v)) + "]"
    return "'" + str(v).replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    """``(values ...) t(columns)`` of literal rows."""
    return "(values " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") t({columns})"


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def replaced(x: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(to)}, 'g')"
    return x


def trimmed(x: str) -> str:
    return replaced(x, (f"^{S}+|{S}+$", ""))


def strip_markdown(x: str) -> str:
    x = replaced(f"coalesce({x}, '')", (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]", r"\1"), (r"`([^`]*)`", r"\1"), (r"[*_~=#>]", " "), (f"{S}+", " "))
    return trimmed(x)


def normalize_term(x: str) -> str:
    """Canonical accents only: DuckDB has no compatibility decomposition."""
    x = replaced(f"strip_accents({strip_markdown(x)})", ("[“”]", '"'), ("[‘’]", "'"), (r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""), (f"{S}+", " "))
    return trimmed(f"lower({x})")


def slugify(x: str, fallback: str = "item") -> str:
    slug = replaced(normalize_term(x), ("&", " and "), ("[^a-z0-9]+", "-"), ("^-+|-+$", ""))
    return f"coalesce(nullif(substr({slug}, 1, 80), ''), {quoted(fallback)})"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {quoted(pattern)}))::bigint"
