"""Model answers and YAML values: JSON that is nearly right, array fields, scalars, model names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillion.functions.regex import S, trim

#: A string of JSON up to the quote that ends it, which is the first before a comma, colon, closing bracket or the end.
STRING = rf'(?s)"((?:\\(?:.|\z)|[^"\\]++|"(?!{S}*(?:[,}}\]:]|\z)))*+)(?:"|\z)'
#: A quote inside a string that no backslash escapes.
BARE = r'(?<!\\)((?:\\\\)*)"'
#: Beginnings of one provider's model names.
MODEL = "^(gpt-|o1-|o3-|o4-)"
NUMBER = r"^-?\d+(\.\d+)?$"


def bare_quotes_escaped(c: Column) -> Column:
    """JSON text with a backslash before every quote that stands inside a string."""
    between, inside = F.split(c, STRING, -1), F.regexp_extract_all(c, F.lit(STRING), F.lit(1))
    whole = F.regexp_extract_all(c, F.lit(STRING), F.lit(0))
    put = F.transform(inside, lambda x, i: F.concat(F.get(between, i), F.lit('"'), F.regexp_replace(x, BARE, r'$1\\"'), F.when(F.length(F.get(whole, i)) > F.length(x) + 1, '"').otherwise("")))
    return F.concat(F.array_join(put, ""), F.element_at(between, -1))


def loose_json(c: Column) -> Column:
    """``c`` where it is JSON, else with its bare quotes escaped where that is, else null."""
    repaired = bare_quotes_escaped(c)
    return F.when(F.try_parse_json(c).isNotNull(), c).when(F.try_parse_json(repaired).isNotNull(), repaired)


def array_field(json: Column, name: str) -> Column:
    """The JSON text of an answer's array: the answer itself, its field, or either written as a string; null where there is none."""
    of = lambda x: F.get_json_object(x, f"$.{name}")
    value = of(json)
    loose = F.coalesce(loose_json(trim(value)), value)
    found = F.when(json.rlike(rf"^{S}*\["), json).when(loose.rlike(rf"^{S}*\["), loose).when(loose.rlike(rf"^{S}*\{{"), of(loose))
    return F.when(found.rlike(rf"^{S}*\["), found)


def yaml_scalar(c: Column) -> Column:
    """(kind, value) of a YAML value: true and false, numbers, JSON (kept as text), or plain text without the quotes around it."""
    t = trim(F.coalesce(c, F.lit("")))
    json = t.rlike(r'^[\[{"]')
    kind = F.when(t.isin("true", "false"), "boolean").when(t.rlike(NUMBER), "number").when(json & F.try_parse_json(t).isNotNull(), "json").otherwise("text")
    value = F.when(json & (kind == "text"), F.regexp_replace(t, '^"|"$', "")).otherwise(t)
    return F.struct(kind.alias("kind"), value.alias("value"))


def is_openai_model(c: Column) -> Column:
    return trim(F.coalesce(c, F.lit(""))).rlike(MODEL)
