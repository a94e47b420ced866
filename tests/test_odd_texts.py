"""Queries against their SQL on a few odd documents."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers the queries)
from quillion.plans import registry


def differences(spark, folder, name: str, texts: list[str], first: int = 0) -> list[tuple]:
    """Rows that only one of the two forms has."""
    docs = [(first + i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
    pq.write_table(pa.table(dict(zip(("doc_id", "text", "lang", "source", "n_chars"), map(list, zip(*docs)), strict=True))), folder / "documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as from '{folder}/documents.parquet'")
    want = c.sql(registry.ORACLE[name])
    got = registry.QUERIES[name](spark, str(folder)).select(*want.columns)
    have, asked = {str(tuple(r)) for r in got.collect()}, {str(r) for r in want.fetchall()}
    assert asked
    return sorted(have ^ asked)


def test_loose_json_of_texts_with_quotes_and_backslashes(spark, tmp_path):
    assert not differences(spark, tmp_path, "n2_loose_json", ['he said "so", then', "a\\b", 'c\\"d', "plain\ttext"])


def test_no_word_before_a_line_end_at_the_position(spark, tmp_path):
    assert not differences(spark, tmp_path, "f9_word_at", ["a", "b", "c", "d", "e", "f", "words\nafter", "seven\nseven", "words\r\nafter", "nine", "ten", "eleven words\r", "letters"])


def test_capitals_are_those_of_the_sql(spark):
    from quillion.functions import text

    letters = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i <= 0xDFFF]
    whole = "".join(letters)
    got = spark.createDataFrame([(whole,)], "x string").select(text.upper(F.col("x"))).head()[0]
    assert got == duckdb.connect().execute("select upper(?)", [whole]).fetchone()[0]


@pytest.mark.parametrize("name", ["k1_k2_k3_notes", "s8_s9_parse_notes", "t6_j9_glossary_index"])
def test_terms_that_begin_with_letters_without_a_plain_capital(spark, tmp_path, name):
    assert not differences(spark, tmp_path, name, ["ßheit und", "Heit was", "ßheit, so", "ÿes it", "heit it", " led by", "éa b", ""])


def test_a_numbered_heading_of_120_letters_with_sharp_s(spark, tmp_path):
    """Line 28 of the view has a number in front of the text's and is in capitals."""
    assert not differences(spark, tmp_path, "p8_p9_headings", ["x\n" * 25 + "Der " + "ß" * n + "a" * (113 - n) for n in (0, 1, 2)])


def test_of_contexts_that_tie_the_earlier_find_comes_first(spark):
    """Of two paragraphs with a find each both contexts begin with the first; the SQL leaves open which is kept."""
    from quillion.operators import paragraphs, terms

    docs = spark.createDataFrame([(i, "Here is the first of them.\n\nHere is the second of them.") for i in range(40)], "doc_id long, markdown string")
    asked = docs.selectExpr("doc_id", "'here' as term", "cast(array() as array<string>) as aliases")
    apart = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(apart, "false")  # the two come from different tasks, in any order
    try:
        found = terms.clusters(docs, paragraphs.paragraphs(docs), asked, most=1).collect()
    finally:
        spark.conf.unset(apart)
    assert [r.label for r in found] == ["Paragraphs 0-1"] * 40
