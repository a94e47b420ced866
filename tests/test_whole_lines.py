"""Queries without an oracle read whole lines."""

import pytest

import __spark_entry__


@pytest.mark.parametrize("name", ["t8_reference_entries", "k17_references", "a23_p15_inline_markers"])
def test_line_ends_are_read(spark, tmp_path, name):
    long = "Reference words that go on and on, " * 4
    text = "\n".join(f"{long}end{i}" for i in range(14))
    spark.createDataFrame([(0, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = __spark_entry__.queries()[name](spark, str(tmp_path)).collect()
    if name == "a23_p15_inline_markers":
        assert max(r.k for r in rows) > 29  # the words of a whole line
    else:
        assert all(f"end{i}" in str(rows) for i in range(8, 14))  # the first entry starts at line 8
