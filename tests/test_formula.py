"""Literal cases of formula detection and conversion."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quillion.functions import formula


@pytest.fixture(scope="module")
def of(spark):
    return lambda fn, value: spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("α₁ → β²", r"\alpha _{1} \to \beta ^{2}"),
        ("α = β", r"\alpha = \beta"),
        ("x₁₂ᵢ yᵢ²", "x _{12i} y ^{i2}"),
        ("iffPr(E | H1 & K) > Pr(E | H2 & K)", r"iff \operatorname{Pr}(E | H_{1} \& K) > \operatorname{Pr}(E | H_{2} \& K)"),
        ("∑x + ∫y ≥ z ∴ H1 ‡", r"\sum x + \int y \geq z \therefore H_{1} \ddagger"),
        ("√ 2", r"\sqrt{2}"),
        ("{x²}", r"{x ^{2}}"),
        ("x² }", r"x ^{2}}"),
        ("a₁² b²₁ {cᵢ₂} ⁿ", r"a _{1} ^{2} b ^{2} _{1} {c ^{i} _{2}} ^{n}"),
    ],
)
def test_latex(of, text, want):
    assert of(formula.to_latex, text) == want


def test_rendering(of):
    assert of(formula.render, "α = β") == r"$\alpha = \beta$"
    assert of(formula.render, "[") == "["
    assert of(lambda c: formula.render(c, display=True), "α") == "$$\n\\alpha\n$$"


@pytest.mark.parametrize(
    ("text", "want"),
    [("α = β + 1", True), ("□p → ◇q", True), ("f(x)", True), ("Ἀριστοτέλης εἶπε τὸ ζῷον πολιτικόν", False), ("Überzeugung café العربية", False), ("Nicod’s (3) is a charitable reconstruction", False), ("precisifications/reconstructions", False), ("•", False), ("", False)],
)
def test_detection(of, text, want):
    assert of(formula.is_likely_math, text) is want


def test_formulas_after_the_30th_character(spark, tmp_path):
    line = "aaaaaaaaaa bbbbbbbbbb cccccccccc " + " ".join(["α=β"] * 12)
    spark.createDataFrame([(0, line)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    latex = __spark_entry__.queries()["f22_f24_latex"](spark, str(tmp_path)).first()
    assert latex.inline.count(r"\alpha") == latex.display.count(r"\beta") == 12
    assert __spark_entry__.queries()["f27_f28_display_lines"](spark, str(tmp_path)).first().formula
