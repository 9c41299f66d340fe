import pytest
from pyspark.sql import functions as F

from gridloom.plans.expression import Correction, ExpressionError, parse, simplify, to_text, without_undefined

FULL = "(S - BG_o * BG_s) / (FG_f * FG_s) + FG_o"


def test_undefined_names_vanish(spark):
    assert Correction(FULL).current == "S"
    assert Correction(FULL, {"BG_o": F.lit(1.0)}).current == "(S - BG_o)"
    assert Correction(FULL, {"FG_f": F.lit(1.0), "FG_o": F.lit(0.0)}).current == "((S / FG_f) + FG_o)"
    assert Correction(FULL, {"BG_o": F.lit(1.0)}).cleared().current == "S"


@pytest.mark.parametrize("text, short", [("S*1 + 0", "S"), ("0 - S", "-S"), ("S * 0 + 2^3", "8"), ("(2+3)*S", "(5 * S)"), ("S^1", "S"), ("+S", "S"), ("0/S + S", "S"), ("-(-2)*S", "(2 * S)"), ("S .* BG_s", "S")])
def test_simplify(text, short):
    assert to_text(without_undefined(simplify(parse(text)), set())) == short


@pytest.mark.parametrize("text", ["", "S +", "T * S", "BG_o + 1", "S.real", "abs(S)", "S if S else 1", "'a' + S", "S % 2", "not S", "[S]", "S == 1", "True * S", "__import__('os')"])
def test_refused(text):
    with pytest.raises(ExpressionError):
        Correction(text)


def test_undefined_can_be_an_error(spark):
    with pytest.raises(ExpressionError):
        Correction(FULL).column(F.col("S"), remove_undefined=False)
    with pytest.raises(ExpressionError):
        Correction("S", {"other": F.lit(1)})


def test_values_and_division_by_zero(spark):
    df = spark.createDataFrame([(3.0, 1.0, 2.0), (3.0, 1.0, 0.0)], "S double, b double, f double")
    c = Correction(FULL).with_surface("BG_o", F.col("b")).with_surface("FG_f", F.col("f"))
    assert [r.c for r in df.select(c.column(F.col("S")).alias("c")).collect()] == [1.0, None]


@pytest.mark.parametrize("text", ["S*(0-8)^(1/3)", "S+0^(0-1)", "S*9^9^9^9", "S + 1e999 * (1e308 ^ 2)", "S" + "+(" * 300 + "1" + ")" * 300])
def test_numbers_that_cannot_be_folded(text):
    with pytest.raises(ExpressionError):
        Correction(text).current


@pytest.mark.parametrize(
    "text, value",
    [("2^3^2", 64), ("2^(3^2)", 512), ("2^-1^2", 0.25), ("(2^3)^2", 64), ("2^3^2^0.5", 8), ("2^(1+1)^2", 16), ("-2^2", -4), ("2.^3.^2*1", 64), ("2^(3)^2", 64), ("4^3^2/2", 2048)],
)
def test_powers_from_the_left(text, value):
    assert simplify(parse(text, ())).value == value if not text.startswith("-") else to_text(simplify(parse(text, ()))) == "-4"
