import pytest

from spindrift.functions.expressions import expression
from spindrift.operators.tables import resolve


@pytest.mark.parametrize(
    ("text", "want"),
    [("a + 2 * b", 8.0), ("(a + 2) * b", 12.0), ("-a ** 2", -4.0), ("2 ** 3 ** 1", 8.0), ("a / 0", None), ("not a > 1 or b == 3", True), ("c in ['x', 'y'] and a % 2 = 0", True), ("max(a, b) - min(a, b)", 1.0), ("sqrt(abs(0 - 9))", 3.0), ("c != \"x\"", False)],
)
def test_values(spark, text, want):
    df = spark.createDataFrame([(2.0, 3.0, "x")], "a double, b double, c string")
    assert df.select(expression(text, df.columns).alias("v")).first().v == want


@pytest.mark.parametrize("text", ["a +", "d", "system('x')", "a; drop", "(a", "a b", "c in []", "", "a.b", "`a`"])
def test_anything_else_raises(spark, text):
    with pytest.raises(ValueError):
        expression(text, ["a", "b", "c"])


def test_column_references(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Aa int, b int, c int")
    assert resolve(df, "aa,3,c2,1-2,last") == ["Aa", "c", "b", "Aa", "b", "c"] and resolve(df, "all") == ["Aa", "b", "c"]
    with pytest.raises(ValueError):
        resolve(df, "nothing")
