import math

import pytest
from pyspark.sql import functions as F

from quillstone.functions.expressions import ExpressionError, coefficients, compile_column, evaluate, parse, rewrite

KNOWN = {"P": ["a", "b", "x[c]"], "Q": ["b", "d"]}


def test_terms():
    p = parse("2 * a + x[c] - Q.b * max(d, 1)", KNOWN)
    assert p.terms == [("P", "a"), ("P", "x[c]"), ("Q", "b"), ("Q", "d")] and p.calls == ["max"]
    assert rewrite(p, lambda m, i: f"{m}.{i}") == "2 * P.a + P.x[c] - Q.b * max ( Q.d , 1 )"


@pytest.mark.parametrize("text", ["b + 1", "unknown", "a +", "__import__('os')", "a; a", "x [c]", "eval(a)", "'s'"])
def test_errors(text):
    with pytest.raises(ExpressionError):
        parse(text, KNOWN)


@pytest.mark.parametrize(("text", "want"), [("2 * a - 3 * d + a", {"a": 3.0, "d": -3.0}), ("a * 2", None), ("a + 1", None), ("a * d", None), ("a / 2", None), ("-(a - 2 * d)", {"a": -1.0, "d": 2.0}), ("2 * (a + d)", {"a": 2.0, "d": 2.0}), ("exp(a)", None)])
def test_linear(text, want):
    got = coefficients(parse(text, KNOWN))
    assert (got and {i: c for (_, i), c in got.items()}) == want


@pytest.mark.parametrize("text", ["a + 2 * d", "pow(a, 2) / d", "round(a / 2)", "a // d + a % d", "max(a, d, 7) - min(a, d)", "sqrt(a) + log(d) + exp(1)", "a < d and d > 1", "-a ** 2", "hypot(a, d) * degrees(1)", "factorial(4) + ceil(a) - floor(d)"])
def test_engine_and_driver_agree(spark, text):
    p = parse(text, KNOWN)
    values = {("P", "a"): 5.0, ("Q", "d"): 3.0}
    want = evaluate(p, values)
    got = spark.range(1).select(compile_column(p, [F.lit(values[t]) for t in p.terms])).first()[0]
    assert math.isclose(float(got), float(want))


def test_domain_errors(spark):
    from pyspark.errors import PySparkException

    for text in ("sqrt(0 - a)", "log(a - a)", "a / (a - a)"):
        p = parse(text, KNOWN)
        with pytest.raises(PySparkException):
            spark.range(1).select(compile_column(p, [F.lit(2.0) + F.col("id")] * len(p.terms))).collect()


def test_nested(spark):
    from quillstone.functions.expressions import compile_nested

    known = {"P": ["a"], "F": ["f", "g"]}
    made = compile_nested({("F", "g"): "f + 1", ("F", "f"): "2 * a"}, known, {("P", "a"): F.lit(3.0)})
    assert spark.range(1).select(made["F", "g"]).first()[0] == 7.0
    with pytest.raises(ExpressionError):
        compile_nested({("F", "g"): "f", ("F", "f"): "g"}, known, {})
