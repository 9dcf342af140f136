import math

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions.codecs import NoTypeError, codec
from quillstone.functions.domain import parse_unit


def cleaned(spark, kind, texts, **options):
    k = codec(kind, **options)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", k.clean(F.col("t")).alias("v"), k.bad(F.col("t")).alias("bad")).orderBy("i").collect()
    return [r["v"] for r in rows], [r["bad"] for r in rows]


@pytest.mark.parametrize(
    ("kind", "texts", "values", "bad"),
    [
        ("Boolean", ["true", "FALSE", "1", "0.0", "", None, "yes", "nan"], [True, False, True, False, None, None, None, None], [0, 0, 0, 0, 0, 0, 1, 0]),
        ("Integer", ["3", "4.0", "4.5", "x", "", "-7"], [3, 4, None, None, None, -7], [0, 0, 1, 1, 0, 0]),
        ("Integer", ["9223372036854775807", "9223372036854775808"], [9223372036854775807, None], [0, 1]),
        ("Time", ["1:02", "23:59:59", "24:00", "0.5", ""], [3720, 86399, None, 43200, None], [0, 0, 1, 0, 0]),
        ("List", ["a, b", '"x, y", "say \\"z\\""', "", 'a "b'], [["a", "b"], ["x, y", 'say "z"'], [], None], [0, 0, 0, 1]),
        ("PubMedIds", ["1, 2", "x"], [[1, 2], None], [0, 1]),
        ("Array", ["[1, 2.5]", "[]", "{", "3"], [[1.0, 2.5], [], None, None], [0, 0, 1, 1]),
    ],
)
def test_clean(spark, kind, texts, values, bad):
    got, wrong = cleaned(spark, kind, texts)
    assert got == values
    assert [int(b) for b in wrong] == bad


def test_float_blank_is_nan(spark):
    got, bad = cleaned(spark, "Float", ["1.5", "", None, "nan", "x"])
    assert got[0] == 1.5 and all(math.isnan(v) for v in got[1:4]) and got[4] is None
    assert bad == [False, False, False, False, True]


def test_dates(spark):
    got, bad = cleaned(spark, "Date", ["2020-02-03", "43864", "2020-02-03 00:00:00", "2020-02-03 01:00:00", "1"])
    assert [str(v) for v in got] == ["2020-02-03", "2020-02-04", "2020-02-03", "None", "1900-01-01"]
    assert bad == [False, False, False, True, False]


def test_enum_by_name_and_value(spark):
    assert cleaned(spark, "Enum", ["b", "1", "3", ""], choices=["a", "b"], default="a") == (["b", "a", None, "a"], [False, False, True, False])


def test_range(spark):
    got, bad = cleaned(spark, "Range", ["1 - 2", "3", "0", "1e-3-2", "x"])
    assert [None if v is None else (v["min"], v["max"]) for v in got] == [(1, 2), (3, 3), (0, 0), (1e-3, 2), None]
    assert bad[-1]


def test_reaction(spark):
    got, bad = cleaned(spark, "chem.ReactionEquation", ["[c]: a + (2) b <=> d", "a[c] <=> a[e]", "[c]: a + a <=> d", "<=> "])
    assert [(p["species"], p["compartment"], p["stoichiometry"]) for p in got[0]] == [("a", "c", -1), ("b", "c", -2), ("d", "c", 1)]
    assert [(p["compartment"], p["stoichiometry"]) for p in got[1]] == [("c", -1), ("e", 1)]
    assert bad == [False, False, True, False]


def test_formula_round_trip(spark):
    k = codec("ChemicalFormula")
    row = spark.createDataFrame([("C6H12O6",), ("H2OH",)], "t string").select(k.serialize(k.clean(F.col("t"))).alias("s")).collect()
    assert [r["s"] for r in row] == ["C6H12O6", "H3O"]


def test_sequences(spark):
    df = spark.createDataFrame([("ACGT",), ("ACGX",), ("",)], "t string")
    (_, bad) = codec("DnaSeq").checks(F.col("t"))[-1]
    assert [r[0] for r in df.select(bad).collect()] == [False, True, False]


@pytest.mark.parametrize(("text", "scale", "dims"), [("m", 1.0, "m1"), ("mmol / l", 1.0, "m-3 mol1"), ("g m^-3", 1.0, "g1 m-3"), ("ms", 1e-3, "s1"), ("furlong", None, None)])
def test_units(text, scale, dims):
    got = parse_unit(text)
    assert got is None if scale is None else got[1] == dims and math.isclose(got[0], scale)


def test_float_tolerance_is_relative_to_the_left(spark):
    df = spark.createDataFrame([(1.0, 1.05), (0.0, 0.05), (0.0, 0.2), (float("nan"), float("nan")), (1.0, float("nan"))], "a double, b double")
    assert [r[0] for r in df.select(codec("Float").equal(F.col("a"), F.col("b"), 0.1)).collect()] == [True, True, False, True, False]


def test_slugs(spark):
    df = spark.createDataFrame([("2abc",), ("123",), ("0x1f",), ("1e5",), ("a-b",), ("",)], "t string")
    assert [r[0] for r in df.select(codec("Slug").checks(F.col("t"))[0][1]).collect()] == [False, True, True, True, True, True]


def test_natural_order(spark):
    df = spark.createDataFrame([("b10",), ("B9",), ("a2",), ("a010",)], "t string")
    assert [r[0] for r in df.orderBy(T.natural_key(F.col("t"))).collect()] == ["a2", "a010", "B9", "b10"]


def test_lists_round_trip(spark):
    items = [["a", 'b "c"', "d; e", " f "], [], ["x"]]
    df = spark.createDataFrame([(i,) for i in items], "v array<string>")
    for sep in (",", ";"):
        got = [r[0] for r in df.select(T.split_list(T.join_list(F.col("v"), sep), sep)).collect()]
        assert got == items


def test_no_such_type():
    with pytest.raises(NoTypeError):
        codec("Nothing")
