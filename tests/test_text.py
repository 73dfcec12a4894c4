import math

import pytest
from pyspark.sql import functions as F

from fleetspan.functions import text


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_keys(spark):
    given = [" .x", "a.b", "", None, "\t  ab.c  \n", "AB", "a b . c"]
    assert column(spark, given, text.normalize_key("c", strip_domain=True)) == [None, "A", None, None, "AB", "AB", "A B "]
    assert column(spark, given, text.normalize_key("c")) == [".X", "A.B", None, None, "AB.C", "AB", "A B . C"]


def test_strip_equals_python(spark):
    odd = [chr(c) + "x" + chr(c) for c in range(1, 0x3001) if chr(c).isspace()]
    assert column(spark, odd, text.strip("c")) == [o.strip() for o in odd]


def test_first_segment(spark):
    assert column(spark, ["A, B", ",B", "A ,B,C", None, "A"], text.first_segment("c")) == ["A", "", "A", None, "A"]


def test_numbers(spark):
    given = ["12d", "1,2", " 3 ", "1e3", "$4", "", "inf", "n/a", None, "-.5", "7."]
    assert column(spark, given, text.to_double("c")) == [
        None, None, 3.0, 1000.0, None, None, math.inf, None, None, -0.5, 7.0,
    ]


def test_dates(spark):
    given = ["2025-01-02", "01/02/2025", "x", None, " 2024-02-29 ", "2023-02-29"]
    assert [str(d) if d else None for d in column(spark, given, text.to_date("c"))] == [
        "2025-01-02", None, None, None, "2024-02-29", None,
    ]
    assert str(column(spark, ["31.12.2024"], text.to_date("c", "dd.MM.yyyy"))[0]) == "2024-12-31"


def test_source_label(spark):
    assert column(spark, [None, "", " ", "NAN", " X "], text.source_label("c")) == ["NA", "NA", "NA", "NA", "X"]


def test_null_tokens_and_not_in(spark):
    df = spark.createDataFrame([("NA", 1), ("n/a", 2), (None, 3), ("x", 4)], "c string, n int")
    assert [r.c for r in text.null_tokens(df).orderBy("n").collect()] == [None, None, None, "x"]
    assert [r.n for r in df.filter(text.not_in("c", ["x"])).orderBy("n").collect()] == [1, 2, 3]


def test_columns(spark):
    df = spark.createDataFrame([(1, 2)], "`Device?` int, `Site Code` int")
    assert text.snake_columns(df).columns == ["device", "site_code"]
    with pytest.raises(ValueError, match="collide"):
        text.snake_columns(df.toDF("A b", "a-B"))
    assert text.to_snake(" ?? ") == "col"
    assert text.with_optional(df, {"x": "double"}).dtypes[-1] == ("x", "double")
    with pytest.raises(ValueError, match="lacks"):
        text.require_columns(df, ["nope"], "frame")
    assert df.select(F.col("`Device?`")).first()[0] == 1
