import datetime as dt
from decimal import Decimal

import pytest
from conftest import day
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabweave.functions import scalar as s
from tabweave.functions.checksum import checksum_valid, register_case_function


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


L = F.lit


@pytest.mark.parametrize(
    "build,expected",
    [
        (lambda: s.divide(1.0, 0.0), None),
        (lambda: s.divide(1.0, 0.0, -1.0), -1.0),
        (lambda: s.divide(1.0, None), None),
        (lambda: s.if_(L(None).cast("boolean"), 1, 2), 2),
        (lambda: s.switch(L("b"), "a", 1, "b", 2), 2),
        (lambda: s.switch(L("z"), "a", 1, "b", 2), None),
        (lambda: s.switch(L("z"), "a", 1, 9), 9),
        (lambda: s.switch_true(L(False), 1, L(True), 2, 3), 2),
        (lambda: s.is_blank(s.blank()), True),
        (lambda: s.is_number(L("1e3")), True),
        (lambda: s.is_number(L("1a")), False),
        (lambda: s.is_number(L(None).cast("string")), False),
        (lambda: s.is_logical(L("TRUE")), True),
        (lambda: s.is_text(L("abc")), True),
        (lambda: s.is_text(L("12")), False),
        (lambda: s.if_error(s.safe_cast(L("x"), "int"), 5), 5),
        (lambda: s.safe_cast(L("99999999999"), "int"), None),
        (lambda: s.safe_cast(L("2001-02-30"), "date"), None),
        (lambda: s.int_floor(L(-1.5)), -2),
        (lambda: s.mod(L(-7), 3), -1),
        (lambda: s.mod(L(7), 0), None),
        (lambda: s.round_up(L(-1.21), 1), -1.3),
        (lambda: s.round_down(L(-1.29), 1), -1.2),
        (lambda: s.mid(L("abcdef"), 2, 3), "bcd"),
        (lambda: s.substitute(L("a.b.c"), ".", ""), "abc"),
        (lambda: s.concatenate("a", None), None),
        (lambda: s.format_number(L(1234.5)), "1234.50"),
        (lambda: s.value(L("12.5")), Decimal("12.5000000000")),
        (lambda: s.value(L("twelve")), None),
        (lambda: s.find("b", L("aBb")), 3),
        (lambda: s.search("B", L("abb")), 2),
        (lambda: s.find("z", L("abb")), 0),
        (lambda: s.file_name(L("batch_0/file.csv")), "file.csv"),
        (lambda: s.today("2001-02-03"), day("2001-02-03")),
        (lambda: s.now() >= s.today(), True),
        (lambda: s.weekday(L("2001-01-07").cast("date")), 1),
        (lambda: s.edate(L("2001-01-31").cast("date"), 1), day("2001-02-28")),
        (lambda: s.eomonth(L("2000-01-31").cast("date"), 1), day("2000-02-29")),
        (lambda: s.date(2000, 2, 29), day("2000-02-29")),
        (lambda: s.time(1, 2, 3), dt.time(1, 2, 3)),
        (lambda: s.datediff("month", L("2001-01-31").cast("date"), L("2001-02-01").cast("date")), 1),
        (lambda: s.datediff("year", L("2000-12-31").cast("date"), L("2001-01-01").cast("date")), 1),
        (lambda: s.datediff("quarter", L("2001-03-31").cast("date"), L("2001-04-01").cast("date")), 1),
        (lambda: s.datediff("day", L("2001-03-01").cast("date"), L("2001-02-28").cast("date")), -1),
        (lambda: s.datediff("week", L("2001-01-07").cast("date"), L("2001-01-08").cast("date")), 1),
        (lambda: s.datediff("hour", L("2001-01-07 00:59").cast("timestamp"), L("2001-01-07 01:00").cast("timestamp")), 1),
        (lambda: s.from_units(s.to_units(L(0.29)) * 3), 0.87),
    ],
)
def test_function(spark, build, expected):
    assert one(spark, build()) == expected


def reference_checksum(text):
    digits = [int(c) for c in text or "" if c in "0123456789"]
    total = sum(d if i % 2 == 0 else 2 * d - 9 * (2 * d > 9) for i, d in enumerate(digits))
    return bool(digits) and total % 10 == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123456789-x ", max_size=20) | st.none(), min_size=20, max_size=40))
def test_checksum(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(checksum_valid(F.col("t"))).collect()] == [reference_checksum(t) for t in texts]


def test_case_function(spark):
    register_case_function(spark, "grade", "CASE WHEN x > 5 THEN 'high' ELSE 'low' END", "x INT")
    assert [r[0] for r in spark.sql("SELECT grade(6), grade(1)").collect()[0:1]] == ["high"]


def test_safe_cast_takes_what_spark_takes(spark):
    texts = ["NaN", "-Infinity", "inf", "1e3", " 7 ", "x", "", None, "2024", "2024-02", "yes", "T ", "0"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for kind in ("double", "int", "date", "timestamp", "boolean", "decimal(10,2)"):
        pairs = df.select(s.safe_cast(F.col("t"), kind).alias("a"), F.col("t").try_cast(kind).alias("b"))
        assert pairs.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0, kind


def test_rounding_and_units(spark):
    one = spark.range(1)
    got = one.select(s.round_up(F.lit(0.07), 2), s.round_down(F.lit(0.29), 2), s.round_up(F.lit(-1.21), 1), s.to_units(F.lit(0.29))).first()
    assert tuple(got) == (0.07, 0.29, -1.3, 29)
    sizes = spark.createDataFrame([(1e17,), (1e-14,), (-1e300,), (3.3000000000000003,), (2.675,), (None,), (1234.0,), (0.0,)], "x double")
    up, down = ([r[0] for r in sizes.select(f(F.col("x"), n)).collect()] for f, n in ((s.round_up, 2), (s.round_down, -2)))
    assert up == [1e17, 0.01, -1e300, 3.3, 2.68, None, 1234.0, 0.0] and down == [1e17, 0.0, -1e300, 0.0, 0.0, None, 1200.0, 0.0]
    large = spark.range(0, 1000, 1, 7).select((F.lit(9_007_199_254_740.99) * 100).cast("bigint").alias("u"))
    assert large.agg(F.sum("u")).first()[0] == 1000 * 900719925474099
