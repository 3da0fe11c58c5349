import datetime as dt
import random
import statistics

import pytest
from conftest import day, rows
from pyspark.sql import functions as F

from tabweave.plans import measures as m
from tabweave.plans import timeintel as ti


def daily(spark, *pairs):
    return spark.createDataFrame([(day(d), v) for d, v in pairs], "date date, value double")


def values(df, column):
    return {str(r["date"]): r[column] for r in df.collect()}


def test_default_spine(spark):
    spine = ti.date_spine(spark)
    first, last = spine.orderBy("date_key").first(), spine.orderBy(F.desc("date_key")).first()
    assert spine.count() == 18263
    assert tuple(first) == (day("2000-01-01"), 2000, 1, 7, day("2000-01-01"), day("2000-01-01"), day("2000-01-01"), day("2000-01-31"))
    assert last["date_key"] == day("2049-12-31")


def test_same_period_last_year_with_gap_and_leap_day(spark):
    df = daily(spark, ("1999-02-28", 1.0), ("1999-03-01", 2.0), ("2000-02-28", 3.0), ("2000-02-29", 4.0), ("2000-03-02", 5.0))
    out = values(ti.same_period_last_year(df, "value"), "last_year")
    assert out["2000-02-28"] == 1.0 and out["2000-02-29"] == 1.0
    assert out["2000-03-02"] is None
    assert ti.same_period_last_year(df, "value").count() == 5


def test_shift_clamps_month_end(spark):
    df = daily(spark, ("2001-01-31", 1.0), ("2001-02-28", 2.0))
    out = values(ti.date_shift(df, "value", 1, "month"), "shifted")
    assert out["2001-01-31"] == 2.0


def test_month_increments_sum_to_the_month(spark):
    df = daily(spark, *[(f"2001-01-{d:02d}", float(d)) for d in range(1, 32) if d != 15])
    out = values(ti.total_to_date(df, "value", "month", out="mtd"), "mtd")
    assert out["2001-01-31"] == sum(range(1, 32)) - 15
    assert out["2001-01-16"] == sum(range(1, 17)) - 15


def test_to_date_restarts_per_key_and_period(spark):
    df = daily(spark, ("2000-12-31", 1.0), ("2001-01-01", 2.0), ("2001-04-01", 4.0)).withColumn("k", F.lit("a"))
    df = df.unionByName(df.withColumn("k", F.lit(None).cast("string")))
    ytd = ti.total_to_date(df, "value", "year", ["k"], out="ytd")
    qtd = ti.total_to_date(df, "value", "quarter", ["k"], out="qtd")
    assert values(ytd.where("k = 'a'"), "ytd") == {"2000-12-31": 1.0, "2001-01-01": 2.0, "2001-04-01": 6.0}
    assert values(qtd.where("k is null"), "qtd")["2001-04-01"] == 4.0


@pytest.mark.parametrize("unit,n,expected", [("day", 2, 6.0), ("month", 1, 6.0), ("month", 2, 7.0), ("week", 1, 6.0)])
def test_rolling_window_excludes_its_first_edge(spark, unit, n, expected):
    df = daily(spark, ("2001-02-28", 1.0), ("2001-03-30", 2.0), ("2001-03-31", 4.0))
    # One month up to 31 March begins after 28 February.
    assert values(ti.dates_in_period(df, "value", n, unit), "rolling")["2001-03-31"] == expected


def test_previous_periods(spark):
    df = daily(spark, ("2000-12-05", 1.0), ("2000-12-31", 2.0), ("2001-01-31", 4.0), ("2001-04-02", 8.0))
    assert values(ti.previous_period(df, "value", "month"), "previous_month")["2001-01-31"] == 3.0
    assert values(ti.previous_period(df, "value", "month"), "previous_month")["2001-04-02"] is None
    assert values(ti.previous_period(df, "value", "quarter"), "previous_quarter")["2001-04-02"] == 4.0
    assert values(ti.previous_period(df, "value", "year"), "previous_year")["2001-04-02"] == 3.0


def test_as_of_filters(spark):
    df = daily(spark, ("1999-12-31", 1.0), ("2000-02-29", 2.0), ("2001-01-31", 4.0), ("2001-02-28", 8.0), ("2001-03-01", 16.0))
    d = F.col("date")

    def total(predicate):
        return df.agg(F.sum(F.when(predicate, F.col("value")))).first()[0]

    assert total(ti.to_date_filter(d, "year", "2001-02-28")) == 12.0
    assert total(ti.last_year_filter(d, "year", "2001-02-28")) is None
    assert total(ti.previous_filter(d, "month", "2001-03-31")) == 8.0
    assert total(ti.previous_filter(d, "year", "2001-03-31")) == 2.0
    assert total(ti.in_period_filter(d, 1, "month", "2001-02-28")) == 12.0
    assert total(ti.in_period_filter(d, 31, "day", "2001-03-01")) == 28.0
    assert total(ti.dates_between(d, "2000-01-01", "2001-01-31")) == 6.0


def test_densify(spark):
    df = daily(spark, ("2001-01-01", 1.0), ("2001-01-03", 3.0)).withColumn("k", F.lit("a"))
    dense = ti.densify_dates(df, "date", ["k"], "2001-01-01", "2001-01-04", {"value": 0.0})
    assert sorted(values(dense, "value").items()) == [
        ("2001-01-01", 1.0),
        ("2001-01-02", 0.0),
        ("2001-01-03", 3.0),
        ("2001-01-04", 0.0),
    ]
    assert ti.densify_dates(df.drop("k"), "date", [], "2001-01-01", "2001-01-04").count() == 4


def test_growth(spark):
    df = spark.createDataFrame([(2.0, 1.0), (1.0, 0.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in df.select(ti.growth(F.col("a"), F.col("b"))).collect()] == [1.0, None, None]


def test_measures_over_periods(spark):
    """Distinct counts, means and ratios to date on a dense axis, per period, and exact month frames."""
    data = [("k", "2001-01-30", 1, 4.0), ("k", "2001-02-01", 1, 2.0), ("k", "2001-02-01", 2, 6.0), ("k", "2001-02-03", 1, None)]
    df = spark.createDataFrame(data, "g string, d string, c int, v double").withColumn("d", F.to_date("d"))
    measures = [m.sum_("v", "v"), m.count_rows("n"), m.distinct_count("c", "c"), m.average("mean", "v"), m.ratio("per_c", "v", "c")]
    got = ti.measures_to_date(df, measures, "month", "d", ["g"])
    assert rows(got) == [
        ("k", day("2001-01-30"), 4.0, 1, 1, 4.0, 4.0),
        ("k", day("2001-01-31"), 4.0, 1, 1, 4.0, 4.0),
        ("k", day("2001-02-01"), 8.0, 2, 2, 4.0, 4.0),
        ("k", day("2001-02-02"), 8.0, 2, 2, 4.0, 4.0),
        ("k", day("2001-02-03"), 8.0, 3, 2, 4.0, 4.0),
    ]
    with pytest.raises(ValueError):
        ti.measures_to_date(df, [m.median("s", "v")], "month", "d")
    months = ti.measures_per(df, measures, "month", "d", show=["c", "mean"])
    assert rows(ti.date_shift(months, "mean", -1, "month")) == [(day("2001-01-01"), 1, 4.0, None), (day("2001-02-01"), 2, 4.0, 4.0)]
    edge = spark.createDataFrame([("2001-02-28", 1e17), ("2001-03-01", 1.0), ("2001-03-28", 2.0), ("2001-03-31", 3.0)], "date string, v double")
    rolled = ti.dates_in_period(edge.withColumn("date", F.to_date("date")), "v", 1, "month")
    assert [r[2] for r in rows(rolled)] == [1e17, 1e17, 3.0, 6.0]


def test_rolling_measures_match_all_pairs(spark):
    """Distinct counts, sums, extremes and deviations over moving frames, against every row in the frame."""
    rng = random.Random(4)
    start = dt.date(2000, 1, 20)
    data = [(rng.choice("ab"), start + dt.timedelta(rng.randrange(110)), rng.randrange(6), 1e9 + rng.randrange(9)) for _ in range(60)]
    data += [("a", dt.date(2000, 1, 31), 9, 1e9), ("a", None, 1, 1.0), ("b", dt.date(2000, 2, 3), None, None)]
    df = spark.createDataFrame(data, "k string, d date, v int, x double")
    measures = [m.distinct_count("kinds", "v"), m.count("n", "x"), m.maximum("top", "x"), m.variance("spread", "x")]
    for n, unit in ((1, "month"), (2, "month"), (9, "day"), (2, "week")):
        got = {(r.k, r.date): r for r in ti.measures_in_period(df, measures, n, unit, "d", ["k"]).collect()}
        days = (max(d for _, d, _, _ in data if d) - min(d for _, d, _, _ in data if d)).days + 1
        assert len(got) == 2 * days
        for (k, day), r in got.items():
            before = day - dt.timedelta(n * {"day": 1, "week": 7}.get(unit, 0))
            if unit == "month":
                month = day.year * 12 + day.month - 1 - n
                last = (dt.date(month // 12 + (month % 12 == 11), (month + 1) % 12 + 1, 1) - dt.timedelta(1)).day
                before = dt.date(month // 12, month % 12 + 1, min(day.day, last))
            inside = [(v, x) for key, d, v, x in data if d and key == k and before < d <= day]
            xs = [x for _, x in inside if x is not None]
            assert (r.kinds, r.n) == (len({v for v, _ in inside if v is not None}), len(xs))
            assert r.top == (max(xs) if xs else None)
            if len(xs) < 2:
                assert r.spread is None
            else:
                assert r.spread == pytest.approx(statistics.variance([x - 1e9 for x in xs]), abs=1e-4)


def test_to_date_deviations_far_from_zero(spark):
    data = [(dt.date(2000, 1, d), 1e9 + (d * 7) % 5) for d in range(1, 29) for _ in range(d % 3)]
    got = ti.measures_to_date(spark.createDataFrame(data, "d date, x double"), [m.stddev("s", "x")], "month", "d").collect()
    for r in got:
        xs = [x - 1e9 for d, x in data if d <= r.date]
        assert r.s == pytest.approx(statistics.stdev(xs), abs=1e-4) if len(xs) > 1 else r.s is None


def test_parallel_measures(spark):
    df = spark.createDataFrame([(dt.date(2000, 1, 5), 1), (dt.date(2000, 1, 9), 1), (dt.date(2000, 4, 1), 2)], "d date, v int")
    out = ti.measures_parallel(df, [m.distinct_count("kinds", "v")], -1, "quarter", "d")
    assert rows(out.select("date", "kinds", "parallel_kinds")) == [(dt.date(2000, 1, 1), 1, None), (dt.date(2000, 4, 1), 1, 1)]
