"""Calendar and period queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabweave.functions.scalar import divide
from tabweave.operators.positions import rank_by
from tabweave.operators.transforms import dedupe_first
from tabweave.plans import measures as m
from tabweave.plans import timeintel as ti
from workload.base import ORDER_TOTAL, REVENUE, amounts, longs, order_total, query, revenue, revenues, sales_model, table

AS_OF = "2000-08-15"
DAY = "CAST(o_orderdate AS DATE)"
DAILY = f"""d AS (SELECT o_orderpriority, {DAY} AS date, sum({ORDER_TOTAL}) AS value FROM orders GROUP BY 1, 2)"""
KEYS = ["o_orderpriority"]


def daily(spark, sf_dir):
    return ti.daily_total(table(spark, sf_dir, "orders"), order_total(), "o_orderdate", KEYS)


def _to_date(name: str, unit: str):
    """Total, distinct customers and mean per order so far, for every day of the span."""

    @query(
        name,
        f"""WITH {DAILY}, o AS (SELECT o_orderpriority, {DAY} AS date, o_custkey FROM orders),
a AS (SELECT o_orderpriority, CAST(unnest(generate_series((SELECT min(date) FROM o), (SELECT max(date) FROM o), INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT DISTINCT o_orderpriority FROM o)),
f AS (SELECT o_orderpriority, date, count(*) AS n FROM (SELECT o_orderpriority, o_custkey, min(date) AS date FROM o
  GROUP BY 1, 2, date_trunc('{unit}', date)) GROUP BY 1, 2),
c AS (SELECT o_orderpriority, date, count(*) AS n FROM o GROUP BY 1, 2)
SELECT a.o_orderpriority, a.date, CAST(sum(d.value) OVER w AS DOUBLE) AS to_date,
  CAST(coalesce(sum(f.n) OVER w, 0) AS BIGINT) AS customers, CAST(sum(d.value) OVER w AS DOUBLE) / CAST(sum(c.n) OVER w AS DOUBLE) AS mean_order
FROM a LEFT JOIN d ON d.o_orderpriority = a.o_orderpriority AND d.date = a.date
LEFT JOIN f ON f.o_orderpriority = a.o_orderpriority AND f.date = a.date
LEFT JOIN c ON c.o_orderpriority = a.o_orderpriority AND c.date = a.date
WINDOW w AS (PARTITION BY a.o_orderpriority, date_trunc('{unit}', a.date) ORDER BY a.date ROWS UNBOUNDED PRECEDING)""",
    )
    def run(spark, sf_dir):
        mean = m.compound("mean_order", ("to_date", "orders"), lambda p: divide(p["to_date"] / 100, p["orders"]))
        measures = [m.sum_("to_date", order_total()), m.count_rows("orders"), m.distinct_count("customers", "o_custkey"), mean]
        shown = ["to_date", "customers", "mean_order"]
        out = ti.measures_to_date(table(spark, sf_dir, "orders"), measures, unit, "o_orderdate", KEYS, shown)
        return amounts(out, "to_date")


_to_date("total_ytd", "year")
_to_date("total_qtd", "quarter")
_to_date("total_mtd", "month")


def _as_of(name: str, unit: str, start: str):
    @query(
        name,
        f"""SELECT o_orderpriority, CAST(sum({ORDER_TOTAL}) FILTER (WHERE {DAY} BETWEEN DATE '{start}' AND DATE '{AS_OF}')
  AS DOUBLE) AS total FROM orders GROUP BY 1""",
    )
    def run(spark, sf_dir):
        measure = m.calculate_filter(
            m.sum_("total", order_total()), ti.to_date_filter(F.col("o_orderdate"), unit, AS_OF)
        )
        return amounts(m.evaluate(table(spark, sf_dir, "orders"), [measure], KEYS), "total")


_as_of("dates_ytd", "year", "2000-01-01")
_as_of("dates_qtd", "quarter", "2000-07-01")
_as_of("dates_mtd", "month", "2000-08-01")


def _shifted(name: str, n: int, unit: str, interval: str):
    @query(
        name,
        f"""WITH {DAILY} SELECT a.o_orderpriority, a.date, CAST(a.value AS DOUBLE) AS value, CAST(b.value AS DOUBLE) AS shifted
FROM d a LEFT JOIN d b ON b.o_orderpriority = a.o_orderpriority AND b.date = CAST(a.date + {interval} AS DATE)""",
    )
    def run(spark, sf_dir):
        return amounts(ti.date_shift(daily(spark, sf_dir), "value", n, unit, KEYS), "value", "shifted")


_shifted("date_shift", -1, "quarter", "INTERVAL (-3) MONTH")


@query(
    "same_period_last_year",
    f"""WITH {DAILY} SELECT a.o_orderpriority, a.date, CAST(a.value AS DOUBLE) AS value, CAST(b.value AS DOUBLE) AS last_year
FROM d a LEFT JOIN d b ON b.o_orderpriority = a.o_orderpriority AND b.date = CAST(a.date + INTERVAL (-12) MONTH AS DATE)""",
)
def same_period_last_year(spark, sf_dir):
    return amounts(ti.same_period_last_year(daily(spark, sf_dir), "value", KEYS), "value", "last_year")


def _whole_period(name: str, n: int, unit: str, months: int, out: str):
    @query(
        name,
        f"""WITH {DAILY}, p AS (SELECT o_orderpriority, date_trunc('{unit}', date) AS start, sum(value) AS total FROM d GROUP BY 1, 2)
SELECT d.o_orderpriority, d.date, CAST(d.value AS DOUBLE) AS value, CAST(p.total AS DOUBLE) AS {out}
FROM d LEFT JOIN p ON p.o_orderpriority = d.o_orderpriority AND p.start = date_trunc('{unit}', d.date) + INTERVAL ({months}) MONTH""",
    )
    def run(spark, sf_dir):
        return amounts(ti.parallel_period(daily(spark, sf_dir), "value", n, unit, KEYS, out=out), "value", out)


_whole_period("parallel_period", 1, "quarter", 3, "parallel")
@query(
    "previous_month",
    f"""WITH p AS (SELECT o_orderpriority, CAST(date_trunc('month', {DAY}) AS DATE) AS date, count(DISTINCT o_custkey) AS customers,
  CAST(sum({ORDER_TOTAL}) AS DOUBLE) AS total FROM orders GROUP BY 1, 2)
SELECT a.o_orderpriority, a.date, a.customers, a.total, b.customers AS previous_customers, b.total AS previous
FROM p a LEFT JOIN p b ON b.o_orderpriority = a.o_orderpriority AND b.date = CAST(a.date - INTERVAL 1 MONTH AS DATE)""",
)
def previous_month(spark, sf_dir):
    measures = [m.sum_("total", order_total()), m.distinct_count("customers", "o_custkey")]
    months = amounts(ti.measures_per(table(spark, sf_dir, "orders"), measures, "month", "o_orderdate", KEYS), "total")
    out = ti.date_shift(months, "total", -1, "month", KEYS, out="previous")
    return ti.date_shift(out, "customers", -1, "month", KEYS, out="previous_customers")


_whole_period("previous_quarter", -1, "quarter", -3, "previous")
_whole_period("previous_year", -1, "year", -12, "previous")


@query(
    "dates_in_period",
    f"""WITH {DAILY} SELECT o_orderpriority, date,
  CAST(sum(value) OVER (PARTITION BY o_orderpriority ORDER BY date RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW) AS DOUBLE) AS rolling_30d,
  (SELECT CAST(sum(b.value) AS DOUBLE) FROM d b WHERE b.o_orderpriority = d.o_orderpriority AND b.date <= d.date
    AND b.date > CAST(d.date - INTERVAL 3 MONTH AS DATE)) AS rolling_3m FROM d""",
)
def dates_in_period(spark, sf_dir):
    rows = ti.dates_in_period(daily(spark, sf_dir), "value", 30, "day", KEYS, out="rolling_30d")
    rows = ti.dates_in_period(rows, "value", 3, "month", KEYS, out="rolling_3m")
    return amounts(rows.drop("value"), "rolling_30d", "rolling_3m")


@query(
    "dates_in_period_measures",
    f"""WITH o AS (SELECT o_orderpriority, {DAY} AS date, o_custkey, {ORDER_TOTAL} AS value FROM orders),
a AS (SELECT o_orderpriority, CAST(unnest(generate_series((SELECT min(date) FROM o), (SELECT max(date) FROM o), INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT DISTINCT o_orderpriority FROM o))
SELECT a.o_orderpriority, a.date, count(DISTINCT o.o_custkey) AS customers, CAST(sum(o.value) AS DOUBLE) AS total, CAST(sum(o.value) AS DOUBLE) / nullif(CAST(count(o.value) AS DOUBLE), 0) AS mean_order,
  round(stddev_samp(CAST(o.value AS DOUBLE)), 2) AS spread
FROM a LEFT JOIN o ON o.o_orderpriority = a.o_orderpriority AND o.date <= a.date AND o.date > CAST(a.date - INTERVAL 3 MONTH AS DATE) GROUP BY 1, 2""",
)
def dates_in_period_measures(spark, sf_dir):
    """Customers, total, mean and spread of the last three months, for every day."""
    mean = m.compound("mean_order", ("total", "orders"), lambda p: divide(p["total"] / 100, p["orders"]))
    measures = [m.sum_("total", order_total()), m.count_rows("orders"), m.distinct_count("customers", "o_custkey"), mean, m.stddev("spread", "o_totalprice")]
    shown = ["customers", "total", "mean_order", "spread"]
    out = ti.measures_in_period(table(spark, sf_dir, "orders"), measures, 3, "month", "o_orderdate", KEYS, shown)
    return amounts(out, "total").withColumn("spread", F.round("spread", 2))


@query(
    "parallel_period_measures",
    f"""WITH q AS (SELECT o_orderpriority, CAST(date_trunc('quarter', {DAY}) AS DATE) AS date, count(DISTINCT o_custkey) AS customers,
  CAST(sum({ORDER_TOTAL}) AS DOUBLE) / count(DISTINCT o_custkey) AS per_customer FROM orders GROUP BY 1, 2)
SELECT a.o_orderpriority, a.date, a.customers, a.per_customer, b.customers AS parallel_customers, b.per_customer AS parallel_per_customer
FROM q a LEFT JOIN q b ON b.o_orderpriority = a.o_orderpriority AND b.date = CAST(a.date - INTERVAL 12 MONTH AS DATE)""",
)
def parallel_period_measures(spark, sf_dir):
    """A distinct count and a ratio of each quarter and of the same quarter a year before."""
    ratio = m.compound("per_customer", ("total", "customers"), lambda p: divide(p["total"] / 100, p["customers"]))
    measures = [m.sum_("total", order_total()), m.distinct_count("customers", "o_custkey"), ratio]
    return ti.measures_parallel(table(spark, sf_dir, "orders"), measures, -4, "quarter", "o_orderdate", KEYS, ["customers", "per_customer"])


@query(
    "dates_between",
    f"SELECT o_orderpriority, count(*) AS order_rows FROM orders WHERE {DAY} BETWEEN DATE '1998-02-15' AND DATE '1999-06-30' GROUP BY 1",
)
def dates_between(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    where = {"o_orderdate": ti.dates_between(F.col("o_orderdate"), "1998-02-15", "1999-06-30")}
    return m.evaluate(rows, [m.count_rows("order_rows")], KEYS, where)


@query(
    "rankx",
    f"""SELECT p_partkey, CAST(total AS DOUBLE) AS revenue, rank() OVER (ORDER BY total DESC) AS rank
FROM (SELECT p_partkey, sum({REVENUE}) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)""",
)
def rankx(spark, sf_dir):
    model = sales_model(spark, sf_dir, [m.sum_("revenue", revenue())])
    totals = model.query("lineitem", ["revenue"], ["l_partkey"]).withColumnRenamed("l_partkey", "p_partkey")
    return revenues(rank_by(totals, "revenue"), "revenue")


@query(
    "rankx_within",
    f"""SELECT o_orderpriority, o_custkey, CAST(total AS DOUBLE) AS total,
  rank() OVER (PARTITION BY o_orderpriority ORDER BY total DESC) AS rank
FROM (SELECT o_orderpriority, o_custkey, sum({ORDER_TOTAL}) AS total FROM orders GROUP BY 1, 2)""",
)
def rankx_within(spark, sf_dir):
    totals = m.evaluate(table(spark, sf_dir, "orders"), [m.sum_("total", order_total())], ["o_orderpriority", "o_custkey"])
    return amounts(rank_by(totals, "total", within=["o_orderpriority"]), "total")


@query(
    "dedupe_first",
    """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""",
)
def dedupe_first_(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return dedupe_first(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query(
    "date_spine",
    f"""WITH span AS (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders),
days AS (SELECT CAST(unnest(generate_series(date_trunc('year', lo), date_trunc('year', hi) + INTERVAL 1 YEAR - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date_key FROM span),
n AS (SELECT {DAY} AS day, count(*) AS order_rows FROM orders GROUP BY 1)
SELECT date_key, CAST(year(date_key) AS BIGINT) AS year, CAST(month(date_key) AS BIGINT) AS month_num,
  CAST(dayofweek(date_key) + 1 AS BIGINT) AS weekday_num, CAST(date_trunc('month', date_key) AS DATE) AS month_start,
  CAST(date_trunc('quarter', date_key) AS DATE) AS quarter_start, CAST(date_trunc('year', date_key) AS DATE) AS year_start,
  last_day(date_key) AS month_end, coalesce(order_rows, 0) AS order_rows
FROM days LEFT JOIN n ON day = date_key""",
)
def date_spine(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    counts = orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("order_rows"))
    spine = ti.date_spine_of(orders, "o_orderdate")
    out = spine.join(counts, F.col("date_key") == F.col("day"), "left").drop("day").fillna(0, ["order_rows"])
    return longs(out, "year", "month_num", "weekday_num")


@query(
    "densify_dates",
    f"""WITH {DAILY}, days AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM d), (SELECT max(date) FROM d), INTERVAL 1 DAY)) AS DATE) AS date),
k AS (SELECT DISTINCT o_orderpriority FROM d)
SELECT k.o_orderpriority, days.date, coalesce(CAST(d.value AS DOUBLE), 0) AS value FROM k CROSS JOIN days
LEFT JOIN d ON d.o_orderpriority = k.o_orderpriority AND d.date = days.date""",
)
def densify_dates(spark, sf_dir):
    rows = amounts(daily(spark, sf_dir), "value")
    first, last = rows.agg(F.min("date"), F.max("date")).first()
    return ti.densify_dates(rows, "date", KEYS, first, last, {"value": 0.0})


@query(
    "calculated_table_view",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'",
)
def calculated_table_view(spark, sf_dir):
    urgent = (
        table(spark, sf_dir, "orders")
        .where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'")
        .select("o_orderkey", "o_custkey", "o_totalprice")
    )
    return ti.calculated_table_view(spark, "urgent_open_orders", urgent)
