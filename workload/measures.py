"""Aggregation queries: measures, filter context, calculation items, rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabweave.operators.joins import lookup_join
from tabweave.operators.positions import exact_percentiles
from tabweave.operators.joins import null_safe_join
from tabweave.operators.transforms import union_all
from tabweave.plans import bitmaps
from tabweave.plans import measures as m
from tabweave.plans.model import Relationship, SemanticModel
from tabweave.plans.timeintel import daily_total, parallel_period, time_items
from tabweave.session import scratch_dir
from tabweave.sources.sinks import mart_overwrite
from workload.base import (
    ORDER_TOTAL,
    REVENUE,
    SALES_SQL,
    TAXED,
    amounts,
    cents,
    doubles,
    longs,
    order_total,
    query,
    revenue,
    revenues,
    sales_model,
    table,
    taxed,
)


@query(
    "flagship_sales_by_region_year",
    f"""SELECT r_name, CAST(year(o_orderdate) AS BIGINT) AS order_year,
  CAST(sum({REVENUE}) AS DOUBLE) AS revenue,
  CAST(sum({REVENUE}) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS returned_revenue,
  round(CAST(sum({REVENUE}) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) / CAST(sum({REVENUE}) AS DOUBLE), 9) AS returned_share
FROM {SALES_SQL} GROUP BY 1, 2""",
)
def flagship(spark, sf_dir):
    base = m.sum_("revenue", revenue())
    model = sales_model(
        spark,
        sf_dir,
        [
            base,
            m.calculate_filter(base, F.col("l_returnflag") == "R", "returned_revenue"),
            m.compound(
                "returned_share",
                ("returned_revenue", "revenue"),
                lambda p: F.round(p["returned_revenue"] / p["revenue"], 9),
            ),
        ],
    )
    out = model.query(
        "lineitem",
        ["revenue", "returned_revenue", "returned_share"],
        by=["r_name", "order_year"],
        columns={"order_year": F.year("o_orderdate").cast("bigint")},
    )
    return revenues(out, "revenue", "returned_revenue")


def _by_flag(spark, sf_dir, *measures, by=("l_returnflag",)):
    return m.evaluate(table(spark, sf_dir, "lineitem"), measures, list(by))


@query(
    "agg_sum",
    f"SELECT l_returnflag, CAST(sum({REVENUE}) AS DOUBLE) AS revenue, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1",
)
def agg_sum(spark, sf_dir):
    out = _by_flag(spark, sf_dir, m.sum_("revenue", revenue()), m.sum_("quantity", "l_quantity"))
    return revenues(out, "revenue")


@query(
    "agg_count",
    "SELECT o_orderpriority, count(l_orderkey) AS lines, count(*) AS order_rows FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
)
def agg_count(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_orderkey").alias("line_order"))
    rows = lookup_join(table(spark, sf_dir, "orders"), lines, {"o_orderkey": "l_orderkey"})
    return m.evaluate(rows, [m.count("lines", "line_order"), m.count_rows("order_rows")], ["o_orderpriority"])


@query(
    "agg_distinct_count",
    "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1",
)
def agg_distinct_count(spark, sf_dir):
    return _by_flag(spark, sf_dir, m.distinct_count("suppliers", "l_suppkey"), m.distinct_count("orders", "l_orderkey"))


@query(
    "agg_average",
    f"SELECT o_orderpriority, CAST(sum({ORDER_TOTAL}) AS DOUBLE) / count(o_totalprice) AS avg_total FROM orders GROUP BY 1",
)
def agg_average(spark, sf_dir):
    average = m.Measure(
        "avg_total",
        m.average("avg_total", order_total()).base,
        lambda p: p["sum"] / 100 / p["count"],
    )
    return m.evaluate(table(spark, sf_dir, "orders"), [average], ["o_orderpriority"])


@query(
    "agg_min_max",
    "SELECT l_shipmonth, min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest FROM (SELECT *, CAST(date_trunc('month', l_shipdate) AS DATE) AS l_shipmonth FROM lineitem) GROUP BY 1",
)
def agg_min_max(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("l_shipmonth", F.trunc("l_shipdate", "month"))
    return m.evaluate(
        rows, [m.minimum("lowest", "l_extendedprice"), m.maximum("highest", "l_extendedprice")], ["l_shipmonth"]
    )


@query("agg_countrows", "SELECT l_returnflag, l_linestatus, count(*) AS lines FROM lineitem GROUP BY 1, 2")
def agg_countrows(spark, sf_dir):
    return _by_flag(spark, sf_dir, m.count_rows("lines"), by=("l_returnflag", "l_linestatus"))


@query(
    "agg_countblank",
    "SELECT o_orderpriority, count(*) - count(l_orderkey) AS orders_without_line FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey GROUP BY 1",
)
def agg_countblank(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_orderkey").alias("line_order")).distinct()
    rows = lookup_join(table(spark, sf_dir, "orders"), lines, {"o_orderkey": "l_orderkey"})
    return m.evaluate(rows, [m.count_blank("orders_without_line", "line_order")], ["o_orderpriority"])


@query(
    "agg_statistics",
    """SELECT l_returnflag, round(median(l_extendedprice), 4) AS median_price,
  round(quantile_cont(l_extendedprice, 0.9), 4) AS p90_price,
  round(stddev_samp(l_quantity), 6) AS stddev_qty, round(var_samp(l_quantity), 6) AS var_qty
FROM lineitem GROUP BY 1""",
)
def agg_statistics(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    spread = m.evaluate(rows, [m.stddev("stddev_qty", "l_quantity"), m.variance("var_qty", "l_quantity")], ["l_returnflag"])
    points = exact_percentiles(rows, "l_extendedprice", {"median_price": 0.5, "p90_price": 0.9}, ["l_returnflag"])
    out = null_safe_join(points, spread, ["l_returnflag"])
    return out.withColumns(
        {
            "median_price": F.round("median_price", 4),
            "p90_price": F.round("p90_price", 4),
            "stddev_qty": F.round("stddev_qty", 6),
            "var_qty": F.round("var_qty", 6),
        }
    )


@query(
    "agg_percentiles_in_context",
    f"""SELECT l_returnflag, l_linestatus, CAST(sum({REVENUE}) AS DOUBLE) AS revenue, round(median(l_extendedprice), 4) AS median_price,
  round(median(l_extendedprice) FILTER (WHERE l_quantity > 25), 4) AS median_large, round(median(l_discount) FILTER (WHERE l_tax < 0.04), 6) AS median_discount,
  round(quantile_cont(l_extendedprice, 0.9) FILTER (WHERE l_shipdate >= TIMESTAMP '1998-01-01'), 4) AS p90_late,
  round((SELECT median(l_extendedprice) FROM lineitem), 4) AS median_all FROM lineitem GROUP BY 1, 2""",
)
def agg_percentiles_in_context(spark, sf_dir):
    """Percentiles beside a sum, each under its own filter, by two columns and over all."""
    price = m.median("median_price", "l_extendedprice")
    late = F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    measures = [
        m.sum_("revenue", revenue()),
        price,
        m.calculate_filter(price, F.col("l_quantity") > 25, "median_large"),
        m.calculate_filter(m.median("median_discount", "l_discount"), F.col("l_tax") < 0.04),
        m.calculate_filter(m.percentile("p90_late", "l_extendedprice", 0.9), late),
        m.calculate_all(price, "median_all"),
    ]
    out = revenues(_by_flag(spark, sf_dir, *measures, by=("l_returnflag", "l_linestatus")), "revenue")
    digits = {"median_price": 4, "median_large": 4, "median_discount": 6, "p90_late": 4, "median_all": 4}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(
    "agg_distinct_noblank",
    "SELECT source, count(DISTINCT nullif(trim(lang), '')) AS langs FROM documents GROUP BY 1",
)
def agg_distinct_noblank(spark, sf_dir):
    filled = F.nullif(F.trim("lang"), F.lit(""))
    return m.evaluate(table(spark, sf_dir, "documents"), [m.distinct_count("langs", filled)], ["source"])


@query(
    "aggregate_transform",
    """SELECT user_id, event_type, count(*) AS n, min(value) AS lo, max(value) AS hi,
  CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2""",
)
def aggregate_transform(spark, sf_dir):
    out = (
        table(spark, sf_dir, "events")
        .groupBy("user_id", "event_type")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("value").alias("lo"),
            F.max("value").alias("hi"),
            F.sum(cents("value")).alias("total"),
        )
    )
    return amounts(out, "total")


@query(
    "group_by_all",
    "SELECT c_mktsegment, c_nationkey, count(*) AS customers, CAST(sum(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE) AS balance FROM customer GROUP BY ALL",
)
def group_by_all(spark, sf_dir):
    return spark.sql(
        """SELECT c_mktsegment, c_nationkey, count(*) AS customers,
             CAST(sum(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE) AS balance
           FROM {customer} GROUP BY ALL""",
        customer=table(spark, sf_dir, "customer"),
    )


def _iterator(name, measure, sql_aggregate, digits=4):
    @query(
        name,
        f"SELECT l_linestatus, CAST({sql_aggregate} AS DOUBLE) AS result FROM lineitem GROUP BY 1",
    )
    def run(spark, sf_dir):
        return amounts(_by_flag(spark, sf_dir, measure(), by=("l_linestatus",)), "result", digits=digits)

    return run


_iterator("iterator_sumx", lambda: m.sum_("result", taxed()), f"sum({TAXED})")
_iterator("iterator_minx", lambda: m.minimum("result", taxed()), f"min({TAXED})")
_iterator("iterator_maxx", lambda: m.maximum("result", taxed()), f"max({TAXED})")
_iterator(
    "iterator_averagex",
    lambda: m.Measure(
        "result", m.average("result", taxed()).base, lambda p: p["sum"] / 10000 / p["count"]
    ),
    f"CAST(sum({TAXED}) AS DOUBLE) / count({TAXED})",
    digits=0,
)
_iterator(
    "iterator_countx",
    lambda: m.count("result", F.expr("CASE WHEN l_discount > 0.05 THEN l_quantity END")),
    "count(CASE WHEN l_discount > 0.05 THEN l_quantity END)",
    digits=0,
)


@query(
    "concatenatex",
    "SELECT lang, string_agg(source, ', ' ORDER BY source) AS sources FROM documents GROUP BY 1",
)
def concatenatex(spark, sf_dir):
    return m.concatenatex(table(spark, sf_dir, "documents"), "source", ["lang"], out="sources")


@query(
    "has_one_value",
    "SELECT l_orderkey, count(DISTINCT l_returnflag) = 1 AS one_flag FROM lineitem GROUP BY 1",
)
def has_one_value(spark, sf_dir):
    return _by_flag(spark, sf_dir, m.has_one_value("one_flag", "l_returnflag"), by=("l_orderkey",))


@query(
    "selected_value",
    "SELECT l_orderkey, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN max(l_linestatus) ELSE 'mixed' END AS line_status FROM lineitem GROUP BY 1",
)
def selected_value(spark, sf_dir):
    return _by_flag(spark, sf_dir, m.selected_value("line_status", "l_linestatus", "mixed"), by=("l_orderkey",))


@query(
    "calculate_filter",
    f"""SELECT p_brand, CAST(sum({REVENUE}) AS DOUBLE) AS revenue,
  CAST(sum(CASE WHEN p_type = 'PROMO' THEN {REVENUE} END) AS DOUBLE) AS promo_revenue,
  round(sum(CASE WHEN p_type = 'PROMO' THEN l_quantity END) / count(CASE WHEN p_type = 'PROMO' THEN 1 END), 9) AS promo_size
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1""",
)
def calculate_filter(spark, sf_dir):
    base = m.sum_("revenue", revenue())
    promo = m.calculate_filter(base, F.col("p_type") == "PROMO", "promo_revenue")
    sizes = [m.sum_("quantity", "l_quantity"), m.count_rows("lines"), m.ratio("size", "quantity", "lines")]
    promo_size = m.calculate_filter(sizes[2], F.col("p_type") == "PROMO", "promo_size")
    model = sales_model(spark, sf_dir, [base, promo, *sizes, promo_size])
    out = model.query("lineitem", ["revenue", "promo_revenue", "promo_size"], by=["p_brand"])
    out = out.withColumn("promo_size", F.round("promo_size", 9))
    return revenues(out, "revenue", "promo_revenue")


@query(
    "calculate_all",
    f"""SELECT l_returnflag, CAST(sum({REVENUE}) AS DOUBLE) AS revenue,
  (SELECT CAST(sum({REVENUE}) AS DOUBLE) FROM lineitem) AS all_revenue,
  round(CAST(sum({REVENUE}) AS DOUBLE) / (SELECT CAST(sum({REVENUE}) AS DOUBLE) FROM lineitem), 9) AS share
FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1""",
)
def calculate_all(spark, sf_dir):
    base = m.sum_("revenue", revenue())
    share = m.compound(
        "share", ("revenue", "all_revenue"), lambda p: F.round(p["revenue"] / p["all_revenue"], 9)
    )
    out = m.evaluate(
        table(spark, sf_dir, "lineitem"),
        [base, m.calculate_all(base, "all_revenue"), share],
        ["l_returnflag"],
        {"l_linestatus": F.col("l_linestatus") == "O"},
    )
    return revenues(out, "revenue", "all_revenue")


@query(
    "calculate_allselected",
    f"""SELECT l_returnflag, CAST(sum({REVENUE}) AS DOUBLE) AS revenue,
  (SELECT CAST(sum({REVENUE}) AS DOUBLE) FROM lineitem WHERE l_linestatus = 'O') AS selected_revenue
FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1""",
)
def calculate_allselected(spark, sf_dir):
    base = m.sum_("revenue", revenue())
    out = m.evaluate(
        table(spark, sf_dir, "lineitem"),
        [base, m.calculate_allselected(base, "selected_revenue")],
        ["l_returnflag"],
        {"l_linestatus": F.col("l_linestatus") == "O"},
    )
    return revenues(out, "revenue", "selected_revenue")


@query(
    "calculate_allexcept",
    f"""WITH g AS (SELECT o_orderpriority, o_orderstatus, sum({ORDER_TOTAL}) AS total FROM orders
  WHERE o_orderpriority <> '5-LOW' AND o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1, 2),
k AS (SELECT o_orderpriority, sum({ORDER_TOTAL}) AS priority_total FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1)
SELECT g.o_orderpriority, o_orderstatus, CAST(total AS DOUBLE) AS total, CAST(priority_total AS DOUBLE) AS priority_total
FROM g JOIN k ON g.o_orderpriority = k.o_orderpriority""",
)
def calculate_allexcept(spark, sf_dir):
    base = m.sum_("total", order_total())
    out = m.evaluate(
        table(spark, sf_dir, "orders"),
        [base, m.calculate_allexcept(base, ["o_orderpriority"], "priority_total")],
        ["o_orderpriority", "o_orderstatus"],
        {
            "o_orderpriority": F.col("o_orderpriority") != "5-LOW",
            "o_orderdate": F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"),
        },
    )
    return amounts(out, "total", "priority_total")


@query(
    "calculate_keepfilters",
    f"""SELECT c_mktsegment, CAST(sum({ORDER_TOTAL}) AS DOUBLE) AS total,
  CAST(sum(CASE WHEN o_orderstatus = 'F' THEN {ORDER_TOTAL} END) AS DOUBLE) AS final_total
FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O') GROUP BY 1""",
)
def calculate_keepfilters(spark, sf_dir):
    base = m.sum_("total", order_total())
    final = m.calculate_keepfilters(base, F.col("o_orderstatus") == "F", "final_total")
    out = sales_model(spark, sf_dir, [base, final]).query(
        "orders", ["total", "final_total"], ["c_mktsegment"], {"o_orderstatus": F.col("o_orderstatus").isin("F", "O")}
    )
    return amounts(out, "total", "final_total")


@query(
    "calculate_table",
    "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0",
)
def calculate_table(spark, sf_dir):
    return (
        table(spark, sf_dir, "customer")
        .where((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 0))
        .select("c_custkey", "c_name", "c_acctbal")
    )


@query(
    "summarize",
    f"""SELECT r_name, p_type, count(*) AS lines, sum(l_quantity) AS quantity
FROM {SALES_SQL} LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
)
def summarize(spark, sf_dir):
    return sales_model(spark, sf_dir).query("lineitem", ["lines", "quantity"], by=["r_name", "p_type"])


@query(
    "ratio_measure",
    f"""SELECT l_suppkey, CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') = 0 THEN 0
  ELSE sum(l_quantity) FILTER (WHERE l_returnflag = 'R') / count(*) FILTER (WHERE l_returnflag = 'R') END AS qty_per_return
FROM lineitem GROUP BY 1""",
)
def ratio_measure(spark, sf_dir):
    returned = F.col("l_returnflag") == "R"
    measures = [
        m.calculate_filter(m.sum_("returned_qty", "l_quantity"), returned),
        m.calculate_filter(m.count_rows("returns"), returned),
        m.ratio("qty_per_return", "returned_qty", "returns", 0.0),
    ]
    return m.evaluate(table(spark, sf_dir, "lineitem"), measures, ["l_suppkey"], show=["qty_per_return"])


@query(
    "compound_measure",
    f"""SELECT p_type, CAST(rev AS DOUBLE) AS revenue, CAST(price AS DOUBLE) AS gross,
  CAST(price - rev AS DOUBLE) AS discount_given, round(CAST(price - rev AS DOUBLE) / CAST(price AS DOUBLE), 9) AS discount_rate,
  round(CAST(price - rev AS DOUBLE) / CAST(price AS DOUBLE) * 100, 6) AS discount_pct
FROM (SELECT p_type, sum({REVENUE}) AS rev, sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS price
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1)""",
)
def compound_measure(spark, sf_dir):
    def rate(parts):
        return parts["discount_given"] / parts["gross"]

    measures = [
        m.compound("discount_pct", ("discount_given", "gross"), lambda p: F.round(rate(p) * 100, 6)),
        m.compound("discount_rate", ("discount_given", "gross"), lambda p: F.round(rate(p), 9)),
        m.compound("discount_given", ("gross", "revenue"), lambda p: p["gross"] - p["revenue"]),
        m.sum_("gross", cents("l_extendedprice") * 100),
        m.sum_("revenue", revenue()),
    ]
    out = sales_model(spark, sf_dir, measures).query("lineitem", [x.name for x in measures], by=["p_type"])
    return revenues(out, "discount_given", "gross", "revenue")


AS_OF = "2000-08-15"


def _item_sql(base: str, name: str, shown: str = "{}") -> str:
    day = "CAST(o_orderdate AS DATE)"
    bounds = {
        "MTD": "DATE '2000-08-01' AND DATE '2000-08-15'",
        "QTD": "DATE '2000-07-01' AND DATE '2000-08-15'",
        "YTD": "DATE '2000-01-01' AND DATE '2000-08-15'",
        "PY": "DATE '1999-01-01' AND DATE '1999-08-15'",
    }
    columns = [
        f"CAST({shown.format(f'{base} FILTER (WHERE {day} BETWEEN {b})')} AS DOUBLE) AS \"{name} {item}\""
        for item, b in bounds.items()
    ]
    return ", ".join([*columns, f'CAST({shown.format(base)} AS DOUBLE) AS "{name} Current"'])


@query(
    "calc_group_expand",
    f"SELECT o_orderpriority, {_item_sql(f'sum({ORDER_TOTAL})', 'Total')}, {_item_sql('count(*)', 'Orders')}, {_item_sql('avg(cents)', 'Mean', 'round({}, 2)')} FROM (SELECT *, CAST(round(o_totalprice * 100) AS DOUBLE) AS cents FROM orders) GROUP BY 1",
)
def calc_group_expand(spark, sf_dir):
    bases = [m.sum_("Total", order_total()), m.count_rows("Orders"), m.ratio("Mean", "Total", "Orders")]
    measures = m.calc_group_expand(bases, time_items("o_orderdate", AS_OF), {"PY": "0.00"})
    out = m.evaluate(table(spark, sf_dir, "orders"), [*bases, *measures], ["o_orderpriority"], show=[x.name for x in measures])
    out = out.withColumns({x.name: F.round(x.name, 2) for x in measures if x.name.startswith("Mean")})
    names = [x.name for x in measures]
    out = amounts(out, *[n for n in names if n.startswith("Total")])
    return doubles(out, *[n for n in names if n.startswith("Orders")])


@query(
    "period_over_period",
    f"""SELECT r_name, CAST(ytd AS DOUBLE) AS "Total YTD", CAST(py AS DOUBLE) AS "Total PY",
  round((CAST(ytd AS DOUBLE) - CAST(py AS DOUBLE)) / CAST(py AS DOUBLE), 9) AS growth
FROM (SELECT r_name, sum({ORDER_TOTAL}) FILTER (WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '2000-01-01' AND DATE '2000-08-15') AS ytd,
  sum({ORDER_TOTAL}) FILTER (WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1999-01-01' AND DATE '1999-08-15') AS py
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1)""",
)
def period_over_period(spark, sf_dir):
    items = {k: v for k, v in time_items("o_orderdate", AS_OF).items() if k in ("YTD", "PY")}
    expanded = m.calc_group_expand([m.sum_("Total", order_total())], items)

    def change(parts):
        now, before = parts["Total YTD"], parts["Total PY"]
        return F.round((now - before) / before, 9)

    growth = m.compound("growth", ("Total YTD", "Total PY"), change)
    model = sales_model(spark, sf_dir, [*expanded, growth])
    return amounts(model.query("orders", ["Total YTD", "Total PY", "growth"], ["r_name"]), "Total YTD", "Total PY")


@query(
    "kpi_status",
    f"""WITH mth AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum({ORDER_TOTAL}) AS total FROM orders GROUP BY 1),
v AS (SELECT a.month, CAST(a.total AS DOUBLE) AS value, CAST(b.total AS DOUBLE) AS previous
  FROM mth a LEFT JOIN mth b ON b.month = CAST(a.month - INTERVAL 1 MONTH AS DATE))
SELECT month, value, previous, previous * 1.05 AS target,
  CASE WHEN value >= previous * 1.05 THEN 1 WHEN value >= previous * 1.05 * 0.9 THEN 0 WHEN value IS NOT NULL THEN -1 END AS status,
  CASE WHEN value > previous THEN 1 WHEN value < previous THEN -1 WHEN value = previous THEN 0 END AS trend FROM v""",
)
def kpi_status(spark, sf_dir):
    months = daily_total(
        table(spark, sf_dir, "orders").withColumn("month", F.trunc("o_orderdate", "month")), order_total(), "month"
    )
    shifted = parallel_period(months, "value", -1, "month", out="previous")
    values = amounts(shifted, "value", "previous").select(
        F.col("date").alias("month"), "value", "previous"
    ).withColumn("target", F.col("previous") * 1.05)
    return values.withColumns(m.kpi_columns(F.col("value"), F.col("target"), F.col("previous")))


@query(
    "hierarchy_rollup",
    f"""SELECT r_name, n_name, c_mktsegment,
  CAST(3 - grouping(r_name) - grouping(n_name) - grouping(c_mktsegment) AS INTEGER) AS depth,
  CAST(sum({ORDER_TOTAL}) AS DOUBLE) AS total, count(*) AS order_rows
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""",
)
def hierarchy_rollup(spark, sf_dir):
    measures = [m.sum_("total", order_total()), m.count_rows("order_rows")]
    model = sales_model(spark, sf_dir, measures, hierarchies={"geography": ["r_name", "n_name", "c_mktsegment"]})
    return amounts(model.drill("orders", ["total", "order_rows"], "geography"), "total")


def _tree(spark, sf_dir):
    """World, regions, nations and customers as one parent-child table."""
    text = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
    regions = table(spark, sf_dir, "region").select(text("r", "r_regionkey").alias("node"), F.lit("world").alias("parent"))
    nations = table(spark, sf_dir, "nation").select(text("n", "n_nationkey").alias("node"), text("r", "n_regionkey").alias("parent"))
    customers = table(spark, sf_dir, "customer").select(text("c", "c_custkey").alias("node"), text("n", "c_nationkey").alias("parent"))
    top = regions.select(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent")).distinct()
    return union_all(top, regions, nations, customers)


@query(
    "hierarchy_rollup_parent_child",
    f"""WITH f AS (SELECT 'c' || o_custkey AS c, 'n' || c_nationkey AS n, 'r' || n_regionkey AS r, {ORDER_TOTAL} AS total FROM orders
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT NULL, 'n' || s_nationkey, 'r' || n_regionkey, CAST(s_acctbal AS DECIMAL(12,2)) FROM supplier JOIN nation ON s_nationkey = n_nationkey),
t AS (SELECT 'world' AS node, NULL AS parent UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
s AS (SELECT c AS node, total FROM f WHERE c IS NOT NULL UNION ALL SELECT n, total FROM f UNION ALL SELECT r, total FROM f UNION ALL SELECT 'world', total FROM f)
SELECT t.node, t.parent, CAST(sum(total) AS DOUBLE) AS total, count(total) AS n, CAST(max(total) AS DOUBLE) AS largest FROM t LEFT JOIN s ON s.node = t.node GROUP BY 1, 2""",
)
def hierarchy_rollup_parent_child(spark, sf_dir):
    """Orders at customers and balances at nations, at every node of a ragged tree."""
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node"), order_total().alias("amount"))
    balances = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("node"), cents("s_acctbal").alias("amount"))
    measures = [m.sum_("total", "amount"), m.count("n", "amount"), m.maximum("largest", "amount")]
    out = m.parent_child_rollup(union_all(orders, balances), _tree(spark, sf_dir), "node", "parent", measures)
    return amounts(out, "total", "largest")


@query(
    "preaggregate",
    f"SELECT o_orderstatus, CAST(sum({ORDER_TOTAL}) AS DOUBLE) AS total, count(*) AS order_rows, max(o_totalprice) AS largest FROM orders GROUP BY 1",
)
def preaggregate(spark, sf_dir):
    measures = [m.sum_("total", order_total()), m.count_rows("order_rows"), m.maximum("largest", "o_totalprice")]
    rows = table(spark, sf_dir, "orders").withColumn("month", F.trunc("o_orderdate", "month"))
    path = scratch_dir(spark, "preaggregate")
    mart_overwrite(m.preaggregate(rows, measures, ["month", "o_orderstatus", "o_orderpriority"]), path)
    return amounts(m.reaggregate(spark.read.parquet(path), measures, ["o_orderstatus"]), "total")


@query(
    "preaggregate_statistics",
    """SELECT o_orderpriority, CAST(year(o_orderdate) AS BIGINT) AS year, round(stddev_samp(o_totalprice), 4) AS spread,
  round(var_samp(CAST(o_custkey AS DOUBLE)), 2) AS customer_variance, count(*) AS order_rows FROM orders GROUP BY 1, 2""",
)
def preaggregate_statistics(spark, sf_dir):
    """Deviations kept per day and status answer priority and year."""
    measures = [m.stddev("spread", "o_totalprice"), m.variance("customer_variance", "o_custkey"), m.count_rows("order_rows")]
    rows = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    path = scratch_dir(spark, "preaggregate-statistics")
    mart_overwrite(m.preaggregate(rows, measures, ["day", "o_orderstatus", "o_orderpriority"]), path)
    partials = spark.read.parquet(path).withColumn("year", F.year("day").cast("bigint"))
    out = m.reaggregate(partials, measures, ["o_orderpriority", "year"])
    return out.withColumns({"spread": F.round("spread", 4), "customer_variance": F.round("customer_variance", 2)})


@query(
    "preaggregate_distinct",
    f"""WITH o AS (SELECT *, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(date_trunc('year', o_orderdate) AS DATE) AS year FROM orders)
SELECT 'month' AS grain, month AS start, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities, CAST(sum({ORDER_TOTAL}) AS DOUBLE) AS total FROM o GROUP BY 2
UNION ALL SELECT 'year', year, count(DISTINCT o_custkey), count(DISTINCT o_orderpriority), CAST(sum({ORDER_TOTAL}) AS DOUBLE) FROM o GROUP BY 2
UNION ALL SELECT 'all', NULL, count(DISTINCT o_custkey), count(DISTINCT o_orderpriority), CAST(sum({ORDER_TOTAL}) AS DOUBLE) FROM o""",
)
def preaggregate_distinct(spark, sf_dir):
    """Daily sets of customers, stored as bitmaps, answer months, years and the whole exactly."""
    orders = table(spark, sf_dir, "orders")
    measures = [m.distinct_count("customers", "o_custkey"), m.distinct_count("priorities", "o_orderpriority"), m.sum_("total", order_total())]
    codes = {}
    for name, column in (("customers", "o_custkey"), ("priorities", "o_orderpriority")):
        path = scratch_dir(spark, f"codes-{name}")
        # The dictionary of an earlier load, then the values that came since.
        known = bitmaps.dictionary(orders.where("o_orderstatus = 'F'"), column)
        known.write.parquet(path)
        bitmaps.extended(spark.read.parquet(path), orders, column).write.mode("append").parquet(path)
        codes[name] = spark.read.parquet(path)
    daily = scratch_dir(spark, "preaggregate-distinct")
    rows = orders.withColumn("day", F.to_date("o_orderdate"))
    mart_overwrite(m.preaggregate(rows, measures, ["day", "o_orderstatus"], codes=codes), daily)
    partials = spark.read.parquet(daily)
    grains = [
        m.reaggregate(partials.withColumn("start", F.trunc("day", unit)), measures, ["start"]).select(F.lit(unit).alias("grain"), "*")
        for unit in ("month", "year")
    ]
    whole = m.reaggregate(partials, measures).select(F.lit("all").alias("grain"), F.lit(None).cast("date").alias("start"), "*")
    return amounts(union_all(*grains, whole), "total")


@query(
    "row_context_metric_facts",
    f"""WITH o AS (SELECT r_name, CAST(year(o_orderdate) AS BIGINT) AS order_year, CAST(sum({ORDER_TOTAL}) AS DOUBLE) AS order_value, count(*) AS n_orders
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
  WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2),
l AS (SELECT r_name, CAST(year(o_orderdate) AS BIGINT) AS order_year, CAST(sum({REVENUE}) AS DOUBLE) AS revenue, count(*) AS lines
  FROM {SALES_SQL} WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2)
SELECT r_name, order_year, order_value, n_orders, revenue, coalesce(lines, 0) AS lines, CAST(lines AS DOUBLE) / n_orders AS lines_per_order
FROM o FULL JOIN l USING (r_name, order_year)""",
)
def row_context_metric_facts(spark, sf_dir):
    """Metrics of orders and of their lines side by side; no order is counted once per line."""
    measures = [
        m.sum_("order_value", order_total()),
        m.count_rows("n_orders"),
        m.sum_("revenue", revenue()),
        m.count_rows("lines"),
        m.ratio("lines_per_order", "lines", "n_orders"),
    ]
    out = sales_model(spark, sf_dir, measures).query_facts(
        {"orders": ["order_value", "n_orders"], "lineitem": ["revenue", "lines"]},
        by=["r_name", "order_year"],
        where={"c_mktsegment": F.col("c_mktsegment") == "BUILDING"},
        across=["lines_per_order"],
        columns={"order_year": F.year("o_orderdate").cast("bigint")},
        tables=["orders"],
    )
    return revenues(amounts(out, "order_value"), "revenue")


@query(
    "row_context_metric_qualified",
    f"""SELECT n_name AS nation__name, r_name AS region__name, count(*) AS order_rows, CAST(sum({ORDER_TOTAL}) AS DOUBLE) AS total FROM orders
LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
WHERE r_name <> 'ASIA' AND c_name LIKE '%1' GROUP BY 1, 2""",
)
def row_context_metric_qualified(spark, sf_dir):
    """Tables whose keys and names are all called alike."""
    named = {"customer": ("custkey", "nationkey"), "nation": ("nationkey", "regionkey"), "region": ("regionkey", None)}
    tables = {"orders": table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent"), "o_totalprice")}
    for name, (key, parent) in named.items():
        columns = [F.col(f"{name[0]}_{key}").alias("key"), F.col(f"{name[0]}_name").alias("name")]
        tables[name] = table(spark, sf_dir, name).select(*columns, *([F.col(f"{name[0]}_{parent}").alias("parent")] if parent else []))
    chain = ["orders", *named]
    links = [Relationship(a, "parent", b, "key") for a, b in zip(chain, chain[1:])]
    model = SemanticModel(tables, links, [m.count_rows("order_rows"), m.sum_("total", order_total())])
    where = {"region.name": lambda c: c != "ASIA", "customer.name": lambda c: c.endswith("1")}
    return amounts(model.query("orders", ["order_rows", "total"], ["nation.name", "region.name"], where), "total")


@query(
    "row_context_metric",
    f"""SELECT r_name, p_brand, CAST(sum({REVENUE}) AS DOUBLE) AS revenue, sum(l_quantity) AS quantity, count(DISTINCT l_orderkey) AS orders
FROM {SALES_SQL} LEFT JOIN part ON l_partkey = p_partkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1, 2""",
)
def row_context_metric(spark, sf_dir):
    out = sales_model(spark, sf_dir).query(
        "lineitem",
        ["revenue", "quantity", "orders"],
        by=["r_name", "p_brand"],
        where={
            "c_mktsegment": F.col("c_mktsegment") == "BUILDING",
            "o_orderdate": F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"),
        },
    )
    return longs(revenues(out, "revenue"), "orders")
