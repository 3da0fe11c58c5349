"""Row transform, routing, ordering and set operation queries."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from tabweave.operators import transforms as t
from tabweave.operators.joins import lookup_default
from tabweave.session import scratch_dir
from workload.base import REVENUE, query, revenue, revenues, sales_model, table


def cut(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query(
    "derived_column",
    """SELECT o_orderkey, upper(o_orderpriority) AS o_orderpriority, o_totalprice * 1.1 AS gross,
  CAST(year(o_orderdate) AS BIGINT) AS order_year FROM orders""",
)
def derived_column(spark, sf_dir):
    out = t.derived_column(
        table(spark, sf_dir, "orders"),
        o_orderpriority=F.upper("o_orderpriority"),
        gross=F.col("o_totalprice") * 1.1,
        order_year=F.year("o_orderdate").cast("bigint"),
    )
    return out.select("o_orderkey", "o_orderpriority", "gross", "order_year")


@query(
    "data_conversion",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey,
  CAST(CAST(c_acctbal AS DECIMAL(19,4)) AS VARCHAR) AS c_acctbal, c_name FROM customer""",
)
def data_conversion(spark, sf_dir):
    kinds = {"c_custkey": "string", "c_nationkey": "int64", "c_acctbal": "currency"}
    rows = table(spark, sf_dir, "customer").select(*kinds, "c_name")
    converted = t.data_conversion(rows, {c: t.spark_type(k) for c, k in kinds.items()})
    # As text, so that the scale of the amount shows.
    return t.data_conversion(converted, {"c_acctbal": "string"})


@query(
    "safe_conversion",
    """SELECT page_id, TRY_CAST(regexp_extract(url, '([^/?#=]*)$', 1) AS BIGINT) AS tail_number, url FROM pages""",
)
def safe_conversion(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "([^/?#=]*)$", 1).alias("tail_number"), "url")
    return t.safe_conversion(rows, {"tail_number": "bigint"})


@query(
    "calculated_column",
    """SELECT p_partkey, p_name, p_retailprice, p_size, p_retailprice * p_size AS stock_value,
  p_brand || ' ' || p_type AS full_type, CAST(NULL AS BIGINT) AS untranslated FROM part""",
)
def calculated_column(spark, sf_dir):
    return t.calculated_column(
        table(spark, sf_dir, "part"),
        {
            "stock_value": F.col("p_retailprice") * F.col("p_size"),
            "full_type": F.concat_ws(" ", "p_brand", "p_type"),
            "untranslated": "int64",
        },
    ).drop("p_brand", "p_type")


@query("alias_view", 'SELECT s_suppkey AS "Supplier Key", s_name AS "Supplier", s_acctbal AS "Balance" FROM supplier')
def alias_view(spark, sf_dir):
    names = {"S_SUPPKEY": "Supplier Key", "s_name": "Supplier", "S_AcctBal": "Balance", "s_phone": "Phone"}
    return t.alias_view(table(spark, sf_dir, "supplier"), names)


@query("hidden_prune", "SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part")
def hidden_prune(spark, sf_dir):
    return t.hidden_prune(table(spark, sf_dir, "part"), ["p_retailprice"])


@query("perspective_view", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders")
def perspective_view(spark, sf_dir):
    model = sales_model(
        spark, sf_dir, perspectives={"Sales": {"orders": ["o_orderkey", "o_orderdate", "o_totalprice"]}}
    )
    return model.perspective("Sales", "orders")


@query("row_filter", "SELECT * FROM events WHERE event_type = 'purchase' AND value > 100")
def row_filter(spark, sf_dir):
    return t.row_filter(table(spark, sf_dir, "events"), (F.col("event_type") == "purchase") & (F.col("value") > 100))


@query("distinct_values", "SELECT DISTINCT p_brand, p_type FROM part")
def distinct_values(spark, sf_dir):
    return t.distinct_values(table(spark, sf_dir, "part"), "p_brand", "p_type")


def _routes():
    return [
        ("priority", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")),
        ("large", F.col("o_totalprice") > 300000),
    ]


ROUTE_SQL = """CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'priority' WHEN o_totalprice > 300000 THEN 'large' ELSE 'default' END"""


@query("conditional_split", f"SELECT o_orderkey, o_totalprice, {ROUTE_SQL} AS output FROM orders")
def conditional_split(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    outputs = t.conditional_split(rows, _routes())
    return t.union_all(
        *[df.select("o_orderkey", "o_totalprice", F.lit(name).alias("output")) for name, df in outputs.items()]
    )


@query(
    "multicast",
    """SELECT 'by_status' AS branch, o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'by_priority', o_orderpriority, count(*) FROM orders GROUP BY 2""",
)
def multicast(spark, sf_dir):
    one, two = t.multicast(table(spark, sf_dir, "orders"), 2)
    n = F.count(F.lit(1)).alias("n")
    return t.union_all(
        one.groupBy(F.col("o_orderstatus").alias("label")).agg(n).withColumn("branch", F.lit("by_status")),
        two.groupBy(F.col("o_orderpriority").alias("label")).agg(n).withColumn("branch", F.lit("by_priority")),
    )


@query(
    "row_count",
    "SELECT l_returnflag, (SELECT count(*) FROM lineitem) AS rows_passed, count(*) AS n FROM lineitem GROUP BY 1",
)
def row_count(spark, sf_dir):
    passed = Observation("passed")
    rows = t.row_count(table(spark, sf_dir, "lineitem"), passed)
    path = scratch_dir(spark, "row-count")
    rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
    return spark.read.parquet(path).withColumn("rows_passed", F.lit(passed.get["rows"]).cast("bigint"))


@query(
    "empty_to_null",
    "SELECT doc_id, nullif(trim(lang), '') AS lang, nullif(trim(source), '') AS source FROM documents",
)
def empty_to_null(spark, sf_dir):
    return t.empty_to_null(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "lang", "source")


@query(
    "zero_datetime_to_null",
    """SELECT o_orderkey, CASE WHEN o_orderdate NOT IN (TIMESTAMP '1995-01-01', TIMESTAMP '1995-01-02') THEN o_orderdate END AS o_orderdate
FROM orders""",
)
def zero_datetime_to_null(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return t.zero_datetime_to_null(rows, "o_orderdate", ["1995-01-01 00:00:00", "1995-01-02 00:00:00"])


@query(
    "lookup_category_map",
    """SELECT event_id, event_type, CASE event_type WHEN 'purchase' THEN 'revenue' WHEN 'signup' THEN 'growth' ELSE 'other' END AS category,
  CASE event_type WHEN 'purchase' THEN 'revenue' WHEN 'signup' THEN 'growth' ELSE 'other' END AS seed_category FROM events""",
)
def lookup_category_map(spark, sf_dir):
    categories = {"purchase": "revenue", "signup": "growth"}
    seed = spark.createDataFrame(list(categories.items()), "event_type string, seed_category string")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    mapped = rows.withColumn("category", t.category_column("event_type", categories, "other"))
    return lookup_default(mapped, seed, "event_type", {"seed_category": "other"})


@query(
    "literal_system_vars",
    """SELECT o_orderkey, 'DailyLoad' AS package_name, CAST(7 AS INTEGER) AS batch_id,
  (SELECT max(o_orderdate) FROM orders) AS last_order, (SELECT count(*) FROM orders) AS order_count FROM orders""",
)
def literal_system_vars(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    bound = orders.agg(F.max("o_orderdate").alias("last_order"), F.count(F.lit(1)).alias("order_count"))
    return t.literal_columns(orders.select("o_orderkey"), {"package_name": "DailyLoad", "batch_id": 7}, bound)


@query(
    "surrogate_key",
    """SELECT o_orderkey, o_custkey, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id
FROM orders""",
)
def surrogate_key(spark, sf_dir):
    start = t.next_key(table(spark, sf_dir, "customer"), "c_custkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return t.surrogate_key(rows, ["o_orderdate", "o_orderkey"], start).drop("o_orderdate")


@query(
    "last_row_filter",
    "SELECT o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= (SELECT count(*) / 3 FROM orders)",
)
def last_row_filter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return t.last_row_filter(orders, ["o_orderdate", "o_orderkey"], orders.count() / 3)


@query(
    "add_columns",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) AS net,
  CAST(datediff('day', o_orderdate, l_shipdate) AS BIGINT) AS days_to_ship FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def add_columns(spark, sf_dir):
    rows = sales_model(spark, sf_dir).star("lineitem", ["orders"])
    return t.derived_column(
        rows,
        net=F.col("l_extendedprice") * (1 - F.col("l_discount")),
        days_to_ship=F.datediff("l_shipdate", "o_orderdate").cast("bigint"),
    ).select("l_orderkey", "l_linenumber", "l_partkey", "net", "days_to_ship")


@query("sort_transform", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey")
def sort_transform(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return t.sort_transform(rows, F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").asc_nulls_last())


@query(
    "sort_by_column",
    "SELECT monthname(o_orderdate) AS month_name, min(CAST(month(o_orderdate) AS BIGINT)) AS month_num FROM orders GROUP BY 1 ORDER BY 2",
)
def sort_by_column(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "MMMM").alias("month_name"), F.month("o_orderdate").cast("bigint").alias("month_num")
    )
    return t.sort_by_column(rows, "month_name", "month_num")


@query(
    "top_n",
    f"""SELECT l_partkey, CAST(total AS DOUBLE) AS revenue FROM (SELECT l_partkey, sum({REVENUE}) AS total FROM lineitem GROUP BY 1)
ORDER BY total DESC, l_partkey LIMIT 10""",
)
def top_n(spark, sf_dir):
    totals = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum(revenue()).alias("revenue"))
    return revenues(t.top_n(totals, "revenue", 10, ["l_partkey"]), "revenue")


@query(
    "union_all",
    """SELECT c_custkey AS party_key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier""",
)
def union_all(spark, sf_dir):
    customers = t.alias_view(
        table(spark, sf_dir, "customer"),
        {"c_custkey": "party_key", "c_name": "name", "c_acctbal": "balance", "c_mktsegment": "segment"},
    )
    suppliers = t.alias_view(
        table(spark, sf_dir, "supplier"), {"s_suppkey": "party_key", "s_name": "name", "s_acctbal": "balance"}
    )
    return t.union_all(customers, suppliers)


@query(
    "merge_sorted",
    "SELECT o_orderkey AS key, o_orderdate AS moment FROM orders UNION ALL SELECT l_orderkey, l_shipdate FROM lineitem ORDER BY moment, key",
)
def merge_sorted(spark, sf_dir):
    orders = t.alias_view(table(spark, sf_dir, "orders"), {"o_orderkey": "key", "o_orderdate": "moment"})
    lines = t.alias_view(table(spark, sf_dir, "lineitem"), {"l_orderkey": "key", "l_shipdate": "moment"})
    return t.merge_sorted(orders, lines, order_by=["moment", "key"])


@query(
    "multi_source_union",
    """SELECT o_orderkey, o_totalprice, 'hot' AS origin FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'
UNION ALL SELECT o_orderkey, o_totalprice, 'history' FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01'""",
)
def multi_source_union(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    hot = orders.where(F.col("o_orderdate") >= cut("2001-01-01"))
    history = orders.where(F.col("o_orderdate") < cut("2001-03-01"))
    both = t.multi_source_union(
        hot.select("o_orderkey", "o_totalprice", F.lit("hot").alias("origin")),
        history.select("o_orderkey", "o_totalprice", F.lit("history").alias("origin")),
        "o_orderkey",
    )
    return both


@query(
    "name_set_difference",
    """WITH a AS (SELECT DISTINCT upper(c_name) AS name FROM customer), b AS (SELECT DISTINCT upper(replace(s_name, 'Supplier', 'customer')) AS name FROM supplier)
SELECT name, 'left' AS side FROM a WHERE name NOT IN (SELECT name FROM b)
UNION ALL SELECT name, 'right' FROM b WHERE name NOT IN (SELECT name FROM a)""",
)
def name_set_difference(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    suppliers = table(spark, sf_dir, "supplier").select(F.replace("s_name", F.lit("Supplier"), F.lit("customer")).alias("name"))
    return t.name_set_difference(customers, suppliers, "name")
