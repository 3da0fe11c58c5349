"""Data quality, audit and reconciliation queries."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from tabweave.operators import quality as q
from tabweave.plans import measures as m
from tabweave.session import scratch_dir
from workload.base import ORDER_TOTAL, amounts, order_total, query, table


@query(
    "validate_required_tables",
    """SELECT 'orders' AS "check", 'rows' AS expected, CASE WHEN n > 0 THEN 'rows' ELSE 'empty' END AS actual, CASE WHEN n > 0 THEN 'SUCCESS' ELSE 'FAILED' END AS status FROM (SELECT count(*) AS n FROM orders)
UNION ALL SELECT 'lineitem', 'rows', CASE WHEN n > 0 THEN 'rows' ELSE 'empty' END, CASE WHEN n > 0 THEN 'SUCCESS' ELSE 'FAILED' END FROM (SELECT count(*) AS n FROM lineitem)
UNION ALL SELECT 'late_orders', 'rows', CASE WHEN n > 0 THEN 'rows' ELSE 'empty' END, CASE WHEN n > 0 THEN 'SUCCESS' ELSE 'WARNING' END
  FROM (SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '2010-01-01')
UNION ALL SELECT 'missing_table', 'rows', 'missing', 'FAILED'""",
)
def validate_required_tables(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    late = orders.where(F.col("o_orderdate") >= F.lit("2010-01-01").cast("timestamp_ntz"))
    required = {"orders": orders, "lineitem": table(spark, sf_dir, "lineitem"), "missing_table": "missing_table"}
    return q.validate_required_tables(spark, required, {"late_orders": late})


@query(
    "audit_record",
    """SELECT CAST(1 AS BIGINT) AS id, CAST(7 AS BIGINT) AS batch_id, 'lineitem' AS file_name, count(*) AS rows_extracted,
  count(*) FILTER (WHERE l_quantity <= 40) AS rows_inserted, count(*) FILTER (WHERE l_quantity > 40) AS rows_rejected, 'Y' AS successful FROM lineitem""",
)
def audit_record(spark, sf_dir):
    seen = Observation("load")
    large = F.col("l_quantity") > 40
    rows = table(spark, sf_dir, "lineitem").observe(
        seen,
        F.count(F.lit(1)).alias("rows_extracted"),
        F.count_if(~large).alias("rows_inserted"),
        F.count_if(large).alias("rows_rejected"),
    )
    rows.where(~large).write.parquet(scratch_dir(spark, "audit"))
    return q.audit_record(spark, 1, 7, "lineitem", seen)


@query(
    "audit_check",
    """SELECT 'unsuccessful_runs' AS "check", CAST(0 AS BIGINT) AS expected, count(*) FILTER (WHERE event_type = 'error') AS actual,
  CASE WHEN count(*) FILTER (WHERE event_type = 'error') = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM events
UNION ALL SELECT 'null_user_id', 0, count(*) - count(user_id), CASE WHEN count(*) = count(user_id) THEN 'PASS' ELSE 'FAIL' END FROM events
UNION ALL SELECT 'null_ts', 0, count(*) - count(ts), CASE WHEN count(*) = count(ts) THEN 'PASS' ELSE 'FAIL' END FROM events""",
)
def audit_check(spark, sf_dir):
    return q.audit_check(table(spark, sf_dir, "events"), F.col("event_type") != "error", ["user_id", "ts"])


@query(
    "row_count_reconcile",
    """WITH a AS (SELECT o_orderkey AS order_key FROM orders), b AS (SELECT DISTINCT l_orderkey AS order_key FROM lineitem),
e AS (SELECT order_key, count(*) AS expected FROM a GROUP BY 1), g AS (SELECT order_key, count(*) AS actual FROM b GROUP BY 1)
SELECT order_key, CAST(coalesce(expected, 0) AS BIGINT) AS expected, CAST(coalesce(actual, 0) AS BIGINT) AS actual,
  CASE WHEN coalesce(expected, 0) = coalesce(actual, 0) THEN 'PASS' ELSE 'FAIL' END AS status FROM e FULL JOIN g USING (order_key)""",
)
def row_count_reconcile(spark, sf_dir):
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"))
    actual = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_key")).distinct()
    return q.row_count_reconcile(expected, actual, "order_key")


@query(
    "measure_parity",
    f"""WITH e AS (SELECT o_orderstatus, o_orderpriority, CAST(sum({ORDER_TOTAL}) AS DOUBLE) AS expected FROM orders GROUP BY 1, 2),
a AS (SELECT o_orderstatus, o_orderpriority, CAST(sum({ORDER_TOTAL}) AS DOUBLE) AS actual FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1, 2)
SELECT o_orderstatus, o_orderpriority, expected, actual, CASE WHEN abs(expected - actual) <= 3000000 THEN 'PASS' ELSE 'FAIL' END AS status
FROM e FULL JOIN a USING (o_orderstatus, o_orderpriority)""",
)
def measure_parity(spark, sf_dir):
    by, total = ["o_orderstatus", "o_orderpriority"], m.sum_("total", order_total())
    orders = table(spark, sf_dir, "orders")
    shipped = orders.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    sides = [amounts(m.evaluate(df, [total], by), "total") for df in (orders, shipped)]
    return q.measure_parity(*sides, by, "total", 3_000_000)


@query(
    "column_reconcile",
    """WITH m AS (SELECT DISTINCT url_host AS name FROM (SELECT split_part(url, '/', 3) AS url_host FROM pages)),
p AS (SELECT DISTINCT replace(upper(split_part(url, '/', 3)), 'BLOG.', 'WWW.') AS name FROM pages)
SELECT m.name AS model_name, p.name AS physical_name, CASE WHEN p.name IS NULL THEN 'missing' WHEN m.name IS NULL THEN 'extra' ELSE 'mapped' END AS status
FROM (SELECT upper(name) AS u, min(name) AS name FROM m GROUP BY 1) m FULL JOIN p ON m.u = p.name""",
)
def column_reconcile(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("name"))
    # Physical names in capitals, with one prefix renamed: some are missing, some extra.
    physical = hosts.select(F.replace(F.upper("name"), F.lit("BLOG."), F.lit("WWW.")).alias("name"))
    return q.column_reconcile(hosts, physical, "name")


@query(
    "max_length_profile",
    """SELECT column_name, max_length, declared, CASE WHEN max_length <= declared THEN 'PASS' ELSE 'FAIL' END AS status FROM (
  SELECT 'text' AS column_name, CAST(max(length(text)) AS INTEGER) AS max_length, 4000 AS declared FROM documents
  UNION ALL SELECT 'lang', CAST(max(length(lang)) AS INTEGER), 2 FROM documents
  UNION ALL SELECT 'source', CAST(max(length(source)) AS INTEGER), 10 FROM documents)""",
)
def max_length_profile(spark, sf_dir):
    return q.max_length_profile(table(spark, sf_dir, "documents"), {"text": 4000, "lang": 2, "source": 10})


@query(
    "type_safety_profile",
    """WITH t AS (SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_totalprice AS VARCHAR) AS o_totalprice,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_day, o_orderpriority, right('000000000' || CAST(o_custkey AS VARCHAR), 9) AS cust_code,
  CAST(o_orderstatus = 'F' AS VARCHAR) AS is_final FROM orders),
c AS (SELECT unnest(['o_orderkey', 'o_totalprice', 'order_day', 'o_orderpriority', 'cust_code', 'is_final']) AS column_name,
  unnest([o_orderkey, o_totalprice, order_day, o_orderpriority, cust_code, is_final]) AS v FROM t)
SELECT column_name, count(v) AS filled, count(*) FILTER (WHERE regexp_full_match(v, '-?[0-9]+(\\.[0-9]+)?')) AS numeric,
  count(*) FILTER (WHERE regexp_full_match(v, '-?[0-9]+')) AS whole, count(*) FILTER (WHERE regexp_matches(v, '^-?0[0-9]')) AS padded,
  count(*) FILTER (WHERE regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND TRY_CAST(v AS DATE) IS NOT NULL) AS dates,
  count(*) FILTER (WHERE lower(v) IN ('true', 'false')) AS logical,
  CASE column_name WHEN 'o_orderkey' THEN 'bigint' WHEN 'o_totalprice' THEN 'double' WHEN 'order_day' THEN 'date' WHEN 'is_final' THEN 'boolean' ELSE 'string' END AS declare
FROM c GROUP BY 1""",
)
def type_safety_profile(spark, sf_dir):
    text = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string"),
        F.col("o_totalprice").cast("decimal(12,2)").cast("string").alias("o_totalprice"),
        F.to_date("o_orderdate").cast("string").alias("order_day"),
        "o_orderpriority",
        F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("cust_code"),
        (F.col("o_orderstatus") == "F").cast("string").alias("is_final"),
    )
    return q.type_safety_profile(text, text.columns)
