"""Scalar function and CASE function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabweave.functions import checksum
from tabweave.functions import scalar as s
from tabweave.operators.transforms import category_column
from workload.base import longs, query, table


@query(
    "fn_math",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
  CASE WHEN l_tax = 0 THEN NULL ELSE l_discount / l_tax END AS div_null,
  CASE WHEN l_tax = 0 THEN -1.0 ELSE l_discount / l_tax END AS div_alt,
  abs(l_discount - 0.05) AS abs_gap, round(l_extendedprice, 1) AS price_1, CAST(floor(l_extendedprice) AS BIGINT) AS price_int,
  CAST(ceil(l_extendedprice) AS BIGINT) AS price_ceil, round(sqrt(l_extendedprice), 6) AS root,
  l_quantity * l_quantity AS qty_2, l_quantity % 7 AS qty_mod,
  CAST(ceil(CAST(l_extendedprice AS DECIMAL(18,4)) * 10) AS DOUBLE) / 10 AS price_up,
  CAST(floor(CAST(l_extendedprice AS DECIMAL(18,4)) * 10) AS DOUBLE) / 10 AS price_down
FROM lineitem""",
)
def fn_math(spark, sf_dir):
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
        s.divide(F.col("l_discount"), F.col("l_tax")).alias("div_null"),
        s.divide(F.col("l_discount"), F.col("l_tax"), -1.0).alias("div_alt"),
        F.abs(F.col("l_discount") - 0.05).alias("abs_gap"),
        F.round(price, 1).alias("price_1"),
        s.int_floor(price).alias("price_int"),
        F.ceil(price).alias("price_ceil"),
        F.round(F.sqrt(price), 6).alias("root"),
        F.pow(quantity, F.lit(2)).alias("qty_2"),
        s.mod(quantity, 7).alias("qty_mod"),
        s.round_up(price, 1).alias("price_up"),
        s.round_down(price, 1).alias("price_down"),
    )


@query(
    "fn_text",
    """SELECT c_custkey, CAST(length(c_name) AS BIGINT) AS len, left(c_name, 4) AS left_4, right(c_name, 3) AS right_3,
  substr(c_name, 10, 5) AS mid_5, upper(c_name) AS up, lower(c_name) AS low, trim('  ' || c_mktsegment || ' ') AS trimmed,
  replace(c_name, '#', '-') AS substituted, c_name || ' / ' || c_mktsegment AS joined,
  CAST(CAST(c_acctbal AS DECIMAL(38,2)) AS VARCHAR) AS balance_text,
  CAST(TRY_CAST(right(c_name, 9) AS DECIMAL(38,10)) AS DOUBLE) AS name_value, TRY_CAST(left(c_name, 9) AS DECIMAL(38,10)) IS NULL AS no_value,
  CAST(instr(c_name, '#') AS BIGINT) AS found, CAST(instr(lower(c_name), 'mer') AS BIGINT) AS searched,
  reverse(c_name) AS reversed, split_part(c_name, '#', -1) AS last_part, regexp_extract(c_name, '[0-9]+') AS digits
FROM customer""",
)
def fn_text(spark, sf_dir):
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    out = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.length(name).alias("len"),
        F.left(name, F.lit(4)).alias("left_4"),
        F.right(name, F.lit(3)).alias("right_3"),
        s.mid(name, 10, 5).alias("mid_5"),
        F.upper(name).alias("up"),
        F.lower(name).alias("low"),
        F.trim(F.concat(F.lit("  "), segment, F.lit(" "))).alias("trimmed"),
        s.substitute(name, "#", "-").alias("substituted"),
        s.concatenate(name, " / ", segment).alias("joined"),
        s.format_number(F.col("c_acctbal")).alias("balance_text"),
        s.value(F.right(name, F.lit(9))).cast("double").alias("name_value"),
        s.value(F.left(name, F.lit(9))).isNull().alias("no_value"),
        s.find("#", name).alias("found"),
        s.search("MER", name).alias("searched"),
        F.reverse(name).alias("reversed"),
        F.split_part(name, F.lit("#"), F.lit(-1)).alias("last_part"),
        F.regexp_substr(name, F.lit("[0-9]+")).alias("digits"),
    )
    return longs(out, "len", "found", "searched")


@query(
    "fn_date",
    """SELECT event_id, CAST(year(ts) AS BIGINT) AS y, CAST(month(ts) AS BIGINT) AS mo, CAST(day(ts) AS BIGINT) AS d,
  CAST(hour(ts) AS BIGINT) AS h, CAST(minute(ts) AS BIGINT) AS mi, CAST(second(ts) AS BIGINT) AS sec,
  CAST(dayofweek(ts) + 1 AS BIGINT) AS wd, CAST(weekofyear(ts) AS BIGINT) AS wk,
  last_day(CAST(CAST(ts AS DATE) + INTERVAL 1 MONTH AS DATE)) AS next_month_end, CAST(CAST(ts AS DATE) - INTERVAL 2 MONTH AS DATE) AS two_back,
  make_date(year(ts), 2, 28) AS fixed, CAST(datediff('day', DATE '2023-12-25', CAST(ts AS DATE)) AS BIGINT) AS days,
  CAST(datediff('month', DATE '2023-11-30', CAST(ts AS DATE)) AS BIGINT) AS months,
  CAST(datediff('quarter', DATE '2023-09-30', CAST(ts AS DATE)) AS BIGINT) AS quarters,
  CAST(datediff('year', DATE '2022-12-31', CAST(ts AS DATE)) AS BIGINT) AS years, CAST(date_trunc('quarter', ts) AS DATE) AS q_start
FROM events""",
)
def fn_date(spark, sf_dir):
    ts, day = F.col("ts"), F.to_date("ts")

    def fixed(text):
        return F.lit(text).cast("date")

    out = table(spark, sf_dir, "events").select(
        "event_id",
        F.year(ts).alias("y"),
        F.month(ts).alias("mo"),
        F.day(ts).alias("d"),
        F.hour(ts).alias("h"),
        F.minute(ts).alias("mi"),
        F.second(ts).alias("sec"),
        s.weekday(ts).alias("wd"),
        s.weeknum(ts).alias("wk"),
        s.eomonth(day, 1).alias("next_month_end"),
        s.edate(day, -2).alias("two_back"),
        s.date(F.year(ts), 2, 28).alias("fixed"),
        s.datediff("day", fixed("2023-12-25"), day).alias("days"),
        s.datediff("month", fixed("2023-11-30"), day).alias("months"),
        s.datediff("quarter", fixed("2023-09-30"), day).alias("quarters"),
        s.datediff("year", fixed("2022-12-31"), day).alias("years"),
        F.trunc(day, "quarter").alias("q_start"),
    )
    return longs(out, "y", "mo", "d", "h", "mi", "sec", "wd", "wk", "days", "months", "quarters", "years")


@query(
    "fn_logic",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'small' END AS size_label,
  CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'pending' END AS status_label,
  CASE WHEN o_totalprice < 50000 THEN 1 WHEN o_totalprice < 150000 THEN 2 END AS tier,
  (CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END) IS NULL AS is_pending,
  o_orderstatus = 'F' AND o_totalprice > 100000 AS both_hold, o_orderstatus = 'F' OR o_totalprice > 100000 AS one_holds,
  NOT (o_orderstatus = 'F') AS not_final, TRUE AS yes, FALSE AS no,
  coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END, 'none') AS known,
  coalesce(TRY_CAST(o_orderpriority AS INTEGER), 0) AS number_or_zero,
  TRY_CAST(left(o_orderpriority, 1) AS DOUBLE) IS NOT NULL AS starts_numeric, TRUE AS priority_is_text
FROM orders""",
)
def fn_logic(spark, sf_dir):
    status, total, priority = F.col("o_orderstatus"), F.col("o_totalprice"), F.col("o_orderpriority")
    open_or_final = F.when(status != "P", status)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        s.if_(total > 200000, "large", "small").alias("size_label"),
        s.switch(status, "F", "final", "O", "open", "pending").alias("status_label"),
        s.switch_true(total < 50000, 1, total < 150000, 2).alias("tier"),
        s.is_blank(open_or_final).alias("is_pending"),
        ((status == "F") & (total > 100000)).alias("both_hold"),
        ((status == "F") | (total > 100000)).alias("one_holds"),
        (~(status == "F")).alias("not_final"),
        F.lit(True).alias("yes"),
        F.lit(False).alias("no"),
        F.coalesce(open_or_final, F.lit("none")).alias("known"),
        s.if_error(s.safe_cast(priority, "int"), 0).alias("number_or_zero"),
        s.is_number(F.left(priority, F.lit(1))).alias("starts_numeric"),
        s.is_text(priority).alias("priority_is_text"),
    )


CHECKSUM_SQL = """SELECT c_custkey, c_name, length(digits) > 0 AND list_sum([
    CASE WHEN i % 2 = 1 THEN CAST(digits[i] AS INTEGER)
         WHEN 2 * CAST(digits[i] AS INTEGER) > 9 THEN 2 * CAST(digits[i] AS INTEGER) - 9
         ELSE 2 * CAST(digits[i] AS INTEGER) END FOR i IN range(1, length(digits) + 1)]) % 10 = 0 AS valid
FROM (SELECT c_custkey, c_name, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits FROM customer)"""


@query("checksum_udf", CHECKSUM_SQL)
def checksum_udf(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", checksum.checksum_valid(F.col("c_name")).alias("valid")
    )


EVENT_GROUPS = {"purchase": "revenue", "signup": "growth", "error": "fault"}


@query(
    "sql_udf_case",
    """SELECT event_type, CASE event_type WHEN 'purchase' THEN 'revenue' WHEN 'signup' THEN 'growth' WHEN 'error' THEN 'fault'
  ELSE 'browse' END AS event_group, count(*) AS n FROM events GROUP BY 1, 2""",
)
def sql_udf_case(spark, sf_dir):
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_GROUPS.items())
    checksum.register_case_function(spark, "event_group", f"CASE x {whens} ELSE 'browse' END")
    return (
        table(spark, sf_dir, "events")
        .withColumn("event_group", F.expr("event_group(event_type)"))
        .groupBy("event_type", "event_group")
        .agg(F.count(F.lit(1)).alias("n"))
    )


SEGMENTS = {"BUILDING": "B2B", "MACHINERY": "B2B", "AUTOMOBILE": "B2B"}


@query(
    "script_transform",
    f"""SELECT segment_group, valid, count(*) AS customers FROM ({CHECKSUM_SQL}) JOIN
  (SELECT c_custkey AS k, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN 'B2B' ELSE 'B2C' END AS segment_group
   FROM customer) ON k = c_custkey GROUP BY 1, 2""",
)
def script_transform(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        category_column("c_mktsegment", SEGMENTS, "B2C").alias("segment_group"),
        checksum.checksum_valid(F.col("c_name")).alias("valid"),
    )
    return rows.groupBy("segment_group", "valid").agg(F.count(F.lit(1)).alias("customers"))
