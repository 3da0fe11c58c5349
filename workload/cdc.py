"""Change feed queries, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabweave.operators import cdc
from tabweave.operators.transforms import union_all
from tabweave.plans import measures as m
from tabweave.session import cut_lineage, scratch_dir
from tabweave.streaming import feeds
from workload.base import ORDER_TOTAL, amounts, cents, order_total, query, table

KEY = ["o_orderkey"]


def cut(text: str):
    return F.lit(text).cast("timestamp_ntz")


def snapshots(spark, sf_dir):
    """Two states of the order book.

    The old one ends with the year 2000. The new one dropped the orders of 1995,
    has the orders of 2001, and closed the pending orders of earlier years.
    """
    book = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    old = book.where(F.col("o_orderdate") < cut("2001-01-01"))
    closed = (F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < cut("2001-01-01"))
    new = book.where(F.col("o_orderdate") >= cut("1996-01-01")).withColumn(
        "o_orderstatus", F.when(closed, F.lit("F")).otherwise(F.col("o_orderstatus"))
    )
    return old, new


NEW_STATUS = "CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '2001-01-01' THEN 'F' ELSE o_orderstatus END"
BOOK_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders"
OLD_SQL = f"{BOOK_SQL} WHERE o_orderdate < TIMESTAMP '2001-01-01'"
NEW_SQL = f"SELECT o_orderkey, o_custkey, {NEW_STATUS} AS o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'"
CHANGED = "o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '2001-01-01'"
DIFF_SQL = f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, 'INSERT' AS _action, false AS _is_update FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, 'DELETE', false FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'
UNION ALL SELECT o_orderkey, o_custkey, 'F', o_totalprice, o_orderdate, 'INSERT', true FROM orders WHERE {CHANGED}
UNION ALL SELECT o_orderkey, o_custkey, 'P', o_totalprice, o_orderdate, 'DELETE', true FROM orders WHERE {CHANGED}"""


def changes(spark, sf_dir):
    """The change feed as it would be stored: read by several branches, computed once."""
    return cut_lineage(cdc.cdc_diff(*snapshots(spark, sf_dir), KEY))


@query("cdc_diff", DIFF_SQL)
def cdc_diff(spark, sf_dir):
    return cdc.cdc_diff(*snapshots(spark, sf_dir), KEY)


@query(
    "cdc_source",
    f"{DIFF_SQL} UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, 'INSERT', false FROM ({OLD_SQL})",
)
def cdc_source(spark, sf_dir):
    # First read: the initial rows of the old state, then the changes stored by the feed.
    old, new = snapshots(spark, sf_dir)
    path = scratch_dir(spark, "changes")
    cdc.cdc_diff(old, new, KEY).write.parquet(path)
    return union_all(cdc.initial_rows(old), spark.read.parquet(path))


@query(
    "cdc_split",
    f"""SELECT CASE WHEN _action = 'DELETE' THEN 'delete' WHEN _is_update THEN 'update' ELSE 'insert' END AS path, o_orderkey, o_orderstatus
FROM ({DIFF_SQL}) WHERE NOT (_action = 'DELETE' AND _is_update)""",
)
def cdc_split(spark, sf_dir):
    parts = dict(zip(("insert", "update", "delete"), cdc.cdc_split(changes(spark, sf_dir))))
    return union_all(*[df.select(F.lit(n).alias("path"), "o_orderkey", "o_orderstatus") for n, df in parts.items()])


# Events as changes of a user record: signup inserts, error deletes, the rest updates.
EVENT_CHANGES = """SELECT user_id, event_id, event_type, value, CASE event_type WHEN 'error' THEN 'DELETE' ELSE 'INSERT' END AS _action,
  event_type NOT IN ('signup', 'error') AS _is_update, event_id AS _seq FROM events"""


def event_changes(events):
    return events.select(
        "user_id",
        "event_id",
        "event_type",
        "value",
        F.when(F.col("event_type") == "error", F.lit("DELETE")).otherwise(F.lit("INSERT")).alias("_action"),
        (~F.col("event_type").isin("signup", "error")).alias("_is_update"),
        F.col("event_id").alias("_seq"),
    )


NET_SQL = f"""WITH c AS ({EVENT_CHANGES}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY _seq DESC) AS last_rn,
  first_value(_action = 'DELETE' OR _is_update) OVER (PARTITION BY user_id ORDER BY _seq) AS known FROM c)
SELECT user_id, event_id, event_type, value, _action, _action = 'INSERT' AND known AS _is_update, _seq FROM r WHERE last_rn = 1 AND (known OR _action = 'INSERT')"""


@query("cdc_net_changes", NET_SQL)
def cdc_net_changes(spark, sf_dir):
    return cdc.cdc_net_changes(event_changes(table(spark, sf_dir, "events")), ["user_id"])


@query("cdc_apply_insert", f"{OLD_SQL} UNION ALL {BOOK_SQL} WHERE o_orderdate >= TIMESTAMP '2001-01-01'")
def cdc_apply_insert(spark, sf_dir):
    old, _ = snapshots(spark, sf_dir)
    inserts, _, _ = cdc.cdc_split(changes(spark, sf_dir))
    return cdc.cdc_apply_insert(old, inserts, KEY)


@query(
    "cdc_apply_update",
    f"SELECT o_orderkey, o_custkey, CASE WHEN {CHANGED} THEN 'F' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01'",
)
def cdc_apply_update(spark, sf_dir):
    old, _ = snapshots(spark, sf_dir)
    _, updates, _ = cdc.cdc_split(changes(spark, sf_dir))
    return cdc.cdc_apply_update(old, updates, KEY)


@query("cdc_apply_delete", f"{OLD_SQL} AND o_orderdate >= TIMESTAMP '1996-01-01'")
def cdc_apply_delete(spark, sf_dir):
    old, _ = snapshots(spark, sf_dir)
    _, _, deletes = cdc.cdc_split(changes(spark, sf_dir))
    return cdc.cdc_apply_delete(old, deletes, KEY)


@query("cdc_merge", NEW_SQL)
def cdc_merge(spark, sf_dir):
    old, _ = snapshots(spark, sf_dir)
    feed = changes(spark, sf_dir).withColumn("_seq", F.lit(1))
    return cdc.cdc_merge(old, cdc.cdc_net_changes(feed, KEY), KEY)


@query(
    "cdc_counts",
    f"""SELECT count(*) FILTER (WHERE _action = 'INSERT' AND NOT _is_update) AS inserts, count(*) FILTER (WHERE _action = 'INSERT' AND _is_update) AS updates,
  count(*) FILTER (WHERE _action = 'DELETE' AND NOT _is_update) AS deletes FROM ({DIFF_SQL})""",
)
def cdc_counts(spark, sf_dir):
    return cdc.cdc_counts(cdc.cdc_diff(*snapshots(spark, sf_dir), KEY))


@query(
    "watermark_extract",
    "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate > (SELECT max(l_shipdate) - INTERVAL 1 YEAR FROM lineitem)",
)
def watermark_extract(spark, sf_dir):
    state = table(spark, sf_dir, "lineitem").select(
        (F.col("l_shipdate") - F.expr("INTERVAL 1 YEAR")).alias("last_processed")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return cdc.watermark_extract(orders, "o_orderdate", state)


@query(
    "cdc_state_window",
    """SELECT 'orders' AS table_name, max(o_orderdate) AS last_processed, CAST(NULL AS VARCHAR) AS stream_offset, 'idle' AS status FROM orders
UNION ALL SELECT 'events', max(ts), NULL, 'running' FROM events""",
)
def cdc_state_window(spark, sf_dir):
    columns = "table_name string, last_processed timestamp_ntz, stream_offset string, status string"
    state = spark.createDataFrame([], columns)
    for name, stamp in (("orders", "o_orderdate"), ("events", "ts")):
        state = cdc.mark_state(state, name, "running")
        mark = table(spark, sf_dir, name).agg(F.max(stamp)).first()[0]
        state = cdc.mark_state(state, name, "running", last_processed=mark)
    return cdc.mark_state(state, "orders", "idle")


def _event_feed(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return feeds.file_feed(spark, sf_dir, schema, glob="events.parquet")


@query("stream_append", "SELECT event_id, user_id, event_type, value FROM events WHERE event_type <> 'error'")
def stream_append(spark, sf_dir):
    # The feed is a change stream; only its INSERT rows reach the target.
    rows = event_changes(_event_feed(spark, sf_dir))
    out = scratch_dir(spark, "append")
    feeds.stream_append(rows, out, scratch_dir(spark, "append-checkpoint"), feeds.AVAILABLE_NOW).awaitTermination()
    return spark.read.parquet(out).select("event_id", "user_id", "event_type", "value")


@query("stream_cdc_foreach_batch", f"SELECT user_id, event_id, event_type, value FROM ({NET_SQL}) WHERE _action = 'INSERT'")
def stream_cdc_foreach_batch(spark, sf_dir):
    rows = event_changes(_event_feed(spark, sf_dir))
    schema = event_changes(table(spark, sf_dir, "events")).select("user_id", "event_id", "event_type", "value").schema
    target = feeds.ChangeTable(spark, scratch_dir(spark, "change-table"), ["user_id"], schema)
    feeds.stream_cdc_foreach_batch(rows, target, trigger=feeds.AVAILABLE_NOW).awaitTermination()
    return target.current()


@query(
    "auto_ingest",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
)
def auto_ingest(spark, sf_dir):
    landing, out = scratch_dir(spark, "landing"), scratch_dir(spark, "ingested")
    orders = table(spark, sf_dir, "orders")
    orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority").write.partitionBy("o_orderpriority").csv(landing)
    feeds.auto_ingest(
        spark,
        landing,
        "o_orderkey bigint, o_custkey bigint, o_totalprice double",
        out,
        scratch_dir(spark, "ingest-checkpoint"),
        feeds.AVAILABLE_NOW,
        max_files=2,
    ).awaitTermination()
    return spark.read.parquet(out).drop("file_name")


@query(
    "incremental_aggregate",
    """SELECT event_type, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total, count(*) AS n, max(value) AS largest FROM events GROUP BY 1""",
)
def incremental_aggregate(spark, sf_dir):
    measures = [
        m.sum_("total", cents("value")),
        m.count_rows("n"),
        m.maximum("largest", "value"),
    ]
    summary = feeds.IncrementalAggregate(spark, scratch_dir(spark, "summary"), measures, ["event_type"])
    summary.start(_event_feed(spark, sf_dir), feeds.AVAILABLE_NOW).awaitTermination()
    return amounts(summary.result(), "total")


@query(
    "incremental_aggregate_changes",
    f"""SELECT o_orderstatus, CAST(sum({ORDER_TOTAL}) AS DOUBLE) AS total, count(*) AS n, count(DISTINCT o_custkey) AS customers,
  min(o_orderdate) AS earliest, max(o_totalprice) AS largest FROM ({NEW_SQL}) GROUP BY 1""",
)
def incremental_aggregate_changes(spark, sf_dir):
    # The old order book comes as inserts, then the deletes, updates and inserts that lead to the new one.
    old, new = snapshots(spark, sf_dir)
    path = scratch_dir(spark, "order-changes")
    for part in (cdc.initial_rows(old), cdc.cdc_diff(old, new, KEY)):
        part.write.mode("append").parquet(path)
    feed = feeds.file_feed(spark, path, cdc.initial_rows(old).schema, max_files=6)
    measures = [
        m.sum_("total", order_total()),
        m.count_rows("n"),
        m.distinct_count("customers", "o_custkey"),
        m.minimum("earliest", "o_orderdate"),
        m.maximum("largest", "o_totalprice"),
    ]
    summary = feeds.IncrementalAggregate(spark, scratch_dir(spark, "order-summary"), measures, ["o_orderstatus"])
    summary.start(feed, feeds.AVAILABLE_NOW).awaitTermination()
    return amounts(summary.result(), "total")


@query(
    "stream_multi_target",
    """SELECT 'purchases' AS target, user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 2
UNION ALL SELECT 'errors', user_id, count(*) FROM events WHERE event_type = 'error' GROUP BY 2""",
)
def stream_multi_target(spark, sf_dir):
    root = scratch_dir(spark, "fan-out")
    targets = {
        "purchases": lambda df: df.where("event_type = 'purchase'").select("event_id", "user_id"),
        "errors": lambda df: df.where("event_type = 'error'").select("event_id", "user_id"),
    }
    feeds.stream_multi_target(
        _event_feed(spark, sf_dir), targets, root, scratch_dir(spark, "fan-checkpoint"), feeds.AVAILABLE_NOW
    ).awaitTermination()
    return union_all(
        *[spark.read.parquet(f"{root}/{n}").select(F.lit(n).alias("target"), "user_id") for n in targets]
    ).groupBy("target", "user_id").agg(F.count(F.lit(1)).alias("n"))
