"""Source and sink queries. File inputs are written by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabweave.session import scratch_dir
from tabweave.sources import files, sinks
from tabweave.sources.nested import nested_json_flatten
from workload.base import query, table

ORDER_DDL = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
TABLES = ["customer", "events", "lineitem", "orders", "part", "supplier"]


@query("table_source", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def table_source(spark, sf_dir):
    orders = files.table_source(spark, f"{sf_dir}/orders.parquet", ORDER_DDL)
    return orders.select("o_orderkey", "o_custkey", "o_totalprice")


def _order_lines(spark, sf_dir, sep="|", **options):
    """Orders as delimited text: status P is written as the token NULL, F as empty."""
    path = scratch_dir(spark, "delimited")
    token = F.when(F.col("o_orderstatus") == "P", F.lit("NULL")).when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))
    rows = table(spark, sf_dir, "orders").withColumn("o_orderstatus", token)
    sinks.delimited_sink(rows, path, sep=sep, timestampNTZFormat="yyyy-MM-dd HH:mm:ss", **options)
    return path


READ_SQL = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'O' THEN 'O' END AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"""


@query("delimited_source", READ_SQL)
def delimited_source(spark, sf_dir):
    return files.delimited_source(
        spark, _order_lines(spark, sf_dir), ORDER_DDL, sep="|", null_tokens=("", "NULL")
    )


@query("cr_line_source", READ_SQL)
def cr_line_source(spark, sf_dir):
    path = _order_lines(spark, sf_dir, lineSep="\r")
    return files.cr_line_source(spark, path, ORDER_DDL, sep="|", null_tokens=("", "NULL"))


@query("positional_source", "SELECT o_orderkey AS c1, o_custkey AS c2, CASE WHEN o_orderstatus = 'O' THEN 'O' END AS c3, o_totalprice AS c4 FROM orders")
def positional_source(spark, sf_dir):
    path = _order_lines(spark, sf_dir, sep=",")
    return files.positional_source(
        spark, path, ["bigint", "bigint", "string", "double"], header=True, null_tokens=("", "NULL")
    )


def _folders(spark, sf_dir):
    """Order files in one folder per priority and month."""
    path = scratch_dir(spark, "folders")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year")
    )
    rows.hint("rebalance", F.col("priority"), F.col("year")).write.partitionBy("priority", "year").csv(path)
    return path


@query(
    "multi_file_source",
    "SELECT o_orderkey, o_totalprice, o_orderpriority AS priority FROM orders",
)
def multi_file_source(spark, sf_dir):
    rows = files.multi_file_source(
        spark, _folders(spark, sf_dir), "o_orderkey bigint, o_totalprice double", glob="*.csv", header=False
    )
    folder = F.regexp_extract(F.url_decode("file_path"), "priority=([^/]*)/", 1)
    return rows.select("o_orderkey", "o_totalprice", folder.alias("priority"))


@query(
    "file_listing",
    "SELECT DISTINCT o_orderpriority AS priority, CAST(year(o_orderdate) AS VARCHAR) AS year, true AS has_bytes FROM orders",
)
def file_listing(spark, sf_dir):
    listed = files.file_listing(spark, _folders(spark, sf_dir), "*.csv", depth=2)
    path = F.url_decode("path")
    return listed.groupBy(
        F.regexp_extract(path, "priority=([^/]*)/", 1).alias("priority"), F.regexp_extract(path, "year=([^/]*)/", 1).alias("year")
    ).agg((F.sum("length") > 0).alias("has_bytes"))


@query("file_name_column", "SELECT page_id, split_part(url, '/', -1) AS file_name FROM pages")
def file_name_column(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", files.file_name(F.col("url")).alias("file_name"))


RAW_DDL = "o_orderkey bigint, o_totalprice double, o_orderpriority string"


def _uneven_lines(spark, sf_dir):
    """P rows carry a price that is no number, F rows are short, O rows of high value are long."""
    path = scratch_dir(spark, "uneven")
    key, price = F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    line = (
        F.when(F.col("o_orderstatus") == "P", F.concat_ws("|", key, F.lit("n/a"), "o_orderpriority"))
        .when(F.col("o_orderstatus") == "F", F.concat_ws("|", key, price))
        .when(F.col("o_totalprice") > 250000, F.concat_ws("|", key, price, "o_orderpriority", F.lit("surplus")))
        .otherwise(F.concat_ws("|", key, price, "o_orderpriority"))
    )
    table(spark, sf_dir, "orders").select(line.alias("value")).write.text(path)
    return path


@query(
    "bulk_load_tolerant",
    "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderstatus <> 'P'",
)
def bulk_load_tolerant(spark, sf_dir):
    return files.bulk_load_tolerant(spark, _uneven_lines(spark, sf_dir), RAW_DDL, sep="|", header=False)


@query(
    "reject_rows",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'CONVERSION' ELSE 'FIELD_COUNT' END AS error_code,
  CASE WHEN o_orderstatus = 'P' THEN 'o_totalprice' END AS error_column FROM orders
WHERE o_orderstatus IN ('P', 'F') OR o_totalprice > 250000""",
)
def reject_rows(spark, sf_dir):
    rows = files.text_rows(spark, _uneven_lines(spark, sf_dir), RAW_DDL, sep="|", header=False, keep_corrupt=True)
    _, rejects = files.reject_rows(rows, RAW_DDL, strict=True)
    return rejects.select("o_orderkey", "error_code", "error_column")


@query(
    "nested_json_flatten",
    """SELECT r_name AS model, n_name AS table_name, c_mktsegment AS column_name, CAST(row_number() OVER (PARTITION BY n_name ORDER BY c_mktsegment) - 1 AS INTEGER) AS column_ordinal
FROM (SELECT DISTINCT r_name, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
)
def nested_json_flatten_(spark, sf_dir):
    # One document per nation: its region as the model, its customer segments as columns.
    path = scratch_dir(spark, "models")
    names = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    tables = names.groupBy("r_name", "n_name").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("segments"))
    columns = F.transform("segments", lambda s: F.struct(s.alias("name"), F.lit("string").alias("dataType")))
    documents = tables.select(
        F.struct(
            F.col("r_name").alias("name"), F.array(F.struct(F.col("n_name").alias("name"), columns.alias("columns"))).alias("tables")
        ).alias("model")
    )
    documents.write.json(path)
    return nested_json_flatten(spark, path, multi_line=False)["columns"].select(
        "model", "table_name", "column_name", "column_ordinal"
    )


@query(
    "seed_source",
    """SELECT prefix, count(*) AS customers FROM (SELECT left(lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 7) AS prefix FROM customer)
WHERE prefix IN (SELECT left(lpad(CAST(o_custkey AS VARCHAR), 9, '0'), 7) FROM orders) GROUP BY 1""",
)
def seed_source(spark, sf_dir):
    path = scratch_dir(spark, "seed")

    def prefix(column):
        return F.left(F.lpad(F.col(column).cast("string"), 9, "0"), F.lit(7)).alias("prefix")

    sinks.delimited_sink(table(spark, sf_dir, "orders").select(prefix("o_custkey")).distinct(), path)
    seed = files.seed_source(spark, path, "prefix string")
    customers = table(spark, sf_dir, "customer").select(prefix("c_custkey"))
    return customers.join(seed, "prefix").groupBy("prefix").agg(F.count(F.lit(1)).alias("customers"))


@query(
    "catalog_profile",
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count, true AS has_bytes FROM {n}" for n in TABLES),
)
def catalog_profile(spark, sf_dir):
    profile = files.catalog_profile(spark, {n: f"{sf_dir}/{n}.parquet" for n in TABLES})
    return profile.select("table_name", "row_count", (F.col("bytes") > 0).alias("has_bytes"))


# -- sinks ---------------------------------------------------------------


@query("mart_overwrite", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def mart_overwrite(spark, sf_dir):
    path = scratch_dir(spark, "mart")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    # The second load replaces the first.
    sinks.mart_overwrite(rows.unionAll(rows), path)
    sinks.mart_overwrite(rows, path, ["o_orderstatus"])
    return spark.read.parquet(path)


@query("mart_append", "SELECT o_orderkey, o_totalprice FROM orders")
def mart_append(spark, sf_dir):
    path = scratch_dir(spark, "mart")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    sinks.mart_append(rows.where("o_totalprice < 200000"), path, "o_orderkey")
    sinks.mart_append(rows, path, "o_orderkey")
    return spark.read.parquet(path)


@query("delimited_sink", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def delimited_sink(spark, sf_dir):
    path = scratch_dir(spark, "flat")
    sinks.delimited_sink(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), path, sep="\t")
    return files.delimited_source(spark, path, "c_custkey bigint, c_name string, c_acctbal double", sep="\t", strict=True)


@query("clustered_write", "SELECT l_orderkey, l_partkey, l_linenumber, l_shipdate, l_extendedprice FROM lineitem")
def clustered_write(spark, sf_dir):
    path = scratch_dir(spark, "clustered")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    keys = sinks.cluster_keys([], ["l_shipdate"], [], ["l_orderkey", "l_partkey"])
    sinks.clustered_write(lines, path, keys)
    return spark.read.parquet(path)


@query("clustered_write_curve", "SELECT l_orderkey, l_partkey, l_linenumber, l_shipdate, l_extendedprice FROM lineitem")
def clustered_write_curve(spark, sf_dir):
    path = scratch_dir(spark, "curve")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    sinks.curve_write(lines, path, ["l_shipdate", "l_orderkey", "l_partkey"])
    return spark.read.parquet(path)


@query(
    "partition_split_write",
    "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'sales' WHEN event_type = 'error' THEN 'faults' ELSE 'default' END AS route FROM events",
)
def partition_split_write(spark, sf_dir):
    path = scratch_dir(spark, "routes")
    routes = [("sales", F.col("event_type") == "purchase"), ("faults", F.col("event_type") == "error")]
    sinks.partition_split_write(table(spark, sf_dir, "events"), path, routes)
    return spark.read.parquet(path).select("event_id", "route")


@query(
    "processed_manifest",
    "SELECT DISTINCT o_orderpriority AS priority, CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders WHERE year(o_orderdate) >= 2000",
)
def processed_manifest(spark, sf_dir):
    folders, manifest = _folders(spark, sf_dir), scratch_dir(spark, "manifest")
    listing = files.file_listing(spark, folders, "*.csv")
    path = F.url_decode("path")
    year = F.regexp_extract(path, "year=([^/]*)/", 1)
    first = sinks.processed_manifest(listing, sinks.read_if_present(spark, manifest))
    sinks.mark_processed(first.where(year < "2000"), manifest)
    waiting = sinks.processed_manifest(listing, sinks.read_if_present(spark, manifest))
    return waiting.select(F.regexp_extract(path, "priority=([^/]*)/", 1).alias("priority"), year.alias("year")).distinct()
