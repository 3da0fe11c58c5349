"""Scorecard, classification and dependency queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabweave.operators import catalog as c
from tabweave.operators.transforms import union_all
from workload.base import query, table
from workload.joins import NODES_SQL, geography_nodes

# Order states stand for component states: F supported, O partial, P not supported.
STATES = {"F": "Success", "O": "Partial", "P": "NotSupported"}
STATE_SQL = "CASE o_orderstatus WHEN 'F' THEN 'Success' WHEN 'O' THEN 'Partial' WHEN 'P' THEN 'NotSupported' ELSE 'N/A' END"
COUNTS = {"success": "Success", "partial": "Partial", "not_supported": "NotSupported", "na": "N/A"}


def components(spark, sf_dir):
    state = F
    for code, name in STATES.items():
        state = state.when(F.col("o_orderstatus") == code, F.lit(name))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("pkg"), F.col("o_custkey").cast("string")).alias("package"),
        state.otherwise(F.lit("N/A")).alias("status"),
        F.col("o_orderpriority").alias("subtype"),
        F.col("o_orderkey").alias("component"),
    )


COMPONENTS_SQL = f"SELECT 'pkg' || o_custkey AS package, {STATE_SQL} AS status, o_orderpriority AS subtype, o_orderkey AS component FROM orders"


@query(
    "status_scorecard",
    f"""SELECT package, count(*) AS total, count(*) FILTER (WHERE status = 'Success') AS success, count(*) FILTER (WHERE status = 'Partial') AS partial,
  count(*) FILTER (WHERE status = 'NotSupported') AS not_supported, count(*) FILTER (WHERE status = 'N/A') AS na,
  round(sum(CASE status WHEN 'Success' THEN 0.5::DOUBLE WHEN 'Partial' THEN 2 WHEN 'NotSupported' THEN 4 ELSE 0 END), 1) AS effort_hrs,
  round(sum(CASE status WHEN 'Success' THEN 1.0::DOUBLE WHEN 'Partial' THEN 0.5 ELSE 0 END) / (count(*) - count(*) FILTER (WHERE status = 'N/A')) * 100, 1) AS supported_pct
FROM ({COMPONENTS_SQL}) GROUP BY 1
UNION ALL SELECT NULL, count(*), count(*) FILTER (WHERE status = 'Success'), count(*) FILTER (WHERE status = 'Partial'),
  count(*) FILTER (WHERE status = 'NotSupported'), count(*) FILTER (WHERE status = 'N/A'),
  round(sum(CASE status WHEN 'Success' THEN 0.5::DOUBLE WHEN 'Partial' THEN 2 WHEN 'NotSupported' THEN 4 ELSE 0 END), 1),
  round(sum(CASE status WHEN 'Success' THEN 1.0::DOUBLE WHEN 'Partial' THEN 0.5 ELSE 0 END) / (count(*) - count(*) FILTER (WHERE status = 'N/A')) * 100, 1)
FROM ({COMPONENTS_SQL})""",
)
def status_scorecard(spark, sf_dir):
    rows = components(spark, sf_dir)
    total = c.status_scorecard(rows, None, "status", COUNTS).withColumn("package", F.lit(None).cast("string"))
    return c.status_scorecard(rows, "package", "status", COUNTS).unionByName(total)


@query(
    "presence_classify",
    """SELECT l_suppkey, CASE WHEN bool_or(l_quantity = 50) THEN 'Bulk' WHEN bool_or(l_returnflag = 'R') AND bool_or(l_returnflag = 'A') THEN 'Mixed returns'
  WHEN bool_or(l_returnflag = 'R') THEN 'Returns' ELSE 'Plain' END AS classification FROM lineitem GROUP BY 1""",
)
def presence_classify(spark, sf_dir):
    returned, accepted = F.col("l_returnflag") == "R", F.col("l_returnflag") == "A"
    rules = [("Bulk", [F.col("l_quantity") == 50]), ("Mixed returns", [returned, accepted]), ("Returns", [returned])]
    return c.presence_classify(table(spark, sf_dir, "lineitem"), "l_suppkey", rules, "Plain")


@query(
    "threshold_tier",
    f"""SELECT *, CASE WHEN not_supported >= 3 OR drivers >= 2 OR issues >= 8 THEN 'High' WHEN not_supported >= 1 OR drivers >= 1 OR issues >= 3 THEN 'Medium' ELSE 'Low' END AS tier
FROM (SELECT package, count(*) FILTER (WHERE status = 'NotSupported') AS not_supported, count(*) FILTER (WHERE subtype = '1-URGENT') AS drivers,
  count(*) FILTER (WHERE status <> 'Success') AS issues FROM ({COMPONENTS_SQL}) GROUP BY 1)""",
)
def threshold_tier(spark, sf_dir):
    metrics = {
        "not_supported": F.count_if(F.col("status") == "NotSupported"),
        "drivers": F.count_if(F.col("subtype") == "1-URGENT"),
        "issues": F.count_if(F.col("status") != "Success"),
    }
    return c.threshold_tier(components(spark, sf_dir), "package", metrics, c.COMPLEXITY_TIERS)


@query(
    "issue_rollup",
    """SELECT c_custkey AS package, coalesce(open_issues, 0) AS open_issues, coalesce(low_issues, 0) AS low_issues FROM customer LEFT JOIN (
  SELECT o_custkey, count(*) FILTER (WHERE code LIKE 'O-%') AS open_issues, count(*) FILTER (WHERE code LIKE 'P-5%') AS low_issues
  FROM (SELECT o_custkey, o_orderstatus || '-' || o_orderpriority AS code FROM orders) GROUP BY 1) ON o_custkey = c_custkey""",
)
def issue_rollup(spark, sf_dir):
    issues = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("package"), F.concat_ws("-", "o_orderstatus", "o_orderpriority").alias("code")
    )
    packages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("package"))
    return c.issue_rollup(packages, issues, "package", "code", {"open_issues": "O-", "low_issues": "P-5"})


@query(
    "dimension_role_classify",
    f"""WITH e AS (SELECT node AS f, parent AS t FROM ({NODES_SQL}) WHERE parent IS NOT NULL)
SELECT name AS table_name, NOT bool_or(many) AS is_dimension FROM (SELECT f AS name, true AS many FROM e UNION ALL SELECT t, false FROM e) GROUP BY 1""",
)
def dimension_role_classify(spark, sf_dir):
    return c.dimension_role_classify(relations(spark, sf_dir))


def relations(spark, sf_dir):
    return (
        geography_nodes(spark, sf_dir)
        .where(F.col("parent").isNotNull())
        .select(F.col("node").alias("from_table"), F.col("parent").alias("to_table"))
    )


def trade_edges(spark, sf_dir, distinct=True):
    """Orders need their customer and the parts they list; customers need their nation and region."""
    pairs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    lines = (pairs.distinct() if distinct else pairs).select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("from"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("to"),
    )
    up = relations(spark, sf_dir).select(F.col("from_table").alias("from"), F.col("to_table").alias("to"))
    return union_all(up, lines)


@query(
    "dependency_levels",
    """SELECT 'r' || r_regionkey AS node, 0 AS level FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
UNION ALL SELECT 'p' || l_partkey, 0 FROM (SELECT DISTINCT l_partkey FROM lineitem)
UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 'c' || c_custkey, 2 FROM customer
UNION ALL SELECT 'o' || o_orderkey, 3 FROM orders""",
)
def dependency_levels(spark, sf_dir):
    return c.dependency_levels(trade_edges(spark, sf_dir, distinct=False))


@query(
    "dependency_levels_cycles",
    """WITH n AS (SELECT n_nationkey, n_regionkey, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS first, count(*) OVER (PARTITION BY n_regionkey) AS size FROM nation),
f AS (SELECT n_regionkey, min('n' || n_nationkey) AS component FROM nation GROUP BY 1)
SELECT 'r' || r_regionkey AS node, 'r' || r_regionkey AS component, 1::BIGINT AS members, 0 AS level FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
UNION ALL SELECT 'n' || n_nationkey, component, size, 1 FROM n JOIN f USING (n_regionkey)
UNION ALL SELECT 'c' || c_custkey, 'c' || c_custkey, 1, 2 FROM customer UNION ALL SELECT 'o' || o_orderkey, 'o' || o_orderkey, 1, 3 FROM orders""",
)
def dependency_levels_cycles(spark, sf_dir):
    """The nations of a region need each other in a ring; customers and orders stand on these cycles."""
    nations = table(spark, sf_dir, "nation")
    ring = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    whole = Window.partitionBy("n_regionkey")
    after = F.coalesce(F.lead("n_nationkey").over(ring), F.min("n_nationkey").over(whole))
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    rings = nations.select(name(F.col("n_nationkey")).alias("from"), name(after).alias("to"))
    up = relations(spark, sf_dir).select(F.col("from_table").alias("from"), F.col("to_table").alias("to"))
    return c.dependency_components(union_all(up, rings))


@query(
    "dependency_fanin",
    """SELECT node AS "from", count(*) AS dependencies FROM (SELECT 'o' || o_orderkey AS node FROM orders
  UNION ALL SELECT 'o' || l_orderkey FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) GROUP BY 1 HAVING count(*) >= 2""",
)
def dependency_fanin(spark, sf_dir):
    return c.dependency_fanin(trade_edges(spark, sf_dir))
