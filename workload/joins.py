"""Lookup, merge and hierarchy join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabweave.operators import joins as j
from tabweave.operators.transforms import union_all
from tabweave.plans import measures as m
from tabweave.plans.model import Relationship, SemanticModel
from workload.base import ORDER_TOTAL, REVENUE, SALES_SQL, amounts, cents, order_total, query, revenue, revenues, sales_model, table


@query(
    "lookup_join",
    """SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)""",
)
def lookup_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return j.lookup_join(docs, table(spark, sf_dir, "labels"), "doc_id")


@query(
    "lookup_first_match",
    """SELECT c_custkey, c_name, r.o_orderkey, r.o_totalprice FROM customer LEFT JOIN (
  SELECT o_custkey, o_orderkey, o_totalprice FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1) r ON r.o_custkey = c_custkey""",
)
def lookup_first_match(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return j.lookup_first_match(customers, orders, {"c_custkey": "o_custkey"}, ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "lookup_default",
    """SELECT doc_id, source, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)""",
)
def lookup_default(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return j.lookup_default(docs, table(spark, sf_dir, "labels"), "doc_id", {"quality": -1, "toxic": 0})


def _merge(name, how, sql_join):
    @query(
        name,
        f"""WITH p AS (SELECT o_orderkey + 10 AS o_orderkey, o_totalprice FROM orders),
l AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem)
SELECT {'coalesce(o_orderkey, l_orderkey)' if how == 'full' else 'o_orderkey'} AS o_orderkey, o_totalprice, l_linenumber, l_quantity
FROM p {sql_join} JOIN l ON o_orderkey = l_orderkey""",
    )
    def run(spark, sf_dir):
        # Keys moved by ten, so that both sides have rows without partner.
        orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 10).alias("o_orderkey"), "o_totalprice")
        lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
        return j.merge_join(orders, lines, {"o_orderkey": "l_orderkey"}, how)


_merge("merge_join_inner", "inner", "INNER")
_merge("merge_join_left", "left", "LEFT")
_merge("merge_join_full", "full", "FULL")


@query(
    "prefix_join",
    """SELECT o_orderkey, o_orderpriority, prefix, n_lines FROM orders LEFT JOIN (
  SELECT CAST(l_linenumber AS VARCHAR) AS prefix, count(*) AS n_lines FROM lineitem GROUP BY 1) ON substr(o_orderpriority, 1, 1) = prefix AND length(prefix) = 1""",
)
def prefix_join(spark, sf_dir):
    codes = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n_lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    out = j.prefix_join(orders, codes, "o_orderpriority", "l_linenumber", 1)
    return out.withColumn("prefix", F.col("l_linenumber").cast("string")).drop("l_linenumber")


@query(
    "related",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, p_brand, p_type FROM lineitem LEFT JOIN part ON l_partkey = p_partkey",
)
def related(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return j.related(lines, table(spark, sf_dir, "part"), {"l_partkey": "p_partkey"}, "p_brand", "p_type")


@query(
    "related_table",
    """SELECT c_custkey, c_name, CAST(total AS DOUBLE) AS total, n_orders FROM customer LEFT JOIN (
  SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS total, count(*) AS n_orders FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
)
def related_table(spark, sf_dir):
    out = j.related_table(
        table(spark, sf_dir, "customer").select("c_custkey", "c_name"),
        table(spark, sf_dir, "orders"),
        {"c_custkey": "o_custkey"},
        total=F.sum(order_total()),
        n_orders=F.count(F.lit(1)),
    )
    return amounts(out, "total")


@query(
    "star_join",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, o_orderdate, c_name, n_name, r_name, p_brand, s_name
FROM {SALES_SQL} LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey""",
)
def star_join(spark, sf_dir):
    return (
        sales_model(spark, sf_dir)
        .star("lineitem")
        .select(
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            "l_quantity",
            "o_orderdate",
            "c_name",
            "n_name",
            "r_name",
            "p_brand",
            "s_name",
        )
    )


@query(
    "bidirectional_join",
    "SELECT doc_id, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)",
)
def bidirectional_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    model = SemanticModel(
        {"documents": docs, "labels": table(spark, sf_dir, "labels")},
        [Relationship("documents", "doc_id", "labels", "doc_id", both_directions=True)],
    )
    return model.star("documents")


@query(
    "inactive_relationship",
    f"""WITH c AS (SELECT n_name, sum({REVENUE}) AS v, count(*) AS n FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
s AS (SELECT n_name, sum({REVENUE}) AS v FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT coalesce(c.n_name, s.n_name) AS n_name, CAST(c.v AS DOUBLE) AS customer_revenue, CAST(s.v AS DOUBLE) AS supplier_revenue,
  c.n AS lines, round(CAST(s.v AS DOUBLE) / CAST(c.v AS DOUBLE), 9) AS supplier_share
FROM c FULL JOIN s ON c.n_name = s.n_name""",
)
def inactive_relationship(spark, sf_dir):
    # The same nations, reached over the customer and over the supplier.
    customers = m.sum_("customer_revenue", revenue())
    suppliers = m.use_relationship(customers, "supplier_nation", name="supplier_revenue")
    share = m.compound("supplier_share", ("supplier_revenue", "customer_revenue"), lambda p: F.round(p["supplier_revenue"] / p["customer_revenue"], 9))
    model = sales_model(spark, sf_dir, [customers, suppliers, m.count_rows("lines"), share])
    out = model.query("lineitem", ["customer_revenue", "supplier_revenue", "lines", "supplier_share"], by=["n_name"])
    return revenues(out, "customer_revenue", "supplier_revenue")


@query(
    "crossfilter_none",
    """SELECT p_brand, count(*) AS lines, (SELECT count(*) FROM lineitem) AS all_lines
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25 GROUP BY 1""",
)
def crossfilter_none(spark, sf_dir):
    # The second measure does not see the part relationship: neither grouping nor filter reach it.
    lines = m.count_rows("lines")
    model = sales_model(spark, sf_dir, [lines, m.ignore_relationship(lines, "line_part", name="all_lines")])
    return model.query("lineitem", ["lines", "all_lines"], by=["p_brand"], where={"p_size": F.col("p_size") > 25})


@query(
    "bridge_join",
    """SELECT p_type, count(*) AS parts, CAST(sum(CAST(p_retailprice AS DECIMAL(12,2))) AS DOUBLE) AS list_value FROM part WHERE p_partkey IN (
  SELECT l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 5000) GROUP BY 1""",
)
def bridge_join(spark, sf_dir):
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    bridge = j.semi_join(table(spark, sf_dir, "lineitem"), rich, {"l_suppkey": "s_suppkey"})
    parts = j.bridge_filter(table(spark, sf_dir, "part"), bridge, {"p_partkey": "l_partkey"})
    values = parts.groupBy("p_type").agg(
        F.count(F.lit(1)).alias("parts"), F.sum(cents("p_retailprice")).alias("list_value")
    )
    return amounts(values, "list_value")


_BRIDGED = f"""SELECT DISTINCT n_name, o_orderkey, {ORDER_TOTAL} AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""


@query(
    "bridge_join_measures",
    f"""SELECT n_name, false AS is_total, CAST(sum(total) AS DOUBLE) AS total, count(*) AS order_rows, round(stddev_samp(CAST(total AS DOUBLE)), 4) AS spread FROM ({_BRIDGED}) GROUP BY 1
UNION ALL SELECT NULL, true, CAST(sum(total) AS DOUBLE), count(*), round(stddev_samp(CAST(total AS DOUBLE)), 4) FROM (SELECT DISTINCT o_orderkey, total FROM ({_BRIDGED}))""",
)
def bridge_join_measures(spark, sf_dir):
    """Order value by the nations of all suppliers of an order's lines, and over all orders."""
    suppliers = j.equi_join(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), {"s_nationkey": "n_nationkey"})
    measures = [m.sum_("total", order_total()), m.count_rows("order_rows"), m.stddev("spread", "o_totalprice")]
    out = m.bridge_measures(
        table(spark, sf_dir, "orders"),
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"),
        suppliers.select("s_suppkey", "n_name"),
        {"o_orderkey": "l_orderkey"},
        {"l_suppkey": "s_suppkey"},
        measures,
        ["n_name"],
    )
    return amounts(out, "total").withColumn("spread", F.round("spread", 4))


@query(
    "natural_join",
    """SELECT doc_id, lang, quality FROM documents NATURAL JOIN labels""",
)
def natural_join(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return j.natural_join(docs.select("doc_id", "lang"), labels.select("doc_id", "quality"))


@query(
    "semi_join_filter",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
)
def semi_join_filter(spark, sf_dir):
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return j.semi_join(table(spark, sf_dir, "orders"), returned, {"o_orderkey": "l_orderkey"}).select("o_orderkey", "o_totalprice")


@query(
    "anti_join_new_rows",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def anti_join_new_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return j.anti_join(orders, table(spark, sf_dir, "lineitem"), {"o_orderkey": "l_orderkey"})


NODES_SQL = """SELECT 'r' || r_regionkey AS node, CAST(NULL AS VARCHAR) AS parent, r_name AS label FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer
UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, o_orderpriority FROM orders"""


def geography_nodes(spark, sf_dir):
    def nodes(name, prefix, key, parent_prefix, parent, label):
        up = F.concat(F.lit(parent_prefix), F.col(parent).cast("string")) if parent else F.lit(None).cast("string")
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("node"), up.alias("parent"), F.col(label).alias("label")
        )

    return union_all(
        nodes("region", "r", "r_regionkey", None, None, "r_name"),
        nodes("nation", "n", "n_nationkey", "r", "n_regionkey", "n_name"),
        nodes("customer", "c", "c_custkey", "n", "c_nationkey", "c_name"),
        nodes("orders", "o", "o_orderkey", "c", "o_custkey", "o_orderpriority"),
    )


@query(
    "hierarchy_expand",
    f"""WITH RECURSIVE nodes AS ({NODES_SQL}), h AS (
  SELECT node, parent, label, 0 AS depth, label AS path FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.node, n.parent, n.label, h.depth + 1, h.path || ' > ' || n.label FROM nodes n JOIN h ON n.parent = h.node)
SELECT * FROM h""",
)
def hierarchy_expand(spark, sf_dir):
    return j.hierarchy_expand(geography_nodes(spark, sf_dir), "node", "parent", "label")
