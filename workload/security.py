"""Row and column security queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabweave.operators import security as sec
from tabweave.plans import measures as m
from tabweave.plans.model import Role
from workload.base import ORDER_TOTAL, amounts, order_total, query, sales_model, table


def user_regions(spark, sf_dir):
    """Every supplier may see the nations of its own region."""
    nation = table(spark, sf_dir, "nation")
    home = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_name", "n_regionkey")
    return home.join(nation.select("n_nationkey", F.col("n_regionkey").alias("region")), F.col("n_regionkey") == F.col("region")).select(
        F.col("s_name").alias("username"), F.col("n_nationkey").alias("c_nationkey")
    )


MAP_SQL = """SELECT s_name AS username, b.n_nationkey AS c_nationkey FROM supplier
JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON a.n_regionkey = b.n_regionkey"""
USER, ADMIN = "Supplier#000000001", "Supplier#000000000"


def admins(spark, sf_dir):
    """The override table: the first supplier by name."""
    return table(spark, sf_dir, "supplier").agg(F.min("s_name").alias("username"))


@query("rls_direct", "SELECT conv_id, turn, role, text FROM conversations WHERE role = 'assistant'")
def rls_direct(spark, sf_dir):
    return sec.rls_direct(table(spark, sf_dir, "conversations"), "role", "assistant")


@query(
    "rls_mapping",
    f"SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM ({MAP_SQL}) WHERE username = '{USER}')",
)
def rls_mapping(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return sec.rls_mapping(customers, "c_nationkey", user_regions(spark, sf_dir), USER)


@query(
    "rls_admin_bypass",
    f"""SELECT 'admin' AS seen_by, c_custkey FROM customer
UNION ALL SELECT 'user', c_custkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM ({MAP_SQL}) WHERE username = '{USER}')""",
)
def rls_admin_bypass(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    mapping, override = user_regions(spark, sf_dir), admins(spark, sf_dir)

    def seen(who, principal):
        rows = sec.rls_admin_bypass(customers, "c_nationkey", mapping, override, principal)
        return rows.select(F.lit(who).alias("seen_by"), "c_custkey")

    return seen("admin", ADMIN).unionByName(seen("user", USER))


@query(
    "ols_table",
    f"""SELECT c_mktsegment, CAST(sum({ORDER_TOTAL}) AS DOUBLE) AS total,
  'customer,lineitem,nation,orders,region,supplier' AS tables, 'c_custkey,c_name,c_nationkey,c_mktsegment' AS customer_columns
FROM orders JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'MACHINERY') ON o_custkey = c_custkey GROUP BY 1""",
)
def ols_table(spark, sf_dir):
    # The role sees no part table, no balance and only some segments; the facts follow the dimension's filter.
    role = Role(
        rows={"customer": lambda df: df.where("c_mktsegment <> 'MACHINERY'")},
        hidden_tables=("part",),
        hidden_columns={"customer": ("c_acctbal",)},
    )
    model = sales_model(spark, sf_dir, [m.sum_("total", order_total())], roles={"analyst": role})
    seen = model.visible("analyst")
    out = amounts(model.query("orders", ["total"], ["c_mktsegment"], role="analyst"), "total")
    return out.withColumns({"tables": F.lit(",".join(sorted(seen))), "customer_columns": F.lit(",".join(seen["customer"]))})


@query("ols_column_omit", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def ols_column_omit(spark, sf_dir):
    return sec.ols_column_omit(table(spark, sf_dir, "customer"), ["c_acctbal"])


@query(
    "column_mask",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '***' ELSE c_name END AS c_name,
  CAST(NULL AS VARCHAR) AS c_mktsegment FROM customer""",
)
def column_mask(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    masked = sec.column_mask(rows, ["c_name"], F.col("c_mktsegment") == "HOUSEHOLD")
    return sec.column_mask(masked, ["c_mktsegment"], True, None)
