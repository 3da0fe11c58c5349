"""Registry, table access and the exact money expressions the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.functions.scalar import from_units, to_units
from tabweave.plans.measures import Measure, count_rows, distinct_count, sum_
from tabweave.plans.model import Relationship, SemanticModel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under an inventory name, with its SQL where there is one."""

    def add(function):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


#: Declared schemas, so a read starts no job to look into file footers.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,"
    " o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,"
    " l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING,"
    " l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


# The SQL side sums money as decimals. The Spark side sums whole units (bigint),
# 1/100 for prices and 1/10000 for prices times a rate, and divides at the end.
PRICE = "CAST(l_extendedprice AS DECIMAL(12,2))"
REVENUE = f"{PRICE} * (1 - CAST(l_discount AS DECIMAL(4,2)))"
TAXED = f"{PRICE} * (1 + CAST(l_tax AS DECIMAL(4,2)))"
ORDER_TOTAL = "CAST(o_totalprice AS DECIMAL(12,2))"


def cents(column: str) -> Column:
    return to_units(F.col(column), 2)


def revenue() -> Column:
    """In 1/10000."""
    return cents("l_extendedprice") * (100 - cents("l_discount"))


def taxed() -> Column:
    """In 1/10000."""
    return cents("l_extendedprice") * (100 + cents("l_tax"))


def order_total() -> Column:
    """In 1/100."""
    return cents("o_totalprice")


def amounts(df: DataFrame, *columns: str, digits: int = 2) -> DataFrame:
    """Units back to amounts."""
    return df.withColumns({c: from_units(F.col(c), digits) for c in columns})


def revenues(df: DataFrame, *columns: str) -> DataFrame:
    return amounts(df, *columns, digits=4)


def doubles(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


SALES_SQL = """lineitem
LEFT JOIN orders ON l_orderkey = o_orderkey
LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey"""


def sales_measures() -> list[Measure]:
    return [
        sum_("revenue", revenue()),
        sum_("quantity", "l_quantity"),
        count_rows("lines"),
        distinct_count("orders", "l_orderkey"),
    ]


def sales_model(spark: SparkSession, sf_dir: str, measures: list[Measure] | None = None, **parts) -> SemanticModel:
    names = ["lineitem", "orders", "customer", "nation", "region", "part", "supplier"]
    return SemanticModel(
        {n: table(spark, sf_dir, n) for n in names},
        [
            Relationship("lineitem", "l_orderkey", "orders", "o_orderkey"),
            Relationship("orders", "o_custkey", "customer", "c_custkey"),
            Relationship("customer", "c_nationkey", "nation", "n_nationkey"),
            Relationship("nation", "n_regionkey", "region", "r_regionkey"),
            Relationship("lineitem", "l_partkey", "part", "p_partkey", name="line_part"),
            Relationship("lineitem", "l_suppkey", "supplier", "s_suppkey"),
            Relationship("supplier", "s_nationkey", "nation", "n_nationkey", active=False, name="supplier_nation"),
        ],
        sales_measures() if measures is None else measures,
        **parts,
    )
