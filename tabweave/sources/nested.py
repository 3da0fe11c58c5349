"""Nested model documents flattened into child tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields that are read from a model document (fixed names).
TABLES = """ARRAY<STRUCT<
    name: STRING, isHidden: BOOLEAN,
    columns: ARRAY<STRUCT<name: STRING, sourceColumn: STRING, dataType: STRING, isHidden: BOOLEAN,
        isKey: BOOLEAN, type: STRING, expression: STRING, formatString: STRING, sortByColumn: STRING>>,
    measures: ARRAY<STRUCT<name: STRING, expression: STRING, formatString: STRING,
        kpi: STRUCT<targetExpression: STRING, statusExpression: STRING, trendExpression: STRING>>>,
    hierarchies: ARRAY<STRUCT<name: STRING, levels: ARRAY<STRUCT<name: STRING, `column`: STRING, ordinal: INT>>>>,
    partitions: ARRAY<STRUCT<name: STRING, mode: STRING, source: STRUCT<type: STRING, query: STRING>>>>>"""
RELATIONSHIPS = """ARRAY<STRUCT<name: STRING, fromTable: STRING, fromColumn: STRING, toTable: STRING,
    toColumn: STRING, isActive: BOOLEAN, crossFilteringBehavior: STRING, fromCardinality: STRING,
    toCardinality: STRING>>"""
MODEL = f"STRUCT<name: STRING, tables: {TABLES}, relationships: {RELATIONSHIPS}>"

#: The accepted shapes: under a database of a create command, under ``model``, at the root.
DOCUMENT_DDL = (
    f"name STRING, tables {TABLES}, relationships {RELATIONSHIPS}, model {MODEL},"
    f" `create` STRUCT<database: STRUCT<name: STRING, model: {MODEL}>>"
)


def _lines(text: Column) -> Column:
    """An expression is one text, or a JSON list of its lines."""
    listed = F.array_join(F.from_json(text, "array<string>"), "\n")
    return F.trim(F.when(text.startswith("["), F.coalesce(listed, text)).otherwise(text))


def _items(parent: DataFrame, keys: list[str], array: Column, ordinal: str, item: str) -> DataFrame:
    return parent.select(*keys, F.posexplode(array).alias(ordinal, item))


def nested_json_flatten(spark: SparkSession, path: str, multi_line: bool = True) -> dict[str, DataFrame]:
    """Child tables of model documents with their keys and ordinals.

    Gives ``tables``, ``columns``, ``measures``, ``hierarchy_levels``,
    ``partitions`` and ``relationships``. With ``multi_line=False`` every line is
    a document, so large collections are read in splits.
    """
    raw = spark.read.schema(DOCUMENT_DDL).option("multiLine", multi_line).json(path)
    at_root = F.struct("name", "tables", "relationships")
    documents = raw.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.coalesce(F.col("create.database.name"), F.col("model.name"), F.col("name")).alias("model"),
        F.coalesce(F.col("create.database.model"), F.col("model"), at_root).alias("body"),
    )
    tables = _items(documents, ["model"], F.col("body.tables"), "table_ordinal", "t")
    keys = ["model", F.col("t.name").alias("table_name")]

    def children(array: str, ordinal: str) -> DataFrame:
        return tables.select(*keys, F.posexplode(F.col(f"t.{array}")).alias(ordinal, "c"))

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    hierarchies = children("hierarchies", "hierarchy_ordinal")
    return {
        "tables": tables.select(
            *keys,
            "table_ordinal",
            flag("t.isHidden").alias("is_hidden"),
            F.greatest(F.size(F.col("t.columns")), F.lit(0)).alias("n_columns"),
            F.greatest(F.size(F.col("t.measures")), F.lit(0)).alias("n_measures"),
        ),
        "columns": children("columns", "column_ordinal").select(
            "model",
            "table_name",
            "column_ordinal",
            F.col("c.name").alias("column_name"),
            F.col("c.sourceColumn").alias("source_column"),
            F.coalesce(F.col("c.dataType"), F.lit("string")).alias("data_type"),
            flag("c.isHidden").alias("is_hidden"),
            flag("c.isKey").alias("is_key"),
            F.coalesce(F.col("c.type") == "calculated", F.lit(False)).alias("is_calculated"),
            F.when(F.col("c.type") == "calculated", _lines(F.col("c.expression"))).alias("expression"),
            F.col("c.formatString").alias("format_string"),
            F.col("c.sortByColumn").alias("sort_by_column"),
        ),
        "measures": children("measures", "measure_ordinal").select(
            "model",
            "table_name",
            "measure_ordinal",
            F.col("c.name").alias("measure_name"),
            _lines(F.col("c.expression")).alias("expression"),
            F.col("c.formatString").alias("format_string"),
            _lines(F.col("c.kpi.targetExpression")).alias("kpi_target"),
            _lines(F.col("c.kpi.statusExpression")).alias("kpi_status"),
            _lines(F.col("c.kpi.trendExpression")).alias("kpi_trend"),
        ),
        "hierarchy_levels": hierarchies.select(
            "model", "table_name", F.col("c.name").alias("hierarchy"), F.posexplode("c.levels").alias("pos", "l")
        ).select(
            "model",
            "table_name",
            "hierarchy",
            F.coalesce(F.col("l.ordinal"), F.col("pos")).alias("level_ordinal"),
            F.col("l.name").alias("level_name"),
            F.col("l")["column"].alias("column_name"),
        ),
        "partitions": children("partitions", "partition_ordinal").select(
            "model",
            "table_name",
            "partition_ordinal",
            F.col("c.name").alias("partition_name"),
            F.coalesce(F.col("c.mode"), F.lit("import")).alias("mode"),
            F.coalesce(F.col("c.source.type"), F.lit("unknown")).alias("source_type"),
            F.trim(F.coalesce(F.col("c.source.query"), F.lit(""))).alias("query"),
        ),
        "relationships": _items(documents, ["model"], F.col("body.relationships"), "relationship_ordinal", "r").select(
            "model",
            "relationship_ordinal",
            F.col("r.fromTable").alias("from_table"),
            F.col("r.fromColumn").alias("from_column"),
            F.col("r.toTable").alias("to_table"),
            F.col("r.toColumn").alias("to_column"),
            F.coalesce(F.col("r.isActive"), F.lit(True)).alias("is_active"),
            F.coalesce(F.col("r.crossFilteringBehavior"), F.lit("oneDirection")).alias("cross_filtering"),
            F.concat(
                F.coalesce(F.col("r.fromCardinality"), F.lit("many")),
                F.lit("_to_"),
                F.coalesce(F.col("r.toCardinality"), F.lit("one")),
            ).alias("cardinality"),
        ),
    }
