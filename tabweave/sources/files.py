"""Table and file sources. Whole folders are one read, never a loop over files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.functions.scalar import file_name, safe_cast

CORRUPT = "_corrupt_record"


def table_source(spark: SparkSession, name_or_path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A catalog table, or Parquet files in place when given a path."""
    if "/" not in name_or_path:
        return spark.table(name_or_path)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(name_or_path)


def external_table(spark: SparkSession, name: str, path: str, schema: T.StructType | str) -> DataFrame:
    """Register Parquet files in place as a catalog table."""
    return spark.catalog.createTable(name, path=path, source="parquet", schema=_struct(schema))


def _struct(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _as_text(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema])


def _reader(spark: SparkSession, sep: str, header: bool, line_sep: str | None, recursive: bool, glob: str | None, **options):
    reader = spark.read.options(sep=sep, header=header, mode="PERMISSIVE", **({"escape": '"'} | options))
    if line_sep:
        reader = reader.option("lineSep", line_sep)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader


def text_rows(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    sep: str = ",",
    header: bool = True,
    null_tokens: Sequence[str] = ("",),
    line_sep: str | None = None,
    recursive: bool = False,
    glob: str | None = None,
    keep_corrupt: bool = False,
    encoding: str | None = None,
    quote: str = '"',
    multi_line: bool = False,
) -> DataFrame:
    """Delimited rows as text under the declared names, null tokens replaced.

    Short rows are filled with NULLs and surplus fields dropped. A quote inside a
    quoted field is doubled. With ``multi_line`` quoted fields may hold line breaks;
    such a file cannot be split, so one task reads it.
    """
    text = _as_text(_struct(schema))
    names = text.names
    options = {"quote": quote, "escape": quote, "multiLine": multi_line} | ({"encoding": encoding} if encoding else {})
    if keep_corrupt:
        text = text.add(CORRUPT, "string")
        # A pruned read does not look at the other fields, so it cannot tell their number.
        options |= {"columnNameOfCorruptRecord": CORRUPT, "columnPruning": "false"}
    df = _reader(spark, sep, header, line_sep, recursive, glob, **options).schema(text).csv(path)
    tokens = list(null_tokens)
    if tokens:
        df = df.withColumns({n: F.when(~F.col(n).isin(tokens), F.col(n)) for n in names})
    return df


def delimited_source(
    spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False, **options
) -> DataFrame:
    """Delimited files with a declared schema.

    Text that does not convert becomes NULL, or fails the query when ``strict``.
    """
    fields = _struct(schema)
    rows = text_rows(spark, path, fields, **options)
    return rows.select(*[_converted(f, strict).alias(f.name) for f in fields])


def _converted(field: T.StructField, strict: bool) -> Column:
    text, kind = F.col(field.name), field.dataType.simpleString()
    if kind == "variant":
        return F.parse_json(text) if strict else safe_cast(text, kind)
    return text.cast(kind) if strict else safe_cast(text, kind)


def cr_line_source(spark: SparkSession, path: str, schema: T.StructType | str, **options) -> DataFrame:
    """Delimited files whose lines end in a bare carriage return."""
    return delimited_source(spark, path, schema, line_sep="\r", **options)


def positional_source(spark: SparkSession, path: str, types: Sequence[str], names: Sequence[str] | None = None, header: bool = False, **options) -> DataFrame:
    """Columns by position, read as text and then converted."""
    names = names or [f"c{i + 1}" for i in range(len(types))]
    schema = T.StructType([T.StructField(n, T.StructType.fromDDL(f"x {t}")[0].dataType) for n, t in zip(names, types)])
    return delimited_source(spark, path, schema, header=header, **options)


def multi_file_source(spark: SparkSession, root: str, schema: T.StructType | str, glob: str = "*.csv", **options) -> DataFrame:
    """All files under ``root`` at any depth whose name matches, with their path and name."""
    fields = _struct(schema)
    rows = text_rows(spark, root, fields, recursive=True, glob=glob, **options)
    return rows.select(
        *[safe_cast(F.col(f.name), f.dataType.simpleString()).alias(f.name) for f in fields],
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
    )


def file_listing(spark: SparkSession, path: str, glob: str = "*", depth: int | None = None) -> DataFrame:
    """One row per file: path, name, size and time; contents are not read.

    ``depth`` keeps files exactly that many folders below ``path``.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(path)
        .select("path", file_name(F.col("path")).alias("file_name"), "length", "modificationTime")
    )
    if depth is None:
        return files
    inside = F.split_part(F.col("path"), F.lit(path.rstrip("/") + "/"), F.lit(-1))
    return files.where(F.size(F.split(inside, "/")) == depth + 1)


def _failed_columns(fields: T.StructType) -> list[Column]:
    return [
        F.when(F.col(f.name).isNotNull() & safe_cast(F.col(f.name), f.dataType.simpleString()).isNull(), F.lit(f.name))
        for f in fields
        if not isinstance(f.dataType, T.StringType)
    ]


def reject_rows(rows: DataFrame, schema: T.StructType | str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Split text rows into converted rows and rejects with a code and a column.

    Tolerant: a row is rejected for the first column that does not convert.
    Strict: rows with missing or surplus fields are rejected too; read them with
    ``keep_corrupt=True``. Without rejects the error output is a typed empty frame.
    """
    fields = _struct(schema)
    checks = _failed_columns(fields)
    failed = F.coalesce(*checks, F.lit(None).cast("string")) if checks else F.lit(None).cast("string")
    code = F.when(failed.isNotNull(), F.lit("CONVERSION"))
    if strict:
        code = F.when(F.col(CORRUPT).isNotNull() & failed.isNull(), F.lit("FIELD_COUNT")).otherwise(code)
    marked = rows.withColumns({"error_column": failed, "error_code": code})
    good = marked.where(F.col("error_code").isNull()).select(
        *[safe_cast(F.col(f.name), f.dataType.simpleString()).alias(f.name) for f in fields]
    )
    bad = marked.where(F.col("error_code").isNotNull()).select(*fields.names, "error_code", "error_column")
    return good, bad


def bulk_load_tolerant(spark: SparkSession, path: str, schema: T.StructType | str, **options) -> DataFrame:
    """Keep short and long rows, skip rows with a value that does not convert."""
    good, _ = reject_rows(text_rows(spark, path, schema, **options), schema)
    return good


def seed_source(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Small reference file; declared types keep codes such as ``00123`` as text."""
    return delimited_source(spark, path, schema, strict=True)


def catalog_profile(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Row count and bytes per table."""
    counts = [
        spark.read.parquet(p).select(F.lit(n).alias("table_name"), F.lit(1).alias("__rows"), F.lit(0).cast("long").alias("__bytes"))
        for n, p in paths.items()
    ]
    sizes = [
        file_listing(spark, p, "*.parquet").select(
            F.lit(n).alias("table_name"), F.lit(0).alias("__rows"), F.col("length").alias("__bytes")
        )
        for n, p in paths.items()
    ]
    return (
        reduce(DataFrame.unionByName, [*counts, *sizes])
        .groupBy("table_name")
        .agg(F.sum("__rows").alias("row_count"), F.sum("__bytes").alias("bytes"))
    )
