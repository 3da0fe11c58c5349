"""Destinations. Writers spread hot keys over several files and tasks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.operators.joins import anti_join
from tabweave.operators.transforms import route_column
from tabweave.session import cut_lineage

#: Most keys by which clustering is of use (fixed value).
MAX_CLUSTER_KEYS = 3

#: Bits of a key's range number on the curve.
CURVE_BITS = 8


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def mart_overwrite(df: DataFrame, target: str, partition_by: Sequence[str] = ()) -> None:
    """Materialise a destination: Parquet files under a path, or a catalog table by name."""
    if partition_by:
        # Rebalancing gathers a partition's rows into few files and splits large ones.
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    if "/" in target:
        writer.parquet(target)
    else:
        writer.format("parquet").saveAsTable(target)


def mart_append(df: DataFrame, path: str, key: Sequence[str] | str) -> None:
    """Append the rows whose key the destination does not have yet. NULL keys are equal.

    Rows that repeat a key within ``df`` are all appended.
    """
    present = read_if_present(df.sparkSession, path)
    new = df if present is None else anti_join(df, present, key, null_safe=True)
    new.write.mode("append").parquet(path)


def delimited_sink(df: DataFrame, path: str, sep: str = ",", header: bool = True, null_token: str = "", **options) -> None:
    df.write.mode("overwrite").options(sep=sep, header=header, nullValue=null_token, escape='"', **options).csv(path)


def cluster_keys(*candidates: Sequence[str]) -> list[str]:
    """The first three keys out of: partition dates, date keys, hierarchy levels, foreign keys."""
    return list(dict.fromkeys(c for group in candidates for c in group))[:MAX_CLUSTER_KEYS]


def clustered_write(df: DataFrame, path: str, keys: Sequence[str | Column], mode: str = "overwrite") -> None:
    """Write rows in ranges of up to three keys, so scans can skip files.

    A seeded random number after the keys lets a single hot key value, or many
    copies of one row, span several ranges. The rows are checkpointed before, so a
    repeated task reads them in the same order and deals them the same way.
    """
    if len(keys) > MAX_CLUSTER_KEYS:
        raise ValueError(f"{len(keys)} cluster keys; at most {MAX_CLUSTER_KEYS} are of use")
    order = [F.col(k) if isinstance(k, str) else k for k in keys]
    ranged = cut_lineage(df).withColumn("__spread", F.rand(7)).repartitionByRange(*order, F.col("__spread"))
    ranged.sortWithinPartitions(*order).drop("__spread").write.mode(mode).parquet(path)


def _bounds(df: DataFrame, key: Column, parts: int) -> list:
    """The smallest values of at most ``parts`` ranges with about as many rows each; the first range has none."""
    ranged = df.select(key.alias("key")).repartitionByRange(parts, "key")
    least = ranged.groupBy(F.spark_partition_id()).agg(F.min("key").alias("key")).where("key IS NOT NULL")
    return sorted(row["key"] for row in least.collect())[1:]


def _range_number(key: Column, bounds: Sequence, first: int = 0) -> Column:
    """In which of the ranges ``key`` lies, by a binary search written as one expression; NULL is in the first."""
    if not bounds:
        return F.lit(first)
    middle = len(bounds) // 2
    above = _range_number(key, bounds[middle + 1 :], first + middle + 1)
    return F.when(key >= F.lit(bounds[middle]), above).otherwise(_range_number(key, bounds[:middle], first))


def interleaved(numbers: Sequence[Column], bits: int) -> Column:
    """Position on the curve that takes the bits of all numbers in turn, the highest first."""
    parts = [
        F.shiftleft(F.shiftright(n.cast("long"), bit).bitwiseAND(F.lit(1)), bit * len(numbers) + len(numbers) - 1 - i)
        for i, n in enumerate(numbers)
        for bit in range(bits)
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def curve_write(df: DataFrame, path: str, keys: Sequence[str | Column], files: int | None = None, mode: str = "overwrite") -> None:
    """Write rows along a space-filling curve over all keys, so a filter on any of them can skip files.

    Every key is cut into 256 ranges of about equal size, and the range numbers are
    interleaved. The driver holds only the range bounds, at most 255 values a key.
    The curve is cut into ``files`` parts of about equal size (default: the shuffle
    partitions); a hot position spans several.
    """
    if not keys:
        raise ValueError("no keys to cluster by")
    fixed = cut_lineage(df)
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    numbers = [_range_number(c, _bounds(fixed, c, 1 << CURVE_BITS)) for c in columns]
    placed = fixed.withColumn("__curve", interleaved(numbers, CURVE_BITS)).withColumn("__spread", F.rand(7))
    order = F.col("__curve"), F.col("__spread")
    ranged = placed.repartitionByRange(files, *order) if files else placed.repartitionByRange(*order)
    ranged.sortWithinPartitions("__curve", *columns).drop("__curve", "__spread").write.mode(mode).parquet(path)


def partition_split_write(df: DataFrame, path: str, routes: Sequence[tuple[str, Column]], default: str = "default", column: str = "route") -> None:
    """Write the outputs of a split to one folder each, in one pass."""
    routed = df.withColumn(column, route_column(routes, default))
    routed.hint("rebalance", F.col(column)).write.mode("overwrite").partitionBy(column).parquet(path)


def processed_manifest(listing: DataFrame, manifest: DataFrame | None, key: str = "path") -> DataFrame:
    """Files that are not in the manifest yet."""
    return listing if manifest is None else anti_join(listing, manifest, key)


def mark_processed(files: DataFrame, manifest_path: str) -> None:
    """Append files to the manifest once their load has succeeded."""
    stamped = files.select("path", "length", "modificationTime", F.current_timestamp().alias("processed_at"))
    stamped.write.mode("append").parquet(manifest_path)
