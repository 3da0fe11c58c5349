"""Helpers for tables that are written between steps and for joins on skewed keys."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.session import scratch_dir

HOT_KEYS = 256


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read again, so that a lost executor costs no recomputation."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def temp_name(prefix: str) -> str:
    return f"__{prefix}_{uuid.uuid4().hex[:8]}"


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row per key, safe when a key holds a large part of all rows.

    ``groups`` is a stored table with the number of rows of each key in ``size``.
    Keys with more than 1 / HOT_KEYS of ``total`` rows are fewer than HOT_KEYS;
    these few are broadcast, so their rows are never shuffled. The rest has no
    large key.
    """
    limit = total / HOT_KEYS
    hot = groups.filter((F.col(size) > limit) & (F.col(size) > 1))
    cold = groups.filter(~((F.col(size) > limit) & (F.col(size) > 1)))
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return near.unionByName(far)
