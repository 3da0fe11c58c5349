"""Shards that are balanced in bytes, tokens and rows by vector bin packing.

A group (equal texts) is a vector of bytes, tokens and rows. Each group goes to
the shard where the dot product of its vector with the shard's residual capacity
is highest. Large groups, at most SHARES * 3 per shard, are placed first, one
after another; a group of more than a shard's SHARES-th part is cut into pieces
of at most that size, so copies that hold a large part of all rows spread over
shards. The many small groups are dealt to buckets, and every bucket is packed
on its own against its part of the capacity that the large groups left.

Null and empty texts have no bytes and no tokens, and are one group. Ids may be
null or repeat; every row gets a place. Other columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabweave.llm.base import query
from tabweave.llm.frames import documents, stored

SHARDS = 40
ROW_BYTES = 16
SHARES = 64
BUCKET_GROUPS = 4000
PART_ROWS = 4000
DIMENSIONS = ["size", "tokens", "rows"]


def place(vectors: np.ndarray, capacity: np.ndarray, first: int = 0) -> np.ndarray:
    """Shard of each vector, in the given order; ``capacity`` (shards x dimensions) is used up.

    Dimensions are scaled by their capacity, so they count alike. Among equal
    products the shard that comes first after ``first`` is taken.
    """
    shards = len(capacity)
    scale = np.maximum(capacity.clip(0).sum(0), 1e-9) / shards
    left = np.roll(capacity / scale, -first, axis=0)
    scaled = vectors / scale
    out = np.empty(len(vectors), np.int64)
    for i, v in enumerate(scaled):
        out[i] = k = int(np.argmax(left @ v))
        left[k] -= v
    return (out + first) % shards


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Size, tokens, checksum and group of every row. Tokens are words between white space."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_size(F.split(F.trim(text), r"[\x20\x09-\x0D]+"))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.when(F.trim(text) == "", 0).otherwise(words).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text, 256).alias("group"),
    )


def pack(rows: DataFrame, shards: int = SHARDS, shares: int = SHARES) -> DataFrame:
    """``rows`` of ``sized`` with their shard."""
    spark = rows.sparkSession
    groups = rows.groupBy("group").agg(
        F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")
    )
    groups = stored(groups, "groups")
    n_groups, *totals = groups.agg(F.count(F.lit(1)), *(F.sum(c) for c in DIMENSIONS)).first()
    totals = np.array([float(x or 0) for x in totals])
    limits = np.maximum(totals / (shards * shares), 1)

    is_large = F.lit(False)
    for name, limit in zip(DIMENSIONS, limits, strict=True):
        is_large = is_large | (F.col(name) > float(limit))
    large = groups.filter(is_large).orderBy(F.desc("size"), "group").collect()
    pieces = []
    for g in large:
        v = np.array([g.size, g.tokens, g.rows], float)
        n = int(min(g.rows, np.ceil((v / limits).max())))
        pieces += [(g.group, n, i, v / n) for i in range(n)]
    capacity = np.tile(totals / shards, (shards, 1))
    vectors = np.array([p[3] for p in pieces]).reshape(-1, 3)
    order = np.argsort(-(vectors / limits).max(1), kind="stable") if len(pieces) else []
    chosen = place(vectors[order], capacity) if len(pieces) else np.empty(0, np.int64)
    for at, k in zip(order, chosen, strict=True):
        capacity[k] -= vectors[at]
    of_group: dict[str, list[int]] = {}
    for at, k in sorted(zip(order, chosen, strict=True)):
        of_group.setdefault(pieces[at][0], []).append(int(k))
    placed = F.broadcast(spark.createDataFrame(list(of_group.items()), "group string, places array<int>"))
    near = numbered(stored(rows.join(placed, "group"), "large-groups"), "group", "number")
    piece = F.pmod(F.col("number"), F.size("places").cast("long")).cast("int")
    near = near.withColumn("shard", F.get("places", piece)).drop("places", "number")

    buckets = max(1, -(-n_groups // BUCKET_GROUPS))
    room = capacity.clip(0)
    share = room / np.maximum(room.sum(0), 1e-9)

    def pack_bucket(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        v = frame[DIMENSIONS].to_numpy(float)
        order = np.lexsort((frame.group.to_numpy(), -(v / limits).max(1)))
        out = np.empty(len(v), np.int64)
        out[order] = place(v[order], share * v.sum(0), key[0] * 7 % shards)
        return pd.DataFrame({"group": frame.group, "shard": out.astype(np.int32)})

    small = groups.filter(~is_large).withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets)).cast("int"))
    shard_of = stored(small.groupBy("bucket").applyInPandas(pack_bucket, "group string, shard int"), "shards")
    far = rows.join(placed.select("group"), "group", "left_anti").join(shard_of, "group")
    return near.unionByName(far)


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Gapless numbers from 0 within each ``key``: rows are numbered in small parts, parts by running sums."""
    parts = max(1, -(-rows.count() // PART_ROWS))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "group"), F.lit(parts)).cast("int"))
    counts = rows.groupBy(key, "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(counts.select(key, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "starts")
    own = Window.partitionBy("part", key).orderBy("doc_id", "group")
    out = rows.withColumn("at", F.row_number().over(own) - 1).join(starts, ["part", key])
    return out.withColumn(name, F.col("at") + F.col("start")).drop("part", "at", "start")


@query("op2_shards")
def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(sized(documents(spark, sf_dir)), "sized")
    placed = numbered(stored(pack(rows), "packed"), "shard", "slot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "tokens",
    )
