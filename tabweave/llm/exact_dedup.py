"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest: one row per normalised text
with the document that stands for it. New rows are reduced to one per digest,
those whose digest is known are removed by a sort-merge anti-join, and the rest
is appended. Only DataFrame operations are used.

Null texts count as empty; empty texts are equal to each other. Rows that repeat
an id are rows of their own. A null id loses against any other id of equal
length. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm.base import query
from tabweave.llm.frames import documents, join_groups, shuffle_tasks, stored, temp_name

#: What normalisation deletes: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, digest of the normalised text, and length in code points of the original text."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(normalised(F.col(text_col)), 256).alias("digest"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_points"),
    )


def representatives(rows: DataFrame) -> DataFrame:
    """One row per digest: the longest original text, then the smallest id, stands for it."""
    best = F.max(F.struct("n_points", (-F.col("doc_id")).alias("minus_id")))
    return (
        rows.groupBy("digest")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", (-F.col("best.minus_id")).alias("keep_id"), "best.n_points", "group_size")
    )


@dataclasses.dataclass(frozen=True)
class DigestIndex:
    """A persistent table of known digests, bucketed and sorted by digest."""

    table: str
    buckets: int

    def open(self, spark: SparkSession) -> DataFrame:
        """The table, made empty where it does not exist yet."""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest STRING, keep_id BIGINT, n_points INT, group_size BIGINT)"
            f" USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
        )
        return spark.table(self.table)

    def append(self, found: DataFrame) -> DataFrame:
        """Add the digests of ``found`` that the index lacks; returns the rows that were new.

        ``found`` has one row per digest. The anti-join reads the index in its
        sorted buckets without a shuffle.
        """
        known = self.open(found.sparkSession).select("digest").hint("merge")
        new = stored(found.join(known, "digest", "left_anti"), "digests-new")
        columns = "digest", "keep_id", "n_points", "group_size"
        writer = new.select(*columns).repartition(self.buckets, "digest").write.format("parquet")
        writer.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.table)
        return new


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of ``docs`` to keep: first of their text here, and not in the index before. The index learns them."""
    return index.append(representatives(digests(docs, id_col, text_col))).select(F.col("keep_id").alias(id_col))


def groups(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Every row with the row that stands for its text, after the index has taken in ``docs``."""
    rows = stored(digests(docs), "digests")
    index.append(representatives(rows))
    known = index.open(rows.sparkSession).select("digest", "keep_id", "group_size")
    return join_groups(rows, known, "digest", "group_size", rows.count())


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
         length(coalesce(text, '')) AS n_points
  FROM documents
), k AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""


@query("op9_exact_dedup", SQL)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(temp_name("digest_index"), shuffle_tasks(spark))
    return groups(documents(spark, sf_dir), index).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each text. Rows without id can't be told apart and stay."""
    index = DigestIndex(temp_name("pipeline_index"), shuffle_tasks(spark))
    dropped = groups(docs, index).filter("doc_id <> keep_id").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti")
