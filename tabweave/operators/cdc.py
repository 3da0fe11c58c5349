"""Change feeds: derive, split, net and apply inserts, updates and deletes.

A change row carries the table's columns plus ``_action`` (INSERT or DELETE),
``_is_update`` and ``_seq``; an update is a DELETE and an INSERT row that both
have ``_is_update`` set. Where both would share a position the INSERT counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.operators.joins import anti_join, semi_join

ACTION, IS_UPDATE, SEQ, ROW_ID = "_action", "_is_update", "_seq", "_row_id"
CONTROL = (ACTION, IS_UPDATE, SEQ, ROW_ID)


def payload_columns(changes: DataFrame) -> list[str]:
    return [c for c in changes.columns if c not in CONTROL]


def initial_rows(snapshot: DataFrame) -> DataFrame:
    """The whole table as change rows, for the first read of a feed."""
    return snapshot.withColumns({ACTION: F.lit("INSERT"), IS_UPDATE: F.lit(False)})


def cdc_diff(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Change rows that lead from one snapshot to the next; keys are unique.

    Both snapshots shuffle once on the key, and each key comes out as the pair
    of its old and new row.
    """
    columns = new.columns
    sides = [
        df.select(*columns).withColumn("__side", F.lit(side)) for side, df in (("old", old), ("new", new))
    ]

    def side(name: str) -> Column:
        return F.max(F.when(F.col("__side") == name, F.struct(*columns))).alias(f"__{name}")

    pairs = sides[0].unionByName(sides[1]).groupBy(*key).agg(side("old"), side("new"))
    before, after = F.col("__old"), F.col("__new")
    changed = pairs.where(~before.eqNullSafe(after))
    updated = before.isNotNull() & after.isNotNull()

    def change(row: Column, action: str) -> Column:
        return F.struct(row.alias("row"), F.lit(action).alias(ACTION), updated.alias(IS_UPDATE))

    rows = F.array_compact(
        F.array(
            F.when(before.isNotNull(), change(before, "DELETE")), F.when(after.isNotNull(), change(after, "INSERT"))
        )
    )
    return changed.select(F.explode(rows).alias("__change")).select(
        *[F.col("__change.row")[c].alias(c) for c in columns],
        F.col("__change")[ACTION].alias(ACTION),
        F.col("__change")[IS_UPDATE].alias(IS_UPDATE),
    )


def _kind(action: str, is_update: bool) -> Column:
    return (F.col(ACTION) == action) & (F.col(IS_UPDATE) == F.lit(is_update))


def cdc_split(changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Inserts, updates (their INSERT half) and deletes."""
    return (
        changes.where(_kind("INSERT", False)),
        changes.where(_kind("INSERT", True)),
        changes.where(_kind("DELETE", False)),
    )


def cdc_net_changes(changes: DataFrame, key: Sequence[str], seq: str = SEQ) -> DataFrame:
    """One row per key with the net effect of its changes.

    The first change says whether the key existed before, the last one what it
    is now: new keys come out as inserts, known keys as updates or deletes, and
    keys that came and went do not come out. Both picks are aggregates with
    map-side combine, so a key with very many changes does not gather in one task.
    """
    live = F.col(ACTION) == "INSERT"
    rest = [c for c in changes.columns if c not in key and c not in (ACTION, IS_UPDATE)]
    picks = changes.groupBy(*key).agg(
        F.min(F.struct(F.col(seq).alias("at"), live.alias("live"), F.col(IS_UPDATE).alias("update"))).alias("__first"),
        F.max(F.struct(F.col(seq).alias("__at"), live.alias("__live"), *[F.col(c) for c in rest])).alias("__last"),
    )
    known = ~F.col("__first.live") | F.col("__first.update")
    now = F.col("__last.__live")
    shown = {
        ACTION: F.when(now, F.lit("INSERT")).otherwise(F.lit("DELETE")),
        IS_UPDATE: now & known,
    }
    return picks.where(now | known).select(
        *[
            F.col(c) if c in key else shown[c].alias(c) if c in shown else F.col("__last")[c].alias(c)
            for c in changes.columns
        ]
    )


def cdc_apply_insert(target: DataFrame, inserts: DataFrame, key: Sequence[str]) -> DataFrame:
    """Append rows whose key is new; a replayed insert changes nothing."""
    return target.unionByName(anti_join(inserts.select(*target.columns), target, key))


def cdc_apply_update(target: DataFrame, updates: DataFrame, key: Sequence[str]) -> DataFrame:
    """Overwrite matched rows; updates without a target row do nothing."""
    rows = updates.select(*target.columns)
    return anti_join(target, rows, key).unionByName(semi_join(rows, target, key))


def cdc_apply_delete(target: DataFrame, deletes: DataFrame, key: Sequence[str]) -> DataFrame:
    return anti_join(target, deletes, key)


def cdc_merge(target: DataFrame, net: DataFrame, key: Sequence[str]) -> DataFrame:
    """Upsert and delete at once: untouched rows plus the live net rows.

    Written as an anti-join and a union, a small change set leaves a large
    target unshuffled.
    """
    live = net.where(F.col(ACTION) == "INSERT").select(*target.columns)
    return anti_join(target, net, key).unionByName(live)


def cdc_counts(changes: DataFrame) -> DataFrame:
    """Inserts, updates and deletes of a change set, one row."""
    return changes.agg(
        F.count_if(_kind("INSERT", False)).alias("inserts"),
        F.count_if(_kind("INSERT", True)).alias("updates"),
        F.count_if(_kind("DELETE", False)).alias("deletes"),
    )


def watermark_extract(df: DataFrame, ts_col: str, state: DataFrame, state_col: str = "last_processed") -> DataFrame:
    """Rows newer than the stored high watermark; all rows when there is none.

    The watermark is one value, read once, so the filter reaches the scan.
    Deleted rows are not seen by this kind of extract.
    """
    mark = state.agg(F.max(state_col)).first()[0]
    return df if mark is None else df.where(F.col(ts_col) > F.lit(mark).cast(df.schema[ts_col].dataType))


def mark_state(state: DataFrame, table_name: str, status: str, last_processed=None, offset: str | None = None) -> DataFrame:
    """The state table with one entry set to running or idle (added if new)."""
    spark, columns = state.sparkSession, ["table_name", "last_processed", "stream_offset", "status"]
    here = F.col("table_name") == table_name
    kept = state.where(~here)
    if last_processed is None and offset is None:
        known = state.where(here).withColumn("status", F.lit(status))
        if not known.isEmpty():
            return kept.unionByName(known)
    kinds = state.schema
    entry = spark.range(1).select(
        F.lit(table_name).alias("table_name"),
        F.lit(last_processed).cast(kinds["last_processed"].dataType).alias("last_processed"),
        F.lit(offset).cast("string").alias("stream_offset"),
        F.lit(status).alias("status"),
    )
    return kept.unionByName(entry).select(*columns)

