"""Change feeds and file feeds as streaming queries.

Tables and aggregates that follow a feed live in the state store of a streaming
aggregation. The checkpoint is the feed's position and holds that state, so a
batch that runs again after a failure counts once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tabweave.operators.cdc import ACTION, IS_UPDATE, SEQ
from tabweave.plans.measures import Measure, finished, resolved, slot

Trigger = Mapping[str, object]
AVAILABLE_NOW: Trigger = {"availableNow": True}
EVERY_MINUTE: Trigger = {"processingTime": "1 minute"}

#: Refresh cadence and the trigger interval it asks for (fixed values).
TARGET_LAG = {"real-time": "60 seconds", "hourly": "1 hour", "daily": "1 day", "weekly": "7 days"}

def lag_trigger(cadence: str) -> Trigger:
    return {"processingTime": TARGET_LAG[cadence]}


def file_feed(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    source_format: str = "parquet",
    max_files: int | None = None,
    glob: str | None = None,
    **options,
) -> DataFrame:
    """A folder as a stream: every file is delivered once."""
    reader = spark.readStream.format(source_format).schema(schema).options(**options)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def stream_append(feed: DataFrame, out_path: str, checkpoint: str, trigger: Trigger = EVERY_MINUTE) -> StreamingQuery:
    """Append new rows to a target; of a change feed only the INSERT rows."""
    rows = feed.where(F.col(ACTION) == "INSERT") if ACTION in feed.columns else feed
    return (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start(out_path)
    )


def auto_ingest(
    spark: SparkSession,
    in_path: str,
    schema: T.StructType | str,
    out_path: str,
    checkpoint: str,
    trigger: Trigger = EVERY_MINUTE,
    max_files: int | None = None,
    glob: str | None = "*.csv",
    **options,
) -> StreamingQuery:
    """Load delimited files as they arrive, each once, with the file they came from."""
    feed = file_feed(spark, in_path, schema, "csv", max_files, glob, recursiveFileLookup=True, **options)
    return stream_append(
        feed.select("*", F.col("_metadata.file_name").alias("file_name")), out_path, checkpoint, trigger
    )


def state_of(spark: SparkSession, checkpoint: str, columns: Sequence[str]) -> DataFrame | None:
    """What a streaming aggregation holds after its last batch, by its key and buffer columns; None before the first."""
    try:
        state = spark.read.format("statestore").load(checkpoint)
    except PySparkException as error:
        if error.getCondition() != "STDS_COMMITTED_BATCH_UNAVAILABLE":
            raise
        return None
    keys, buffers = (state.schema[c].dataType for c in ("key", "value"))
    # Buffers of one kind share a name. That of a decimal sum is followed by a flag.
    names = iter(columns[len(keys) :])
    renamed = T.StructType([T.StructField(f"__flag_{i}" if f.name == "isEmpty" else next(names), f.dataType) for i, f in enumerate(buffers)])
    named = state.select("key.*", F.col("value").cast(renamed).alias("__value"))
    return named.select(*named.columns[:-1], "__value.*").toDF(*columns[: len(keys)], *renamed.names)


class ChangeTable:
    """A keyed table held by Spark's state store: per key the change with the highest sequence number.

    A deleted key stays as a tombstone with its number, so batches that come late,
    repeatedly or in any order lead to the same table. Of one number, the live row
    wins over the deleted one it replaces. A batch costs the keys that it touches.
    Large tables want ``spark.sql.streaming.stateStore.providerClass`` set to the
    RocksDB provider.
    """

    def __init__(self, spark: SparkSession, checkpoint: str, key: Sequence[str], schema: T.StructType):
        self.spark, self.checkpoint, self.key, self.schema = spark, checkpoint, list(key), schema

    def latest(self, changes: DataFrame) -> DataFrame:
        live = (F.col(ACTION) == "INSERT").alias("live")
        rest = [F.col(c) for c in self.schema.names if c not in self.key]
        order = F.struct(F.col(SEQ).cast("long").alias("seq"), live)
        return changes.groupBy(*self.key).agg(F.max_by(F.struct(live, *rest), order).alias("row"))

    def current(self) -> DataFrame:
        """The live rows after the last finished batch."""
        state = state_of(self.spark, self.checkpoint, [*self.key, "__row", "__order"])
        if state is None:
            return self.spark.createDataFrame([], self.schema)
        columns = [F.col(c) if c in self.key else F.col("__row")[c].alias(c) for c in self.schema.names]
        return state.where("__row.live").select(*columns)


def stream_cdc_foreach_batch(
    feed: DataFrame,
    target: ChangeTable,
    on_batch: Callable[[DataFrame, int], None] | None = None,
    trigger: Trigger = EVERY_MINUTE,
) -> StreamingQuery:
    """Take the change rows of every micro-batch into ``target``; ``batch_counts`` shows what came.

    ``on_batch`` gets the keys that a batch has changed, each with its latest change ``row``.
    """
    kinds = {"inserts": ("INSERT", False), "updates": ("INSERT", True), "deletes": ("DELETE", False)}
    counts = [F.count_if((F.col(ACTION) == a) & (F.col(IS_UPDATE) == F.lit(u))).alias(n) for n, (a, u) in kinds.items()]
    writer = target.latest(feed.observe("changes", *counts)).writeStream.outputMode("update")
    writer = writer.foreachBatch(on_batch) if on_batch else writer.format("noop")
    return writer.option("checkpointLocation", target.checkpoint).trigger(**trigger).start()


def batch_counts(query: StreamingQuery) -> DataFrame:
    """Inserts, updates and deletes of the query's recent batches, from its progress reports."""
    spark = SparkSession.active()
    found = [(p["batchId"], p["observedMetrics"]["changes"]) for p in query.recentProgress if "changes" in p["observedMetrics"]]
    rows = [(i, c["inserts"], c["updates"], c["deletes"]) for i, c in found]
    return spark.createDataFrame(rows, "batch_id bigint, inserts bigint, updates bigint, deletes bigint")


class IncrementalAggregate:
    """A grouped result that follows a table through inserts, updates and deletes.

    The state store keeps signed sums and counts per group, and for minima, maxima
    and distinct counts how many rows hold each value. An update is a DELETE of the
    old row and an INSERT of the new one. A batch costs the groups and values that
    it touches; a hot group is combined before the shuffle. Sums are exact for whole
    numbers and decimals. Rows of a feed without change columns are inserts.
    """

    def __init__(self, spark: SparkSession, checkpoint: str, measures: Sequence[Measure], by: Sequence[str]):
        self.spark, self.checkpoint, self.measures, self.by = spark, checkpoint, resolved(measures), list(by)
        aggs = {slot(x, p): a for x in self.measures if not x.needs for p, a in x.base.items()}
        self.sums = {s: a for s, a in aggs.items() if a.signed}
        self.values = {s: a for s, a in aggs.items() if a.distinct or a.extreme}
        stuck = aggs.keys() - self.sums.keys() - self.values.keys()
        if stuck:
            raise ValueError(f"{sorted(stuck)} cannot follow deletes")
        self.show = [x.name for x in measures]

    def state(self, feed: DataFrame) -> DataFrame:
        """Signed sums and value counts of the feed's rows."""
        sign = F.when(F.col(ACTION) == "DELETE", -1).otherwise(1) if ACTION in feed.columns else F.lit(1)
        kinds = feed.select(*[a.input().alias(s) for s, a in (self.sums | self.values).items()]).schema
        inputs = feed.select(*self.by, sign.cast("long").alias("__sign"), *[a.input().alias(s) for s, a in (self.sums | self.values).items()])

        def part(number: int, value: str | None) -> Column:
            """One row of a change: all its sums, or one value."""
            nothing = {s: F.lit(None).cast(kinds[s].dataType) for s in (*self.sums, *self.values)}
            shown = {s: F.col(f"`{s}`") for s in (self.sums if value is None else [value])}
            return F.struct(F.lit(number).alias("__part"), *[(shown | {}).get(s, nothing[s]).alias(s) for s in (*self.sums, *self.values)])

        parts = F.array(part(0, None), *[F.when(F.col(f"`{s}`").isNotNull(), part(i, s)) for i, s in enumerate(self.values, 1)])
        rows = inputs.select(*self.by, "__sign", F.explode(F.array_compact(parts)).alias("__p")).select(*self.by, "__sign", "__p.*")
        signed = []
        for s, a in self.sums.items():
            held = F.col(f"`{s}`")
            amount = F.when(held.isNotNull(), F.lit(1)) if a.counts else held
            signed += [F.sum(amount * F.col("__sign")), F.sum(F.when(held.isNotNull(), F.col("__sign")))]
        return rows.groupBy(*self.by, "__part", *[F.col(f"`{s}`") for s in self.values]).agg(F.sum("__sign"), *signed)

    def start(self, feed: DataFrame, trigger: Trigger = EVERY_MINUTE) -> StreamingQuery:
        writer = self.state(feed).writeStream.outputMode("update").format("noop")
        return writer.option("checkpointLocation", self.checkpoint).trigger(**trigger).start()

    def result(self, by: Sequence[str] | None = None) -> DataFrame:
        """The current aggregate, also for a coarser grouping."""
        by = self.by if by is None else list(by)
        sums = [c for s in self.sums for c in (s, f"{s} held")]
        names = [*self.by, "__part", *self.values, "__n", *sums]
        state = state_of(self.spark, self.checkpoint, names)
        if state is None:
            raise ValueError("no batch has been taken yet")
        own = F.col("__part") == 0
        folds = []
        for s, a in self.sums.items():
            total = F.sum(F.when(own, F.col(f"`{s}`")))
            held = F.sum(F.when(own, F.col(f"`{s} held`")))
            folds.append((F.coalesce(total, F.lit(0)) if a.counts else F.when(held > 0, total)).alias(s))
        for i, (s, a) in enumerate(self.values.items(), 1):
            folds.append(a.fold(F.when((F.col("__part") == i) & (F.col("__n") > 0), F.col(f"`{s}`"))).alias(s))
        rows = F.sum(F.when(own, F.col("__n"))).alias("__rows")
        merged = state.groupBy(*by).agg(rows, *folds)
        if by:
            merged = merged.where("__rows > 0")
        return finished(merged, self.measures, by, self.show)


def stream_multi_target(
    feed: DataFrame,
    targets: Mapping[str, Callable[[DataFrame], DataFrame]],
    root: str,
    checkpoint: str,
    trigger: Trigger = EVERY_MINUTE,
) -> StreamingQuery:
    """Fan one feed out to several targets; the batch is read once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        shared = batch.persist()
        try:
            for name, transform in targets.items():
                transform(shared).write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
        finally:
            shared.unpersist()

    return (
        feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )

