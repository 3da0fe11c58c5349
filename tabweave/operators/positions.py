"""Exact positions in a global order without a single-partition window.

Row numbers, ranks and percentiles need to know how many rows come before a row.
The rows are range partitioned and checkpointed with the number of their slice.
One small row per slice and group then carries the offset, and each slice is
numbered on its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.operators.joins import null_safe_join
from tabweave.session import cut_lineage

_SLICE = "__slice"


def running_before(
    df: DataFrame,
    order_by: Sequence[str | Column],
    weight: str | None = None,
    within: Sequence[str] = (),
    out: str = "rows_before",
    total: str | None = None,
) -> DataFrame:
    """Add the total ``weight`` (or row count) of the rows ordered before a row.

    With ``within`` the count starts anew in each group, and ``total`` names a
    column for the group's whole weight. ``order_by`` has to tell the rows of a
    group apart: rows that share all its values land in one slice, so group
    repeated values first and pass their count as ``weight``.
    """
    order = [F.col(item) if isinstance(item, str) else item for item in order_by]
    if weight is None and not within and total is None:
        return _rows_before(df, order, out)
    size = F.col(weight) if weight else F.lit(1)
    ranged = df.repartitionByRange(*[F.col(c) for c in within], *order)
    sliced = cut_lineage(ranged.withColumn(_SLICE, F.spark_partition_id()))
    # A group has at most one part per slice, which bounds these two windows.
    parts = sliced.groupBy(_SLICE, *within).agg(F.sum(size).cast("long").alias("__n"))
    group = Window.partitionBy(*within)
    parts = parts.select(
        _SLICE,
        *within,
        (F.sum("__n").over(group.orderBy(_SLICE)) - F.col("__n")).alias("__start"),
        *([F.sum("__n").over(group).alias(total)] if total else []),
    )
    inside = Window.partitionBy(_SLICE, *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = sliced.withColumn("__inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return (
        null_safe_join(numbered, parts, [_SLICE, *within])
        .withColumn(out, (F.col("__inside") + F.col("__start")).cast("long"))
        .drop(_SLICE, "__start", "__inside")
    )


def _rows_before(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Row counts without groups or weights: one range shuffle.

    Each slice is sorted where it is, and its rows are numbered by
    ``monotonically_increasing_id``, which holds the slice above bit 33 and the
    place in the slice below. Checkpointed, these numbers are fixed.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(sorted_.withColumn("__id", F.monotonically_increasing_id()))
    slice_ = F.shiftright("__id", 33)
    sizes = placed.groupBy(slice_.alias("__at")).agg(F.count(F.lit(1)).alias("__n"))
    # One row per slice: as many as the shuffle has partitions.
    starts = sizes.select("__at", (F.sum("__n").over(Window.orderBy("__at")) - F.col("__n")).alias("__start"))
    joined = placed.join(starts, slice_ == F.col("__at"))
    before = F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn(out, before.cast("long")).drop("__id", "__at", "__start")


def number_rows(df: DataFrame, order_by: Sequence[str | Column], out: str = "row_number", start: int | Column = 1) -> DataFrame:
    """Dense global row numbers from ``start``; ``order_by`` is a unique key."""
    first = start if isinstance(start, Column) else F.lit(start)
    return running_before(df, order_by, out=out).withColumn(out, (F.col(out) + first).cast("long"))


def _tallies(df: DataFrame, value: str, within: Sequence[str]) -> DataFrame:
    return df.groupBy(*within, value).agg(F.count(F.lit(1)).alias("__n"))


def rank_by(df: DataFrame, value: str, within: Sequence[str] = (), descending: bool = True, out: str = "rank") -> DataFrame:
    """SQL ``rank()`` of ``value``, optionally inside ``within`` groups.

    Equal values are counted before they are placed, so a value or a group that
    holds most rows costs one row in the ordered part.
    """
    # Read twice below, so whatever led to these rows should run once.
    df = cut_lineage(df)
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    placed = running_before(_tallies(df, value, within), [order], "__n", within, "__before")
    ranks = placed.select(*within, value, (F.col("__before") + 1).alias(out))
    return null_safe_join(df, ranks, [*within, value])


def exact_percentiles(df: DataFrame, value: str, points: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Interpolated exact percentiles per group, whatever the group sizes.

    ``points`` maps output names to fractions, e.g. ``{"median": 0.5}``.
    """
    tallies = _tallies(df.where(F.col(value).isNotNull()), value, by)
    placed = running_before(tallies, [value], "__n", by, "__before", total="__size")
    first, last = F.col("__before"), F.col("__before") + F.col("__n") - 1
    picks = []
    for name, fraction in points.items():
        at = F.lit(float(fraction)) * (F.col("__size") - 1)
        below, above = F.floor(at), F.ceil(at)
        picks += [
            F.max(F.when(below.between(first, last), F.col(value))).alias(f"__lo_{name}"),
            F.max(F.when(above.between(first, last), F.col(value))).alias(f"__hi_{name}"),
            F.max(at - below).alias(f"__part_{name}"),
        ]
    found = placed.groupBy(*by).agg(*picks)
    return found.select(
        *by,
        *[
            (F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__part_{n}")).alias(n)
            for n in points
        ],
    )


def exact_quantiles(
    df: DataFrame, points: Mapping[str, tuple[Column, float, Column | None]], by: Sequence[str] = ()
) -> DataFrame:
    """Interpolated exact percentiles of several columns per group, all in one pass.

    ``points`` maps output names to a value column, a fraction and, if some rows only
    count, the predicate that holds for these. NULL values do not count. A column that
    is given several times is tallied once: an entry per row and column goes into the
    tally, and each predicate is a count beside it.
    """
    columns: dict[int, Column] = {id(value): value for value, _, _ in points.values()}
    keeps: dict[int, dict[int, Column]] = {i: {} for i in columns}
    for value, _, keep in points.values():
        keeps[id(value)][id(keep)] = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    width = max(map(len, keeps.values()))
    number = {(i, k): at * width + j for at, i in enumerate(columns) for j, k in enumerate(keeps[i])}
    flags = [f"__flag_{j}" for j in range(width)]
    entries = []
    for at, (i, value) in enumerate(columns.items()):
        own = [*keeps[i].values(), *[F.lit(False)] * (width - len(keeps[i]))]
        entries.append(F.struct(F.lit(at).alias("__at"), value.cast("double").alias("__value"), *[k.alias(f) for k, f in zip(own, flags, strict=True)]))
    rows = df.select(*by, F.inline(F.array(*entries))).where(F.col("__value").isNotNull() & reduce(lambda a, b: a | b, map(F.col, flags)))
    counted = rows.groupBy(*by, "__at", "__value").agg(*[F.count_if(F.col(f)).alias(f) for f in flags])
    parts = [F.struct((F.col("__at") * width + j).alias("__column"), F.col(f).alias("__n")) for j, f in enumerate(flags)]
    tallies = counted.select(*by, "__value", F.inline(F.array(*parts))).where("__n > 0")
    placed = running_before(tallies, ["__value"], "__n", [*by, "__column"], "__before", total="__size")
    first, last = F.col("__before"), F.col("__before") + F.col("__n") - 1
    picks, out = [], []
    for i, (name, (value, fraction, keep)) in enumerate(points.items()):
        own = F.col("__column") == number[id(value), id(keep)]
        at = F.lit(float(fraction)) * (F.col("__size") - 1)
        below, above = F.floor(at), F.ceil(at)
        low, high, part = (f"__{kind}_{i}" for kind in ("low", "high", "part"))
        picks += [
            F.max(F.when(own & below.between(first, last), F.col("__value"))).alias(low),
            F.max(F.when(own & above.between(first, last), F.col("__value"))).alias(high),
            F.max(F.when(own, at - below)).alias(part),
        ]
        out.append((F.col(low) + (F.col(high) - F.col(low)) * F.col(part)).alias(name))
    return placed.groupBy(*by).agg(*picks).select(*by, *out)
