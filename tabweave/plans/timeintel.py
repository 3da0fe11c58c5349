"""Calendar tables and period functions.

Every function takes an explicit date axis and, where "today" would be the
anchor, an explicit ``as_of``. Shifts are equi-joins on a shifted date, so gaps
in the data do not move a value to a wrong day. Windows run over one row per day
and key, which bounds them by the length of the calendar.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tabweave.operators.joins import null_safe_join
from tabweave.plans.measures import Measure, accumulated, calculate_filter, evaluate, finished, resolved, slot

#: First day and length of the default calendar (fixed values): 2000-01-01 to 2049-12-31.
#: ``date_spine_of`` covers the dates that a table holds.
CALENDAR_START = "2000-01-01"
CALENDAR_DAYS = 18263

MONTHS = {"month": 1, "quarter": 3, "year": 12}


def _date(value: str | dt.date | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def period_start(day: Column, unit: str) -> Column:
    return day.cast("date") if unit == "day" else F.trunc(day, unit)


def shift(day: Column, n: int, unit: str) -> Column:
    """Move a date by whole units; month ends are clamped."""
    if unit in ("day", "week"):
        return F.date_add(day, n * (7 if unit == "week" else 1))
    return F.add_months(day, n * MONTHS[unit])


# -- calendar ------------------------------------------------------------


def calendar_columns(day: Column) -> dict[str, Column]:
    return {
        "year": F.year(day),
        "month_num": F.month(day),
        "weekday_num": F.dayofweek(day),
        "month_start": F.trunc(day, "month"),
        "quarter_start": F.trunc(day, "quarter"),
        "year_start": F.trunc(day, "year"),
        "month_end": F.last_day(day),
    }


def date_spine(spark: SparkSession, start: str = CALENDAR_START, days: int = CALENDAR_DAYS) -> DataFrame:
    """One row per day from ``start`` with its calendar attributes."""
    return (
        spark.range(days)
        .select(F.date_add(_date(start), F.col("id").cast("int")).alias("date_key"))
        .withColumns(calendar_columns(F.col("date_key")))
    )


def date_spine_of(df: DataFrame, date_col: str) -> DataFrame:
    """The calendar that covers the dates found in ``df``, whole years."""
    day = F.col(date_col).cast("date")
    span = df.agg(F.trunc(F.min(day), "year").alias("lo"), F.max(day).alias("hi"))
    last = F.date_sub(F.add_months(F.trunc("hi", "year"), 12), 1)
    return span.select(F.explode(F.sequence("lo", last)).alias("date_key")).withColumns(
        calendar_columns(F.col("date_key"))
    )


def densify_dates(
    df: DataFrame, date_col: str, keys: Sequence[str], start: str | dt.date, end: str | dt.date, fill: dict | None = None
) -> DataFrame:
    """Give every key a row for every day from ``start`` to ``end``.

    The grid grows from the distinct keys by a date sequence per key; ``df`` has
    at most one row per key and day. A row outside the range is an error when the
    result is computed, as it would be lost.
    """
    outside = f"{date_col} lies outside {start} to {end}"
    inside = F.col(date_col).cast("date").between(_date(start), _date(end)) | F.col(date_col).isNull()
    df = df.withColumn(date_col, F.when(inside, F.col(date_col)).otherwise(F.raise_error(F.lit(outside))))
    days = F.explode(F.sequence(_date(start), _date(end))).alias(date_col)
    seeds = df.select(*keys).distinct() if keys else df.sparkSession.range(1)
    grid = seeds.select(*keys, days)
    dense = null_safe_join(grid, df, [*keys, date_col], "left")
    return dense.fillna(fill) if fill else dense


def calculated_table_view(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    df.createOrReplaceTempView(name)
    return spark.table(name)


# -- period functions over one row per day and key -------------------------


def daily_total(df: DataFrame, value: Column, date_col: str, by: Sequence[str] = (), out: str = "value") -> DataFrame:
    """Sum per day and key: the input of the period functions."""
    return (
        df.withColumn("date", F.col(date_col).cast("date")).groupBy(*by, "date").agg(F.sum(value).alias(out))
    )


def total_to_date(daily: DataFrame, value: str, unit: str, by: Sequence[str] = (), date_col: str = "date", out: str | None = None) -> DataFrame:
    """Running total since the start of the year, quarter or month."""
    window = (
        Window.partitionBy(*by, period_start(F.col(date_col), unit))
        .orderBy(date_col)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return daily.withColumn(out or f"{value}_{unit[0]}td", F.sum(value).over(window))


def date_shift(
    daily: DataFrame, value: str, n: int, unit: str, by: Sequence[str] = (), date_col: str = "date", out: str = "shifted"
) -> DataFrame:
    """The value of the date ``n`` units away, NULL where that day has none."""
    other = daily.select(*by, F.col(date_col).alias("__at"), F.col(value).alias(out))
    return null_safe_join(
        daily.withColumn("__at", shift(F.col(date_col), n, unit)), other, [*by, "__at"], "left"
    ).drop("__at")


def same_period_last_year(daily: DataFrame, value: str, by: Sequence[str] = (), date_col: str = "date", out: str = "last_year") -> DataFrame:
    return date_shift(daily, value, -1, "year", by, date_col, out)


def parallel_period(
    daily: DataFrame, value: str, n: int, unit: str, by: Sequence[str] = (), date_col: str = "date", out: str = "parallel"
) -> DataFrame:
    """Total of the whole period ``n`` units away from the row's period."""
    totals = daily.groupBy(*by, period_start(F.col(date_col), unit).alias("__at")).agg(F.sum(value).alias(out))
    at = shift(period_start(F.col(date_col), unit), n, unit)
    return null_safe_join(daily.withColumn("__at", at), totals, [*by, "__at"], "left").drop("__at")


def previous_period(daily: DataFrame, value: str, unit: str, by: Sequence[str] = (), date_col: str = "date", out: str | None = None) -> DataFrame:
    """Total of the whole previous month, quarter or year."""
    return parallel_period(daily, value, -1, unit, by, date_col, out or f"previous_{unit}")


def dates_in_period(
    daily: DataFrame, value: str, n: int, unit: str, by: Sequence[str] = (), date_col: str = "date", out: str = "rolling"
) -> DataFrame:
    """Rolling total of the last ``n`` units that end at each date."""
    number, width = _day_number(F.col(date_col), n, unit)
    return daily.withColumn(out, F.sum(value).over(Window.partitionBy(*by).orderBy(number).rangeBetween(1 - width, 0)))


def growth(current: Column, previous: Column) -> Column:
    return F.when(previous != 0, (current - previous) / previous)


# -- period functions over measures --------------------------------------


def measures_per(df: DataFrame, measures: Sequence[Measure], unit: str, date_col: str, by: Sequence[str] = (), show: Sequence[str] | None = None) -> DataFrame:
    """Any measures per group and day, month, quarter or year; ``date`` is the period's first day.

    ``date_shift`` moves the results: by one unit for the previous period, by a
    year for the same period of the last year.
    """
    rows = df.withColumn("date", period_start(F.col(date_col), unit))
    return evaluate(rows, measures, [*by, "date"], show=show)


def measures_to_date(
    df: DataFrame, measures: Sequence[Measure], unit: str, date_col: str, by: Sequence[str] = (), show: Sequence[str] | None = None
) -> DataFrame:
    """Measures since the start of the year, quarter or month, for every group and every day of the whole span.

    Partial results per day are merged along the period. A distinct value counts
    on the first day of the period that has it. Measures made of other
    aggregates cannot be accumulated.
    """
    show, measures = show or [m.name for m in measures], resolved(measures)
    rows = df.withColumn("date", F.col(date_col).cast("date")).where("date IS NOT NULL")
    start = period_start(F.col("date"), unit)

    def firsts(value: Column) -> DataFrame:
        first = rows.select(*by, "date", value.alias("__value")).where("__value IS NOT NULL")
        return first.groupBy(*by, "__value", start.alias("__period")).agg(F.min("date").alias("date")).withColumn("__change", F.lit(1))

    dense = _dense_days(rows, measures, by, firsts)
    period = Window.partitionBy(*by, start)
    window = period.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return finished(_moving(dense, measures, window, period, window), measures, [*by, "date"], show)


def measures_in_period(
    df: DataFrame, measures: Sequence[Measure], n: int, unit: str, date_col: str, by: Sequence[str] = (), show: Sequence[str] | None = None
) -> DataFrame:
    """Measures over the last ``n`` units, for every group and every day of the whole span.

    Partial results per day are merged over the moving frame. A distinct value is
    present from each day that has it until the frame has left that day or the value
    comes again; its arrivals and departures are summed up along the days. No row
    is copied to the days that see it.
    """
    show, measures = show or [m.name for m in measures], resolved(measures)
    rows = df.withColumn("date", F.col(date_col).cast("date")).where("date IS NOT NULL")

    def presence(value: Column) -> DataFrame:
        seen = rows.select(*by, "date", value.alias("__value")).where("__value IS NOT NULL").distinct()
        again = F.lead("date").over(Window.partitionBy(*by, "__value").orderBy("date"))
        until = F.least(period_end(F.col("date"), n, unit), F.col("__again"))
        events = F.array(F.struct(F.col("date"), F.lit(1).alias("__change")), F.struct(until.alias("date"), F.lit(-1).alias("__change")))
        return seen.withColumn("__again", again).select(*by, F.explode(events).alias("__event")).select(*by, "__event.*")

    dense = _dense_days(rows, measures, by, presence)
    group = Window.partitionBy(*by)
    number, width = _day_number(F.col("date"), n, unit)
    moving = group.orderBy(number).rangeBetween(1 - width, 0)
    so_far = group.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return finished(_moving(dense, measures, moving, group, so_far), measures, [*by, "date"], show)


def measures_parallel(
    df: DataFrame, measures: Sequence[Measure], n: int, unit: str, date_col: str, by: Sequence[str] = (), show: Sequence[str] | None = None
) -> DataFrame:
    """Any measures of each period and of the whole period ``n`` units away, named ``parallel_<measure>``."""
    show = show or [m.name for m in measures]
    periods = measures_per(df, measures, unit, date_col, by, show)
    other = periods.select(*by, F.col("date").alias("__at"), *[F.col(f"`{c}`").alias(f"parallel_{c}") for c in show])
    return null_safe_join(periods.withColumn("__at", shift(F.col("date"), n, unit)), other, [*by, "__at"], "left").drop("__at")


def _day_number(day: Column, n: int, unit: str) -> tuple[Column, int]:
    """A number per day and how many of them ``n`` units take."""
    if unit in ("day", "week"):
        return F.datediff(day, _date("1970-01-01")), n * (7 if unit == "week" else 1)
    # Months of 32 numbers: a day's number less n months is the same day n months ago, and no
    # day of a shorter month lies behind it.
    return (F.year(day) * 12 + F.month(day)) * 32 + F.day(day), 32 * n * MONTHS[unit]


def period_end(day: Column, n: int, unit: str) -> Column:
    """The first day whose last ``n`` units do not reach back to ``day``."""
    moved = shift(day, n, unit)
    return moved if unit in ("day", "week") else F.when(F.day(moved) < F.day(day), F.date_add(moved, 1)).otherwise(moved)


def _dense_days(rows: DataFrame, measures: Sequence[Measure], by: Sequence[str], changes: Callable[[Column], DataFrame]) -> DataFrame:
    """Partial results of each group for every day of the span; ``changes`` gives the steps of a distinct count."""
    aggs = {slot(m, p): a for m in measures if not m.needs for p, a in m.base.items()}
    stuck = [m.name for m in measures for a in m.base.values() if not (a.merge or a.distinct)]
    if stuck:
        raise ValueError(f"{stuck} cannot be accumulated from daily results")
    merging = {s: a for s, a in aggs.items() if a.merge}
    daily = rows.groupBy(*by, "date").agg(F.count(F.lit(1)).alias("__rows"), *[a.column().alias(s) for s, a in merging.items()])
    span = rows.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).select(F.struct("lo", "hi")).scalar()
    groups = rows.select(*by).distinct() if by else rows.sparkSession.range(1)
    lo_hi = groups.withColumn("__span", span)
    axis = lo_hi.select(*by, F.explode(F.sequence("__span.lo", "__span.hi")).alias("date"))
    dense = null_safe_join(axis, daily, [*by, "date"], "left")
    for s, a in aggs.items():
        if a.distinct:
            steps = changes(a.input()).groupBy(*by, "date").agg(F.sum("__change").alias(s))
            dense = null_safe_join(dense, steps, [*by, "date"], "left")
    return dense


def _moving(dense: DataFrame, measures: Sequence[Measure], window: WindowSpec, whole: WindowSpec, so_far: WindowSpec) -> DataFrame:
    """Partial results merged over ``window``; the steps of distinct counts added up over ``so_far``."""
    steps = [slot(m, p) for m in measures if not m.needs for p, a in m.base.items() if a.distinct]
    counted = {s: F.coalesce(F.sum(f"`{s}`").over(so_far), F.lit(0)) for s in steps}
    return accumulated(dense, measures, window, whole).withColumns(counted)


# -- as_of filters for measures ------------------------------------------


def to_date_filter(day: Column, unit: str, as_of: str | dt.date) -> Column:
    """From the start of the period to ``as_of``."""
    return day.cast("date").between(period_start(_date(as_of), unit), _date(as_of))


def last_year_filter(day: Column, unit: str, as_of: str | dt.date) -> Column:
    """The same period to date, one year earlier."""
    anchor = F.add_months(_date(as_of), -12)
    return day.cast("date").between(period_start(anchor, unit), anchor)


def previous_filter(day: Column, unit: str, as_of: str | dt.date) -> Column:
    """The whole period before the one of ``as_of``."""
    start = period_start(_date(as_of), unit)
    return day.cast("date").between(shift(start, -1, unit), F.date_sub(start, 1))


def in_period_filter(day: Column, n: int, unit: str, as_of: str | dt.date) -> Column:
    """The ``n`` units that end at ``as_of``."""
    after = shift(_date(as_of), -n, unit)
    return (day.cast("date") > after) & (day.cast("date") <= _date(as_of))


def dates_between(day: Column, start: str | dt.date, end: str | dt.date) -> Column:
    return day.cast("date").between(_date(start), _date(end))


def time_items(date_col: str, as_of: str | dt.date):
    """Calculation items MTD, QTD, YTD, PY and Current for ``calc_group_expand``."""
    day = F.col(date_col)

    def limited(predicate: Column):
        return lambda measure: calculate_filter(measure, predicate)

    def current(measure: Measure) -> Measure:
        return measure

    return {
        "MTD": limited(to_date_filter(day, "month", as_of)),
        "QTD": limited(to_date_filter(day, "quarter", as_of)),
        "YTD": limited(to_date_filter(day, "year", as_of)),
        "PY": limited(last_year_filter(day, "year", as_of)),
        "Current": current,
    }
