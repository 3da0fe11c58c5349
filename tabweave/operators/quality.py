"""Data quality, audit and reconciliation checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F



class ValidationError(RuntimeError):
    """A coded failure of a strict check; codes run from -20999 to -20000."""

    def __init__(self, code: int, message: str):
        if not -20999 <= code <= -20000:
            raise ValueError("error codes run from -20999 to -20000")
        super().__init__(f"{code}: {message}")
        self.code = code


#: Error conditions of an input that does not exist.
MISSING = ("TABLE_OR_VIEW_NOT_FOUND", "SCHEMA_NOT_FOUND", "PATH_NOT_FOUND")


def _exists_nonempty(spark: SparkSession, table: str | DataFrame) -> bool | None:
    """None when the input does not exist, else whether it has a row."""
    try:
        df = table if isinstance(table, DataFrame) else spark.table(table)
        return not df.isEmpty()
    except AnalysisException as error:
        if error.getCondition() not in MISSING:
            raise
        return None


def validate_required_tables(
    spark: SparkSession,
    required: Mapping[str, str | DataFrame],
    optional: Mapping[str, str | DataFrame] | None = None,
    strict: bool = False,
    code: int = -20001,
) -> DataFrame:
    """One row per input with SUCCESS, WARNING (optional input empty) or FAILED."""
    rows = []
    for needed, inputs in ((True, required), (False, optional or {})):
        for name, table in inputs.items():
            filled = _exists_nonempty(spark, table)
            actual = "missing" if filled is None else "rows" if filled else "empty"
            status = "SUCCESS" if filled else "FAILED" if needed else "WARNING"
            rows.append((name, "rows", actual, status))
    failed = [name for name, _, _, status in rows if status == "FAILED"]
    if strict and failed:
        raise ValidationError(code, f"required inputs missing or empty: {', '.join(failed)}")
    return spark.createDataFrame(rows, "check string, expected string, actual string, status string")


def audit_record(
    spark: SparkSession,
    run_id: int,
    batch_id: int,
    file_name: str,
    metrics: Observation | Mapping[str, int],
    success: bool = True,
) -> DataFrame:
    """One audit row from the counts a load observed while it ran."""
    counts = metrics.get if isinstance(metrics, Observation) else dict(metrics)
    return spark.createDataFrame(
        [
            (
                run_id,
                batch_id,
                file_name,
                *(counts.get(k, 0) for k in ("rows_extracted", "rows_inserted", "rows_rejected")),
                "Y" if success else "N",
            )
        ],
        "id bigint, batch_id bigint, file_name string, rows_extracted bigint, rows_inserted bigint,"
        " rows_rejected bigint, successful string",
    )


def check_rows(df: DataFrame, checks: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """``check, expected, actual, status`` for pairs of aggregates, in one pass."""
    flat = df.agg(
        *[
            side.cast("bigint").alias(f"__{i}_{s}")
            for i, pair in enumerate(checks.values())
            for s, side in zip("ea", pair)
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("check"), F.col(f"__{i}_e").alias("expected"), F.col(f"__{i}_a").alias("actual"))
            for i, n in enumerate(checks)
        ]
    )
    return flat.select(F.inline(rows)).withColumn("status", _pass(F.col("expected").eqNullSafe(F.col("actual"))))


def _pass(condition: Column) -> Column:
    return F.when(condition, F.lit("PASS")).otherwise(F.lit("FAIL"))


def audit_check(audit: DataFrame, success: Column, keys: Sequence[str]) -> DataFrame:
    """All runs successful, no NULL in the key fields."""
    none = F.lit(0)
    checks = {"unsuccessful_runs": (none, F.count_if(~F.coalesce(success, F.lit(False))))}
    checks |= {f"null_{k}": (none, F.count_if(F.col(k).isNull())) for k in keys}
    return check_rows(audit, checks)


def row_count_reconcile(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Row counts per ``key`` value on both sides; both sides are counted before they meet."""
    sides = expected.select(key, F.lit(1).alias("__e"), F.lit(0).alias("__a")).unionByName(
        actual.select(key, F.lit(0).alias("__e"), F.lit(1).alias("__a"))
    )
    counts = sides.groupBy(key).agg(F.sum("__e").alias("expected"), F.sum("__a").alias("actual"))
    return counts.withColumn("status", _pass(F.col("expected") == F.col("actual")))


def measure_parity(
    left: DataFrame, right: DataFrame, by: Sequence[str], measure: str, tolerance: float = 0.0
) -> DataFrame:
    """The same measure from two sources, one row per group of either side."""
    # One row per side and group meets in one aggregate; a group that a side lacks fails.
    def side(df: DataFrame, name: str) -> DataFrame:
        other = "actual" if name == "expected" else "expected"
        return df.select(
            *by,
            F.col(measure).alias(name),
            F.lit(None).cast(df.schema[measure].dataType).alias(other),
            F.lit(True).alias(f"__{name}"),
            F.lit(False).alias(f"__{other}"),
        )

    sides = side(left, "expected"), side(right, "actual")
    both = sides[0].unionByName(sides[1]).groupBy(*by)
    names = ("expected", "actual")
    both = both.agg(*[F.max(n).alias(n) for n in names], *[F.bool_or(f"__{n}").alias(f"__{n}") for n in names])
    close = F.abs(F.col("expected") - F.col("actual")) <= tolerance
    blank = F.col("expected").isNull() & F.col("actual").isNull()
    passes = F.col("__expected") & F.col("__actual") & F.coalesce(close, blank)
    return both.withColumn("status", _pass(passes)).drop("__expected", "__actual")


def column_reconcile(model: DataFrame, physical: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Model names against physical names, without regard to case: mapped, missing or extra."""
    upper = F.upper(F.col(name)).alias("__upper")
    first = F.min(F.col(name))
    m = model.groupBy(*by, upper).agg(first.alias("model_name"))
    p = physical.groupBy(*by, upper).agg(first.alias("physical_name"))
    sides = m.unionByName(p, allowMissingColumns=True)
    both = sides.groupBy(*by, "__upper").agg(
        F.max("model_name").alias("model_name"), F.max("physical_name").alias("physical_name")
    )
    status = (
        F.when(F.col("physical_name").isNull(), "missing").when(F.col("model_name").isNull(), "extra").otherwise("mapped")
    )
    return both.withColumn("status", status).drop("__upper")


def _per_column(df: DataFrame, columns: Sequence[str], metrics: Mapping[str, callable]) -> DataFrame:
    """One aggregate over all columns, turned into one row per column."""
    flat = df.agg(
        *[metric(F.col(c)).alias(f"__{i}_{m}") for i, c in enumerate(columns) for m, metric in metrics.items()]
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), *[F.col(f"__{i}_{m}").alias(m) for m in metrics])
            for i, c in enumerate(columns)
        ]
    )
    return flat.select(F.inline(rows))


def max_length_profile(df: DataFrame, declared: Mapping[str, int]) -> DataFrame:
    """Longest value per column against its declared width."""
    profile = _per_column(df, list(declared), {"max_length": lambda c: F.max(F.length(c.cast("string")))})
    chain = reduce(lambda acc, kv: acc.when(F.col("column_name") == kv[0], F.lit(kv[1])), declared.items(), F)
    return profile.withColumn("declared", chain).withColumn(
        "status", _pass(F.coalesce(F.col("max_length"), F.lit(0)) <= F.col("declared"))
    )


def type_safety_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """What text columns look like, and the type to declare for each.

    Leading zeros, numbers beyond 64 bits or a mix of numbers and other text mean a
    code: it stays text.
    """

    def kind(name: str) -> Column:
        """One class per value, so most values meet one or two patterns."""
        text = F.col(name).cast("string")
        return (
            F.when(text.isNull(), F.lit(None))
            .when(text.rlike("^-?[0-9]+$"), F.when(text.rlike("^-?0[0-9]"), "padded").when(text.try_cast("bigint").isNull(), "long").otherwise("whole"))
            .when(text.rlike(r"^-?[0-9]+\.[0-9]+$"), F.when(text.rlike("^-?0[0-9]"), "padded fraction").otherwise("fraction"))
            .when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.when(text.try_cast("date").isNotNull(), "date").otherwise("other"))
            .when(F.lower(text).isin("true", "false"), "logical")
            .otherwise("other")
        ).alias(name)

    def among(*kinds: str):
        return lambda c: F.count_if(c.isin(*kinds))

    profile = _per_column(
        df.select(*map(kind, columns)),
        columns,
        {
            "filled": lambda c: F.count(c),
            "numeric": among("whole", "long", "padded", "fraction", "padded fraction"),
            "whole": among("whole", "long", "padded"),
            "padded": among("padded", "padded fraction"),
            "long": among("long"),
            "dates": among("date"),
            "logical": among("logical"),
        },
    )
    filled = F.col("filled")
    declare = (
        F.when(filled == 0, "string")
        .when(F.col("dates") == filled, "date")
        .when(F.col("logical") == filled, "boolean")
        .when((F.col("whole") == filled) & (F.col("padded") + F.col("long") == 0), "bigint")
        .when((F.col("numeric") == filled) & (F.col("padded") + F.col("long") == 0), "double")
        .otherwise("string")
    )
    return profile.withColumn("declare", declare).drop("long")
