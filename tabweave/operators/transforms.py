"""Row transforms, routing, ordering and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.functions.scalar import safe_cast
from tabweave.operators.joins import anti_join, first_per_key
from tabweave.operators.positions import number_rows, running_before

#: Model type names and the Spark type each one is stored as (fixed values).
MODEL_TYPES = {
    "int64": "bigint",
    "int": "bigint",
    "integer": "bigint",
    "double": "double",
    "decimal": "decimal(38,10)",
    "currency": "decimal(19,4)",
    "string": "string",
    "text": "string",
    "datetime": "timestamp_ntz",
    "date": "date",
    "time": "time",
    "boolean": "boolean",
    "bool": "boolean",
    "binary": "binary",
    "variant": "variant",
}


def spark_type(model_type: str) -> str:
    """Spark type of a model type; unknown names are strings."""
    return MODEL_TYPES.get(model_type.strip().lower(), "string")


def derived_column(df: DataFrame, **exprs: Column) -> DataFrame:
    return df.withColumns(exprs)


def data_conversion(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    return df.withColumns({name: F.col(name).cast(kind) for name, kind in types.items()})


def safe_conversion(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast, with NULL where the text does not convert."""
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.withColumns(
        {n: safe_cast(F.col(n), kind) if n in text else F.col(n).try_cast(kind) for n, kind in types.items()}
    )


def calculated_column(df: DataFrame, columns: Mapping[str, Column | str]) -> DataFrame:
    """Publish row expressions next to the base columns.

    A type name instead of an expression stands for a column that has no
    translation: it is published as a NULL of that model type.
    """
    return df.select(
        "*",
        *[
            (F.lit(None).cast(spark_type(e)) if isinstance(e, str) else e).alias(name)
            for name, e in columns.items()
        ],
    )


def alias_view(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Expose physical columns under model names.

    Names match without regard to case; columns that do not exist are skipped
    and columns that are not listed are left out.
    """
    physical = {c.upper(): c for c in df.columns}
    return df.select(
        *[F.col(physical[p.upper()]).alias(model) for p, model in names.items() if p.upper() in physical]
    )


def hidden_prune(df: DataFrame, hidden: Sequence[str]) -> DataFrame:
    return df.drop(*hidden)


def perspective_view(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Named subset of the columns. This is convenience, not security."""
    return df.select(*columns)


def row_filter(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition)


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def route_column(routes: Sequence[tuple[str, Column]], default: str) -> Column:
    """Name of the first route whose predicate holds, else ``default``."""
    chain = F
    for name, predicate in routes:
        chain = chain.when(predicate, F.lit(name))
    return chain.otherwise(F.lit(default))


def conditional_split(df: DataFrame, routes: Sequence[tuple[str, Column]], default: str = "default") -> dict[str, DataFrame]:
    """Named outputs that partition the input; the first match wins."""
    routed = df.withColumn("__route", route_column(routes, default))
    return {
        name: routed.where(F.col("__route") == name).drop("__route")
        for name in [*dict.fromkeys(name for name, _ in routes), default]
    }


def multicast(df: DataFrame, n: int) -> tuple[DataFrame, ...]:
    """The same plan for ``n`` branches; ``persist`` it first if it is costly."""
    return (df,) * n


def row_count(df: DataFrame, observation: Observation, name: str = "rows") -> DataFrame:
    """Count rows as they pass; the count arrives with the branch's own action."""
    return df.observe(observation, F.count(F.lit(1)).alias(name))


def empty_to_null(df: DataFrame, *columns: str, trim: bool = True) -> DataFrame:
    text = (lambda c: F.trim(F.col(c))) if trim else F.col
    return df.withColumns({c: F.nullif(text(c), F.lit("")) for c in columns})


def zero_datetime_to_null(df: DataFrame, column: str, zero_values: Sequence[str] = ()) -> DataFrame:
    """NULL for date values that only mean "never set"."""
    if not zero_values:
        return df
    kind = df.schema[column].dataType
    zeros = [F.lit(v).cast(kind) for v in zero_values]
    return df.withColumn(column, F.when(~F.col(column).isin(*zeros), F.col(column)))


def category_column(column: str, categories: Mapping[object, object], default: object = None) -> Column:
    """A fixed mapping as one CASE expression."""
    chain = F
    for key, value in categories.items():
        chain = chain.when(F.col(column) == F.lit(key), F.lit(value))
    return chain.otherwise(F.lit(default))


def literal_columns(df: DataFrame, values: Mapping[str, object], single_row: DataFrame | None = None) -> DataFrame:
    """Run values as columns, and the columns of a one-row result bound to each row.

    The one-row result is a scalar subquery; more than one row is an error.
    """
    out = df.withColumns({n: v if isinstance(v, Column) else F.lit(v) for n, v in values.items()}) if values else df
    if single_row is None:
        return out
    names = single_row.columns
    bound = single_row.select(F.struct(*names).alias("__bound")).scalar()
    out = out.withColumn("__bound", bound)
    return out.select(*[c for c in out.columns if c != "__bound"], *[F.col("__bound")[n].alias(n) for n in names])


def surrogate_key(df: DataFrame, order_by: Sequence[str], start: int | Column = 1, out: str = "id") -> DataFrame:
    """Dense key values for new rows; ``order_by`` is their natural key."""
    return number_rows(df, order_by, out, start)


def next_key(target: DataFrame, key: str) -> Column:
    """``max(key) + 1`` of the target as a scalar subquery."""
    return target.select((F.coalesce(F.max(key), F.lit(0)) + 1).cast("long")).scalar()


def last_row_filter(df: DataFrame, order_by: Sequence[str], n: int) -> DataFrame:
    """Only the rows up to number ``n`` in the given order of a unique key."""
    return running_before(df, order_by, out="__before").where(F.col("__before") < n).drop("__before")


def dedupe_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Keep the first row of each key."""
    return first_per_key(df, keys, order_by)


def sort_transform(df: DataFrame, *order: Column) -> DataFrame:
    return df.orderBy(*order)


def sort_by_column(df: DataFrame, label: str, sort_column: str) -> DataFrame:
    """Distinct labels in the order of another column."""
    return df.groupBy(label).agg(F.min(sort_column).alias(sort_column)).orderBy(sort_column, label)


def top_n(df: DataFrame, measure: str, n: int, tie_break: Sequence[str]) -> DataFrame:
    """The ``n`` largest rows; every task keeps at most ``n``."""
    return df.orderBy(F.col(measure).desc_nulls_last(), *tie_break).limit(n)


def union_all(*inputs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs)


def merge_sorted(*inputs: DataFrame, order_by: Sequence[str | Column] | None = None) -> DataFrame:
    merged = union_all(*inputs)
    return merged.orderBy(*order_by) if order_by else merged


def multi_source_union(hot: DataFrame, history: DataFrame, key: Sequence[str] | str | None = None) -> DataFrame:
    """Hot and history partitions as one table; with a key the hot row wins."""
    return union_all(hot, history if key is None else anti_join(history, hot, key))


def name_set_difference(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Names on one side only, compared without regard to case."""
    upper = F.upper(F.col(name)).alias(name)
    a, b = left.select(upper).distinct(), right.select(upper).distinct()
    return anti_join(a, b, name).withColumn("side", F.lit("left")).unionByName(
        anti_join(b, a, name).withColumn("side", F.lit("right"))
    )

