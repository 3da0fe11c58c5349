"""Lookups, merges and hierarchy joins.

No join here carries a broadcast hint: Spark broadcasts a side only when its
measured size is below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise
runs a sort-merge join whose skewed partitions adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.session import cut_lineage

Keys = Sequence[str] | Mapping[str, str]


def key_pairs(on: Keys | str) -> list[tuple[str, str]]:
    if isinstance(on, str):
        return [(on, on)]
    if isinstance(on, Mapping):
        return list(on.items())
    return [(name, name) for name in on]


def equi_join(left: DataFrame, right: DataFrame, on: Keys | str, how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Join on column pairs; the right-hand key columns are dropped."""
    pairs = key_pairs(on)
    marked = {r: f"__key_{i}" for i, (_, r) in enumerate(pairs)}
    keyed = right.withColumnsRenamed(marked)
    compare = (lambda a, b: a.eqNullSafe(b)) if null_safe else (lambda a, b: a == b)
    condition = reduce(lambda a, b: a & b, [compare(F.col(l), F.col(marked[r])) for l, r in pairs])
    return left.join(keyed, condition, how).drop(*marked.values())


def null_safe_join(left: DataFrame, right: DataFrame, on: Keys | str, how: str = "inner") -> DataFrame:
    return equi_join(left, right, on, how, null_safe=True)


def lookup_join(df: DataFrame, ref: DataFrame, on: Keys | str) -> DataFrame:
    """Left outer lookup: unmatched rows keep NULLs."""
    return equi_join(df, ref, on, "left")


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], latest: bool = False) -> DataFrame:
    """The first (or last) row of each key by ``order_by``; NULLs order last.

    It is an aggregate with map-side combine, not a window: a hot key never
    gathers in one task. Remaining columns break ties, so the pick is stable.
    """
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    present = [
        field
        for name in order_by
        for field in ((F.col(name).isNotNull() if latest else F.col(name).isNull()).alias(f"__absent_{name}"), F.col(name))
    ]
    entry = F.struct(*present, *[F.col(c) for c in rest])
    pick = (F.max if latest else F.min)(entry)
    return (
        df.groupBy(*keys)
        .agg(pick.alias("__row"))
        .select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns])
    )


def lookup_first_match(df: DataFrame, ref: DataFrame, on: Keys | str, order_by: Sequence[str]) -> DataFrame:
    """Left lookup of the first reference row per key in a fixed order."""
    keys = [r for _, r in key_pairs(on)]
    taken = first_per_key(ref, keys, order_by)
    return lookup_join(df, taken.drop(*[c for c in order_by if c in df.columns and c not in keys]), on)


def lookup_default(df: DataFrame, ref: DataFrame, on: Keys | str, defaults: Mapping[str, object]) -> DataFrame:
    """Left lookup with replacement values where nothing matched."""
    joined = lookup_join(df, ref, on)
    return joined.withColumns({name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()})


def merge_join(left: DataFrame, right: DataFrame, on: Keys | str, how: str = "inner") -> DataFrame:
    """Merge join: ``inner``, ``left`` or ``full``. Inputs need no sort order.

    Column names other than the keys must differ. A full join is a left join
    plus the right rows without partner: adaptive execution can split skewed
    partitions of these two, but not of a full outer join.
    """
    pairs = key_pairs(on)
    if how in ("inner", "left"):
        return equi_join(left, right, on, how)
    if how != "full":
        raise ValueError(f"unsupported merge join type: {how}")
    matched = equi_join(left, right, on, "left")
    alone = right.join(
        left.select(*[F.col(l).alias(f"__left_{l}") for l, _ in pairs]),
        reduce(lambda a, b: a & b, [F.col(f"__left_{l}") == F.col(r) for l, r in pairs]),
        "left_anti",
    ).withColumnsRenamed({r: l for l, r in pairs})
    return matched.unionByName(alone, allowMissingColumns=True)


def prefix_join(df: DataFrame, ref: DataFrame, column: str, ref_column: str, length: int) -> DataFrame:
    """Left join on the first ``length`` characters, both sides as strings."""
    prefixes = ref.withColumn("__prefix", F.col(ref_column).cast("string")).where(F.length("__prefix") == length)
    return df.join(
        prefixes, F.substring(F.col(column).cast("string"), 1, length) == F.col("__prefix"), "left"
    ).drop("__prefix")


def related(df: DataFrame, table: DataFrame, on: Keys | str, *columns: str) -> DataFrame:
    """Bring attributes of the one side to the many side."""
    keys = [r for _, r in key_pairs(on)]
    return lookup_join(df, table.select(*dict.fromkeys([*keys, *columns])), on)


def related_table(one: DataFrame, many: DataFrame, on: Keys | str, **aggregates: Column) -> DataFrame:
    """Aggregate the many side to its key, then attach it to the one side."""
    keys = [r for _, r in key_pairs(on)]
    return lookup_join(one, many.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()]), on)


def bidirectional_join(left: DataFrame, right: DataFrame, on: Keys | str) -> DataFrame:
    """Filters flow both ways, so only matching rows stay."""
    return equi_join(left, right, on, "inner")


def bridge_filter(facts: DataFrame, bridge: DataFrame, on: Keys | str) -> DataFrame:
    """Facts reachable over a many-to-many bridge, each counted once."""
    return semi_join(facts, bridge, on)


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on every column name the two inputs share."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the inputs share no column")
    return left.join(right, shared, how)


def _exists_join(left: DataFrame, right: DataFrame, on: Keys | str, how: str, null_safe: bool = False) -> DataFrame:
    pairs = key_pairs(on)
    compare = (lambda a, b: a.eqNullSafe(b)) if null_safe else (lambda a, b: a == b)
    keys = right.select(*[F.col(r).alias(f"__key_{i}") for i, (_, r) in enumerate(pairs)])
    condition = reduce(lambda a, b: a & b, [compare(F.col(l), F.col(f"__key_{i}")) for i, (l, _) in enumerate(pairs)])
    return left.join(keys, condition, how)


def semi_join(left: DataFrame, right: DataFrame, on: Keys | str) -> DataFrame:
    """Rows with a partner (EXISTS / IN)."""
    return _exists_join(left, right, on, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, on: Keys | str, null_safe: bool = False) -> DataFrame:
    """Rows without a partner, e.g. keys the target does not have yet."""
    return _exists_join(left, right, on, "left_anti", null_safe)


def hierarchy_expand(df: DataFrame, node: str, parent: str, label: str, separator: str = " > ") -> DataFrame:
    """Depth and label path of every node below a root (NULL parent).

    Every round doubles the reach: a node takes over the path, depth and upper
    end of the node it has reached so far, so n levels take log2(n) rounds. A
    round in which no node reaches a root leaves only nodes on or below cycles or
    missing parents; these do not appear.
    """
    state = df.select(node, parent, label, F.col(parent).alias("__up"), F.lit(0).alias("depth"), F.col(label).alias("path"))
    state, placed = cut_lineage(state), None
    while True:
        done = state.where(F.col("__up").isNull())
        now = done.count()
        if now == placed:
            return done.drop("__up")
        placed = now
        above = state.select(
            F.col(node).alias("__node"), F.col("__up").alias("__next"), F.col("depth").alias("__depth"), F.col("path").alias("__path")
        )
        moved = state.where(F.col("__up").isNotNull()).join(above, F.col("__up") == F.col("__node"))
        moved = moved.select(
            node,
            parent,
            label,
            F.col("__next").alias("__up"),
            (F.col("depth") + F.col("__depth") + 1).alias("depth"),
            F.concat(F.col("__path"), F.lit(separator), F.col("path")).alias("path"),
        )
        state = cut_lineage(done.unionByName(moved))
