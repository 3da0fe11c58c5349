"""Named measures and their evaluation in a grouping and filter context.

A measure is made of base aggregates and a finishing function over their
results. One evaluation puts every base aggregate that shares a context into one
``groupBy().agg()``, so N calculation items over M measures still scan once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tabweave.functions.scalar import divide
from tabweave.operators.joins import Keys, anti_join, equi_join, key_pairs, null_safe_join, semi_join
from tabweave.operators.positions import exact_quantiles
from tabweave.plans.bitmaps import BITMAP, BUCKET, SET, bitmap_rows
from tabweave.session import cut_lineage

Where = Column | Mapping[str, Column] | None
Parts = Mapping[str, Column]


@dataclass(frozen=True)
class Agg:
    """An aggregate whose input rows can still be narrowed.

    ``merge`` combines partial results; it is absent where that is not possible.
    ``empty`` is the result over no rows where that is not NULL.
    ``distinct`` marks a fold over the distinct values only, ``extreme`` a minimum
    or maximum, ``signed`` a sum or count that can be undone by a row of opposite
    sign, ``counts`` one that counts its values instead of adding them, ``spread``
    squared deviations, whose partial results have to be centred first, and
    ``fraction`` an exact percentile, which is found by position.
    """

    fold: Callable[[Column], Column]
    value: Column | str | int
    merge: Callable[[Column], Column] | None = None
    empty: int | None = None
    keep: Column | None = None
    distinct: bool = False
    extreme: bool = False
    signed: bool = False
    counts: bool = False
    spread: bool = False
    fraction: float | None = None

    def where(self, predicate: Column) -> Agg:
        return replace(self, keep=predicate if self.keep is None else self.keep & predicate)

    def identity(self) -> tuple:
        """Equal for aggregates made of the same parts, as scoped copies of a measure are."""
        value = id(self.value) if isinstance(self.value, Column) else (type(self.value), self.value)
        return id(self.fold), value, id(self.keep)

    def input(self) -> Column:
        """The value to fold: NULL, which no fold counts, for rows that are not kept."""
        value = _c(self.value)
        return value if self.keep is None else F.when(self.keep, value)

    def column(self) -> Column:
        return self.fold(self.input())

    def merged(self, partial: Column, window: WindowSpec | None = None) -> Column:
        """Partial results combined, over a window if one is given."""
        out = self.merge(partial) if window is None else self.merge(partial).over(window)
        return out if self.empty is None else F.coalesce(out, F.lit(self.empty))


@dataclass(frozen=True)
class Scope:
    """Which part of the context a measure keeps: local, all, allselected or allexcept."""

    kind: str = "local"
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Measure:
    """``finish`` gets the base results, or for a compound the measures it needs.

    ``changes`` are context changes of a compound; they apply to the measures it needs.
    ``use`` and ``ignore`` name relationships of a model that this measure follows or not.
    """

    name: str
    base: Mapping[str, Agg] = field(default_factory=dict)
    finish: Callable[[Parts], Column] = lambda parts: parts["value"]
    needs: tuple[str, ...] = ()
    changes: tuple[Callable[[Measure], Measure], ...] = ()
    scope: Scope = Scope()
    tables: tuple[str, ...] = ()
    use: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    format_string: str | None = None


def _c(value: Column | str | int) -> Column:
    """Names are columns and numbers literals, resolved when a query is built."""
    if isinstance(value, str):
        return F.col(value)
    return value if isinstance(value, Column) else F.lit(value)


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def slot(measure: Measure, part: str) -> str:
    return f"__{measure.name}__{part}"


# -- base measures -------------------------------------------------------


def _total(value: Column | str) -> Agg:
    return Agg(F.sum, value, F.sum, signed=True)


def _tally(value: Column | str | int) -> Agg:
    return Agg(F.count, value, F.sum, empty=0, signed=True, counts=True)


def sum_(name: str, value: Column | str) -> Measure:
    return Measure(name, {"value": _total(value)})


def count(name: str, value: Column | str | int) -> Measure:
    """Non-NULL values."""
    return Measure(name, {"value": _tally(value)})


def count_rows(name: str) -> Measure:
    return count(name, 1)


def count_blank(name: str, value: Column | str) -> Measure:
    return count(name, F.when(_c(value).isNull(), F.lit(1)))


def distinct_count(name: str, value: Column | str) -> Measure:
    """Distinct values; NULL is not one of them."""
    return Measure(name, {"value": Agg(F.count_distinct, value, distinct=True)})


def average(name: str, value: Column | str) -> Measure:
    """Kept as sum and count, so partial results can be merged."""
    return Measure(
        name,
        {"sum": _total(value), "count": _tally(value)},
        lambda parts: divide(parts["sum"], parts["count"]),
    )


def minimum(name: str, value: Column | str) -> Measure:
    return Measure(name, {"value": Agg(F.min, value, F.min, extreme=True)})


def maximum(name: str, value: Column | str) -> Measure:
    return Measure(name, {"value": Agg(F.max, value, F.max, extreme=True)})


def _squares(value: Column) -> Column:
    """Squared deviations from the mean of the values."""
    return F.var_pop(value) * F.count(value)


def variance(name: str, value: Column | str) -> Measure:
    """Sample variance, kept as count, sum and squared deviations, so partial results can be merged."""
    real = _c(value).cast("double")
    base = {"count": _tally(value), "sum": _total(real), "square": Agg(_squares, real, F.sum, spread=True)}
    return Measure(name, base, lambda p: F.when(p["count"] > 1, p["square"] / (p["count"] - 1)))


def stddev(name: str, value: Column | str) -> Measure:
    """Sample standard deviation, mergeable like ``variance``."""
    squared = variance(name, value)
    return replace(squared, finish=lambda p: F.sqrt(squared.finish(p)))


def percentile(name: str, value: Column | str, fraction: float) -> Measure:
    """Exact interpolated percentile of the values in context."""
    if not 0 <= fraction <= 1:
        raise ValueError("a percentile's fraction lies between 0 and 1")
    return Measure(name, {"value": Agg(lambda c: F.percentile(c, fraction), value, fraction=fraction)})


def median(name: str, value: Column | str) -> Measure:
    return percentile(name, value, 0.5)


def _bounds(value: Column | str) -> dict[str, Agg]:
    return {"low": Agg(F.min, value, F.min, extreme=True), "high": Agg(F.max, value, F.max, extreme=True)}


def has_one_value(name: str, value: Column | str) -> Measure:
    """Exactly one distinct value: smallest and largest say so without a distinct."""
    return Measure(name, _bounds(value), lambda p: F.coalesce(p["low"] == p["high"], F.lit(False)))


def selected_value(name: str, value: Column | str, default: object = None) -> Measure:
    """The single value in context, else ``default``."""
    return Measure(name, _bounds(value), lambda p: F.when(p["low"] == p["high"], p["low"]).otherwise(F.lit(default)))


def compound(name: str, needs: Sequence[str], finish: Callable[[Parts], Column]) -> Measure:
    """A measure over the results of other measures."""
    return Measure(name, {}, finish, needs=tuple(needs))


def ratio(name: str, numerator: str, denominator: str, alternative: object = None) -> Measure:
    return compound(name, (numerator, denominator), lambda p: divide(p[numerator], p[denominator], alternative))


# -- context changes -----------------------------------------------------


def _changed(measure: Measure, change: Callable[[Measure], Measure], name: str | None) -> Measure:
    """The measure in a changed context. A compound hands the change on to the measures it needs."""
    name = name or measure.name
    if measure.needs:
        return replace(measure, name=name, changes=(*measure.changes, change))
    return replace(change(measure), name=name)


def resolved(measures: Iterable[Measure]) -> list[Measure]:
    """The measures with every changed compound over changed copies of what it needs."""
    given = {m.name: m for m in measures}
    out: dict[str, Measure] = {}

    def add(measure: Measure) -> None:
        copies = {}
        if measure.changes:
            for need in measure.needs:
                if need not in given:
                    raise KeyError(f"measure {need} is needed but not given")
                copy = reduce(lambda m, change: _changed(m, change, None), measure.changes, given[need])
                copies[need] = f"{need} of {measure.name}"
                add(replace(copy, name=copies[need]))
            finish = measure.finish
            measure = replace(
                measure,
                needs=tuple(copies.values()),
                changes=(),
                finish=lambda parts: finish({need: parts[copy] for need, copy in copies.items()}),
            )
        out[measure.name] = measure

    for measure in given.values():
        add(measure)
    return list(out.values())


def calculate_filter(measure: Measure, predicate: Column, name: str | None = None) -> Measure:
    """The measure over rows that also satisfy ``predicate``; others are unaffected."""

    def change(m: Measure) -> Measure:
        return replace(m, base={k: a.where(predicate) for k, a in m.base.items()})

    return _changed(measure, change, name)


def calculate_keepfilters(measure: Measure, predicate: Column, name: str | None = None) -> Measure:
    """Intersect with the filters in force; the query filter always stays."""
    return calculate_filter(measure, predicate, name)


def _scoped(measure: Measure, scope: Scope, name: str | None) -> Measure:
    return _changed(measure, lambda m: replace(m, scope=scope), name)


def calculate_all(measure: Measure, name: str | None = None) -> Measure:
    """Ignore grouping and query filter."""
    return _scoped(measure, Scope("all"), name)


def calculate_allselected(measure: Measure, name: str | None = None) -> Measure:
    """Ignore the grouping, keep the query filter."""
    return _scoped(measure, Scope("allselected"), name)


def calculate_allexcept(measure: Measure, keep: Sequence[str], name: str | None = None) -> Measure:
    """Keep grouping and filters on the ``keep`` columns only."""
    return _scoped(measure, Scope("allexcept", tuple(keep)), name)


def use_relationship(measure: Measure, *names: str, name: str | None = None) -> Measure:
    """The measure over these relationships of the model instead of the active ones between the same tables."""
    return _changed(measure, lambda m: replace(m, use=(*m.use, *names)), name)


def ignore_relationship(measure: Measure, *names: str, name: str | None = None) -> Measure:
    """The measure without these relationships: grouping and filters beyond them do not reach it."""
    return _changed(measure, lambda m: replace(m, ignore=(*m.ignore, *names)), name)


def calc_group_expand(
    measures: Iterable[Measure],
    items: Mapping[str, Callable[[Measure], Measure]],
    formats: Mapping[str, str] | None = None,
) -> list[Measure]:
    """Every item applied to every measure, named ``"<measure> <item>"``.

    An item is a function from measure to measure. It may choose by the name of
    the measure it gets, and the identity item yields the base measure.
    """
    formats, measures = formats or {}, list(measures)
    return [
        replace(item(m), name=f"{m.name} {item_name}", format_string=formats.get(item_name, m.format_string))
        for item_name, item in items.items()
        for m in measures
    ]


# -- evaluation ----------------------------------------------------------


def _predicate(where: Where, only: Sequence[str] | None = None) -> Column | None:
    """The query filter as one predicate; with ``only``, just its parts on these columns."""
    if where is None:
        return None
    if isinstance(where, Column):
        if only is not None:
            raise ValueError("a measure that keeps some columns' filters needs the query filter given per column")
        return where
    parts = [p for column, p in where.items() if only is None or column in only]
    return reduce(lambda a, b: a & b, parts) if parts else None


def _filtered(df: DataFrame, predicate: Column | None) -> DataFrame:
    return df if predicate is None else df.where(predicate)


def _slots(measures: Iterable[Measure]) -> dict[str, Agg]:
    return {slot(m, part): a for m in measures for part, a in m.base.items()}


def _aggregates(measures: Iterable[Measure]) -> list[Column]:
    return [a.column().alias(s) for s, a in _slots(measures).items()]


def _attached(df: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the totals of its ``keys`` group, or with the only row there is without keys."""
    if keys:
        return null_safe_join(df, totals, keys, "left")
    whole = totals.select(F.struct(*map(_quoted, totals.columns)).alias("__totals")).scalar()
    named = {c: F.col("__totals")[c] for c in totals.columns}
    return df.withColumn("__totals", whole).withColumns(named).drop("__totals")


def _grouped(rows: DataFrame, by: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """Base results per group: one aggregate, and one pass by position for all percentiles."""
    aggs = _slots(measures)
    # Percentiles of one value under several filters share its column, so it is tallied once.
    values = {a.identity()[1]: _c(a.value) for a in aggs.values() if a.fraction is not None}
    placed = {s: (values[a.identity()[1]], a.fraction, a.keep) for s, a in aggs.items() if a.fraction is not None}
    folds = [a.column().alias(s) for s, a in aggs.items() if s not in placed]
    if not placed:
        return rows.groupBy(*by).agg(*folds)
    plain = rows.groupBy(*by).agg(*folds or [F.count(F.lit(1)).alias("__rows")])
    return _attached(plain, exact_quantiles(rows, placed, by), by)


def centred(partials: DataFrame, measures: Iterable[Measure], by: Sequence[str]) -> DataFrame:
    """Partial squared deviations moved to the mean of their ``by`` group, so that their sum is the group's.

    Deviations are taken between means. Nothing is lost where a mean is far above its spread.
    """
    spreads = [m for m in measures if any(a.spread for a in m.base.values())]
    if not spreads:
        return partials
    part = lambda m, p: _quoted(slot(m, p))
    means = {f"__mean_{i}": divide(F.sum(part(m, "sum")), F.sum(part(m, "count"))) for i, m in enumerate(spreads)}
    known = _attached(partials, partials.groupBy(*by).agg(*[c.alias(n) for n, c in means.items()]), by)
    off = [divide(part(m, "sum"), part(m, "count")) - F.col(n) for n, m in zip(means, spreads, strict=True)]
    moved = {slot(m, "square"): part(m, "square") + part(m, "count") * d * d for m, d in zip(spreads, off, strict=True)}
    return known.withColumns(moved).drop(*means)


def accumulated(df: DataFrame, measures: Iterable[Measure], window: WindowSpec, whole: WindowSpec) -> DataFrame:
    """Mergeable partial results combined over ``window``, a moving part of ``whole``."""
    measures = [m for m in measures if not m.needs]
    part = lambda m, p: _quoted(slot(m, p))
    spreads = [m for m in measures if any(a.spread for a in m.base.values())]
    mean = {f"__mean_{i}": divide(F.sum(part(m, "sum")).over(whole), F.sum(part(m, "count")).over(whole)) for i, m in enumerate(spreads)}
    df = df.withColumns(mean) if mean else df
    out = {s: a.merged(_quoted(s), window) for s, a in _slots(measures).items() if a.merge and not a.spread}
    for n, m in zip(mean, spreads, strict=True):
        off, rows = divide(part(m, "sum"), part(m, "count")) - F.col(n), part(m, "count")
        squares = F.sum(part(m, "square") + rows * off * off).over(window)
        aside = F.sum(rows * off).over(window)
        out[slot(m, "square")] = squares - divide(aside * aside, F.sum(rows).over(window))
    return df.withColumns(out).drop(*mean)


def finished(df: DataFrame, measures: Sequence[Measure], by: Sequence[str], show: Sequence[str] | None) -> DataFrame:
    """Finish base measures, then compounds in the order of their needs."""
    df = df.withColumns(
        {m.name: m.finish({p: _quoted(slot(m, p)) for p in m.base}) for m in measures if not m.needs}
    )
    return compounds(df, measures, by, show)


def compounds(df: DataFrame, measures: Sequence[Measure], by: Sequence[str], show: Sequence[str] | None) -> DataFrame:
    """Compounds over finished base measures, in the order of their needs."""
    named = {m.name: m for m in measures}
    for name in TopologicalSorter({m.name: m.needs for m in measures}).static_order():
        if name not in named:
            raise KeyError(f"measure {name} is needed but not given")
        if named[name].needs:
            df = df.withColumn(name, named[name].finish({n: _quoted(n) for n in named[name].needs}))
    shown = show or list(named)
    return df.select(
        *by,
        *[
            _quoted(n).alias(n, metadata={"format": named[n].format_string})
            if named[n].format_string
            else _quoted(n)
            for n in shown
        ],
    )


def _scope_totals(
    df: DataFrame,
    selected: DataFrame,
    where: Where,
    scope: Scope,
    group: Sequence[Measure],
    local: Sequence[Measure],
    by: Sequence[str],
    kept: Sequence[str],
) -> DataFrame:
    """Base results of the measures of one wider scope, per ``kept`` group.

    Where the scope sees the same rows as the query and everything can be
    merged, the totals come from the grouped rows. That grouping is the very one
    the query itself shuffles, so Spark runs it once and the base is read once.
    """
    if scope.kind == "all":
        rows, same_rows = df, where is None
    elif scope.kind == "allselected":
        rows, same_rows = selected, True
    else:
        rows = _filtered(df, _predicate(where, scope.columns))
        same_rows = where is None or (not isinstance(where, Column) and set(where) <= set(scope.columns))
    slots = {a.identity(): slot(m, p) for m in local for p, a in m.base.items()}
    covered = all(a.identity() in slots and not a.spread for m in group for a in m.base.values())
    if not (same_rows and by and covered and mergeable(local)):
        return _grouped(rows, kept, group)
    grouped = selected.groupBy(*by).agg(*_aggregates(local))
    merges = [a.merged(_quoted(slots[a.identity()])).alias(slot(m, p)) for m in group for p, a in m.base.items()]
    if kept:
        return grouped.groupBy(*kept).agg(*merges)
    # Merging every base result keeps the grouping identical to the query's own.
    rest = [a.merged(_quoted(slot(m, p))).alias(slot(m, p)) for m in local for p, a in m.base.items()]
    return grouped.agg(*merges, *rest)


def evaluate(
    df: DataFrame,
    measures: Sequence[Measure],
    by: Sequence[str] = (),
    where: Where = None,
    show: Sequence[str] | None = None,
) -> DataFrame:
    """Evaluate ``measures`` per ``by`` group under the query filter ``where``.

    A filter given per column lets ``calculate_allexcept`` keep the parts on its
    own columns. Totals of wider scopes are aggregated from the base rows and
    attached as scalar subqueries, or joined on the kept columns.
    """
    show = show or [m.name for m in measures]
    measures = resolved(measures)
    bases = [m for m in measures if not m.needs]
    local = [m for m in bases if m.scope.kind == "local"]
    selected = _filtered(df, _predicate(where))
    if local:
        out = _grouped(selected, by, local)
    elif by:
        out = selected.select(*by).distinct()
    else:
        out = selected.agg(F.count(F.lit(1)).alias("__rows"))

    for scope in dict.fromkeys(m.scope for m in bases if m.scope.kind != "local"):
        group = [m for m in bases if m.scope == scope]
        kept = [c for c in by if scope.kind == "allexcept" and c in scope.columns]
        totals = _scope_totals(df, selected, where, scope, group, local, by, kept)
        if kept:
            out = null_safe_join(out, totals, kept, "left")
        else:
            slots = [slot(m, p) for m in group for p in m.base]
            whole = totals.select(F.struct(*map(_quoted, totals.columns)).alias("__totals"))
            out = out.withColumn("__totals", whole.scalar())
            out = out.withColumns({s: F.col("__totals")[s] for s in slots}).drop("__totals")
    return finished(out, measures, by, show)


def mergeable(measures: Iterable[Measure]) -> bool:
    """Whether every base result can be combined from partial results."""
    return all(a.merge for m in measures for a in m.base.values())


def preaggregate(
    df: DataFrame,
    measures: Sequence[Measure],
    by: Sequence[str],
    where: Where = None,
    codes: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Partial results per group, to be stored and re-aggregated later.

    ``codes`` has a dictionary (``tabweave.plans.bitmaps``) for each measure that
    counts distinct values. Their partial results are rows of their own: one bitmap
    per group and bucket of codes.
    """
    measures, codes = resolved(measures), codes or {}
    bases = [m for m in measures if not m.needs]
    for m in bases:
        if any(a.merge is None and not (a.distinct and m.name in codes) for a in m.base.values()):
            raise ValueError(f"{m.name} cannot be computed from partial results")
    rows = _filtered(df, _predicate(where))
    folds = [a.column().alias(s) for s, a in _slots(bases).items() if a.merge]
    if not any(a.distinct for a in _slots(bases).values()):
        return rows.groupBy(*by).agg(*folds)
    plain = rows.groupBy(*by).agg(*folds or [F.count(F.lit(1)).alias("__rows")])
    sets = [
        bitmap_rows(rows, by, slot(m, p), a.input(), codes[m.name]) for m in bases for p, a in m.base.items() if a.distinct
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [plain, *sets])


def merge_partials(partials: DataFrame, measures: Sequence[Measure], by: Sequence[str]) -> DataFrame:
    """Partial results of several inputs or finer groups merged per ``by``."""
    bases = [m for m in resolved(measures) if not m.needs]
    merges = [a.merged(_quoted(s)).alias(s) for s, a in _slots(bases).items() if a.merge]
    moved = centred(partials, bases, by)
    if BITMAP not in partials.columns:
        return moved.groupBy(*by).agg(*merges)
    return moved.groupBy(*by, SET, BUCKET).agg(*merges, F.bitmap_or_agg(BITMAP).alias(BITMAP))


class Reduction:
    """Partial results kept while rows are joined to further tables.

    Mergeable aggregates become partial results. The values of distinct
    aggregates stay as grouping columns, which drops their repeats only.
    """

    def __init__(self, measures: Sequence[Measure]):
        self.measures = resolved(measures)
        aggs = {slot(m, p): a for m in measures if not m.needs for p, a in m.base.items()}
        self.partial = {s: a for s, a in aggs.items() if a.merge}
        self.values = {s: a for s, a in aggs.items() if a.distinct}
        #: Whether every base result can be computed this way.
        self.complete = len(self.partial) + len(self.values) == len(aggs)

    def start(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        valued = df.withColumns({s: a.input() for s, a in self.values.items()})
        return self._group(valued, keys, {s: a.column() for s, a in self.partial.items()})

    def reduce(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        moved = self._centred(df, [*keys, *self.values])
        return self._group(moved, keys, {s: a.merged(_quoted(s)) for s, a in self.partial.items()})

    def _centred(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        return centred(df, [m for m in self.measures if not m.needs], keys)

    def _group(self, df: DataFrame, keys: Sequence[str], folds: Mapping[str, Column]) -> DataFrame:
        groups = [*keys, *map(_quoted, self.values)]
        if not folds:
            return df.select(*groups).distinct()
        return df.groupBy(*groups).agg(*[fold.alias(s) for s, fold in folds.items()])

    def finish(self, df: DataFrame, by: Sequence[str], show: Sequence[str], rollup: bool = False) -> DataFrame:
        """Results per ``by`` group, or per drill level of ``by`` with its depth."""
        folds = [a.merged(_quoted(s)).alias(s) for s, a in self.partial.items()]
        folds += [a.fold(_quoted(s)).alias(s) for s, a in self.values.items()]
        if rollup:
            if any(a.spread for a in self.partial.values()):
                rolled = _levels(by, lambda keys: self._centred(df, keys).groupBy(*keys).agg(*folds))
            else:
                rolled = df.rollup(*by).agg(_depth(by), *folds)
            return finished(rolled, self.measures, [*by, "depth"], show)
        return finished(self._centred(df, by).groupBy(*by).agg(*folds), self.measures, by, show)


def reaggregate(
    partials: DataFrame,
    measures: Sequence[Measure],
    by: Sequence[str] = (),
    where: Where = None,
    show: Sequence[str] | None = None,
) -> DataFrame:
    """Answer a coarser query from stored partial results."""
    show, measures = show or [m.name for m in measures], resolved(measures)
    merged = merge_partials(_filtered(partials, _predicate(where)), measures, by)
    if BITMAP in merged.columns:
        slots = _slots(m for m in measures if not m.needs)
        counts = {s: F.sum(F.when(F.col(SET) == s, F.bitmap_count(BITMAP))) for s, a in slots.items() if a.distinct}
        # The rows of a group are one with its sums and one per bucket, so nothing is centred again.
        folds = [a.merged(_quoted(s)).alias(s) for s, a in slots.items() if a.merge]
        merged = merged.groupBy(*by).agg(*folds, *[F.coalesce(c, F.lit(0)).alias(s) for s, c in counts.items()])
    return finished(merged, measures, by, show)


def _depth(levels: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(1) - F.grouping(c) for c in levels]).cast("int").alias("depth")


def _levels(levels: Sequence[str], grouped: Callable[[Sequence[str]], DataFrame]) -> DataFrame:
    """Drill levels one by one, for aggregates that a rollup cannot merge."""
    parts = [grouped(levels[:k]).withColumn("depth", F.lit(k)) for k in range(len(levels), -1, -1)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def hierarchy_rollup(
    df: DataFrame,
    levels: Sequence[str],
    measures: Sequence[Measure],
    where: Where = None,
    show: Sequence[str] | None = None,
) -> DataFrame:
    """All drill levels, top to leaf; ``depth`` counts the levels present.

    Mergeable measures are aggregated to the leaf level first, so the copies a
    rollup makes are of grouped rows.
    """
    show = show or [m.name for m in measures]
    measures = resolved(measures)
    bases = [m for m in measures if not m.needs]
    slots = _slots(bases).values()
    if any(a.fraction is not None for a in slots):
        rows = _filtered(df, _predicate(where))
        rolled = _levels(levels, lambda keys: _grouped(rows, keys, bases))
    elif mergeable(bases) and any(a.spread for a in slots):
        leaves = preaggregate(df, bases, levels, where)
        rolled = _levels(levels, lambda keys: merge_partials(leaves, bases, keys))
    elif mergeable(bases):
        leaves = preaggregate(df, bases, levels, where)
        rolled = leaves.rollup(*levels).agg(
            _depth(levels), *[a.merged(_quoted(slot(m, p))).alias(slot(m, p)) for m in bases for p, a in m.base.items()]
        )
    else:
        rolled = _filtered(df, _predicate(where)).rollup(*levels).agg(_depth(levels), *_aggregates(bases))
    return finished(rolled, measures, [*levels, "depth"], show)


def bridge_measures(
    facts: DataFrame,
    bridge: DataFrame,
    groups: DataFrame,
    fact_on: Keys | str,
    group_on: Keys | str,
    measures: Sequence[Measure],
    by: Sequence[str],
    show: Sequence[str] | None = None,
) -> DataFrame:
    """Mergeable measures of facts by the far side of a many-to-many bridge, and their total.

    ``fact_on`` leads from the facts to the bridge, ``group_on`` from the bridge to
    the groups. A fact counts once in every group that it has a path to, however
    many paths there are, and once in the total (``is_total``), so the total is not
    the sum of the groups. Facts that share a key are one row of partial results
    before they meet their groups.
    """
    show, measures = show or [m.name for m in measures], resolved(measures)
    on = dict(key_pairs(fact_on))
    keys, ends = list(on), list(on.values())
    pairs = equi_join(bridge, groups, group_on).select(*ends, *by).distinct()
    partials = preaggregate(facts, measures, keys)
    parts = merge_partials(equi_join(partials, pairs, on), measures, by).withColumn("is_total", F.lit(False))
    total = merge_partials(semi_join(partials, pairs, on), measures, []).withColumn("is_total", F.lit(True))
    return finished(parts.unionByName(total, allowMissingColumns=True), measures, [*by, "is_total"], show)


def parent_child_rollup(
    facts: DataFrame,
    nodes: DataFrame,
    key: str,
    parent: str,
    measures: Sequence[Measure],
    fact_key: str | None = None,
    show: Sequence[str] | None = None,
) -> DataFrame:
    """Mergeable measures of every node of a parent-child table with all that is below it.

    ``nodes`` has one row per node; ``parent`` is NULL at the top. Each round a
    node hands what it has gathered to its ancestor 1, 2, 4, 8 ... levels up, so a
    chain of n nodes takes log2(n) rounds, and a parent of very many children is
    summed before the shuffle. A cycle is an error, as is a parent without row.
    Facts of unknown nodes are left out.
    """
    show, measures = show or [m.name for m in measures], resolved(measures)
    slots = [_quoted(s) for s in _slots(m for m in measures if not m.needs)]
    own = preaggregate(facts.withColumn("__node", F.col(fact_key or key)), measures, ["__node"])
    tree = nodes.select(F.col(key).alias("__node"), F.col(parent).alias("__up"))
    sums = cut_lineage(equi_join(tree.select("__node"), own, "__node", "left"))
    jumps = cut_lineage(tree.where("__up IS NOT NULL"))
    lost = anti_join(jumps, tree.select(F.col("__node").alias("__up")), "__up").first()
    if lost is not None:
        raise ValueError(f"node {lost['__node']} has an unknown parent {lost['__up']}")
    rounds = max(tree.count(), 1).bit_length()
    while not jumps.isEmpty():
        if rounds == 0:
            raise ValueError("the nodes have a cycle")
        handed = equi_join(sums, jumps, "__node").select(F.col("__up").alias("__node"), *slots)
        sums = cut_lineage(merge_partials(sums.unionByName(handed), measures, ["__node"]))
        further = jumps.select(F.col("__node").alias("__up"), F.col("__up").alias("__top"))
        jumps = cut_lineage(equi_join(jumps, further, "__up").select("__node", F.col("__top").alias("__up")))
        rounds -= 1
    done = finished(sums, measures, ["__node"], show)
    return equi_join(nodes, done, {key: "__node"}, "left")


def concatenatex(df: DataFrame, value: str, by: Sequence[str] = (), delimiter: str = ", ", out: str = "joined") -> DataFrame:
    """Values of a group in order as one text, repeats included.

    Repeats are counted before the shuffle, so a group ships each value once.
    """
    tallies = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).cast("int").alias("__n"))
    repeated = tallies.withColumn("__text", F.array_join(F.array_repeat(F.col(value).cast("string"), F.col("__n")), delimiter))
    quoted = delimiter.replace("'", "\\'")
    return repeated.groupBy(*by).agg(
        F.expr(f"listagg(__text, '{quoted}') WITHIN GROUP (ORDER BY `{value}`)").alias(out)
    )


def kpi_columns(value: Column, target: Column, previous: Column | None = None, near: float = 0.9) -> dict[str, Column]:
    """Status (1 reached, 0 near, -1 missed) and trend (sign of the change)."""
    status = F.when(value >= target, 1).when(value >= target * near, 0).when(value.isNotNull(), -1)
    columns = {"status": status}
    if previous is not None:
        columns["trend"] = F.when(value > previous, 1).when(value < previous, -1).when(value == previous, 0)
    return columns
