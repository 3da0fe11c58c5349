"""A semantic model: tables, relationships, measures and roles over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from tabweave.operators.joins import equi_join, null_safe_join
from tabweave.operators.transforms import perspective_view
from tabweave.plans.measures import Measure, Reduction, compounds, evaluate, hierarchy_rollup, resolved
from tabweave.session import fits_broadcast


@dataclass(frozen=True)
class Relationship:
    """Many-to-one: ``from_table.from_column`` refers to ``to_table.to_column``."""

    from_table: str
    from_column: str
    to_table: str
    to_column: str
    active: bool = True
    both_directions: bool = False
    name: str | None = None


@dataclass(frozen=True)
class Role:
    """Row filters, hidden tables and hidden columns of a role."""

    rows: Mapping[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    hidden_tables: tuple[str, ...] = ()
    hidden_columns: Mapping[str, tuple[str, ...]] = field(default_factory=dict)


def qualified(table: str, column: str) -> str:
    return f"{table}__{column}"


class SemanticModel:
    def __init__(
        self,
        tables: Mapping[str, DataFrame],
        relationships: Sequence[Relationship] = (),
        measures: Sequence[Measure] = (),
        roles: Mapping[str, Role] | None = None,
        hierarchies: Mapping[str, Sequence[str]] | None = None,
        perspectives: Mapping[str, Mapping[str, Sequence[str]]] | None = None,
    ):
        self.tables = dict(tables)
        self.relationships = list(relationships)
        self.measures = {m.name: m for m in measures}
        self.roles = dict(roles or {})
        self.hierarchies = dict(hierarchies or {})
        self.perspectives = dict(perspectives or {})

    def table(self, name: str, role: str | None = None) -> DataFrame:
        """The table as the role sees it; a hidden table does not exist for it."""
        rules = self.roles[role] if role else Role()
        if name in rules.hidden_tables:
            raise PermissionError(f"table {name} does not exist or is not authorized")
        return self._rows(name, role).drop(*rules.hidden_columns.get(name, ()))

    def _rows(self, name: str, role: str | None) -> DataFrame:
        """The table's rows for the role, with the key columns that joins need even where they are hidden."""
        rules = self.roles[role] if role else Role()
        if name in rules.hidden_tables:
            raise PermissionError(f"table {name} does not exist or is not authorized")
        df = self.tables[name]
        if name in rules.rows:
            df = rules.rows[name](df)
        keys = {r.from_column for r in self.relationships if r.from_table == name}
        keys |= {r.to_column for r in self.relationships if r.to_table == name}
        return df.drop(*[c for c in rules.hidden_columns.get(name, ()) if c not in keys])

    def visible(self, role: str | None = None) -> dict[str, list[str]]:
        """The tables and columns that the role can see."""
        hidden = self.roles[role].hidden_tables if role else ()
        return {name: self.table(name, role).columns for name in self.tables if name not in hidden}

    def _allowed(self, columns: Sequence[str], role: str | None) -> None:
        """Raise where the role names a hidden column."""
        hidden = {c for cs in self.roles[role].hidden_columns.values() for c in cs} if role else set()
        for c in columns:
            if c in hidden:
                raise PermissionError(f"column {c} does not exist or is not authorized")

    def perspective(self, name: str, table: str, role: str | None = None) -> DataFrame:
        """The perspective's columns of the table, as the role sees it."""
        seen = self.table(table, role)
        return perspective_view(seen, [c for c in self.perspectives[name][table] if c in seen.columns])

    def _links(self, use: Sequence[str], ignore: Sequence[str]) -> list[Relationship]:
        """Relationships in force. One named in ``use`` replaces the active one between the same tables."""
        chosen = [r for r in self.relationships if r.name in use]
        replaced = {(r.from_table, r.to_table) for r in chosen}
        rest = [
            r
            for r in self.relationships
            if r.active and r.name not in ignore and (r.from_table, r.to_table) not in replaced
        ]
        return chosen + rest

    def star(
        self,
        fact: str,
        tables: Sequence[str] | None = None,
        role: str | None = None,
        use: Sequence[str] = (),
        ignore: Sequence[str] = (),
    ) -> DataFrame:
        """The fact with the related dimensions that are asked for, or with all of them.

        Only the paths to the wanted tables are joined. A relationship that
        filters in both directions is an inner join, every other a left join.
        """
        df = self._rows(fact, role)
        steps = self._steps(fact, tables, role, use, ignore)
        for link in steps:
            df = self._attach(df, link, role)
        rules = self.roles[role] if role else Role()
        return df.drop(*[c for t in [fact, *(link.to_table for link in steps)] for c in rules.hidden_columns.get(t, ())])

    def _steps(
        self, fact: str, tables: Sequence[str] | None, role: str | None, use: Sequence[str], ignore: Sequence[str]
    ) -> list[Relationship]:
        """The relationships to follow, in join order, to reach the wanted tables."""
        links, paths, queue = self._links(use, ignore), {fact: []}, [fact]
        while queue:
            here = queue.pop(0)
            for link in links:
                if link.from_table == here and link.to_table not in paths:
                    paths[link.to_table] = paths[here] + [link]
                    queue.append(link.to_table)
        wanted = list(paths) if tables is None else [t for t in tables if t != fact]
        missing = [t for t in wanted if t not in paths]
        if missing:
            raise ValueError(f"no active relationship leads from {fact} to {missing}")
        if role:
            # Row security on a dimension also has to limit the facts that point to it.
            wanted += [t for t in self.roles[role].rows if t in paths and t != fact]
        return list({link.to_table: link for t in wanted for link in paths[t]}.values())

    def _attach(self, df: DataFrame, link: Relationship, role: str | None) -> DataFrame:
        """``df`` with the columns of the linked table.

        A name that ``df`` has already stays that of the table that came first; a
        key of the new table that further links need is kept under its qualified name.
        """
        secured = bool(role) and link.to_table in self.roles[role].rows
        how = "inner" if link.both_directions or secured else "left"
        one = self._rows(link.to_table, role)
        source = self._source(df, link)
        further = {r.from_column for r in self.relationships if r.from_table == link.to_table}
        clashing = [c for c in one.columns if c in df.columns]
        copies = {qualified(link.to_table, c): F.col(c) for c in clashing if c in further}
        keyed = one.withColumns({**copies, "__to": F.col(link.to_column)}).drop(*clashing)
        return equi_join(df, keyed, {source: "__to"}, how)

    def _source(self, df: DataFrame, link: Relationship) -> str:
        """The column of the joined rows that holds the link's key."""
        name = qualified(link.from_table, link.from_column)
        return name if name in df.columns else link.from_column

    def _needed(self, metrics: Sequence[str]) -> dict[str, Measure]:
        """The metrics and every measure they are computed from."""
        needed, stack = {}, list(metrics)
        while stack:
            measure = self.measures[stack.pop()]
            if measure.name not in needed:
                needed[measure.name] = measure
                stack += measure.needs
        return needed

    def drill(
        self,
        fact: str,
        metrics: Sequence[str],
        hierarchy: str,
        where: Mapping[str, Column] | None = None,
        role: str | None = None,
    ) -> DataFrame:
        """Metrics at every level of a hierarchy, the total at depth 0."""
        levels, measures = self.hierarchies[hierarchy], list(self._needed(metrics).values())
        self._allowed([*levels, *(where or {})], role)
        tables = [self.owner(c) for c in [*levels, *(where or {})]] + [t for m in measures for t in m.tables]
        steps = self._steps(fact, list(dict.fromkeys(tables)), role, (), ())
        reduction = Reduction(measures)
        reduced = self._reduced_star(fact, steps, reduction, levels, where or {}, {}, role)
        if reduced is not None:
            return reduction.finish(reduced, levels, list(metrics), rollup=True)
        rows = self._rows(fact, role)
        for link in steps:
            rows = self._attach(rows, link, role)
        return hierarchy_rollup(rows, levels, measures, where, list(metrics))

    def owner(self, column: str) -> str:
        holders = [name for name, df in self.tables.items() if column in df.columns]
        if len(holders) != 1:
            raise ValueError(f"column {column} is in {holders or 'no table'}; a shared name is asked for as table.column")
        return holders[0]

    def _parts(self, name: str) -> tuple[str, str] | None:
        """Table and column of a qualified name."""
        table, dot, column = name.partition(".")
        return (table, column) if dot and table in self.tables else None

    def _name(self, name: str) -> str:
        parts = self._parts(name)
        return qualified(*parts) if parts else name

    def _qualified(self, names: Sequence[str], role: str | None) -> SemanticModel:
        """The model with a copy of each of the columns under its qualified name."""
        tables = dict(self.tables)
        for table, column in map(self._parts, dict.fromkeys(names)):
            if role and column in self.roles[role].hidden_columns.get(table, ()):
                raise PermissionError(f"column {table}.{column} does not exist or is not authorized")
            tables[table] = tables[table].withColumn(qualified(table, column), F.col(column))
        return SemanticModel(tables, self.relationships, self.measures.values(), self.roles, self.hierarchies, self.perspectives)

    def query_facts(
        self,
        metrics: Mapping[str, Sequence[str]],
        by: Sequence[str] = (),
        where: Mapping[str, Column] | None = None,
        role: str | None = None,
        across: Sequence[str] = (),
        columns: Mapping[str, Column] | None = None,
        tables: Sequence[str] = (),
    ) -> DataFrame:
        """Metrics of several facts side by side, by dimensions that they share.

        Each fact is aggregated to the grouping columns on its own, so no rows are
        multiplied, and the results meet in one aggregate. A fact that cannot reach
        a grouping or filter column is of another grain, which is an error.
        ``across`` names compounds over metrics of different facts.
        """
        names = [n for own in metrics.values() for n in own]
        repeated = sorted({n for n in names if names.count(n) > 1})
        if repeated:
            raise ValueError(f"{repeated} are asked of several facts")
        frames = []
        for fact, own in metrics.items():
            reached = {link.to_table for link in self._steps(fact, None, role, (), ())} | {fact}
            wanted = {c: (self._parts(c) or (None,))[0] or self.owner(c) for c in [*by, *(where or {})] if c not in (columns or {})}
            lost = [c for c, t in wanted.items() if t not in reached] + [t for t in tables if t not in reached]
            if lost:
                raise ValueError(f"{fact} is not of the grain of {lost}")
            frames.append(self.query(fact, own, by, where, role, columns=columns, tables=tables))
        united = frames[0]
        for frame in frames[1:]:
            united = united.unionByName(frame, allowMissingColumns=True)
        keys = [self._name(c) for c in by]
        met = united.groupBy(*keys).agg(*[self._met(n) for n in names])
        measures = [replace(self.measures[n], needs=(), changes=(), base={}) for n in names]
        return compounds(met, measures + [self.measures[n] for n in across], keys, [*names, *across])

    def _met(self, name: str) -> Column:
        """The one value of a metric in a group; a count of a fact without rows there is 0."""
        found, base = F.max(f"`{name}`"), list(self.measures[name].base.values())
        counted = len(base) == 1 and (base[0].distinct or base[0].empty == 0)
        return (F.coalesce(found, F.lit(0)) if counted else found).alias(name)

    def query(
        self,
        fact: str,
        metrics: Sequence[str],
        by: Sequence[str] = (),
        where: Mapping[str, Column] | None = None,
        role: str | None = None,
        use: Sequence[str] = (),
        ignore: Sequence[str] = (),
        columns: Mapping[str, Column] | None = None,
        tables: Sequence[str] = (),
    ) -> DataFrame:
        """Metrics of a fact by dimension columns under filters per column.

        ``columns`` names grouping expressions, e.g. a year of a date column;
        ``tables`` adds the tables such expressions need beyond those of the
        grouping and filter columns. A name that several tables share is asked for
        as ``table.column`` and shown as ``table__column``; a filter on it is a
        function of the column.
        """
        named = [c for c in [*by, *(where or {})] if self._parts(c)]
        if named:
            known = self._qualified(named, role)
            inner = {self._name(c): p(F.col(self._name(c))) if self._parts(c) else p for c, p in (where or {}).items()}
            return known.query(fact, metrics, [self._name(c) for c in by], inner, role, use, ignore, columns, tables)
        columns, needed = dict(columns or {}), self._needed(metrics)
        self._allowed([*by, *(where or {})], role)
        measures = resolved(needed.values())
        if any(m.use or m.ignore for m in measures):
            if columns:
                raise ValueError("give grouping columns of the tables where measures differ in their relationships")
            return self._over_relationships(fact, measures, metrics, by, where or {}, role, use, ignore)
        tables = list(tables) + [self.owner(c) for c in [*by, *(where or {})] if c not in columns]
        tables += [t for m in needed.values() for t in m.tables]
        steps = self._steps(fact, list(dict.fromkeys(tables)), role, use, ignore)
        where = dict(where or {})
        reduction = Reduction(measures)
        reduced = self._reduced_star(fact, steps, reduction, by, where, columns, role)
        if reduced is not None:
            return reduction.finish(reduced, by, list(metrics))
        rows = self._rows(fact, role)
        for link in steps:
            rows = self._attach(rows, link, role)
        if columns:
            rows = rows.withColumns(columns)
        return evaluate(rows, measures, by, where or None, show=list(metrics))

    def _over_relationships(
        self,
        fact: str,
        measures: Sequence[Measure],
        metrics: Sequence[str],
        by: Sequence[str],
        where: Mapping[str, Column],
        role: str | None,
        use: Sequence[str],
        ignore: Sequence[str],
    ) -> DataFrame:
        """Measures that follow different relationships, each kind over its own star.

        Kinds that see all grouping columns give one row per group each, and meet
        in one aggregate. A kind that cannot reach a grouping column has the same
        value for all groups of what it reaches, and is attached to them.
        """
        bases = [m for m in measures if not m.needs]
        full, partial = [], []
        for kind in dict.fromkeys((m.use, m.ignore) for m in bases):
            own = [replace(m, use=(), ignore=()) for m in bases if (m.use, m.ignore) == kind]
            uses, ignores = (*use, *kind[0]), (*ignore, *kind[1])
            reached = {link.to_table for link in self._steps(fact, None, role, uses, ignores)} | {fact}
            groups = [c for c in by if self.owner(c) in reached]
            filters = {c: p for c, p in where.items() if self.owner(c) in reached}
            part = SemanticModel(self.tables, self.relationships, own, self.roles)
            names = [m.name for m in own]
            frame = part.query(fact, names, groups, filters, role, uses, ignores)
            (full if len(groups) == len(by) else partial).append((frame, groups, names))
        if not full:
            raise ValueError(f"no measure reaches all of {list(by)}")
        out = full[0][0]
        if len(full) > 1:
            united = out
            for frame, _, _ in full[1:]:
                united = united.unionByName(frame, allowMissingColumns=True)
            names = [n for _, _, names in full for n in names]
            out = united.groupBy(*by).agg(*[F.max(f"`{n}`").alias(n) for n in names])
        for frame, groups, names in partial:
            if groups:
                out = null_safe_join(out, frame, groups, "left")
            else:
                whole = frame.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("__whole")).scalar()
                out = out.withColumn("__whole", whole).withColumns({n: F.col("__whole")[n] for n in names}).drop("__whole")
        return compounds(out, measures, by, list(metrics))

    def _reduced_star(
        self,
        fact: str,
        steps: Sequence[Relationship],
        reduction: Reduction,
        by: Sequence[str],
        where: Mapping[str, Column],
        columns: Mapping[str, Column],
        role: str | None,
    ) -> DataFrame | None:
        """Partial results joined to the dimensions, or None where that does not apply.

        Before each join with a dimension too large to broadcast, the rows are
        aggregated to the keys that are still needed, so the shuffle carries
        partial sums instead of fact rows.
        """
        bases = [m for m in reduction.measures if not m.needs]
        df = self._rows(fact, role)
        if not reduction.complete or any(m.scope.kind != "local" for m in bases):
            return None
        if not _resolves(df.groupBy(), [a.column() for m in bases for a in m.base.values()]):
            return None
        if all(fits_broadcast(self._rows(link.to_table, role)) for link in steps):
            return None
        waiting, underived, reduced = dict(where), dict(columns), False
        for i, link in enumerate([*steps, None]):
            for name in [n for n, e in underived.items() if _resolves(df, [e])]:
                df = df.withColumn(name, underived.pop(name))
            for name in [n for n, p in waiting.items() if _resolves(df, [p])]:
                df = df.where(waiting.pop(name))
            if link is None:
                break
            if not fits_broadcast(self._rows(link.to_table, role)):
                later = {step.from_column for step in steps[i:]} | set(by)
                later |= {qualified(step.from_table, step.from_column) for step in steps[i:]}
                keys = [c for c in df.columns if c in later]
                df = reduction.reduce(df, keys) if reduced else reduction.start(df, keys)
                reduced = True
            df = self._attach(df, link, role)
        # An expression over columns of several tables may have lost one of them.
        return None if waiting or underived else df


def _resolves(df: DataFrame | GroupedData, expressions: Sequence[Column]) -> bool:
    try:
        (df.agg if isinstance(df, GroupedData) else df.select)(*expressions)
    except AnalysisException:
        return False
    return True
