"""Scorecards, classifications and dependency levels over catalogue tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.operators.joins import anti_join, equi_join, lookup_join, null_safe_join
from tabweave.session import cut_lineage

#: Effort in hours per component by status (fixed values).
EFFORT_HOURS = {"Success": 0.5, "Partial": 2.0, "NotSupported": 4.0, "N/A": 0.0}

#: Share of support each status counts for; statuses not listed count as none.
SUPPORT_SHARE = {"Success": 1.0, "Partial": 0.5}


def _weight(status: Column, weights: Mapping[str, float]) -> Column:
    chain = reduce(lambda acc, kv: acc.when(status == kv[0], F.lit(float(kv[1]))), weights.items(), F)
    return chain.otherwise(F.lit(0.0))


def status_scorecard(
    df: DataFrame,
    group: str | None,
    status: str,
    statuses: Mapping[str, str],
    effort: Mapping[str, float] = EFFORT_HOURS,
    share: Mapping[str, float] = SUPPORT_SHARE,
    not_applicable: str = "N/A",
) -> DataFrame:
    """Counts by status, supported percentage and effort, per group or in total.

    ``statuses`` maps output columns to status values.
    """
    s = F.col(status)
    scored = df.groupBy(*([group] if group else [])).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(s == value).alias(name) for name, value in statuses.items()],
        F.round(F.sum(_weight(s, effort)), 1).alias("effort_hrs"),
        F.sum(_weight(s, share)).alias("__supported"),
        (F.count(F.lit(1)) - F.count_if(s == not_applicable)).alias("__rated"),
    )
    percent = F.when(F.col("__rated") > 0, F.round(F.col("__supported") / F.col("__rated") * 100, 1)).otherwise(0.0)
    return scored.withColumn("supported_pct", percent).drop("__supported", "__rated")


def presence_classify(
    df: DataFrame, group: str, rules: Sequence[tuple[str, Sequence[Column]]], default: str, out: str = "classification"
) -> DataFrame:
    """Label a group by which values occur in it; the first rule wins.

    A rule is a label and the row predicates that must each hold for some row.
    """
    flags = df.groupBy(group).agg(
        *[
            F.bool_or(F.coalesce(predicate, F.lit(False))).alias(f"__{i}_{j}")
            for i, (_, predicates) in enumerate(rules)
            for j, predicate in enumerate(predicates)
        ]
    )
    chain = F
    for i, (label, predicates) in enumerate(rules):
        chain = chain.when(reduce(lambda a, b: a & b, [F.col(f"__{i}_{j}") for j in range(len(predicates))]), F.lit(label))
    return flags.select(group, chain.otherwise(F.lit(default)).alias(out))


def threshold_tier(
    df: DataFrame,
    group: str,
    metrics: Mapping[str, Column],
    tiers: Sequence[tuple[str, Mapping[str, float]]],
    default: str = "Low",
    out: str = "tier",
) -> DataFrame:
    """Aggregate ``metrics`` per group; the first tier with a threshold met wins."""
    scored = df.groupBy(group).agg(*[m.alias(n) for n, m in metrics.items()])
    chain = F
    for label, thresholds in tiers:
        chain = chain.when(reduce(lambda a, b: a | b, [F.col(n) >= t for n, t in thresholds.items()]), F.lit(label))
    return scored.withColumn(out, chain.otherwise(F.lit(default)))


#: Tiers by unsupported components, complex components and issues (fixed values).
COMPLEXITY_TIERS = (
    ("High", {"not_supported": 3, "drivers": 2, "issues": 8}),
    ("Medium", {"not_supported": 1, "drivers": 1, "issues": 3}),
)


def issue_rollup(groups: DataFrame, issues: DataFrame, group: str, code: str, prefixes: Mapping[str, str]) -> DataFrame:
    """Issues per group by code prefix; groups without issues stay at 0."""
    counts = issues.groupBy(group).agg(*[F.count_if(F.col(code).startswith(p)).alias(n) for n, p in prefixes.items()])
    out = null_safe_join(groups.select(group).distinct(), counts, [group], "left")
    return out.fillna(0, subset=list(prefixes))


def dimension_role_classify(relationships: DataFrame, many: str = "from_table", one: str = "to_table") -> DataFrame:
    """A table is a dimension iff it is a one side and never a many side."""
    sides = relationships.select(F.col(many).alias("table_name"), F.lit(True).alias("__many")).unionByName(
        relationships.select(F.col(one).alias("table_name"), F.lit(False).alias("__many"))
    )
    return sides.groupBy("table_name").agg((~F.bool_or("__many")).alias("is_dimension"))


def dependency_fanin(edges: DataFrame, node: str = "from", minimum: int = 2) -> DataFrame:
    """Nodes with at least ``minimum`` dependencies."""
    return edges.groupBy(node).agg(F.count(F.lit(1)).alias("dependencies")).where(F.col("dependencies") >= minimum)


def _dealt(df: DataFrame) -> DataFrame:
    """``df`` written in a few even parts per core; adaptive execution would leave narrow rows to one task."""
    return cut_lineage(df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, *df.columns))


def _peeled(
    edges: DataFrame, source: str, target: str, nodes: DataFrame | None = None
) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Nodes settled in each round, the nodes left and the edges among them.

    A round drops the edges to the nodes settled last. Nodes that have no edge
    then are settled next. Only what is left is written, once a round, so a round
    costs no more than the edges and nodes still open before it.
    """
    open_edges = edges.select(F.col(source).alias("__from"), F.col(target).alias("__to"))
    seen = open_edges.select(
        F.inline(
            F.array(
                F.struct(F.col("__from").alias("node"), F.lit(True).alias("__needs")),
                F.struct(F.col("__to").alias("node"), F.lit(False).alias("__needs")),
            )
        )
    )
    if nodes is not None:
        seen = seen.unionByName(nodes.select(F.col(nodes.columns[0]).alias("node"), F.lit(False).alias("__needs")))
    # NULL is never equal to a source, so as a target it is settled at once.
    sides = cut_lineage(seen.groupBy("node").agg(F.bool_or("__needs").alias("__needs"), F.bool_and("__needs").alias("__only")))
    ready = sides.where(~F.col("__needs") | (F.col("node").isNull() & ~F.col("__only"))).select("node")
    left = sides.where("__needs").select("node")
    settled = [ready]
    while True:
        open_edges = _dealt(anti_join(open_edges, ready, {"__to": "node"}))
        waiting = open_edges.select(F.col("__from").alias("node")).distinct()
        ready = _dealt(anti_join(left, waiting, ["node"], null_safe=True))
        if ready.isEmpty():
            return settled, left, open_edges
        settled.append(ready)
        left = _dealt(waiting)
        if left.isEmpty():
            return settled, left, open_edges


def dependency_levels(
    edges: DataFrame, nodes: DataFrame | None = None, source: str = "from", target: str = "to"
) -> DataFrame:
    """Level of each node, leaves at 0; nodes on or above a cycle have level NULL.

    ``edges`` is read twice; one that is costly to make should be written before.
    """
    settled, left, _ = _peeled(edges, source, target, nodes)
    levels = [ready.withColumn("level", F.lit(level)) for level, ready in enumerate(settled)]
    return reduce(DataFrame.unionByName, [*levels, left.withColumn("level", F.lit(None).cast("int"))])


def _spread(values: DataFrame, edges: DataFrame, start: str, end: str) -> DataFrame:
    """Every node's largest ``color`` among its own and those of all nodes that ``edges`` lead from to it."""
    known = cut_lineage(values)
    fresh = known
    while not fresh.isEmpty():
        handed = equi_join(edges, fresh, {start: "node"}).groupBy(F.col(end).alias("node")).agg(F.max("color").alias("color"))
        better = equi_join(handed, known.withColumnRenamed("color", "__own"), "node")
        fresh = cut_lineage(better.where(F.col("color") > F.col("__own")).select("node", "color"))
        known = cut_lineage(anti_join(known, fresh, "node").unionByName(fresh))
    return known


def _members(colors: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that reach the node their color is named after, over nodes of that color."""
    tinted = equi_join(edges, colors.withColumnsRenamed({"color": "__color"}), {"__from": "node"})
    inner = cut_lineage(equi_join(tinted, colors, {"__to": "node"}).where(F.col("__color") == F.col("color")).select("__from", "__to"))
    found = fresh = cut_lineage(colors.where(F.col("color") == F.col("node")))
    while not fresh.isEmpty():
        before = equi_join(inner, fresh, {"__to": "node"}).select(F.col("__from").alias("node"), "color").distinct()
        fresh = cut_lineage(anti_join(before, found, "node"))
        found = cut_lineage(found.unionByName(fresh))
    return found


def dependency_components(
    edges: DataFrame, nodes: DataFrame | None = None, source: str = "from", target: str = "to"
) -> DataFrame:
    """Each node with its cycle and a level that counts a cycle as one step.

    Nodes that depend on each other are one component, named after its smallest
    node; other nodes are components of their own. Only what is neither below nor
    above all cycles is searched: every node takes the largest name that reaches
    it, and those that reach the node of that name in turn are its component. The
    components are then levelled like nodes, so what stands on a cycle has a level.
    """
    clean = edges.select(F.col(source).alias("__from"), F.col(target).alias("__to"))
    clean = cut_lineage(clean.where("__from IS NOT NULL AND __to IS NOT NULL"))
    core, found = clean.where("__from <> __to"), None
    for up, down in (("__to", "__from"), ("__from", "__to")):
        _, _, core = _peeled(core, up, down)
        core = core.select(F.col("__from").alias(up), F.col("__to").alias(down)).select("__from", "__to")
    core = cut_lineage(core.distinct())
    while not core.isEmpty():
        names = core.select(F.explode(F.array("__from", "__to")).alias("node")).distinct()
        colors = _spread(names.withColumn("color", F.col("node")), core, "__from", "__to")
        members = _members(colors, core)
        found = members if found is None else found.unionByName(members)
        core = cut_lineage(anti_join(anti_join(core, members, {"__from": "node"}), members, {"__to": "node"}))
    alone = [clean.where("__from = __to").select(F.col("__from").alias("node"))]
    if nodes is not None:
        alone.append(nodes.select(F.col(nodes.columns[0]).alias("node")).where("node IS NOT NULL"))
    alone = reduce(DataFrame.unionByName, alone)
    one = F.lit(1).cast("long")
    if found is None:
        levels = dependency_levels(clean.where("__from <> __to"), alone, "__from", "__to")
        return levels.select("node", F.col("node").alias("component"), one.alias("members"), "level")
    sizes = found.groupBy("color").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("members"))
    # A node that is not found is its own component, so only the found ones are looked up.
    found = cut_lineage(equi_join(found, sizes, "color").select("node", "component", "members"))

    def named(df: DataFrame, node: str) -> DataFrame:
        known = lookup_join(df, found.select(F.col("node").alias("__node"), "component"), {node: "__node"})
        return known.withColumn(node, F.coalesce("component", node)).drop("component")

    over = cut_lineage(named(named(clean, "__from"), "__to").where("__from <> __to"))
    levels = dependency_levels(over, named(alone, "node").unionByName(found.select(F.col("component").alias("node"))), "__from", "__to")
    whole = lookup_join(levels, found.withColumnsRenamed({"node": "__member", "component": "__component"}), {"node": "__component"})
    return whole.select(
        F.coalesce("__member", "node").alias("node"), F.col("node").alias("component"), F.coalesce("members", one).alias("members"), "level"
    )
