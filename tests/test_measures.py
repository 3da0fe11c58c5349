import statistics

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tabweave.operators import positions
from tabweave.plans import bitmaps
from tabweave.plans import measures as m
from tabweave.plans.model import Relationship, Role, SemanticModel

DDL = "region string, product string, amount double"


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(
        [("West", "a", 10.0), ("West", "b", 20.0), ("East", "a", 5.0), (None, "a", 1.0), ("East", None, None)], DDL
    )


AMOUNT = m.sum_("amount", "amount")


def test_base_measures(sales):
    out = m.evaluate(
        sales,
        [
            AMOUNT,
            m.count("n", "amount"),
            m.count_rows("rows"),
            m.count_blank("blank", "amount"),
            m.distinct_count("products", "product"),
            m.average("mean", "amount"),
            m.minimum("lo", "amount"),
            m.maximum("hi", "amount"),
        ],
        ["region"],
    )
    assert rows(out) == [
        (None, 1.0, 1, 1, 0, 1, 1.0, 1.0, 1.0),
        ("East", 5.0, 1, 2, 1, 1, 5.0, 5.0, 5.0),
        ("West", 30.0, 2, 2, 0, 2, 15.0, 10.0, 20.0),
    ]


def test_empty_input(sales):
    empty = sales.where("1 = 0")
    assert rows(m.evaluate(empty, [AMOUNT, m.count_rows("n"), m.average("a", "amount")])) == [(None, 0, None)]
    assert rows(m.evaluate(empty, [AMOUNT], ["region"])) == []


def test_calculate_filter_leaves_other_measures(sales):
    west = m.calculate_filter(AMOUNT, F.col("region") == "West", "west")
    assert rows(m.evaluate(sales, [AMOUNT, west], ["product"])) == [
        (None, None, None),
        ("a", 16.0, 10.0),
        ("b", 20.0, 20.0),
    ]


@pytest.mark.parametrize("extra", [[], [m.distinct_count("d", "product")]])
def test_scopes_with_query_filter(sales, extra):
    """The same totals whether they come from grouped rows or from the base."""
    out = m.evaluate(
        sales,
        [
            AMOUNT,
            m.calculate_all(AMOUNT, "all"),
            m.calculate_allselected(AMOUNT, "selected"),
            m.calculate_allexcept(AMOUNT, ["region"], "of_region"),
            *extra,
        ],
        ["region", "product"],
        {"product": F.col("product") == "a"},
        show=["amount", "all", "selected", "of_region"],
    )
    assert rows(out) == [
        (None, "a", 1.0, 36.0, 16.0, 1.0),
        ("East", "a", 5.0, 36.0, 16.0, 5.0),
        ("West", "a", 10.0, 36.0, 16.0, 30.0),
    ]


def test_allselected_reads_the_base_once(spark, tmp_path, sales):
    path = str(tmp_path / "sales")
    sales.write.parquet(path)
    base = spark.read.schema(DDL).parquet(path)
    out = m.evaluate(base, [AMOUNT, m.count_rows("n"), m.calculate_allselected(AMOUNT, "all")], ["region"])
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in final


def test_scope_without_grouping_and_only_scoped(sales):
    assert rows(m.evaluate(sales, [m.calculate_all(AMOUNT, "all")], where=F.col("region") == "East")) == [(36.0,)]
    out = m.evaluate(sales, [m.calculate_all(AMOUNT, "all")], ["region"])
    assert rows(out) == [(None, 36.0), ("East", 36.0), ("West", 36.0)]


def test_compounds_resolve_in_any_order(sales):
    measures = [
        m.compound("double_share", ("share",), lambda p: p["share"] * 2),
        m.ratio("share", "west", "amount", 0.0),
        AMOUNT,
        m.calculate_filter(AMOUNT, F.col("region") == "West", "west"),
    ]
    assert rows(m.evaluate(sales, measures, show=["double_share"])) == [(60.0 / 36,)]
    with pytest.raises(KeyError):
        m.evaluate(sales, [m.ratio("x", "amount", "absent"), AMOUNT])
    with pytest.raises(KeyError):
        m.evaluate(sales, [m.calculate_filter(m.ratio("x", "amount", "absent"), F.lit(True)), AMOUNT])


def test_ratio_by_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0)], "a double, b double")
    parts = [m.sum_("a", "a"), m.sum_("b", "b")]
    assert rows(m.evaluate(df, [*parts, m.ratio("r", "a", "b")], show=["r"])) == [(None,)]
    assert rows(m.evaluate(df, [*parts, m.ratio("r", "a", "b", -1.0)], show=["r"])) == [(-1.0,)]


def test_one_value(sales):
    out = m.evaluate(sales, [m.has_one_value("one", "product"), m.selected_value("value", "product", "many")], ["region"])
    assert rows(out) == [(None, True, "a"), ("East", True, "a"), ("West", False, "many")]


def test_calc_group_names_formats_and_choice_by_name(sales):
    items = {"Current": lambda x: x, "West": lambda x: m.calculate_filter(x, F.col("region") == "West")}
    items["Chosen"] = lambda x: m.calculate_filter(x, F.col("region") == "East") if x.name == "n" else x
    expanded = m.calc_group_expand([AMOUNT, m.count_rows("n")], items, {"West": "0.00"})
    out = m.evaluate(sales, expanded)
    assert out.columns == ["amount Current", "n Current", "amount West", "n West", "amount Chosen", "n Chosen"]
    assert rows(out) == [(36.0, 5, 30.0, 2, 36.0, 2)]
    assert out.schema["amount West"].metadata == {"format": "0.00"}


def test_rollup_total_is_the_sum(sales):
    for measures in ([AMOUNT], [AMOUNT, m.distinct_count("d", "product")]):
        out = m.hierarchy_rollup(sales, ["region", "product"], measures)
        assert out.where("depth = 0").first()["amount"] == 36.0
        assert out.where("depth = 1").count() == 3


def test_concatenatex_keeps_repeats_and_skips_null(spark):
    df = spark.createDataFrame([("x", "b"), ("x", "a"), ("x", "b"), ("x", None), ("y", "it's")], "k string, v string")
    assert rows(m.concatenatex(df, "v", ["k"], "' ")) == [("x", "a' b' b"), ("y", "it's")]


def test_preaggregate_refuses_distinct(sales):
    with pytest.raises(ValueError):
        m.preaggregate(sales, [m.distinct_count("d", "product")], ["region"])


def test_reaggregate_equals_direct(sales):
    measures = [AMOUNT, m.average("mean", "amount"), m.minimum("lo", "amount")]
    stored = m.preaggregate(sales, measures, ["region", "product"])
    assert rows(m.reaggregate(stored, measures, ["product"])) == rows(m.evaluate(sales, measures, ["product"]))


@pytest.fixture(scope="module")
def star(spark):
    fact = spark.createDataFrame(
        [(i, i % 7 if i % 10 else None, float(i), 1 + i % 3) for i in range(500)],
        "sale_id int, product_key int, amount double, store_key int",
    )
    product = spark.createDataFrame([(k, f"c{k % 2}", k % 3) for k in range(5)], "product_key int, category string, maker_key int")
    maker = spark.createDataFrame([(k, f"m{k}") for k in range(2)], "maker_key int, maker string")
    store = spark.createDataFrame([(k, f"s{k}") for k in range(1, 4)], "id int, store string")
    return SemanticModel(
        {"sales": fact, "product": product, "maker": maker, "store": store},
        [
            Relationship("sales", "product_key", "product", "product_key"),
            Relationship("product", "maker_key", "maker", "maker_key"),
            Relationship("sales", "store_key", "store", "id"),
        ],
        [AMOUNT, m.count_rows("n"), m.ratio("mean", "amount", "n"), m.distinct_count("products", "product_key")],
        roles={
            "limited": Role(
                {"store": lambda df: df.where("store <> 's1'")}, hidden_tables=("maker",), hidden_columns={"product": ("category",)}
            )
        },
    )


def test_reduced_star_equals_plain_star(spark, star):
    """Facts aggregated before large joins give what the plain joins give."""
    asks = [
        dict(metrics=["amount", "n", "mean"], by=["category", "maker"]),
        dict(metrics=["amount"], by=["store"], where={"maker": F.col("maker") == "m1", "amount": F.col("amount") > 50}),
        dict(metrics=["n"], by=["id", "kind"], columns={"kind": F.concat("store", "category")}, tables=["store", "product"]),
        dict(metrics=["amount"], by=["size"], columns={"size": F.floor(F.col("amount") / 100)}, where={"store": F.col("store") != "s2"}),
        dict(metrics=["products", "n"], by=["store"]),
    ]
    default = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for ask in asks:
        plain = rows(star.query("sales", **ask))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            assert rows(star.query("sales", **ask)) == plain
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", default)


def test_drill(spark, star):
    star.hierarchies["make"] = ["category", "maker"]
    default = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    results = []
    for limit in (default, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        out = star.drill("sales", ["mean", "products"], "make", {"store": F.col("store") != "s1"})
        results.append(rows(out))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", default)
    assert results[0] == results[1]
    assert sum(r[2] == 0 for r in results[0]) == 1


def test_roles(star):
    out = star.query("sales", ["n"], ["store"], role="limited")
    assert {r[0] for r in rows(out)} == {"s2", "s3"}
    # A filtered dimension also limits facts when it is not grouped by.
    assert star.query("sales", ["n"], role="limited").first()["n"] == sum(r[1] for r in rows(out))
    with pytest.raises(PermissionError):
        star.table("maker", "limited")
    assert "category" not in star.table("product", "limited").columns


def test_unreachable_table(star):
    with pytest.raises(ValueError):
        star.star("store", ["maker"])


def test_counts_of_nothing_are_zero(spark):
    """Direct, from partial results, and through a model with large and small dimensions."""
    df = spark.createDataFrame([(1, 10, 2.0), (2, 20, 3.0)], "k int, d int, v double")
    measures = [m.count_rows("n"), m.count("v_n", "v"), m.average("mean", "v"), m.sum_("v_sum", "v")]
    nothing = {"k": F.col("k") > 5}
    want = [(0, 0, None, None)]
    assert rows(m.evaluate(df, measures, where=nothing)) == want
    assert rows(m.reaggregate(m.preaggregate(df, measures, ["k"]), measures, where=nothing)) == want
    dim = spark.createDataFrame([(10, "a"), (20, "b")], "key int, name string")
    model = SemanticModel({"f": df, "d": dim}, [Relationship("f", "d", "d", "key")], measures)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit in (threshold, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            names = [x.name for x in measures]
            assert rows(model.query("f", names, where={"name": F.col("name") == "z"})) == want
            assert rows(model.query("f", names, ["name"])) == [("a", 1, 1, 2.0, 2.0), ("b", 1, 1, 3.0, 3.0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_context_changes_of_compounds(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("b", 1, 6.0)], "g string, k int, v double")
    base = [m.sum_("v", "v"), m.count_rows("n"), m.ratio("mean", "v", "n")]
    nested = m.compound("double", ("mean",), lambda p: p["mean"] * 2)
    changed = [
        m.calculate_filter(base[2], F.col("k") == 1, "first"),
        m.calculate_all(nested, "all"),
        m.calculate_filter(m.calculate_allselected(base[2]), F.col("k") == 1, "first_all"),
        m.calculate_allexcept(base[2], ["g"], "of_g"),
    ]
    shown = [x.name for x in changed]
    got = m.evaluate(df, [*base, nested, *changed], ["g"], {"k": F.col("k") < 3}, show=shown)
    assert rows(got) == [("a", 2.0, 8.0, 4.0, 3.0), ("b", 6.0, 8.0, 4.0, 6.0)]
    items = {"first": lambda x: m.calculate_filter(x, F.col("k") == 1), "now": lambda x: x}
    expanded = m.calc_group_expand([base[2]], items)
    assert rows(m.evaluate(df, [*base, *expanded], ["g"], show=[x.name for x in expanded])) == [("a", 2.0, 3.0), ("b", 6.0, 6.0)]
    with pytest.raises(ValueError):
        m.evaluate(df, [*base, m.calculate_allexcept(base[0], ["g"], "x")], ["g"], F.col("k") < 3)


def test_relationships_per_measure(spark):
    """One dimension over two roles side by side, and a measure that a filter does not reach."""
    fact = spark.createDataFrame([(1, 2, 5.0), (2, 2, 7.0), (3, 1, 1.0)], "a int, b int, v double")
    dim = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, name string")
    links = [Relationship("f", "a", "d", "id", name="by_a"), Relationship("f", "b", "d", "id", active=False, name="by_b")]
    total = m.sum_("total", "v")
    measures = [total, m.use_relationship(total, "by_b", name="over_b"), m.ignore_relationship(total, "by_a", name="whole"), m.ratio("share", "over_b", "whole")]
    model = SemanticModel({"f": fact, "d": dim}, links, measures)
    got = model.query("f", ["total", "over_b", "whole", "share"], ["name"], {"name": F.col("name") != "z"})
    assert rows(got) == [("x", 5.0, 1.0, 13.0, 1 / 13), ("y", 7.0, 12.0, 13.0, 12 / 13)]
    filtered = m.use_relationship(m.ratio("half", "total", "twice"), "by_b", name="half_b")
    model = SemanticModel({"f": fact, "d": dim}, links, [total, m.compound("twice", ("total",), lambda p: p["total"] * 2), filtered])
    assert rows(model.query("f", ["half_b", "total"], ["name"])) == [("x", 0.5, 5.0), ("y", 0.5, 7.0), ("z", None, 1.0)]


FAR = [(g, h, 1e9 + i % 7 + (g == "b") * 1e6) for i, (g, h) in enumerate(("ab"[i % 2], i % 5) for i in range(200))] + [("c", 0, 5.0), ("d", 1, None)]


def test_merged_deviations_equal_direct_ones(spark):
    """A mean far above its spread, and groups far from each other: partial results lose nothing."""
    df = spark.createDataFrame(FAR, "g string, h int, x double")
    measures = [m.variance("v", "x"), m.stddev("s", "x"), m.count_rows("n")]
    partials = m.preaggregate(df, measures, ["g", "h"])

    def want(keep):
        xs = [x for g, h, x in FAR if keep(g, h) and x is not None]
        return statistics.variance([x - 1e9 for x in xs]) if len(xs) > 1 else None

    for out in (m.reaggregate(partials, measures, ["g"]), m.reaggregate(m.merge_partials(partials, measures, ["g", "h"]), measures, ["g"])):
        for r in out.collect():
            expected = want(lambda g, _: g == r.g)
            assert r.v == (None if expected is None else pytest.approx(expected, rel=1e-6))
            assert r.s == (None if expected is None else pytest.approx(expected**0.5, rel=1e-6))
    assert m.reaggregate(partials, measures).first().v == pytest.approx(want(lambda *_: True), rel=1e-6)
    rolled = m.hierarchy_rollup(df, ["g", "h"], measures).collect()
    assert len(rolled) == 1 + 4 + 12
    for r in rolled:
        expected = want(lambda g, h: (r.depth < 1 or g == r.g) and (r.depth < 2 or h == r.h))
        assert r.v == (None if expected is None else pytest.approx(expected, rel=1e-6))


def test_deviations_through_a_large_dimension(spark, monkeypatch):
    """The star reduces a fact to partial deviations before it meets a dimension that is not broadcast."""
    from tabweave.plans import model as model_module

    fact = spark.createDataFrame([(i % 10, 1e9 + i % 4) for i in range(100)], "k int, x double")
    one = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(10)], "k int, g string")
    model = model_module.SemanticModel({"f": fact, "d": one}, [model_module.Relationship("f", "k", "d", "k")], [m.variance("v", "x")], hierarchies={"h": ["g"]})
    plain, drilled = rows(model.query("f", ["v"], ["g"])), rows(model.drill("f", ["v"], "h"))
    monkeypatch.setattr(model_module, "fits_broadcast", lambda df: False)
    for (a, x), (b, y) in zip(plain, rows(model.query("f", ["v"], ["g"])), strict=True):
        assert a == b and x == pytest.approx(y, rel=1e-6)
    for a, b in zip(drilled, rows(model.drill("f", ["v"], "h")), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-6)


def test_percentiles_in_context(spark):
    data = [(g, h, v) for g in "ab" for h in (1, 2) for v in [1, 5, 9, None, 5][: h * 2 + 1]] + [("z", 1, None)]
    df = spark.createDataFrame(data, "g string, h int, v int")
    small = m.calculate_filter(m.median("mid", "v"), F.col("v") < 9, "small")
    measures = [m.median("mid", "v"), small, m.percentile("top", "v", 1), m.count("n", "v"), m.calculate_all(m.median("mid", "v"), "all"), m.ratio("part", "mid", "all")]
    pick = lambda keep, p=0.5: (lambda xs: None if not xs else float(np.quantile(xs, p)))([v for g, h, v in data if v is not None and keep(g, h, v)])
    for by in ([], ["g"], ["g", "h"]):
        for r in m.evaluate(df, measures, by).collect():
            own = lambda g, h, v: all({"g": g, "h": h}[c] == r[c] for c in by)
            assert (r.mid, r.top, r.all) == (pick(own), pick(own, 1), pick(lambda *_: True))
            assert r.small == pick(lambda g, h, v: own(g, h, v) and v < 9)
    limited = m.evaluate(df, measures, ["g"], {"h": F.col("h") == 2})
    assert {(r.g, r.mid, r.all) for r in limited.collect()} == {("a", 5.0, 5.0), ("b", 5.0, 5.0)}
    rolled = {(r.g, r.depth): r.mid for r in m.hierarchy_rollup(df, ["g"], measures).collect()}
    assert rolled[None, 0] == pick(lambda *_: True) and rolled["a", 1] == pick(lambda g, h, v: g == "a")
    with pytest.raises(ValueError):
        m.percentile("p", "v", 1.5)


def test_percentiles_of_one_value_under_filters_are_tallied_once(spark, monkeypatch):
    tallies = []
    placed = positions.running_before

    def watched(df, *args, **kwargs):
        tallies.append(df._jdf.queryExecution().optimizedPlan().toString())
        return placed(df, *args, **kwargs)

    monkeypatch.setattr(positions, "running_before", watched)
    data = [(f"g{i % 3}", None if i % 11 == 0 else float(i * 7 % 40), None if i % 5 == 0 else i % 4) for i in range(200)]
    df = spark.createDataFrame(data, "g string, v double, k int")
    mid = m.median("mid", "v")
    measures = [mid, m.calculate_filter(mid, F.col("k") > 1, "some"), m.calculate_filter(mid, F.col("k") > 9, "none"), m.percentile("p", F.col("k") + 1, 0.3)]
    got = {r.g: tuple(r)[1:] for r in m.evaluate(df, measures, ["g"]).collect()}
    for g in ("g0", "g1", "g2"):
        own = [(v, k) for h, v, k in data if h == g]
        want = np.median([v for v, _ in own if v is not None]), np.median([v for v, k in own if v is not None and k is not None and k > 1])
        assert got[g][:2] == want and got[g][2] is None
        assert got[g][3] == pytest.approx(np.quantile([k + 1 for _, k in own if k is not None], 0.3))
    # One entry for each of the two values, whatever the filters, and no function interpreted per row.
    assert len(tallies) == 1 and "lambda" not in tallies[0]
    assert "__at, 1" in tallies[0] and "__at, 2" not in tallies[0]


def test_percentile_of_a_group_with_most_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2900, "big").otherwise("small").alias("g"), (F.col("id") % 7).alias("v"))
    got = {r.g: r.mid for r in m.evaluate(df, [m.median("mid", "v")], ["g"]).collect()}
    assert got == {g: float(np.median([i % 7 for i in range(3000) if (i < 2900) == (g == "big")])) for g in ("big", "small")}


def test_distinct_sets_merge(spark):
    data = [(d, g, v) for d in range(6) for g in "ab" for v in range(d, d + 4)] + [(0, "c", None)]
    df = spark.createDataFrame(data, "d int, g string, v int")
    codes = bitmaps.dictionary(df, "v")
    assert sorted(r.code for r in codes.collect()) == list(range(1, 10))
    more = bitmaps.extended(codes, spark.createDataFrame([(3,), (50,), (40,), (None,)], "v int"), "v")
    assert rows(more) == [(40, 10), (50, 11)]
    measures = [m.distinct_count("kinds", "v"), m.count_rows("n"), m.calculate_filter(m.distinct_count("few", "v"), F.col("v") < 5), m.ratio("each", "n", "kinds")]
    partials = m.preaggregate(df, measures, ["d", "g"], codes={"kinds": codes, "few": codes})
    for by in ([], ["g"], ["d"]):
        want = rows(m.evaluate(df, measures, by))
        assert rows(m.reaggregate(partials, measures, by)) == want
        twice = m.merge_partials(m.merge_partials(partials, measures, ["d", "g"]), measures, by)
        assert rows(m.reaggregate(twice, measures, by)) == want
    with pytest.raises(Exception, match="not in the dictionary"):
        m.preaggregate(df, measures, ["g"], codes={"kinds": codes.where("code > 1"), "few": codes}).collect()


def test_sets_over_several_buckets(spark):
    df = spark.range(70_000).select((F.col("id") % 3).alias("g"), "id")
    codes = df.select(F.col("id").alias("value"), (F.col("id") + 1).alias("code"))
    measures = [m.distinct_count("kinds", "id")]
    partials = m.preaggregate(df, measures, ["g"], codes={"kinds": codes})
    assert partials.where("__bucket IS NOT NULL").select("__bucket").distinct().count() == 3
    assert m.reaggregate(partials, measures).first().kinds == 70_000


def test_metrics_of_several_facts(spark):
    orders = spark.createDataFrame([(1, 10, 5), (2, 10, 7), (3, 11, 1), (4, None, 2)], "o int, c int, amount int")
    lines = spark.createDataFrame([(1, 2), (1, 3), (2, 9), (9, 4)], "o int, qty int")
    targets = spark.createDataFrame([("x", 100), ("z", 50)], "g string, goal int")
    customers = spark.createDataFrame([(10, "x"), (11, "y")], "c int, g string")
    links = [Relationship("lines", "o", "orders", "o"), Relationship("orders", "c", "customers", "c")]
    measures = [m.sum_("amount", "amount"), m.count_rows("orders"), m.sum_("qty", "qty"), m.count_rows("lines"), m.ratio("per_line", "amount", "lines"), m.sum_("goal", "goal")]
    model = SemanticModel({"orders": orders, "lines": lines, "customers": customers, "targets": targets}, links, measures)
    facts = {"orders": ["amount", "orders"], "lines": ["qty", "lines"]}
    out = model.query_facts(facts, ["customers.g"], across=["per_line"])
    assert rows(out) == [(None, 2, 1, 4, 1, 2.0), ("x", 12, 2, 14, 3, 4.0), ("y", 1, 1, None, 0, None)]
    assert rows(model.query_facts(facts)) == [(15, 4, 18, 4)]
    limited = model.query_facts(facts, ["customers.g"], {"customers.g": lambda c: c == "x"})
    assert rows(limited) == [("x", 12, 2, 14, 3)]
    with pytest.raises(ValueError, match="grain"):
        model.query_facts({"orders": ["amount"], "targets": ["goal"]}, ["customers.g"])
    with pytest.raises(ValueError, match="several facts"):
        model.query_facts({"orders": ["amount"], "lines": ["amount"]})


def test_names_that_tables_share(spark, monkeypatch):
    from tabweave.plans import model as model_module

    tables = {
        "sales": spark.createDataFrame([(1, 4), (2, 6), (2, 1)], "parent int, key int"),
        "shop": spark.createDataFrame([(1, "s1", 7), (2, "s2", 8)], "key int, name string, parent int"),
        "city": spark.createDataFrame([(7, "c7"), (8, "c8")], "key int, name string"),
    }
    links = [Relationship("sales", "parent", "shop", "key"), Relationship("shop", "parent", "city", "key")]
    model = SemanticModel(tables, links, [m.sum_("total", "key"), m.count_rows("n")], {"r": Role(hidden_columns={"shop": ("name",)})})
    want = [("c7", "s1", 4, 1), ("c8", "s2", 7, 2)]
    for small in (True, False):
        monkeypatch.setattr(model_module, "fits_broadcast", lambda df: small)
        out = model.query("sales", ["total", "n"], ["city.name", "shop.name"])
        assert out.columns == ["city__name", "shop__name", "total", "n"] and rows(out) == want
        assert rows(model.query("sales", ["n"], ["city.name"], {"shop.name": lambda c: c == "s2"})) == [("c8", 2)]
    with pytest.raises(ValueError, match="table.column"):
        model.query("sales", ["n"], ["name"])
    with pytest.raises(PermissionError):
        model.query("sales", ["n"], ["shop.name"], role="r")
    assert rows(model.query("sales", ["n"], ["city.name"], role="r")) == [("c7", 1), ("c8", 2)]


def test_bridge_counts_a_fact_once_per_group(spark):
    facts = spark.createDataFrame([(1, 10), (1, 5), (2, 7), (3, 100), (None, 1)], "account int, amount int")
    bridge = spark.createDataFrame([(1, "ann"), (1, "bob"), (1, "cy"), (2, "bob"), (2, "bob"), (4, "dee"), (None, "ann")], "account int, person string")
    people = spark.createDataFrame([("ann", "x"), ("bob", "y"), ("cy", "x"), ("dee", "z")], "person string, team string")
    measures = [m.sum_("total", "amount"), m.count_rows("n"), m.ratio("mean", "total", "n")]
    out = m.bridge_measures(facts, bridge, people, "account", "person", measures, ["team"])
    assert rows(out, "team") == [(None, True, 22, 3, 22 / 3), ("x", False, 15, 2, 7.5), ("y", False, 22, 3, 22 / 3)]


def test_measures_at_every_node(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(2000)], "node int, parent int")
    facts = spark.range(2000).select(F.col("id").cast("int").alias("node"), F.lit(1).alias("v"))
    got = m.parent_child_rollup(facts, chain, "node", "parent", [m.sum_("total", "v"), m.maximum("top", "node")]).collect()
    assert all((r.total, r.top) == (2000 - r.node, 1999) for r in got) and len(got) == 2000
    star = spark.createDataFrame([(0, None), (5000, 0), *((i, 0) for i in range(1, 3000))], "node int, parent int")
    hanging = spark.createDataFrame([(1, 5), (1, None), (0, 2), (77777, 9)], "at int, v int")
    got = {r.node: r for r in m.parent_child_rollup(hanging, star, "node", "parent", [m.sum_("total", "v"), m.count_rows("n"), m.variance("s", "v")], "at").collect()}
    assert (got[0].total, got[0].n, got[0].s) == (7, 3, 4.5) and (got[1].total, got[1].n) == (5, 2)
    assert (got[5000].total, got[5000].n) == (None, 0)
    with pytest.raises(ValueError, match="cycle"):
        m.parent_child_rollup(facts, spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "node int, parent int"), "node", "parent", [m.count_rows("n")])
    with pytest.raises(ValueError, match="unknown parent"):
        m.parent_child_rollup(facts, spark.createDataFrame([(1, 2)], "node int, parent int"), "node", "parent", [m.count_rows("n")])
