import itertools
import random

import pytest
from conftest import day, rows
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tabweave.operators import joins as j
from tabweave.operators import positions as p
from tabweave.operators import transforms as t


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (4, "e")], "k int, x string")


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame([(2, "p", 2), (2, "q", 1), (3, "r", 1), (None, "s", 1)], "k int, y string, id int")


@pytest.mark.parametrize("how", ["inner", "left", "full"])
def test_merge_join(left, right, how):
    ref = right.select(F.col("k").alias("rk"), "y")
    got = rows(j.merge_join(left, ref, {"k": "rk"}, how).select("k", "x", "y"))
    expected = rows(
        left.join(ref, left.k == ref.rk, how).select(F.coalesce("k", "rk").alias("k"), "x", "y")
    )
    assert got == expected


def test_merge_join_rejects_other_types(left, right):
    with pytest.raises(ValueError):
        j.merge_join(left, right, "k", "cross")


def test_lookup_keeps_unmatched(left, right):
    one = right.where("y in ('p', 'r')").select("k", "y")
    assert rows(j.lookup_join(left, one, "k")) == [(None, "d", None), (1, "a", None), (2, "b", "p"), (2, "c", "p"), (4, "e", None)]
    defaulted = j.lookup_default(left, one, "k", {"y": "none"})
    assert {r["x"]: r["y"] for r in defaulted.collect()} == {"a": "none", "b": "p", "c": "p", "d": "none", "e": "none"}


def test_first_match_is_by_order_with_nulls_last(spark, left):
    ref = spark.createDataFrame([(2, "p", None), (2, "q", 7), (2, "r", 3), (4, "z", None)], "k int, y string, id int")
    got = {r["x"]: r["y"] for r in j.lookup_first_match(left, ref, "k", ["id"]).collect()}
    assert got == {"a": None, "b": "r", "c": "r", "d": None, "e": "z"}
    assert rows(j.first_per_key(ref, ["k"], ["id"], latest=True)) == [(2, "q", 7), (4, "z", None)]


def test_first_per_key_breaks_ties_the_same_way(spark):
    data = [(1, 5, v) for v in "zxyw"]
    picks = {
        rows(j.first_per_key(spark.createDataFrame(order, "k int, o int, v string"), ["k"], ["o"]))[0]
        for order in itertools.islice(itertools.permutations(data), 0, 24, 5)
    }
    assert picks == {(1, 5, "w")}


def test_semi_anti_natural_bridge(left, right):
    assert [r[1] for r in rows(j.semi_join(left, right, "k"))] == ["b", "c"]
    assert [r[1] for r in rows(j.anti_join(left, right, "k"))] == ["d", "a", "e"]
    assert j.natural_join(left, right.select("k", "y")).count() == 4
    assert j.bridge_filter(left, right, "k").count() == 2
    with pytest.raises(ValueError):
        j.natural_join(left, right.select("y"))


def test_null_safe_join_matches_nulls(left):
    one = left.select("k").distinct().withColumn("z", F.lit(1))
    assert j.null_safe_join(left, one, ["k"]).count() == 5


def test_prefix_join_is_text_on_both_sides(spark):
    codes = spark.createDataFrame([(35209, "x"), (123456, "long")], "prefix int, maker string")
    df = spark.createDataFrame([("352099001",), ("INVALID_IMEI_XX",), ("123456789",), (None,)], "imei string")
    got = {r["imei"]: r["maker"] for r in j.prefix_join(df, codes, "imei", "prefix", 5).collect()}
    assert got == {"352099001": "x", "INVALID_IMEI_XX": None, "123456789": None, None: None}


def test_related_table_keeps_empty_parents(spark, left):
    one = spark.createDataFrame([(1,), (2,), (9,)], "id int")
    out = j.related_table(one, left, {"id": "k"}, n=F.count(F.lit(1)), last=F.max("x"))
    assert rows(out) == [(1, 1, "a"), (2, 2, "c"), (9, None, None)]


EMPLOYEES = [(1, None, "ann"), (2, 1, "bob"), (3, 1, "cy"), (4, 3, "di"), (7, 8, "x"), (8, 7, "y")]


def test_hierarchy(spark):
    df = spark.createDataFrame(EMPLOYEES, "employee_id int, manager_id int, name string")
    out = {r["name"]: (r["depth"], r["path"]) for r in j.hierarchy_expand(df, "employee_id", "manager_id", "name").collect()}
    # x and y manage each other: no root leads to them.
    assert out == {"ann": (0, "ann"), "bob": (1, "ann > bob"), "cy": (1, "ann > cy"), "di": (2, "ann > cy > di")}
    chain = spark.range(300).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("up"), F.lit("n").alias("name"))
    assert j.hierarchy_expand(chain, "id", "up", "name").agg(F.count("*"), F.max("depth"), F.max(F.length("path"))).first()[:] == (300, 299, 300 + 299 * 3)
    assert j.hierarchy_expand(df.where("1 = 0"), "employee_id", "manager_id", "name").count() == 0


# -- positions -----------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    """One value and one group hold more than half of the rows."""
    rng = random.Random(5)
    data = [("hot" if i % 5 else "cold", 7.0 if i % 3 else float(rng.randint(0, 40)), i) for i in range(3000)]
    data += [(None, None, -1), ("cold", None, -2)]
    return data, spark.createDataFrame(data, "g string, v double, id int").repartition(7)


def test_rank_equals_window_rank(skewed):
    data, df = skewed
    got = {r["id"]: r["rank"] for r in p.rank_by(df, "v", ["g"]).collect()}

    def rank(row, pool):
        value = row[1]
        return 1 + sum(1 for o in pool if o[1] is not None and (value is None or o[1] > value))

    for group in ("hot", "cold", None):
        pool = [r for r in data if r[0] == group]
        ranks = {}
        for r in pool:
            if r[1] not in ranks:
                ranks[r[1]] = rank(r, pool)
            assert got[r[2]] == ranks[r[1]]
    ascending = {r["id"]: r["rank"] for r in p.rank_by(df, "v", descending=False).collect()}
    low = min(r[1] for r in data if r[1] is not None)
    assert all(ascending[r[2]] == 1 for r in data if r[1] == low)


def test_row_numbers_are_dense_and_ordered(skewed):
    data, df = skewed
    out = p.number_rows(df, ["id"], start=100).select("id", "row_number").collect()
    numbers = {r[0]: r[1] for r in out}
    assert [numbers[i] for i in sorted(numbers)] == list(range(100, 100 + len(data)))


def test_percentiles_are_exact(skewed):
    data, df = skewed
    out = {r["g"]: r for r in p.exact_percentiles(df, "v", {"p0": 0.0, "median": 0.5, "p90": 0.9}, ["g"]).collect()}

    def at(values, fraction):
        spot = fraction * (len(values) - 1)
        low = int(spot)
        high = min(low + 1, len(values) - 1)
        return values[low] + (values[high] - values[low]) * (spot - low)

    for group in ("hot", "cold"):
        values = sorted(r[1] for r in data if r[0] == group and r[1] is not None)
        for name, fraction in (("p0", 0.0), ("median", 0.5), ("p90", 0.9)):
            assert out[group][name] == pytest.approx(at(values, fraction))
    whole = sorted(r[1] for r in data if r[1] is not None)
    assert p.exact_percentiles(df, "v", {"m": 0.25}).first()["m"] == pytest.approx(at(whole, 0.25))


def test_last_row_filter_and_surrogate_key(skewed):
    data, df = skewed
    kept = t.last_row_filter(df, ["id"], 10).select("id").collect()
    assert sorted(r[0] for r in kept) == sorted(r[2] for r in data)[:10]
    target = df.select(F.lit(41).alias("key"))
    keys = t.surrogate_key(df, ["id"], t.next_key(target, "key"))
    assert keys.agg(F.min("id"), F.max("id")).first() == (42, 41 + len(data))
    assert t.surrogate_key(df, ["id"], t.next_key(target.where("1 = 0"), "key"), "n").agg(F.min("n")).first()[0] == 1


# -- transforms ----------------------------------------------------------


def test_split_partitions_the_input(left):
    routes = [("small", F.col("k") < 3), ("b", F.col("x") == "b")]
    parts = t.conditional_split(left, routes, "rest")
    assert {n: sorted(r["x"] for r in df.collect()) for n, df in parts.items()} == {
        "small": ["a", "b", "c"],
        "b": [],
        "rest": ["d", "e"],
    }


def test_row_count_needs_no_second_pass(left, tmp_path):
    seen = Observation()
    t.row_count(left, seen, "n").write.parquet(str(tmp_path / "out"))
    assert seen.get["n"] == 5


def test_conversion_and_nulls(spark):
    df = spark.createDataFrame([("12", " ", "0001-01-01"), ("1e3", "x ", "2001-01-01"), ("n/a", "", None)], "a string, b string, d string")
    assert [r[0] for r in t.safe_conversion(df, {"a": "double"}).collect()] == [12.0, 1000.0, None]
    assert [r[0] for r in t.safe_conversion(df, {"a": "int"}).select("a").collect()] == [12, None, None]
    assert [r["b"] for r in t.empty_to_null(df, "b").collect()] == [None, "x", None]
    dated = t.data_conversion(df, {"d": "date"})
    assert [r["d"] for r in t.zero_datetime_to_null(dated, "d", ["0001-01-01"]).collect()] == [None, day("2001-01-01"), None]


def test_model_types(spark):
    assert t.spark_type("Currency") == "decimal(19,4)" and t.spark_type("unheard of") == "string"
    spark.range(1).select(*[F.lit(None).cast(k).alias(n) for n, k in t.MODEL_TYPES.items()]).collect()


def test_calculated_and_alias_columns(left):
    out = t.calculated_column(left, {"twice": F.col("k") * 2, "todo": "datetime"})
    assert dict(out.dtypes)["todo"] == "timestamp_ntz" and out.where("todo is not null").isEmpty()
    assert t.alias_view(left, {"K": "Key", "missing": "Gone"}).columns == ["Key"]


def test_literals_bind_one_row_only(left):
    bound = t.literal_columns(left, {"job": "x"}, left.agg(F.max("k").alias("top")))
    assert {(r["job"], r["top"]) for r in bound.collect()} == {("x", 4)}
    with pytest.raises(Exception):
        t.literal_columns(left, {}, left.select("k")).collect()


def test_set_operations(spark, left):
    hot = spark.createDataFrame([(2, "new")], "k int, x string")
    assert rows(t.multi_source_union(hot, left.where("k is not null"), "k")) == [(1, "a"), (2, "new"), (4, "e")]
    assert t.multi_source_union(hot, left).count() == 6
    names = [spark.createDataFrame([(n,) for n in side], "name string") for side in (["A", "b", "c"], ["a", "C", "D"])]
    assert rows(t.name_set_difference(*names, "name")) == [("B", "left"), ("D", "right")]
    assert [r["x"] for r in t.top_n(left, "k", 2, ["x"]).collect()] == ["e", "b"]
    assert [r["x"] for r in t.merge_sorted(left, hot, order_by=["x"]).collect()] == ["a", "b", "c", "d", "e", "new"]
    assert t.multicast(left, 3) == (left, left, left)
    assert [r[0] for r in t.sort_by_column(left.where("k is not null"), "x", "k").collect()] == ["a", "b", "c", "e"]
