import datetime as dt
import random

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.operators import cdc
from tabweave.plans import measures as m
from tabweave.streaming import feeds

DDL = "id int, v string"
CHANGE_DDL = f"{DDL}, _action string, _is_update boolean, _seq bigint"


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.dictionaries(st.integers(0, 15), st.sampled_from(["a", "b", None]), max_size=12),
    st.dictionaries(st.integers(0, 15), st.sampled_from(["a", "b", None]), max_size=12),
)
def test_diff_then_merge_gives_the_new_snapshot(spark, before, after):
    old, new = (spark.createDataFrame(list(d.items()), DDL) for d in (before, after))
    diff = cdc.cdc_diff(old, new, ["id"])
    counts = cdc.cdc_counts(diff).first()
    assert counts["inserts"] == len(after.keys() - before.keys())
    assert counts["deletes"] == len(before.keys() - after.keys())
    assert counts["updates"] == sum(before[k] != after[k] for k in before.keys() & after.keys())
    net = cdc.cdc_net_changes(diff.withColumn("_seq", F.lit(1)), ["id"])
    assert rows(cdc.cdc_merge(old, net, ["id"])) == sorted(
        after.items(), key=lambda r: [(x is not None, x) for x in r]
    )
    inserts, updates, deletes = cdc.cdc_split(diff)
    applied = cdc.cdc_apply_delete(cdc.cdc_apply_update(cdc.cdc_apply_insert(old, inserts, ["id"]), updates, ["id"]), deletes, ["id"])
    assert sorted(rows(applied), key=str) == sorted(after.items(), key=str)


def test_net_changes(spark):
    changes = spark.createDataFrame(
        [
            (1, "new", "INSERT", False, 1),
            (1, "old", "DELETE", True, 2),
            (1, "newer", "INSERT", True, 2),
            (2, "x", "INSERT", False, 1),
            (2, "x", "DELETE", False, 5),
            (3, "was", "DELETE", False, 1),
            (3, "back", "INSERT", False, 2),
            (4, "gone", "DELETE", False, 1),
            (5, "b", "DELETE", True, 1),
            (5, "a", "INSERT", True, 1),
        ],
        CHANGE_DDL,
    )
    net = {r["id"]: (r["v"], r["_action"], r["_is_update"]) for r in cdc.cdc_net_changes(changes, ["id"]).collect()}
    # 2 came and went inside the window; 3 was known before it.
    assert net == {
        1: ("newer", "INSERT", False),
        3: ("back", "INSERT", True),
        4: ("gone", "DELETE", False),
        5: ("a", "INSERT", True),
    }


def test_updates_need_a_target_row_and_inserts_a_new_key(spark):
    target = spark.createDataFrame([(1, "a")], DDL)
    other = spark.createDataFrame([(1, "x"), (2, "y")], DDL)
    assert rows(cdc.cdc_apply_update(target, other, ["id"])) == [(1, "x")]
    assert rows(cdc.cdc_apply_insert(target, other, ["id"])) == [(1, "a"), (2, "y")]
    assert [r["_action"] for r in cdc.initial_rows(target).collect()] == ["INSERT"]


def test_watermark_and_state(spark):
    ddl = "table_name string, last_processed timestamp_ntz, stream_offset string, status string"
    empty = spark.createDataFrame([], ddl)
    df = spark.createDataFrame([(1, dt.datetime(2001, 1, 1)), (2, dt.datetime(2001, 1, 2)), (3, None)], "id int, at timestamp_ntz")
    assert cdc.watermark_extract(df, "at", empty).count() == 3
    state = cdc.mark_state(empty, "t", "running", last_processed=dt.datetime(2001, 1, 1))
    assert rows(cdc.watermark_extract(df, "at", state).select("id")) == [(2,)]
    idle = cdc.mark_state(state, "t", "idle")
    assert rows(idle) == [("t", dt.datetime(2001, 1, 1), None, "idle")]


# -- streams -------------------------------------------------------------


def feed_of(spark, path, *batches):
    """One file per batch; the stream takes them one at a time."""
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, CHANGE_DDL).coalesce(1).write.mode("append").parquet(path)
    return feeds.file_feed(spark, path, T.StructType.fromDDL(CHANGE_DDL), max_files=1)


BATCHES = (
    [(1, "a", "INSERT", False, 1), (2, "b", "INSERT", False, 2)],
    [(1, "a", "DELETE", True, 3), (1, "c", "INSERT", True, 3), (2, "b", "DELETE", False, 4)],
    [(3, "d", "INSERT", False, 5)],
)


def test_change_table_streams(spark, tmp_path):
    feed = feed_of(spark, str(tmp_path / "in"), *BATCHES)
    target = feeds.ChangeTable(spark, str(tmp_path / "ck"), ["id"], T.StructType.fromDDL(DDL))
    assert target.current().count() == 0
    changed = []
    query = feeds.stream_cdc_foreach_batch(feed, target, lambda df, i: changed.append(df.count()), feeds.AVAILABLE_NOW)
    query.awaitTermination()
    assert rows(target.current()) == [(1, "c"), (3, "d")]
    assert sum(changed) == 5
    log = [(r["inserts"], r["updates"], r["deletes"]) for r in feeds.batch_counts(query).collect()]
    assert sum(i for i, _, _ in log) == 3 and sum(d for _, _, d in log) == 1 and sum(u for _, u, _ in log) == 1


def test_any_order_of_batches_gives_one_table(spark, tmp_path):
    """Late, repeated and shuffled batches, tombstones included; a later start goes on from the state."""
    batches = [*BATCHES, [(2, "late", "INSERT", True, 3), (4, "e", "INSERT", False, 6)], [(3, "gone", "DELETE", False, 7)], BATCHES[0]]
    schema = T.StructType.fromDDL(DDL)
    for n, order in enumerate([range(6), reversed(range(6)), (3, 4, 0, 5, 2, 1)]):
        target = feeds.ChangeTable(spark, str(tmp_path / f"ck{n}"), ["id"], schema)
        order = [batches[i] for i in order]
        for part in (order[:3], order[3:]):
            feed = feed_of(spark, str(tmp_path / f"in{n}"), *part)
            feeds.stream_cdc_foreach_batch(feed, target, trigger=feeds.AVAILABLE_NOW).awaitTermination()
        assert rows(target.current()) == [(1, "c"), (4, "e")]


def test_change_table_with_maps(spark, tmp_path):
    ddl = "id int, props map<string,int>"
    batch = spark.createDataFrame([(1, {"a": 1}, "INSERT", False, 1), (1, {"a": 2}, "INSERT", True, 2)], f"{ddl}, _action string, _is_update boolean, _seq bigint")
    batch.write.parquet(str(tmp_path / "in"))
    target = feeds.ChangeTable(spark, str(tmp_path / "ck"), ["id"], T.StructType.fromDDL(ddl))
    feeds.stream_cdc_foreach_batch(feeds.file_feed(spark, str(tmp_path / "in"), batch.schema), target, trigger=feeds.AVAILABLE_NOW).awaitTermination()
    assert [r["props"] for r in target.current().collect()] == [{"a": 2}]


def test_append_takes_inserts_once(spark, tmp_path):
    path, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    feeds.stream_append(feed_of(spark, path, *BATCHES), out, ck, feeds.AVAILABLE_NOW).awaitTermination()
    assert spark.read.parquet(out).count() == 4
    more = feed_of(spark, path, [(8, "n", "INSERT", False, 9)])
    feeds.stream_append(more, out, ck, feeds.AVAILABLE_NOW).awaitTermination()
    assert spark.read.parquet(out).count() == 5


def test_incremental_aggregate(spark, tmp_path):
    path = str(tmp_path / "in")
    measures = [m.count_rows("n"), m.average("mean", "id"), m.maximum("last", "_seq"), m.sum_("total", F.col("_seq").cast("decimal(12,2)"))]
    summary = feeds.IncrementalAggregate(spark, str(tmp_path / "ck"), measures, ["v"])
    with pytest.raises(ValueError):
        summary.result()
    with pytest.raises(ValueError):
        feeds.IncrementalAggregate(spark, str(tmp_path / "no"), [m.variance("spread", "id")], [])
    live = [[(i, v, "INSERT", u, s) for i, v, _, u, s in b] for b in BATCHES]
    for _ in range(2):  # the second start finds nothing new
        feed = feed_of(spark, path, *live)
        live = []
        summary.start(feed, feeds.AVAILABLE_NOW).awaitTermination()
        assert rows(summary.result()) == rows(m.evaluate(spark.read.parquet(path), measures, ["v"]))
    assert summary.result([]).first()["n"] == 6
    with pytest.raises(ValueError):
        m.preaggregate(spark.read.parquet(path), [m.distinct_count("d", "id")], [])


def test_aggregate_follows_updates_and_deletes(spark, tmp_path):
    """After every batch the result is that of the table from scratch: also when a group loses an extreme or all rows."""
    rng = random.Random(9)
    schema = "id int, g string, x int, d date, _action string"
    fold = [m.count_rows("n"), m.sum_("total", "x"), m.count("filled", "x"), m.minimum("low", "x"), m.maximum("day", "d"), m.distinct_count("kinds", "x")]
    fold += [m.ratio("mean", "total", "filled"), m.calculate_filter(m.sum_("big", "x"), F.col("x") > 3), m.selected_value("only", "x", -1)]
    summary = feeds.IncrementalAggregate(spark, str(tmp_path / "ck"), fold, ["g"])
    table = {}
    for _ in range(4):
        batch = []
        for _ in range(25):
            i = rng.randrange(12)
            if i in table:
                batch.append((*table.pop(i), "DELETE"))
            if rng.random() < 0.6:
                table[i] = (i, rng.choice(["a", "b", None]), rng.choice([None, *range(7)]), dt.date(2001, 1, rng.randint(1, 9)))
                batch.append((*table[i], "INSERT"))
        rng.shuffle(batch)
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        feed = feeds.file_feed(spark, str(tmp_path / "in"), schema)
        summary.start(feed, feeds.AVAILABLE_NOW).awaitTermination()
        now = spark.createDataFrame(list(table.values()), "id int, g string, x int, d date")
        assert rows(summary.result()) == rows(m.evaluate(now, fold, ["g"]))
        assert rows(summary.result([])) == rows(m.evaluate(now, fold))


def test_multi_target(spark, tmp_path):
    targets = {"live": lambda df: df.where("_action = 'INSERT'"), "dead": lambda df: df.where("_action = 'DELETE'")}
    root = str(tmp_path / "out")
    feed = feed_of(spark, str(tmp_path / "in"), *BATCHES)
    feeds.stream_multi_target(feed, targets, root, str(tmp_path / "ck"), feeds.AVAILABLE_NOW).awaitTermination()
    assert spark.read.parquet(f"{root}/live").count() == 4
    assert spark.read.parquet(f"{root}/dead").count() == 2


def test_auto_ingest_loads_each_file_once(spark, tmp_path):
    inbox, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    (inbox / "deep").mkdir(parents=True)
    (inbox / "a.csv").write_text("1,x\n2,y\n")
    (inbox / "deep" / "b.csv").write_text("3,z\n")
    (inbox / "note.txt").write_text("9,no\n")

    def load():
        feeds.auto_ingest(spark, str(inbox), "id int, v string", out, ck, feeds.AVAILABLE_NOW).awaitTermination()
        return rows(spark.read.parquet(out).select("id", "file_name"))

    assert load() == [(1, "a.csv"), (2, "a.csv"), (3, "b.csv")]
    (inbox / "c.csv").write_text("4,w\n")
    assert load() == [(1, "a.csv"), (2, "a.csv"), (3, "b.csv"), (4, "c.csv")]


def test_lag():
    assert feeds.lag_trigger("hourly") == {"processingTime": "1 hour"}
