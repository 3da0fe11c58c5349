import random

import pytest
from conftest import rows
from pyspark.errors import AnalysisException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tabweave.operators import catalog as c
from tabweave.operators import quality as q
from tabweave.operators import security as sec
from tabweave.plans.measures import sum_
from tabweave.plans.model import Relationship, Role, SemanticModel
from tabweave.session import scratch_dir


def test_required_tables(spark):
    full, empty = spark.range(1), spark.range(0)
    out = q.validate_required_tables(spark, {"a": full, "b": empty, "c": "no_such_table"}, {"d": empty})
    assert {r["check"]: (r["actual"], r["status"]) for r in out.collect()} == {
        "a": ("rows", "SUCCESS"),
        "b": ("empty", "FAILED"),
        "c": ("missing", "FAILED"),
        "d": ("empty", "WARNING"),
    }
    with pytest.raises(q.ValidationError) as error:
        q.validate_required_tables(spark, {"b": empty}, strict=True, code=-20005)
    assert error.value.code == -20005
    with pytest.raises(ValueError):
        q.ValidationError(5, "x")


def test_audit(spark):
    seen = Observation()
    df = spark.range(10).observe(seen, F.count(F.lit(1)).alias("rows_extracted"))
    df.write.format("noop").mode("overwrite").save()
    first = q.audit_record(spark, 1, 2, "f.csv", seen)
    second = q.audit_record(spark, 2, 2, None, {"rows_rejected": 3}, success=False)
    log = first.unionByName(second)
    assert rows(log)[0] == (1, 2, "f.csv", 10, 0, 0, "Y")
    checks = q.audit_check(log, F.col("successful") == "Y", ["id", "file_name"])
    assert {r["check"]: (r["actual"], r["status"]) for r in checks.collect()} == {
        "unsuccessful_runs": (1, "FAIL"),
        "null_id": (0, "PASS"),
        "null_file_name": (1, "FAIL"),
    }


def test_reconcile(spark):
    a = spark.createDataFrame([("x",), ("x",), (None,)], "t string")
    b = spark.createDataFrame([("x",), ("y",), (None,)], "t string")
    assert rows(q.row_count_reconcile(a, b, "t")) == [(None, 1, 1, "PASS"), ("x", 2, 1, "FAIL"), ("y", 0, 1, "FAIL")]
    left = spark.createDataFrame([("x", 1.0), ("y", 2.0), (None, None)], "k string, v double")
    right = spark.createDataFrame([("x", 1.05), ("z", 3.0), (None, None)], "k string, v double")
    assert rows(q.measure_parity(left, right, ["k"], "v", 0.1)) == [
        (None, None, None, "PASS"),
        ("x", 1.0, 1.05, "PASS"),
        ("y", 2.0, None, "FAIL"),
        ("z", None, 3.0, "FAIL"),
    ]


def test_column_reconcile(spark):
    model = spark.createDataFrame([("t", "Amount"), ("t", "Old Name"), ("u", "Key")], "tbl string, name string")
    physical = spark.createDataFrame([("t", "AMOUNT"), ("t", "LOAD_TS"), ("u", "KEY")], "tbl string, name string")
    out = q.column_reconcile(model, physical, "name", ["tbl"])
    assert rows(out.select("tbl", "status", "model_name", "physical_name")) == [
        ("t", "extra", None, "LOAD_TS"),
        ("t", "mapped", "Amount", "AMOUNT"),
        ("t", "missing", "Old Name", None),
        ("u", "mapped", "Key", "KEY"),
    ]


def test_profiles(spark):
    df = spark.createDataFrame(
        [("490154203237518", "35209", "2001-01-31", "true", None), ("INVALID_IMEI_XX", "0123", "2001-02-30", "FALSE", None)],
        "imei string, code string, d string, b string, e string",
    )
    widths = {r["column_name"]: (r["max_length"], r["status"]) for r in q.max_length_profile(df, {"imei": 14, "code": 5, "e": 1}).collect()}
    assert widths == {"imei": (15, "FAIL"), "code": (5, "PASS"), "e": (None, "PASS")}
    declare = {r["column_name"]: r["declare"] for r in q.type_safety_profile(df, df.columns).collect()}
    assert declare == {"imei": "string", "code": "string", "d": "string", "b": "boolean", "e": "string"}


def test_security(spark):
    df = spark.createDataFrame([("N", 1, "secret"), ("S", 2, "x"), (None, 3, None)], "region string, id int, note string")
    users = spark.createDataFrame([("ann", "N"), ("ann", "N"), ("bob", "S")], "username string, region string")
    admins = spark.createDataFrame([("root",)], "username string")
    assert rows(sec.rls_direct(df, "region", "S").select("id")) == [(2,)]
    assert rows(sec.rls_mapping(df, "region", users, "ann").select("id")) == [(1,)]
    assert sec.rls_mapping(df, "region", users, "eve").count() == 0
    assert sec.rls_admin_bypass(df, "region", users, admins, "root").count() == 3
    assert sec.rls_admin_bypass(df, "region", users, admins, "bob").count() == 1
    assert sec.rls_direct(df, "region").count() == 0  # the session user names no region
    assert sec.ols_column_omit(df, ["note"]).columns == ["region", "id"]
    masked = sec.column_mask(df, ["note"], F.col("region") == "N")
    assert masked.count() == df.count()
    assert {r["id"]: r["note"] for r in masked.collect()} == {1: "***", 2: "x", 3: None}
    assert {r["note"] for r in sec.column_mask(df, ["note"], True, None).collect()} == {None}
    assert {r["id"] for r in sec.column_mask(df, ["id"], False).collect()} == {"1", "2", "3"}


ELEMENTS = [
    ("p1", "Data Flow", "Lookup", "Success", 0),
    ("p1", "Control Flow", "Task", "Partial", 2),
    ("p1", "Data Flow", "Script", "NotSupported", 1),
    ("p1", "Data Flow", "Note", "N/A", 0),
    ("p2", "Data Flow", "Source", "Success", 0),
    ("p3", "Control Flow", "Execute", "N/A", 9),
]


@pytest.fixture(scope="module")
def elements(spark):
    return spark.createDataFrame(ELEMENTS, "file string, category string, subtype string, status string, issues int")


def test_scorecard(elements):
    names = {"success": "Success", "na": "N/A"}
    out = c.status_scorecard(elements, "file", "status", names)
    assert rows(out) == [("p1", 4, 1, 1, 6.5, 50.0), ("p2", 1, 1, 0, 0.5, 100.0), ("p3", 1, 0, 1, 0.0, 0.0)]
    assert rows(c.status_scorecard(elements, None, "status", names)) == [(6, 2, 2, 7.0, 62.5)]


def test_classify_and_tier(elements):
    data, control = F.col("category") == "Data Flow", F.col("category") == "Control Flow"
    rules = [("Orchestration", [F.col("subtype") == "Execute"]), ("Hybrid", [data, control]), ("Transformation", [data])]
    assert rows(c.presence_classify(elements, "file", rules, "Control Flow")) == [
        ("p1", "Hybrid"),
        ("p2", "Transformation"),
        ("p3", "Orchestration"),
    ]
    metrics = {
        "not_supported": F.count_if(F.col("status") == "NotSupported"),
        "drivers": F.count_if(F.col("subtype") == "Script"),
        "issues": F.sum("issues"),
    }
    tiers = c.threshold_tier(elements, "file", metrics, c.COMPLEXITY_TIERS)
    assert rows(tiers.select("file", "tier")) == [("p1", "Medium"), ("p2", "Low"), ("p3", "High")]


def test_issue_rollup_keeps_groups_without_issues(spark, elements):
    issues = spark.createDataFrame([("p1", "E-1"), ("p1", "F-1"), ("p1", "E-2"), ("zz", "E-9")], "file string, code string")
    out = c.issue_rollup(elements, issues, "file", "code", {"errors": "E-", "facts": "F-"})
    assert rows(out) == [("p1", 2, 1), ("p2", 0, 0), ("p3", 0, 0)]


def test_dimension_roles(spark):
    relations = spark.createDataFrame([("sales", "product"), ("product", "maker"), ("sales", "date")], "from_table string, to_table string")
    assert rows(c.dimension_role_classify(relations)) == [("date", True), ("maker", True), ("product", False), ("sales", False)]


def test_dependencies(spark):
    ddl = "from string, to string"
    edges = spark.createDataFrame([("c", "a"), ("c", "b"), ("b", "a"), ("b", "a"), ("e", "d"), ("d", "e"), ("f", "e")], ddl)
    nodes = spark.createDataFrame([("lone",), ("a",)], "node string")
    # d and e form a cycle and f stands on it.
    assert rows(c.dependency_levels(edges, nodes)) == [("a", 0), ("b", 1), ("c", 2), ("d", None), ("e", None), ("f", None), ("lone", 0)]
    assert rows(c.dependency_levels(edges.where("from in ('b', 'c')"))) == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(c.dependency_fanin(edges)) == [("b", 2), ("c", 2)]


def test_rounds_write_only_what_is_left(spark, monkeypatch):
    written = []
    cut = c.cut_lineage

    def watched(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(c, "cut_lineage", watched)
    pairs = [(f"n{i}", f"leaf{i % 3 + j}") for i in range(60) for j in range(8)]
    got = c.dependency_levels(spark.createDataFrame([*pairs, ("top", "n7"), ("top", "n7")], "from string, to string"))
    assert rows(got) == sorted([(f"leaf{i}", 0) for i in range(10)] + [(f"n{i}", 1) for i in range(60)] + [("top", 2)])
    assert sum(written) < len(pairs)


def test_dependencies_on_null(spark):
    edges = spark.createDataFrame([(None, "a"), ("b", None), ("b", "a")], "from string, to string")
    assert rows(c.dependency_levels(edges)) == [(None, 0), (None, 1), ("a", 0), ("b", None)]


def test_scratch_is_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark, "x").startswith(f"{shared}/tabweave/x-")
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")


def test_parity_needs_both_sides(spark):
    left = spark.createDataFrame([("a", None), ("b", 1.0)], "k string, v double")
    right = spark.createDataFrame([("b", 1.0), ("c", None)], "k string, v double")
    assert rows(q.measure_parity(left, right, ["k"], "v").select("k", "status")) == [("a", "FAIL"), ("b", "PASS"), ("c", "FAIL")]


def test_long_codes_stay_text(spark):
    df = spark.createDataFrame([("1234567890123456789012345", "12")], "code string, n string")
    assert rows(q.type_safety_profile(df, ["code", "n"]).select("column_name", "declare")) == [("code", "string"), ("n", "bigint")]


def test_roles_in_perspectives_and_hidden_keys(spark):
    tables = {"f": spark.createDataFrame([(1, 5.0), (2, 7.0)], "k int, v double"), "d": spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string")}
    role = Role(rows={"d": lambda df: df.where("name = 'x'")}, hidden_columns={"f": ("k",), "d": ("id",)})
    model = SemanticModel(tables, [Relationship("f", "k", "d", "id")], [sum_("total", "v")], {"r": role}, perspectives={"p": {"d": ["id", "name"]}})
    assert rows(model.query("f", ["total"], ["name"], role="r")) == [("x", 5.0)]
    assert model.perspective("p", "d", "r").columns == ["name"] and model.perspective("p", "d").count() == 2
    assert model.visible("r") == {"f": ["v"], "d": ["name"]} and "k" not in model.star("f", role="r").columns
    with pytest.raises(PermissionError):
        model.query("f", ["total"], ["id"], role="r")


def test_cycles_are_named_and_what_stands_on_them_has_levels(spark):
    pairs = [("c", "a"), ("c", "b"), ("b", "a"), ("e", "d"), ("d", "e"), ("f", "e"), ("f", "c"), ("s", "s"), ("g", "f"), (None, "a")]
    pairs += [("h", "i"), ("i", "j"), ("j", "h"), ("i", "k"), ("k", "l"), ("l", "m"), ("m", "k"), ("n", "h")]
    edges = spark.createDataFrame(pairs, "from string, to string")
    got = {r.node: (r.component, r.members, r.level) for r in c.dependency_components(edges, spark.createDataFrame([("lone",)], "node string")).collect()}
    assert got == {
        "a": ("a", 1, 0), "b": ("b", 1, 1), "c": ("c", 1, 2), "d": ("d", 2, 0), "e": ("d", 2, 0), "f": ("f", 1, 3), "g": ("g", 1, 4),
        "s": ("s", 1, 0), "lone": ("lone", 1, 0), "k": ("k", 3, 0), "l": ("k", 3, 0), "m": ("k", 3, 0),
        "h": ("h", 3, 1), "i": ("h", 3, 1), "j": ("h", 3, 1), "n": ("n", 1, 2),
    }
    plain = c.dependency_components(edges.where("from in ('b', 'c')"))
    assert rows(plain) == [("a", "a", 1, 0), ("b", "b", 1, 1), ("c", "c", 1, 2)]


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    pairs = {(rng.randrange(25), rng.randrange(25)) for _ in range(38)}
    reach = {a: {a} for a in range(25)}
    for _ in range(25):
        for a, b in pairs:
            reach[a] |= reach[b]
    seen = {x for p in pairs for x in p}
    want = {a: min(b for b in seen if b in reach[a] and a in reach[b]) for a in seen}
    got = {r.node: r.component for r in c.dependency_components(spark.createDataFrame(sorted(pairs), "from int, to int")).collect()}
    assert got == want


def test_only_missing_inputs_are_missing(spark):
    with pytest.raises(AnalysisException):
        q.validate_required_tables(spark, {"odd": "not a name!"})
