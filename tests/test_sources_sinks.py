import datetime as dt
import glob
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tabweave.sources import files, sinks
from tabweave.sources.nested import nested_json_flatten

CALLS = "call_id bigint, code string, seconds double"


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())
    return str(path)


@pytest.mark.parametrize("ending", ["\r", "\n", "\r\n"])
def test_line_endings_and_null_tokens(spark, tmp_path, ending):
    path = write(tmp_path / "calls.csv", ending.join(["id|code|s", "1|007|1.5", "2||NULL", "3|NULL|x", ""]))
    read = files.cr_line_source if ending == "\r" else files.delimited_source
    got = read(spark, path, CALLS, sep="|", null_tokens=("", "NULL"))
    assert rows(got) == [(1, "007", 1.5), (2, None, None), (3, None, None)]


def test_strict_conversion_fails(spark, tmp_path):
    path = write(tmp_path / "calls.csv", "id,code,s\n1,a,x\n")
    with pytest.raises(Exception):
        files.delimited_source(spark, path, CALLS, strict=True).collect()


def test_positional(spark, tmp_path):
    path = write(tmp_path / "p.csv", "1,a,2.5\nx,b,3\n")
    assert rows(files.positional_source(spark, path, ["int", "string", "double"])) == [(None, "b", 3.0), (1, "a", 2.5)]


RAGGED = "1,a,1.5\n2,b\n3,c,3.5,extra\nx,d,4\n5,e,bad\n"


def test_tolerant_load_and_rejects(spark, tmp_path):
    path = write(tmp_path / "r.csv", RAGGED)
    assert rows(files.bulk_load_tolerant(spark, path, CALLS, header=False)) == [(1, "a", 1.5), (2, "b", None), (3, "c", 3.5)]
    loose = files.text_rows(spark, path, CALLS, header=False)
    good, bad = files.reject_rows(loose, CALLS)
    assert good.count() == 3
    assert rows(bad.select("code", "error_code", "error_column")) == [("d", "CONVERSION", "call_id"), ("e", "CONVERSION", "seconds")]
    strict = files.text_rows(spark, path, CALLS, header=False, keep_corrupt=True)
    good, bad = files.reject_rows(strict, CALLS, strict=True)
    assert rows(good) == [(1, "a", 1.5)]
    assert [r[1] for r in rows(bad.select("code", "error_code"))] == ["FIELD_COUNT", "FIELD_COUNT", "CONVERSION", "CONVERSION"]


def test_no_rejects_is_a_typed_empty_frame(spark, tmp_path):
    path = write(tmp_path / "ok.csv", "1,a,1.5\n")
    _, bad = files.reject_rows(files.text_rows(spark, path, CALLS, header=False), CALLS)
    assert bad.count() == 0 and bad.columns == ["call_id", "code", "seconds", "error_code", "error_column"]


def test_folder_is_one_read_at_any_depth(spark, tmp_path):
    write(tmp_path / "in" / "file.csv", "id,v\n1,a\n")
    write(tmp_path / "in" / "batch_0" / "file.csv", "id,v\n2,b\n")
    write(tmp_path / "in" / "batch_0" / "skip.txt", "id,v\n3,c\n")
    root = str(tmp_path / "in")
    out = files.multi_file_source(spark, root, "id int, v string")
    assert rows(out.select("id", "file_name")) == [(1, "file.csv"), (2, "file.csv")]
    listed = files.file_listing(spark, root, "*.csv")
    assert listed.count() == 2 and listed.agg(F.sum("length")).first()[0] == 18
    assert files.file_listing(spark, root, "*.csv", depth=1).first()["path"].endswith("batch_0/file.csv")
    assert files.file_listing(spark, root, "*.csv", depth=0).count() == 1


def test_manifest(spark, tmp_path):
    root, manifest = tmp_path / "in", str(tmp_path / "manifest")
    write(root / "a.csv", "1\n")
    first = sinks.processed_manifest(files.file_listing(spark, str(root)), sinks.read_if_present(spark, manifest))
    assert first.count() == 1
    sinks.mark_processed(first, manifest)
    write(root / "b.csv", "2\n")
    waiting = sinks.processed_manifest(files.file_listing(spark, str(root)), sinks.read_if_present(spark, manifest))
    assert [r["file_name"] for r in waiting.collect()] == ["b.csv"]


def test_seed_keeps_codes(spark, tmp_path):
    path = write(tmp_path / "seed.csv", "prefix,since,ok,doc\n00123,2001-01-31,true,\"{\"\"a\"\":1}\"\n")
    seed = files.seed_source(spark, path, "prefix string, since date, ok boolean, doc variant")
    assert seed.first()["prefix"] == "00123"
    assert dict(seed.dtypes) == {"prefix": "string", "since": "date", "ok": "boolean", "doc": "variant"}
    assert seed.select(F.variant_get("doc", "$.a", "int")).first()[0] == 1


def test_table_source(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    assert files.table_source(spark, path).count() == 3
    spark.range(2).createOrReplaceTempView("two_rows")
    assert files.table_source(spark, "two_rows").count() == 2
    assert files.external_table(spark, "in_place", path, "id bigint").count() == 3
    assert files.table_source(spark, "in_place").count() == 3
    spark.sql("DROP TABLE in_place")
    assert spark.read.parquet(path).count() == 3
    profile = files.catalog_profile(spark, {"t": path}).first()
    assert profile["row_count"] == 3 and profile["bytes"] > 0


BODY = {
    "tables": [
        {
            "name": "Sales",
            "columns": [
                {"name": "Amount", "dataType": "double", "sourceColumn": "amt"},
                {"name": "Twice", "type": "calculated", "expression": ["[Amount]", "* 2"], "isHidden": True},
                {"name": "Plain"},
            ],
            "measures": [{"name": "Total", "expression": "[Amount] sum", "kpi": {"targetExpression": "100"}}],
            "hierarchies": [{"name": "Geo", "levels": [{"name": "Region", "column": "r"}, {"name": "City", "column": "c", "ordinal": 5}]}],
            "partitions": [{"name": "p1", "source": {"type": "query", "query": " SELECT 1 "}}, {"name": "p2", "mode": "directQuery"}],
        },
        {"name": "Empty"},
    ],
    "relationships": [{"name": "r", "fromTable": "Sales", "fromColumn": "k", "toTable": "Product", "toColumn": "k"}],
}


@pytest.mark.parametrize(
    "document", [{"create": {"database": {"name": "m", "model": BODY}}}, {"name": "m", "model": BODY}, {"name": "m", **BODY}]
)
def test_model_documents_in_three_shapes(spark, tmp_path, document):
    path = write(tmp_path / "model.json", json.dumps(document, indent=1))
    out = nested_json_flatten(spark, path)
    assert [(r["table_name"], r["n_columns"], r["n_measures"]) for r in out["tables"].orderBy("table_ordinal").collect()] == [
        ("Sales", 3, 1),
        ("Empty", 0, 0),
    ]
    columns = [(r["column_name"], r["data_type"], r["is_hidden"], r["is_calculated"], r["expression"]) for r in out["columns"].orderBy("column_ordinal").collect()]
    assert columns == [
        ("Amount", "double", False, False, None),
        ("Twice", "string", True, True, "[Amount]\n* 2"),
        ("Plain", "string", False, False, None),
    ]
    measure = out["measures"].first()
    assert (measure["expression"], measure["kpi_target"], measure["kpi_status"]) == ("[Amount] sum", "100", None)
    assert [r["level_ordinal"] for r in out["hierarchy_levels"].orderBy("level_ordinal").collect()] == [0, 5]
    assert rows(out["partitions"].select("partition_name", "mode", "source_type", "query")) == [
        ("p1", "import", "query", "SELECT 1"),
        ("p2", "directQuery", "unknown", ""),
    ]
    relation = out["relationships"].first()
    assert relation["model"] == "m" and relation["is_active"] is True
    assert (relation["cross_filtering"], relation["cardinality"]) == ("oneDirection", "many_to_one")


# -- sinks ---------------------------------------------------------------


def test_append_only_new_keys(spark, tmp_path):
    path = str(tmp_path / "mart")
    sinks.mart_append(spark.range(3), path, "id")
    sinks.mart_append(spark.range(5), path, "id")
    assert rows(spark.read.parquet(path)) == [(i,) for i in range(5)]


def test_overwrite_with_partitions(spark, tmp_path):
    path = str(tmp_path / "mart")
    df = spark.range(20).withColumn("p", F.col("id") % 2)
    sinks.mart_overwrite(df, path)
    sinks.mart_overwrite(df.where("id < 10"), path, ["p"])
    assert spark.read.parquet(path).count() == 10
    assert {p.name for p in (tmp_path / "mart").iterdir() if p.is_dir()} == {"p=0", "p=1"}


def test_overwrite_a_catalog_table(spark, tmp_path):
    spark.sql(f"CREATE DATABASE marts LOCATION '{tmp_path}/marts'")
    sinks.mart_overwrite(spark.range(3), "marts.daily")
    sinks.mart_overwrite(spark.range(2), "marts.daily")
    assert spark.table("marts.daily").count() == 2
    spark.sql("DROP DATABASE marts CASCADE")


def test_hot_cluster_key_spans_files_and_ranges_stay_apart(spark, tmp_path):
    path = str(tmp_path / "c")
    # Three quarters of the rows are copies of one row.
    key = F.when(F.col("id") < 3000, 7).otherwise(F.col("id") % 20)
    df = spark.range(4000).select(key.alias("k"), F.lit("same").alias("v")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.clustered_write(df, path, ["k"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files_ = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(
        F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("n")
    )
    spans = sorted((r["lo"], r["hi"], r["n"]) for r in files_.collect())
    assert sum(n for _, _, n in spans) == 4000
    assert max(n for _, _, n in spans) < 2500
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_cluster_policy():
    assert sinks.cluster_keys(["d"], ["d", "key"], ["h"], ["fk"]) == ["d", "key", "h"]


def test_split_write(spark, tmp_path):
    path = str(tmp_path / "routes")
    sinks.partition_split_write(spark.range(10), path, [("low", F.col("id") < 3), ("even", F.col("id") % 2 == 0)])
    got = {r["route"]: r["n"] for r in spark.read.parquet(path).groupBy("route").agg(F.count("*").alias("n")).collect()}
    assert got == {"low": 3, "even": 3, "default": 4}


def test_delimited_sink(spark, tmp_path):
    path = str(tmp_path / "flat")
    sinks.delimited_sink(spark.createDataFrame([(1, 'a|"b"'), (2, None)], "id int, v string"), path, sep="|", null_token="NULL")
    assert rows(files.delimited_source(spark, path, "id int, v string", sep="|", null_tokens=("NULL",))) == [(1, 'a|"b"'), (2, None)]


def test_append_and_clustering_rules(spark, tmp_path):
    path = str(tmp_path / "mart")
    df = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    for _ in range(2):
        sinks.mart_append(df, path, "k")
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError):
        sinks.clustered_write(df, path, ["k", "v", "k", "v"])


def test_curve_lets_filters_on_every_key_skip_files(spark, tmp_path):
    import pyarrow.parquet as pq

    df = spark.range(16_000).select(*[(F.xxhash64("id", F.lit(i)) % 5000).alias(f"k{i}") for i in range(3)], "id")
    paths = {"curve": str(tmp_path / "curve"), "plain": str(tmp_path / "plain")}
    sinks.curve_write(df, paths["curve"], ["k0", "k1", "k2"], files=64)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        sinks.clustered_write(df, paths["plain"], ["k0", "k1", "k2"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")

    def read(path, key, value):
        """Files whose range of the key holds the value."""
        stats = [f.metadata.row_group(0).column(key).statistics for f in map(pq.ParquetFile, glob.glob(f"{path}/*.parquet")) if f.metadata.num_rows]
        return sum(s.min <= value <= s.max for s in stats), len(stats)

    for key in (1, 2):
        (few, files), (many, plain) = (read(paths[n], key, 1234) for n in ("curve", "plain"))
        assert few < files / 2 and many > plain * 0.8
    assert read(paths["curve"], 0, 1234)[0] < 32
    assert rows(spark.read.parquet(paths["curve"])) == rows(df)


def test_curve_with_hot_missing_and_text_keys(spark, tmp_path):
    df = spark.createDataFrame([(None if i % 5 == 0 else 7 if i % 2 else i, f"t{i % 3}", dt.date(2000, 1, 1 + i % 28)) for i in range(300)], "a int, b string, d date")
    sinks.curve_write(df, str(tmp_path / "out"), ["a", "b", "d", F.col("a") + 1], files=5)
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(df)
    sinks.curve_write(df.limit(0), str(tmp_path / "none"), ["a"])
    assert spark.read.schema(df.schema).parquet(str(tmp_path / "none")).isEmpty()
    with pytest.raises(ValueError):
        sinks.curve_write(df, str(tmp_path / "x"), [])


def test_encoding_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "latin" / "a.csv"
    path.parent.mkdir()
    path.write_bytes("id,name\n1,'Zo\u00e9, ''x''\nend'\n2,plain\n".encode("latin-1"))
    out = files.delimited_source(spark, str(path.parent), "id int, name string", encoding="ISO-8859-1", quote="'", multi_line=True)
    assert rows(out) == [(1, "Zo\u00e9, 'x'\nend"), (2, "plain")]
