"""Files and folders."""

import itertools
import os
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom import session
from tickerloom.session import scratch_path, scratch_root
from tickerloom.sources import delimited, layouts, tables
from tickerloom.sources.layouts import HIVE_LAYOUT


def test_tolerant_csv(spark, tmp_path):
    (tmp_path / "f.csv").write_text('a,b,c\n1,2,3\n1,2\n1,2,3,4\nx,"5,5",6\n')
    schema = T.StructType([T.StructField(n, T.StringType()) for n in "abc"])
    found = delimited.read_csv_skipping_wide_rows(spark, str(tmp_path / "f.csv"), schema)
    assert {tuple(r) for r in found.collect()} == {("1", "2", "3"), ("1", "2", None), ("x", "5,5", "6")}


def test_strict_csv_fails_on_bad_values(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a\n1\nx\n")
    schema = T.StructType([T.StructField("a", T.LongType())])
    with pytest.raises(Exception):
        delimited.read_csv(spark, str(tmp_path / "f.csv"), schema).collect()


def test_csv_keeps_quotes_commas_and_nulls(spark):
    frame = spark.createDataFrame([(1, 'say "hi", twice'), (2, ""), (3, None)], "k long, t string")
    path = scratch_path(spark, "csv")
    delimited.write_csv(frame, path)
    found = {r.k: r.t for r in delimited.read_csv(spark, path, frame.schema).collect()}
    assert found[1] == 'say "hi", twice' and found[3] is None


def test_results_at_any_depth(spark, tmp_path):
    for folder in ("7/bert", "8/org/finbert"):
        target = tmp_path / "models" / folder
        target.mkdir(parents=True)
        (target / "fine_tuned_predictions.csv").write_text("ticker,hit\nA,1\n")
    schema = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("hit", T.IntegerType())])
    found = layouts.collect_results(spark, str(tmp_path / "models"), schema).collect()
    assert sorted(tuple(r) for r in found) == [(7, "bert", "A", 1), (8, "org/finbert", "A", 1)]


def test_keyed_layout(spark):
    frame = spark.createDataFrame([(1, "a/b c", 5), (2, "x+y", 6)], "permco long, model string, v int")
    path = scratch_path(spark, "keyed")
    layouts.write_by_keys(frame, path, ["permco", "model"])
    assert sorted(tuple(r) for r in layouts.read_by_keys(spark, path, frame.schema).select(frame.columns).collect()) == [(1, "a/b c", 5), (2, "x+y", 6)]
    schema = T.StructType([T.StructField("v", T.IntegerType())])
    found = layouts.collect_results(spark, path, schema, HIVE_LAYOUT, "parquet").collect()
    assert sorted(tuple(r) for r in found) == [(1, "a/b c", 5), (2, "x+y", 6)]


def test_sql_arguments_are_bound(spark):
    tables.register_views({"numbers_": spark.range(5)})
    assert tables.run_sql(spark, "SELECT id FROM numbers_ WHERE id > :low", {"low": 2}).count() == 2
    assert "numbers_" in {r.table_name for r in tables.list_tables(spark).collect()}


def test_scratch_follows_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert scratch_path(spark, "x").startswith(configured or scratch_root(spark))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_tolerant_read_counts_fields(spark, tmp_path):
    lines = ['1,2,3', '1,2', '4,5,6,', '1,2,3,,x', '"a,b",5,6', '"a\nb",7,8', 'x,y,9']
    (tmp_path / "f.csv").write_text("a,b,c\n" + "\n".join(lines) + "\n")
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.IntegerType()), T.StructField("c", T.IntegerType())])
    found = delimited.read_csv_skipping_wide_rows(spark, str(tmp_path / "f.csv"), schema, multi_line=True)
    wanted = {("1", 2, 3), ("1", 2, None), ("a,b", 5, 6), ("a\nb", 7, 8), ("x", None, 9)}
    assert set(map(tuple, found.collect())) == wanted
    assert {row.a for row in found.select("a").collect()} == {row[0] for row in wanted}


def test_sorted_write(spark, tmp_path):
    delimited.write_csv(spark.range(50).selectExpr("id", "49 - id as rest").repartition(4), str(tmp_path / "out"), ["rest"])
    files = sorted((tmp_path / "out").glob("part-*"))
    rows = [int(line.split(",")[1]) for file in files for line in file.read_text().splitlines()[1:]]
    assert rows == sorted(rows) and len(rows) == 50


def test_long_quoted_fields_are_read(spark, tmp_path):
    """A wide row with a quoted field of a megabyte, commas, doubled quotes and a line break inside, is counted right."""
    field = '"' + 'a,""b"",' * 130_000 + 'line\nend"'
    (tmp_path / "f.csv").write_text(f"a,b\n{field},1,2\n{field},3\n")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in "ab"])
    found = delimited.read_csv_skipping_wide_rows(spark, str(tmp_path / "f.csv"), schema, multi_line=True).collect()
    assert [(len(r.a), r.b) for r in found] == [(len('a,"b",') * 130_000 + len("line\nend"), "3")]


def test_hive_results_are_pruned(spark):
    frame = spark.createDataFrame([(k, m, k * 10) for k in (1, 2, 3) for m in ("a/b c", "x+y", "100%")], "permco long, model string, v int")
    path = scratch_path(spark, "pruned")
    layouts.write_by_keys(frame, path, ["permco", "model"])
    schema = T.StructType([T.StructField("v", T.IntegerType())])
    one = layouts.collect_results(spark, path, schema, HIVE_LAYOUT, "parquet").where("permco = 2 and model = 'x+y'")
    assert one.collect() == [(2, "x+y", 20)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("PartitionFilters"):].split("PushedFilters")[0]
    assert "permco" in scan and "model" in scan
    assert one.inputFiles() and len(spark.read.parquet(path).where("permco = 2").select(F.input_file_name()).distinct().collect()) == 3


def test_manifest_opens_only_what_is_asked_for(spark, tmp_path):
    """A foreign tree: the file that the filter leaves out would fail to parse."""
    for folder, text in (("7/bert", "ticker,hit\nA,1\n"), ("8/org/fin bert", "ticker,hit\nB,2\n"), ("9/bad", "ticker,hit\nC,x\n"), ("notes", "no result\n")):
        target = tmp_path / "models" / folder
        target.mkdir(parents=True)
        (target / "fine [tuned].csv").write_text(text)
    schema = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("hit", T.IntegerType())])
    manifest = layouts.result_manifest(spark, str(tmp_path / "models"))
    assert sorted((r.permco, r.model, r.bytes) for r in manifest.collect()) == [(7, "bert", 15), (8, "org/fin bert", 15), (9, "bad", 15)]
    found = layouts.read_manifest(manifest.where(F.col("permco") < 9), schema)
    assert sorted(map(tuple, found.collect())) == [(7, "bert", "A", 1), (8, "org/fin bert", "B", 2)]
    nothing = layouts.read_manifest(manifest.where("permco = 1"), schema)
    assert nothing.count() == 0 and nothing.columns == ["permco", "model", "ticker", "hit"]


def test_shuffle_partitions_follow_the_stored_size(spark, tmp_path):
    path, name = str(tmp_path / "t.parquet"), "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    task = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(task)
    spark.range(20_000).write.parquet(path)
    size = sum(file.stat().st_size for file in (tmp_path / "t.parquet").glob("*.parquet"))
    try:
        assert session.spread_for(spark, path) == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert session.spread_for(spark, path, size // 50) >= 50 and int(spark.conf.get(name)) >= 50
        assert session.spread_for(spark, path) >= 50  # never fewer again
    finally:
        spark.conf.unset(name)
        spark.conf.set(task, before)


def test_many_folders_are_read_without_a_search_for_partitions(spark):
    """Keys from the paths and the folders of one company give the rows of the partitioned read, without its list of all folders."""
    rows = [(k, m, k * 10) for k in (1, 7, 17, 70) for m in ("a/b c", "x+y", "100%", "ä=1", None)] + [(None, "x+y", 5)]
    frame = spark.createDataFrame(rows, "permco long, model string, v int")
    path = scratch_path(spark, "many")
    layouts.write_by_keys(frame, path, ["permco", "model"])
    zeros = scratch_path(spark, "zeros")
    layouts.write_by_keys(spark.createDataFrame([("007", "z", 71), ("0917", "z", 72)], "permco string, model string, v int"), zeros, ["permco", "model"])
    by_path = layouts.read_by_keys(spark, path, frame.schema, ["permco", "model"])
    partitioned = layouts.read_by_keys(spark, path, frame.schema)
    assert by_path.columns == partitioned.columns and by_path.schema == partitioned.schema
    wanted = set(rows)
    assert set(map(tuple, by_path.select(frame.columns).collect())) == wanted == set(map(tuple, partitioned.select(frame.columns).collect()))
    assert by_path.count() == len(rows)
    schema = T.StructType([T.StructField("v", T.IntegerType())])
    every = layouts.collect_results(spark, path, schema, HIVE_LAYOUT, "parquet", prune=False)
    assert set(map(tuple, every.collect())) == wanted and every.columns == ["permco", "model", "v"]
    one = layouts.collect_results(spark, path, schema, HIVE_LAYOUT, "parquet", company=7)
    assert set(map(tuple, one.collect())) == {row for row in rows if row[0] == 7} and len(one.inputFiles()) == 5
    padded = layouts.collect_results(spark, zeros, schema, HIVE_LAYOUT, "parquet", company=7)
    assert padded.collect() == [(7, "z", 71)]
    nothing = layouts.collect_results(spark, path, schema, HIVE_LAYOUT, "parquet", company=8)
    assert nothing.collect() == [] and nothing.schema.names == ["permco", "model", "v"]


def test_tasks_of_large_inputs_are_small(spark, tmp_path):
    """Once the shuffles follow the stored size, neither a scan nor a shuffle gives a task more than 32 MB."""
    names = ["spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"]
    before = {name: spark.conf.get(name, None) for name in names}
    spark.range(20_000).write.parquet(str(tmp_path / "t.parquet"))
    try:
        for name in names[1:]:
            spark.conf.set(name, str(128 << 20))
        spark.conf.unset(names[0])
        session.spread_for(spark, str(tmp_path / "t.parquet"), 1000)
        assert int(spark.conf.get(names[1])) <= 16 << 20 and int(spark.conf.get(names[2])) <= 32 << 20
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_local_folders_are_those_of_spark(spark, tmp_path):
    """The same folders and rows as Spark's own writer, without the sums of Hadoop beside every file."""
    rows = [(key, day, i, f"text {i}", Decimal(i) / 4, datetime(2020, 1, 1, 5, i % 60), [i, None], None if i % 3 else 0.5 * i)
            for i, (key, day) in enumerate(itertools.product(["a", "", None, "a/b=c 100%", "ü+'\"#", "[x]{y}:?*\\^\x01"], [date(2020, 2, 29), None]))] * 3
    frame = spark.createDataFrame(rows, "k string, d date, i long, s string, p decimal(10,2), t timestamp, l array<int>, x double")
    ours, theirs = (str(tmp_path / name) for name in ("ours", "theirs"))
    layouts.write_by_keys(frame, ours, ["k", "d"])
    frame.write.partitionBy("k", "d").parquet(theirs)

    def folders(root):
        return sorted({os.path.relpath(at, root) for at, _, names in os.walk(root) if any(name.endswith(".parquet") for name in names)})

    assert folders(ours) == folders(theirs) and len(folders(ours)) == 10
    files = [name for _, _, names in os.walk(ours) for name in names]
    assert sorted(files)[0] == "_SUCCESS" and not [name for name in files if name.endswith(".crc") or name.startswith(".")]
    found, plain = (spark.read.schema(frame.schema).parquet(root) for root in (ours, theirs))
    assert found.count() == 36 and found.exceptAll(plain).isEmpty()
    many = str(tmp_path / "many")
    layouts.write_by_keys(spark.range(60).selectExpr("id", "id AS k"), many, ["k"])
    assert layouts.read_by_keys(spark, many, T.StructType.fromDDL("id long, k long"), ["k"]).rdd.getNumPartitions() <= 8
    layouts.write_by_keys(frame.where("i < 0"), str(tmp_path / "none"), ["k", "d"])
    assert os.listdir(tmp_path / "none") == ["_SUCCESS"]
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        layouts.write_by_keys(frame, ours, ["k", "d"])
