"""Steps whose tasks must stay small as the tables grow."""

import os

import pytest
from pyspark.sql import functions as F

from lagwise.models import training
from lagwise.operators import aggregates, joins, sequence
from lagwise.sources import files
from lagwise.sources.tables import read_documents
from workload import upkeep


def test_documents_are_written_by_many_tasks(spark, tmp_path):
    """However few bytes they have: a task puts at most a folder's share of files in place."""
    path, share = str(tmp_path / "docs"), files.DOCUMENTS_PER_FOLDER
    rows = spark.range(2 * share + 50).select(F.concat(F.lit("{"), F.col("id") % 400, F.lit("}")).alias("body"))
    files.write_documents(rows, path)
    folders = [names for _, _, names in os.walk(path) if any(n.endswith(".txt") for n in names)]
    assert len(folders) == 3 and max(sum(n.endswith(".txt") for n in names) for names in folders) <= share
    back = read_documents(spark, path)
    assert back.select("path").distinct().count() == rows.count()
    assert back.select(F.trim(F.regexp_replace("body", "\n", ""))).exceptAll(rows).count() == 0


def test_deliveries_of_many_files_are_one_batch(spark, monkeypatch, tmp_path):
    """No task writes or reads a whole delivery, and every delivery stays a batch."""
    seen = []
    monkeypatch.setattr(upkeep, "ARRIVAL_ROWS", 400, raising=False)
    wrapped = upkeep.stream_refresh

    def watch(session, arrivals, *rest):
        query = wrapped(session, arrivals, *rest)
        query.awaitTermination()
        batches = sum(p["numInputRows"] > 0 for p in query.recentProgress)
        seen.append((len(session.read.parquet(arrivals).inputFiles()), batches))
        return query

    monkeypatch.setattr(upkeep, "stream_refresh", watch)
    upkeep.stream_append(spark, "/root/testdata/sf0.001")
    assert [b for _, b in seen] == [1, 1, 1] and seen[0][0] > 1


def test_ranges_are_bounded_in_number(spark, monkeypatch):
    """A range costs a task and a file; a few rows each must not mean ever more of them."""
    monkeypatch.setattr(sequence, "MAX_RANGES", 8, raising=False)
    rows = spark.range(3000).select((F.col("id") * 7 % 3000).alias("id"))
    placed = sequence.ranged_positions(rows, ["id"], max_rows=30)
    assert len([f for f in placed.inputFiles() if f.endswith(".parquet")]) <= 8
    assert placed.where("id <> _pos").isEmpty() and placed.count() == 3000
    few = sequence.ranged_positions(rows, ["id"], max_rows=750)
    assert len(few.inputFiles()) == 4


def test_lookup_spreads_missing_and_hot_keys(spark):
    """Rows without a key and rows of a hot key go to many tasks, and find what they found before."""
    rows = spark.range(6000).select("id", F.expr("case when id % 5 < 3 then null when id % 5 = 3 then -1 else id % 50 end").alias("k"))
    table = spark.sql("select * from values (-1L, 'a'), (-1L, 'b'), (4L, 'c'), (null, 'd'), (77L, 'e') t(k, v)")
    plain = rows.join(table, "k", "left")
    names = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = joins.lookup_join(rows, table, ["k"], broadcast_rows=0, max_rows=100)
        assert found.columns == plain.columns
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert found.exceptAll(plain).count() == 0 and plain.exceptAll(found).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", names[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", names[1])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", names[2])
    assert sum(sizes) == 7200 and max(sizes) < 1200


def test_every_file_of_the_folds_has_all_folds(spark):
    """Else a fit on the first fold leaves most tasks without rows."""
    rows = spark.range(6000).select(F.col("id").alias("o"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y"))
    folded = training._folded(rows, ["x"], ["o"], "y", 5)
    per_file = folded.groupBy(F.input_file_name().alias("f")).agg(F.count_distinct("fold").alias("n"), F.count("*").alias("rows"))
    assert [r.n for r in per_file.collect()] == [6] * per_file.count() and per_file.count() > 1
    assert {r.fold: r["count"] for r in folded.groupBy("fold").count().collect()} == {k: 1000 for k in range(6)}


def test_quantiles_and_extremes_take_few_passes_however_many_columns(spark):
    """A pass of its own for every few columns is hundreds of jobs over a wide table."""
    names = [f"c{k}" for k in range(60)]
    df = spark.range(500).select("id", *[((F.col("id") * (2 * k + 1)) % 503).cast("double").alias(c) for k, c in enumerate(names)])
    df = df.withColumn("c7", F.when(F.col("id") % 2 == 0, float("nan")).when(F.col("id") < 99, F.col("c7"))).withColumn("c9", F.lit(None).cast("double"))
    context, group = spark.sparkContext, "few-passes"
    context.setJobGroup(group, group)
    try:
        got = aggregates.column_quantiles(df, names, (0.01, 0.5, 0.99), budget=1500)
    finally:
        context.setJobGroup("others", "others")
    assert len(context.statusTracker().getJobIdsForGroup(group)) <= 40
    rows = df.toPandas()
    for c in names:
        assert got[c] == ([None] * 3 if c == "c9" else pytest.approx(rows[c].quantile([0.01, 0.5, 0.99]).tolist()))


def test_quantiles_of_far_apart_values(spark):
    """Outliers and infinite ends leave nearly all rows in one part; the ranks stay exact."""
    far = F.when(F.col("id") == 0, float("-inf")).when(F.col("id") == 1, -1.7e308).when(F.col("id") == 998, 1.7e308).when(F.col("id") == 999, float("inf"))
    df = spark.range(1000).select(far.otherwise(F.col("id").cast("double")).alias("x"))
    got = aggregates.column_quantiles(df, ["x"], (0.0, 0.01, 0.5, 0.99, 1.0), budget=5)["x"]
    assert got == pytest.approx([float("-inf"), 9.99, 499.5, 989.01, float("inf")])
