"""Sources, sinks, incremental refresh and its streaming form."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lagwise.operators.rolling import rolling_bundle
from lagwise.sources import tables as S
from lagwise.streaming.incremental import refresh

SCHEMA = "game_pk long, pitcher_id long, game_date date, pitches double"


def games(spark, first, last):
    return spark.range(first, last).select(
        F.col("id").alias("game_pk"),
        (F.col("id") % 3).alias("pitcher_id"),
        F.date_add(F.lit("2023-09-01").cast("date"), (F.col("id") * 5).cast("int")).alias("game_date"),
        (F.col("id") * 7 % 11).cast("double").alias("pitches"),
    )


def compute(df):
    return rolling_bundle(df, ["pitcher_id"], ["game_date", "game_pk"], ["pitches"], windows=(3,), halflife=7)


def content(df):
    return sorted(tuple(r) for r in df.select("game_pk", "pitches_mean_3", "pitches_ewm_7", "pitches_std_3").collect())


@pytest.mark.parametrize("keys", [None, ["pitcher_id"]])
def test_appends_equal_a_rebuild(spark, tmp_path, keys):
    target = str(tmp_path / "t")
    done = [
        refresh(spark, games(spark, 0, n), target, compute, ["game_pk"], keys) for n in (20, 45, 45, 60)
    ]
    assert done == ["rebuilt", "appended", "unchanged", "appended"]
    assert content(S.read_table(spark, target)) == content(compute(games(spark, 0, 60)))


def test_late_rows_repair_later_ones(spark, tmp_path):
    target = str(tmp_path / "t")
    everything = games(spark, 0, 60)
    refresh(spark, everything.where("game_pk not in (30, 31)"), target, compute, ["game_pk"])
    assert refresh(spark, everything, target, compute, ["game_pk"]) == "repaired"
    assert content(S.read_table(spark, target)) == content(compute(everything))
    assert refresh(spark, games(spark, 0, 10), target, compute, ["game_pk"], rebuild=True) == "rebuilt"
    assert S.read_table(spark, target).count() == 10


def test_undated_corrected_and_dropped_rows_settle(spark, tmp_path):
    target = str(tmp_path / "t")
    base = games(spark, 0, 60)
    keyless = base.where("game_pk = 59").withColumn("pitcher_id", F.lit(None).cast("long")).withColumn("game_pk", F.lit(900).cast("long"))
    undated = base.where("game_pk = 58").withColumn("game_date", F.lit(None).cast("date")).withColumn("game_pk", F.lit(901).cast("long"))
    fixed = base.withColumn("pitches", F.when(F.col("game_pk") == 20, 99.0).otherwise(F.col("pitches")))
    steps = [base.where("game_pk < 55"), base.union(undated), base.union(undated).union(keyless), fixed.union(undated).union(keyless)]
    done = []
    for source in steps:
        done += [refresh(spark, source, target, compute, ["game_pk"]), refresh(spark, source, target, compute, ["game_pk"])]
        assert content(S.read_table(spark, target).where("game_date is not null")) == content(compute(source).where("game_date is not null"))
    assert done == ["rebuilt", "unchanged", "repaired", "unchanged", "repaired", "unchanged", "repaired", "unchanged"]
    assert S.read_table(spark, target).where("game_pk = 901").count() == 1


def test_year_filter_prunes_and_projection_skips_absent_columns(spark, tmp_path):
    parted, flat = str(tmp_path / "p"), str(tmp_path / "f")
    df = games(spark, 0, 60)
    S.write_table(df.union(df), parted, unique=["game_pk"])
    df.write.parquet(flat)
    for path in (parted, flat):
        got = S.read_table(spark, path, ["game_pk", "game_date", "barrel"], year=2024)
        assert got.columns == ["game_pk", "game_date"]
        assert got.count() == df.where("year(game_date) = 2024").count() > 0
    plan = S.read_table(spark, parted, year=2024)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan
    plan = S.read_table(spark, flat, year=2024)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(game_date,2024-01-01)" in plan


def test_marks_stats_and_lookups(spark, tmp_path):
    df = games(spark, 0, 10)
    assert S.latest_date(df) == dt.date(2023, 10, 16)
    assert S.latest_date(df.where("false")) is None
    assert tuple(S.date_span(df).first()) == (dt.date(2023, 9, 1), dt.date(2023, 10, 16), 10)
    assert S.existing_keys(df, ["pitcher_id"]).count() == 3
    raw = spark.createDataFrame([("12", "A"), ("x", "B"), (None, "C"), ("13.0", None)], "raw_id string, playername string")
    names = {"pitcher_id": "raw_id", "name": "playername"}
    assert [tuple(r) for r in S.id_lookup(raw, "pitcher_id", names, ["name"]).collect()] == [(12, "A")]
    assert not S.table_exists(spark, str(tmp_path / "none"))


def test_files(spark, tmp_path):
    table = spark.createDataFrame([("a", 0.5), ("b", 0.0)], "feature string, importance double")
    S.write_csv(table, str(tmp_path / "c"))
    assert sorted(tuple(r) for r in S.read_csv(spark, str(tmp_path / "c"), "feature string, importance double").collect()) == [("a", 0.5), ("b", 0.0)]
    S.write_json(table, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "1.json").write_text('{"a":\n 1}')
    assert S.read_documents(spark, str(tmp_path / "docs")).first().body == '{"a":\n 1}'


def test_schedule_names_take_the_last_value(spark):
    df = spark.createDataFrame(
        [("2024-04-01", 1, 5, "Old", 6, "Six"), ("2024-04-09", 2, 6, "Six", 5, "New"), ("2024-04-10", 3, None, "No", 5, None)],
        "game_date string, game_pk int, home_probable_pitcher_id int, home_probable_pitcher_name string,"
        " away_probable_pitcher_id int, away_probable_pitcher_name string",
    )
    assert sorted(tuple(r) for r in S.names_from_schedule(df).collect()) == [(5, "New"), (6, "Six")]
