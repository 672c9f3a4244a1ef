"""Tables behind one pointer, changes passed on, the stream on top, and files with bad records."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from lagwise.operators.rolling import rolling_bundle
from lagwise.plans import matrix, staged
from lagwise.sources import files as S
from lagwise.sources.store import Store, Table, vacuum
from lagwise.streaming.incremental import stream_refresh
from lagwise.streaming.stages import Stage, bring_in

SCHEMA = "game_pk long, pitcher_id long, game_date date, pitches double"
RAW = Table("raw", ("pitcher_id", "game_pk"), ("pitcher_id", "game_pk"), bucket=("pitcher_id",))


def rolled(df):
    return rolling_bundle(df, ["pitcher_id"], ["game_date", "game_pk"], ["pitches"], windows=(3,), halflife=7, keep_null_keys=True)


ROLLED = Stage(Table("rolled", ("pitcher_id",), ("pitcher_id", "game_pk")), ("raw",), rolled)
BY_SEASON = Stage(
    Table("seasons", ("season",), ("season",), date=""), ("rolled",),
    lambda df: df.groupBy(F.year("game_date").alias("season")).agg(F.count("*").alias("n"), F.sum("pitches").alias("total")),
    {"rolled": {"season": "year(game_date)"}},
)
STAGES = [ROLLED, BY_SEASON]


def games(spark, first, last, pitchers=3):
    return spark.range(first, last).select(
        F.col("id").alias("game_pk"),
        (F.col("id") % pitchers).alias("pitcher_id"),
        F.date_add(F.lit("2022-03-01").cast("date"), (F.col("id") * 20).cast("int")).alias("game_date"),
        (F.col("id") * 7 % 11).cast("double").alias("pitches"),
    )


def content(df):
    return sorted((tuple(r) for r in df.select("game_pk", "pitches", "pitches_mean_3", "pitches_ewm_7").collect()), key=str)


def seasons(store):
    return {r.season: (r.n, r.total) for r in store.read("seasons").collect()}


def expected_seasons(df):
    return {r.s: (r.n, r.t) for r in df.groupBy(F.year("game_date").alias("s")).agg(F.count("*").alias("n"), F.sum("pitches").alias("t")).collect()}


def test_late_corrected_and_deleted_rows(spark, tmp_path):
    store, everything = Store(spark, str(tmp_path), 4), games(spark, 0, 60)
    undated = everything.where("game_pk = 7").selectExpr("900 as game_pk", "pitcher_id", "cast(null as date) as game_date", "pitches")
    keyless = everything.where("game_pk = 8").selectExpr("901 as game_pk", "cast(null as long) as pitcher_id", "game_date", "pitches")
    bring_in(store, [RAW], STAGES, {"raw": everything.where("game_pk % 5 <> 0")})
    fixed = everything.where("game_pk % 5 = 0 or game_pk = 21").withColumn("pitches", F.col("pitches") + 1)
    bring_in(store, [RAW], STAGES, {"raw": fixed.union(undated).union(keyless).union(fixed)})  # repeated rows too
    now = everything.withColumn("pitches", F.when(F.expr("game_pk % 5 = 0 or game_pk = 21"), F.col("pitches") + 1).otherwise(F.col("pitches")))
    full = now.union(undated).union(keyless)
    assert content(store.read("rolled")) == content(rolled(full)) and seasons(store) == expected_seasons(full)
    version = store.version
    assert bring_in(store, [RAW], STAGES, {"raw": full}).rewritten == {} and store.version == version  # nothing new
    gone = everything.where("year(game_date) = 2024 or game_pk = 3")
    bring_in(store, [RAW], STAGES, {}, {"raw": gone})
    left = full.join(gone.select("game_pk"), "game_pk", "left_anti").select(full.columns)
    assert content(store.read("rolled")) == content(rolled(left)) and 2024 not in seasons(store)
    assert 2024 not in {c.season for c in store.cells("rolled")}
    assert store.latest_date("raw") == left.agg(F.max("game_date")).first()[0]


def test_an_append_touches_only_its_cells(spark, tmp_path):
    store = Store(spark, str(tmp_path), 8)
    bring_in(store, [RAW], STAGES, {"raw": games(spark, 0, 40)})
    build = bring_in(store, [RAW], STAGES, {"raw": games(spark, 40, 42)})
    years = {r.y for r in games(spark, 40, 42).select(F.year("game_date").alias("y")).collect()}
    assert {s for s, _ in build.rewritten["raw"] | build.rewritten["rolled"]} == years
    # What is read for a batch does not grow with the history of other buckets.
    batch = games(spark, 90, 91, 3)
    read = []
    for n in (1, 2):
        other = Store(spark, f"{tmp_path}/{n}", 8)
        mine, rest = games(spark, 0, 40).where("pitcher_id = 0"), games(spark, 100, 100 + 200 * n, 50)
        bucket = mine.select(other.bucket_of(["pitcher_id"])).first()[0]
        rest = rest.where(other.bucket_of(["pitcher_id"]) != bucket)
        bring_in(other, [RAW], [ROLLED], {"raw": mine.union(rest)})
        read.append(bring_in(other, [RAW], [ROLLED], {"raw": batch}).bytes_read)
    assert read[0] == read[1] > 0


def test_a_failed_build_leaves_the_old_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path), 4)
    bring_in(store, [RAW], STAGES, {"raw": games(spark, 0, 20)})
    before = content(store.read("rolled"))

    def fail(build, changes):
        assert build.read("raw").count() == 30  # the build sees its own rows
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        bring_in(store, [RAW], STAGES, {"raw": games(spark, 10, 30)}, last=fail)
    again = Store(spark, str(tmp_path), 4)
    assert content(again.read("rolled")) == before and again.version == 1
    other = again.begin()
    bring_in(store, [RAW], STAGES, {"raw": games(spark, 20, 30)})
    with pytest.raises(RuntimeError, match="version 2"):
        other.commit()
    # A torn slot is not taken for a version: the one before is read.
    spark.createDataFrame([(3, 9, "raw", 1, 1, "x", 1, 1, "{}")], "version long, entries long, name string, season int, bucket int, folder string, n_rows long, n_bytes long, schema string").write.mode("overwrite").parquet(f"{tmp_path}/pointer/slot=1")
    assert Store(spark, str(tmp_path), 4).version == 2
    assert content(Store(spark, str(tmp_path), 4).read("rolled")) == content(rolled(games(spark, 0, 30)))
    bring_in(Store(spark, str(tmp_path), 4), [RAW], STAGES, {"raw": games(spark, 0, 20).withColumn("pitches", F.lit(1.0))})
    bring_in(Store(spark, str(tmp_path), 4), [RAW], STAGES, {"raw": games(spark, 0, 20)})
    assert len(vacuum(spark, str(tmp_path), again)) == sum(len(again.cells(n)) for n in ("raw", "rolled", "seasons"))
    assert content(Store(spark, str(tmp_path), 4).read("rolled")) == content(rolled(games(spark, 0, 30)))


def test_stream_of_files(spark, tmp_path):
    arrivals, check = str(tmp_path / "in"), str(tmp_path / "check")
    store = Store(spark, str(tmp_path / "s"), 4)
    for first, last in ((0, 25), (20, 40), (40, 60)):
        games(spark, first, last).withColumn("gone", F.col("game_pk") == 22).write.mode("append").parquet(arrivals)
        stream_refresh(spark, arrivals, SCHEMA + ", gone boolean", store, RAW, STAGES, check, "gone").awaitTermination()
    full = games(spark, 0, 60).where("game_pk <> 22")
    assert content(store.read("rolled")) == content(rolled(full)) and seasons(store) == expected_seasons(full)


def test_matrix_fit_is_kept_until_training_rows_change(spark, tmp_path):
    def rows(first, last):
        return games(spark, first, last).selectExpr("*", "pitches as strikeouts", "pitches / 2 as x_mean_3", "cast(game_pk % 4 as string) as weather")

    def joined():
        return Stage(Table("joined", ("game_pk",), ("game_pk", "pitcher_id")), ("raw",), lambda d: d.drop("pitches"))

    store, years = Store(spark, str(tmp_path), 4), (2022, 2023)
    raw = Table("raw", ("game_pk", "pitcher_id"), ("game_pk", "pitcher_id"), bucket=("game_pk",))

    def bring(df, deleted=None):
        def last(build, changes):
            staged._refresh_matrix(build, changes, years)

        return bring_in(store, [raw], [joined()], {"raw": df}, deleted, last)

    def want(df):
        made = matrix.finish_matrix(df.drop("pitches"), train_years=years)
        return made.columns, sorted(map(str, made.collect()))

    def got():
        made = store.read("matrix")
        return made.columns, sorted(map(str, made.collect()))

    bring(rows(0, 50))
    assert got() == want(rows(0, 50))
    build = bring(rows(50, 60))  # after the training years
    assert got() == want(rows(0, 60)) and "fit_bounds" not in build.rewritten
    assert {s for s, _ in build.rewritten["matrix"]} == {r.y for r in rows(50, 60).select(F.year("game_date").alias("y")).collect()}
    build = bring(rows(3, 4).withColumn("x_mean_3", F.lit(50.0)))
    assert "fit_bounds" in build.rewritten
    assert got() == want(rows(0, 60).withColumn("x_mean_3", F.when(F.col("game_pk") == 3, 50.0).otherwise(F.col("x_mean_3"))))
    with pytest.raises(ValueError):
        matrix.fit_matrix(rows(0, 5).drop("pitches"), train_years=(1999,), one_sided="error")


def test_bad_files_are_set_aside(spark, tmp_path):
    (tmp_path / "j").mkdir()
    for name, body in (("a", '{"n":\n 1}'), ("b", '{"n": 1'), ("c", " \n"), ("d", '{"n": [2]}')):
        (tmp_path / "j" / f"{name}.json").write_text(body)
    rows, bad = S.read_json_files(spark, str(tmp_path / "j"), "n long")
    assert [r.n for r in rows.collect()] == [1]
    assert sorted((r.path[-6:], r.reason) for r in bad.collect()) == [("b.json", "not JSON"), ("c.json", "empty file"), ("d.json", "other shape")]
    (tmp_path / "c.csv").write_text("n,d\n1,2024-04-01\nx,2024-04-01\n2\n3,not a day\n4,2024-05-06\n")
    rows, bad = S.read_csv_files(spark, str(tmp_path / "c.csv"), "n int, d date")
    assert sorted(r.n for r in rows.collect()) == [1, 4]
    assert sorted(r.line for r in bad.collect()) == ["2", "3,not a day", "x,2024-04-01"]


def test_sorted_tables_and_pruned_loads(spark, tmp_path):
    df = games(spark, 0, 60).withColumn("y_mean_3", F.lit(1.0))
    path = str(tmp_path / "m")
    S.write_sorted(df.repartition(7), path, ["game_date", "game_pk"], files=3)
    ranked = {r.game_pk: r.rank for r in S.read_sorted(spark, path, ["game_date"]).collect()}
    assert ranked == {i: i for i in range(60)}
    got = S.load_matrix(spark, path, ["y_mean_3", "none"], "pitches", year=2023)
    assert got.columns == ["game_pk", "pitcher_id", "game_date", "pitches", "y_mean_3"]
    assert {r.game_date.year for r in got.collect()} == {2023}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(game_date,2023-01-01)" in plan and "LessThan(game_date,2024-01-01)" in plan
    assert dt.date(2023, 1, 1) <= got.agg(F.min("game_date")).first()[0]


def test_tables_that_do_not_need_each_other_are_made_at_once(spark, tmp_path):
    both = threading.Barrier(2, timeout=60)

    def beside(rows):
        both.wait()  # in turn, the first would wait in vain
        return rows.select("k", "d")

    def after(left, right):
        return left.join(right.select("k"), "k")

    stages = [
        Stage(Table("left", ("k",), ("k",), "d"), ("base",), beside),
        Stage(Table("right", ("k",), ("k",), "d"), ("base",), beside),
        Stage(Table("after", ("k",), ("k",), "d"), ("left", "right"), after),
    ]
    store = Store(spark, str(tmp_path / "s"), buckets=2)
    rows = spark.createDataFrame([(k, dt.date(2024, 1, 1 + k)) for k in range(5)], "k int, d date")
    bring_in(store, [Table("base", ("k",), ("k",), "d")], stages, {"base": rows})
    assert sorted(r["k"] for r in store.read("after").collect()) == list(range(5))


def test_the_first_error_of_tables_made_at_once_ends_the_build(spark, tmp_path):
    def fail(rows):
        raise ValueError("no")

    base = Table("base", ("k",), ("k",), "d")
    stages = [
        Stage(Table("good", ("k",), ("k",), "d"), ("base",), lambda rows: rows),
        Stage(Table("bad", ("k",), ("k",), "d"), ("base",), fail),
    ]
    store = Store(spark, str(tmp_path / "s"), buckets=2)
    rows = spark.createDataFrame([(1, dt.date(2024, 1, 1))], "k int, d date")
    with pytest.raises(ValueError, match="no"):
        bring_in(store, [base], stages, {"base": rows})
    assert "good" not in Store(spark, str(tmp_path / "s"), buckets=2)
