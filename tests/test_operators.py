"""Joins, intervals, aggregates, encodings and scalars on small frames with known results."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lagwise.functions import aggregates as A
from lagwise.functions import scalars as X
from lagwise.operators import aggregates as G
from lagwise.operators import clean, encode, folds, intervals, joins
from lagwise.plans import baseball as B


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


# --- joins -------------------------------------------------------------------------

def test_coalescing_join_takes_left_then_right(spark):
    left = spark.createDataFrame([(1, 10, None), (2, None, 5), (None, 1, 1)], "k int, a int, b int")
    right = spark.createDataFrame([(1, 99, 7), (3, 1, 1), (None, 8, 8)], "k int, a int, c int")
    assert rows(joins.coalescing_join(left, right, ["k"])) == [(None, 1, 1, None), (1, 10, None, 7), (2, None, 5, None)]
    outer = joins.coalescing_join(left.dropna(subset=["k"]), right.dropna(), ["k"], "full")
    assert {r.k for r in outer.collect()} == {1, 2, 3}


def test_suffixed_columns_fold_to_their_base(spark):
    df = spark.createDataFrame([(None, 2, 3, 9), (1, 2, 3, 9)], "a_x int, a_y int, a_x_y int, b_y int")
    assert joins.merge_suffixed(df).columns == ["a", "b"]
    assert rows(joins.merge_suffixed(df)) == [(1, 9), (2, 9)]
    kept = spark.createDataFrame([(5, None)], "a_x int, a int")
    assert rows(joins.merge_suffixed(kept)) == [(5,)]


def test_dedup_keeps_one_whole_row(spark):
    df = spark.createDataFrame([(1, 5, "z"), (1, 4, "y"), (1, 4, "x"), (2, 1, None)], "k int, a int, b string")
    assert rows(joins.dedup(df, ["k"])) == [(1, 4, "x"), (2, 1, None)]
    assert rows(joins.dedup(df, ["k"], ["b"])) == [(1, 4, "x"), (2, 1, None)]
    assert rows(joins.last_row(df, ["k"], ["a", "b"])) == [(1, 5, "z"), (2, 1, None)]


def test_fill_from_never_multiplies_rows(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "g int")
    source = spark.createDataFrame([(1, "2024-01-01"), (1, "2024-01-01")], "g int, d string")
    assert rows(joins.fill_from(df, source, ["g"], "d"), "g") == [(1, "2024-01-01"), (1, "2024-01-01"), (2, None)]


def test_anti_and_semi(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "g int")
    done = spark.createDataFrame([(2,), (2,)], "g int")
    assert rows(joins.not_yet_processed(df, done, ["g"])) == [(1,), (3,)]
    assert rows(joins.only_listed(df, done, ["g"])) == [(2,)]


# --- intervals ---------------------------------------------------------------------

def random_marks(n=600, seed=2):
    rng = np.random.default_rng(seed)
    return pd.DataFrame(
        {
            "p": np.where(rng.random(n) < 0.6, 1, rng.integers(2, 6, n)).astype("int64"),
            "d": pd.Timestamp("2021-01-01") + pd.to_timedelta(rng.permutation(n), "D"),
            "action": rng.choice(["start", "end", "other"], n),
        }
    )


@pytest.mark.parametrize("max_rows", [None, 40])
def test_stints_and_state_match_a_plain_loop(spark, max_rows):
    marks = random_marks()
    df = spark.createDataFrame(marks).withColumn("d", F.to_date("d"))
    got = intervals.stints_from_events(df, ["p"], ["d"], "action", max_rows=max_rows)
    want = []
    for p, g in marks[marks.action != "other"].sort_values("d").groupby("p"):
        begun = None
        for r in g.itertuples():
            if r.action == "start":
                begun = r.d.date()
            elif begun is not None:
                want.append((p, begun, r.d.date()))
                begun = None
        if begun is not None:
            want.append((p, begun, None))
    assert sorted(rows(got, "p", "start_date")) == sorted(want)

    games = df.select("p", F.date_add("d", 1).alias("d"))
    state = intervals.stint_state(games, got, "p", "d", "p").collect()
    assert len(state) == len(marks)
    for r in state:
        mine = [s for s in want if s[0] == r.p]
        on = any(s[1] <= r.d and (s[2] is None or r.d < s[2]) for s in mine)
        ended = [s[2] for s in mine if s[2] is not None and s[2] <= r.d]
        assert r.on_il == int(on)
        assert r.days_since_il == ((r.d - max(ended)).days if ended else None)


def test_stint_state_with_overlaps_nulls_and_unknown_players(spark):
    stints = spark.createDataFrame(
        [(1, dt.date(2024, 1, 1), dt.date(2024, 3, 1)), (1, dt.date(2024, 1, 5), dt.date(2024, 1, 10)), (None, dt.date(2024, 1, 1), None)],
        "player_id int, start_date date, end_date date",
    )
    games = spark.createDataFrame(
        [(1, dt.date(2024, 1, 20)), (1, dt.date(2024, 3, 1)), (2, dt.date(2024, 1, 2)), (None, dt.date(2024, 1, 2)), (1, None)],
        "pitcher_id int, game_date date",
    )
    got = rows(intervals.stint_state(games, stints, "pitcher_id", "game_date", "player_id"))
    assert got == [
        (None, dt.date(2024, 1, 2), 0, None),
        (1, None, 0, None),
        (1, dt.date(2024, 1, 20), 1, 10),
        (1, dt.date(2024, 3, 1), 0, 0),
        (2, dt.date(2024, 1, 2), 0, None),
    ]


# --- aggregates --------------------------------------------------------------------

def test_weighted_means_differ_on_missing_values(spark):
    df = spark.createDataFrame([(1.0, 1), (None, 3), (4.0, None), (3.0, 1)], "v double, w int")
    row = df.agg(F.expr(A.weighted_mean("v", "w")).alias("a"), F.expr(A.ratio_of_sums("v", "w")).alias("b")).first()
    assert row.a == 2.0 and row.b == pytest.approx(4 / 5)
    empty = df.where("v > 100").agg(F.expr(A.weighted_mean("v", "w")).alias("a"), F.expr(A.total("v")).alias("t")).first()
    assert empty.a is None and empty.t == 0


def test_require_unique(spark):
    df = spark.createDataFrame([(1, "A"), (1, "A"), (1, "B")], "game_pk int, pitching_team string")
    with pytest.raises(G.DuplicateRowsError):
        G.require_unique(df, ["game_pk", "pitching_team"])
    G.require_unique(df.distinct(), ["game_pk", "pitching_team"])


def test_quantiles_match_pandas_and_skip_missing(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, np.nan, 10.0, 4.0], "b": [5.0, 5.0, 6.0, 7.0, 100.0]})
    got = G.column_quantiles(spark.createDataFrame(pdf), ["a", "b"], (0.01, 0.99))
    for c in "ab":
        assert got[c] == pytest.approx([pdf[c].quantile(0.01), pdf[c].quantile(0.99)])


@pytest.mark.parametrize("budget", [50, 3000])
def test_quantiles_are_exact_when_values_cannot_all_be_counted(spark, budget):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"a": rng.normal(size=20_000), "b": np.where(rng.random(20_000) < 0.7, 3.0, rng.random(20_000)), "c": 1.0})
    pdf.loc[:3000, "a"] = np.nan
    probabilities = (0.0, 0.01, 0.5, 0.99, 1.0)
    got = G.column_quantiles(spark.createDataFrame(pdf), ["a", "b", "c"], probabilities, budget=budget)
    for c in "abc":
        assert got[c] == pytest.approx([pdf[c].quantile(p) for p in probabilities], rel=1e-9)


# --- encodings ---------------------------------------------------------------------

def test_mean_target_encoding(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2), ("b", 4)], "cat string, y long")
    encoded, maps = encode.mean_target_encode(df, ["cat"], "y")
    assert [r.cat_enc for r in encoded.orderBy("cat", "y").collect()] == [2, 2, 3, 3]
    new = spark.createDataFrame([("a",), ("c",), (None,)], "cat string")
    again, _ = encode.mean_target_encode(new, ["cat"], mapping=maps)
    assert {r.cat: r.cat_enc for r in again.collect()} == {"a": 2.0, "c": None, None: None}
    with pytest.raises(KeyError):
        encode.mean_target_encode(new, ["other"], mapping=maps)
    with pytest.raises(ValueError):
        encode.mean_target_encode(new, ["cat"])


def test_winsor_and_log(spark):
    df = spark.createDataFrame([(float(i), -1.0, None if i == 3 else 2.0, 0.5) for i in range(101)], "a double, b double, c double, d double")
    bounds = encode.winsor_bounds(df, ["a", "c"])
    assert bounds["a"] == (1.0, 99.0)
    out = encode.winsorize(df, bounds)
    assert out.agg(F.min("a"), F.max("a"), F.count("c")).first()[:] == (1.0, 99.0, 100)
    # negative, missing and small columns get no log
    assert encode.log_columns(df, ["a", "b", "c", "d"]) == ["a"]
    assert encode.log_columns(df, ["a"], {"a": (0.0, 0.9)}) == []
    assert encode.add_logs(out, ["a"]).agg(F.max("log_a")).first()[0] == pytest.approx(math.log1p(99))


# --- cleaning and folds ------------------------------------------------------------

def test_column_rules(spark):
    df = spark.createDataFrame(
        [(1, 2, 1.0, 1.0, 1.0, 1.0, "x", 3)],
        "game_pk int, leak int, fip_mean_3 double, fip_mean_100 double, fip_ewm_7 double, temp double, hp string, strikeouts int",
    )
    kept = clean.leakage_guard(clean.drop_stale_windows(df, (3, 5)), "strikeouts", B.ALLOWED_BASE_NUMERIC, ["game_pk"])
    assert kept.columns == ["game_pk", "fip_mean_3", "fip_ewm_7", "temp", "hp", "strikeouts"]
    assert clean.candidate_features(kept, "strikeouts", ["game_pk"]) == ["fip_mean_3", "fip_ewm_7", "temp"]
    assert clean.categorical_columns(kept, ["temp"], "strikeouts") == ["hp"]


def test_optional_columns_and_season_filter(spark):
    df = spark.createDataFrame([(1, "R"), (2, "S")], "g int, game_type string")
    assert rows(clean.regular_season(df)) == [(1, "R")]
    assert clean.regular_season(df.drop("game_type")).count() == 2
    days = {r.day for r in clean.calendar(spark, "2019-11-01", "2021-03-10").collect()}
    assert days == {dt.date(2019, 11, n) for n in range(1, 5)} | {dt.date(2021, 3, n) for n in range(7, 11)}


@pytest.mark.parametrize("max_rows", [1_000_000, 7])
def test_time_folds(spark, max_rows):
    df = spark.range(103).select(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 10).cast("int")).alias("d"), "id")
    got = folds.time_folds(df, ["d", "id"], 5, max_rows=max_rows).groupBy("fold").agg(F.count("*").alias("n"), F.min("id").alias("a"))
    assert rows(got) == [(0, 18, 0), (1, 17, 18), (2, 17, 35), (3, 17, 52), (4, 17, 69), (5, 17, 86)]


# --- scalars -----------------------------------------------------------------------

def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_scalars(spark):
    lit = F.lit
    assert one(spark, X.first_number(lit("12 mph, Out"))) == 12.0
    assert one(spark, X.first_number(lit("calm"))) is None
    assert one(spark, X.ratio(lit(1), lit(0))) is None
    assert one(spark, X.clip(lit(None).cast("double"), lit(0.0), lit(1.0))) is None
    assert one(spark, X.round_half_even(lit(2.5))) == 2.0
    assert one(spark, X.first_of_json_list(lit("[12, 5]"))) == 12
    assert one(spark, X.first_of_json_list(lit("oops"))) is None
    assert one(spark, X.clock_time(lit("2024-07-04T17:10:00Z"))) == "05:10 PM"
    assert one(spark, X.clock_time(lit("TBD"))) == "TBD"
    assert one(spark, X.date_from_dashed_id(lit("14-1-2024-07-04"), lit(None).cast("string"))) == dt.date(2024, 7, 4)
    assert one(spark, X.date_from_dashed_id(lit("id-2024-07-04-x"), lit("2024-07-05T01:00:00Z"))) == dt.date(2024, 7, 5)
    assert one(spark, X.player_id_from_link(lit("https://x/player/a-b-605135"))) == 605135
    assert one(spark, X.stint_action(lit("Transferred to the 60-day Injured List"))) == "start"
    assert one(spark, X.stint_action(lit("activated from the injured list"))) == "end"
    assert one(spark, X.stint_action(lit("Placed on waivers"))) is None
    assert one(spark, X.bet_player(lit("John Doe Over 5.5"))) == "John Doe"
    assert one(spark, X.bet_side(lit("John Doe Under 5.5"))) == "under"
    assert one(spark, X.day_of_week(lit("2024-04-01").cast("date"))) == 0
    assert [one(spark, X.month_bucket(lit(f"2024-{m:02}-01").cast("date"))) for m in (4, 5, 9)] == ["early", "mid", "late"]
    miles = one(spark, X.haversine_miles(lit(40.8296), lit(-73.9262), lit(42.3467), lit(-71.0972)))
    assert miles == pytest.approx(179.9, abs=1.0)
    assert one(spark, X.haversine_miles(lit(None).cast("double"), lit(1.0), lit(1.0), lit(1.0))) is None


def test_feature_groups_follow_exact_names_then_first_prefix(spark):
    names = ["days_into_season", "opp_batter_x", "fastball_pct_mean_3", "temp", "fip_mean_3", "spin_x"]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    group = X.group_by_name("f", B.FEATURE_NAME_GROUPS, B.FEATURE_PREFIX_GROUPS, B.DEFAULT_FEATURE_GROUP)
    got = {r.f: r.g for r in df.select("f", group.alias("g")).collect()}
    assert got == dict(zip(names, ["Context", "Opponent", "Pitch_Quality", "Context", "Performance", "Pitch_Quality"]))


def test_infinite_bounds_and_values(spark):
    from lagwise.operators.aggregates import column_quantiles
    from lagwise.operators.encode import winsorize

    df = spark.range(40).selectExpr("case when id = 39 then double('infinity') else cast(id as double) end as x")
    assert winsorize(df, {"x": (5.0, float("inf"))}).agg(F.min("x"), F.max("x")).first() == (5.0, float("inf"))
    assert column_quantiles(df, ["x"], [0.5], budget=20)["x"] == [19.5]


def test_scratch_folder_only_in_local_mode(spark, monkeypatch):
    from lagwise import session

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    monkeypatch.setattr(Session, "conf", type("C", (), {"get": staticmethod(lambda *a: None)})())
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def test_quantiles_of_many_wide_columns(spark):
    """More ranks than one pass takes, each with more distinct values than the budget."""
    names = [f"c{k}" for k in range(40)]
    df = spark.range(400).select(*[((F.col("id") * (2 * k + 1)) % 401).cast("double").alias(c) for k, c in enumerate(names)]).cache()
    got = G.column_quantiles(df, names, (0.01, 0.99), budget=300)
    rows = df.toPandas()
    for c in names:
        assert got[c] == pytest.approx(rows[c].quantile([0.01, 0.99]).tolist())


def test_pivot_takes_the_first_value_of_an_order(spark):
    rows = [(1, "a", 3, None), (1, "a", 5, 7.0), (1, "a", 9, 50.0), (1, "b", 1, 2.0), (2, "b", 4, 1.0), (2, "c", 0, 9.0)]
    df = spark.createDataFrame(rows, "k int, kind string, at int, v double")
    names, values = {"a": "A", "b": "B"}, {"v": "v_{}"}
    first = sorted(tuple(r) for r in G.pivot_first(df, ["k"], "kind", names, values, ["at"]).collect())
    assert first == [(1, 7.0, 2.0), (2, None, 1.0)]
    largest = sorted(tuple(r) for r in G.pivot_first(df, ["k"], "kind", names, values).collect())
    assert largest == [(1, 50.0, 2.0), (2, None, 1.0)]


def test_lookup_spreads_rows_without_a_key(spark):
    df = spark.createDataFrame([(1, "x"), (None, "y"), (None, None), (2, "z"), (7, "w")], "id int, note string")
    table = spark.createDataFrame([(1, "one"), (2, "two")], "id int, name string")
    small, large = (joins.lookup_join(df, table, ["id"], broadcast_rows=n) for n in (100, 0))
    assert small.columns == large.columns == ["id", "note", "name"]
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    assert joins.fits_broadcast(table) and not joins.fits_broadcast(table, 1) and not joins.fits_broadcast(table, size=10)


def test_packed_join_is_a_chain_of_coalescing_joins(spark):
    keys = "g int, p int"
    a = spark.createDataFrame([(1, 1, 1.0, None), (1, 2, None, "a"), (2, 1, 3.0, None), (None, 3, 4.0, "n")], f"{keys}, x double, t string")
    a2 = spark.createDataFrame([(1, 1, 9.0, 7), (2, 1, 9.0, None)], f"{keys}, x double, day int")
    b = spark.createDataFrame([(1, 1, 5.0, "b"), (1, 2, 6.0, "b"), (None, 3, 0.0, "b")], f"{keys}, x double, t_x string")
    b2 = spark.createDataFrame([(2, 1, 1), (1, 2, 2)], f"{keys}, more int")
    c = spark.createDataFrame([(1, 1, 1), (1, 1, 2)], f"{keys}, twice int")
    on = ["g", "p"]
    chain = joins.coalescing_join(a.join(a2.drop("x"), on, "left"), b.join(b2, on, "left"), on, "left")
    chain = joins.coalescing_join(chain, c, on, "left")
    made = joins.packed_join([[a, a2], [b, b2], [c]], on)
    assert set(made.columns) == set(chain.columns)
    assert sorted(map(str, made.collect())) == sorted(map(str, chain.select(*made.columns).collect()))
