"""Rolling operators against pandas, with and without cutting hot keys into blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lagwise.operators import rolling, sequence


def game_log(rows=900, seed=5):
    """One key with two thirds of the rows, NULL values and long NULL runs."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(rows) < 0.66, 1, rng.integers(2, 12, rows))
    pdf = pd.DataFrame(
        {
            "k": key.astype("int64"),
            "d": pd.Timestamp("2020-01-01") + pd.to_timedelta(rng.integers(0, 300, rows), "D"),
            "id": np.arange(rows).astype("int64"),
            "x": rng.normal(5, 3, rows),
            "y": rng.normal(50, 20, rows),
        }
    )
    pdf.loc[rng.random(rows) < 0.1, "x"] = np.nan
    pdf = pdf.sort_values(["k", "d", "id"], ignore_index=True)
    hot = pdf.index[pdf.k == 1]
    pdf.loc[hot[150:400], "y"] = np.nan
    return pdf


def as_spark(spark, pdf):
    df = spark.createDataFrame(pdf)
    nulls = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("x", "y")]
    return df.select("k", F.to_date("d").alias("d"), "id", *nulls)


def expected_bundle(pdf, cols, windows, halflife):
    parts = []
    for _, g in pdf.groupby("k"):
        g = g.sort_values(["d", "id"]).copy()
        for c in cols:
            prev = g[c].shift(1)
            for n in windows:
                roll = prev.rolling(n, min_periods=1)
                g[f"{c}_mean_{n}"] = roll.mean()
                g[f"{c}_std_{n}"] = roll.std()
                g[f"{c}_momentum_{n}"] = prev - g[f"{c}_mean_{n}"]
            e = prev.ewm(halflife=halflife, min_periods=1).mean()
            g[f"{c}_ewm_{int(halflife)}"] = e
            g[f"{c}_momentum_ewm_{int(halflife)}"] = prev - e
        parts.append(g)
    return pd.concat(parts).sort_values("id", ignore_index=True)


@pytest.mark.parametrize("max_rows", [None, 1_000_000, 130])
def test_bundle_matches_pandas(spark, max_rows):
    pdf = game_log()
    got = (
        rolling.rolling_bundle(
            as_spark(spark, pdf), ["k"], ["d", "id"], ["x", "y"], windows=(3, 50), halflife=2, max_rows=max_rows
        )
        .toPandas()
        .sort_values("id", ignore_index=True)
    )
    want = expected_bundle(pdf, ["x", "y"], (3, 50), 2)
    assert len(got) == len(want)
    for c in want.columns[5:]:
        # Near-equal values can make a deviation of about 1e-8 instead of 0.
        np.testing.assert_allclose(
            got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-7, atol=1e-6, err_msg=c
        )


def test_split_blocks_are_bounded(spark):
    df = as_spark(spark, game_log())
    layout = sequence.lay_out(df, ["k"], ["d", "id"], before=20, max_rows=100)
    sizes = layout.df.groupBy(*layout.partition).count().toPandas()
    assert layout.split
    assert sizes["count"].max() <= 120
    assert layout.finish(layout.df).count() == 900


def test_positions_follow_the_order(spark):
    pdf = game_log()
    got = sequence.with_positions(as_spark(spark, pdf), ["k"], ["d", "id"], max_rows=3).toPandas()
    want = pdf.sort_values(["k", "d", "id"]).groupby("k").cumcount()
    merged = got.set_index("id")["_pos"].sort_index()
    assert (merged.to_numpy() == want.reindex(pdf.sort_values(["k", "d", "id"]).index)[pdf.sort_values("id").index].to_numpy()).all()


def test_positions_by_timestamp_and_integer(spark):
    df = spark.range(5000).select(
        (F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 37)).alias("ts"),
        (F.col("id") * 31 - 40000).alias("n"),
        "id",
    )
    for order in (["ts", "id"], ["n"]):
        got = sequence.with_positions(df, [], order, max_rows=40)
        assert got.where(F.col("_pos") != F.col("id")).count() == 0


@pytest.mark.parametrize("max_rows", [None, 100])
def test_day_and_row_sums(spark, max_rows):
    pdf = game_log()
    df = as_spark(spark, pdf)
    days = rolling.sum_last_days(df, ["k"], "d", {"s": ("x", 30)}, max_rows=max_rows).toPandas()
    rows = rolling.sum_last_rows(df, ["k"], ["d", "id"], {"s": ("x", 7)}, max_rows=max_rows).toPandas()
    assert len(days) == len(rows) == len(pdf)
    by_id = pdf.set_index("id")
    for r in days.sample(80, random_state=1).itertuples():
        me = by_id.loc[r.id]
        hit = pdf[(pdf.k == r.k) & (pdf.d < me.d) & (pdf.d >= me.d - pd.Timedelta(days=30))].x
        want = hit.sum(min_count=1)
        assert (np.isnan(want) and np.isnan(r.s)) or abs(want - r.s) < 1e-9
    want = pdf.groupby("k").x.transform(lambda s: s.shift(1).rolling(7, min_periods=1).sum())
    got = rows.set_index("id").s.reindex(pdf.id).to_numpy()
    np.testing.assert_allclose(got, want.to_numpy(), atol=1e-9)


def test_rest_days_and_season_day(spark):
    df = spark.sql(
        "select * from values (1, date'2023-09-28', 1), (1, date'2024-04-01', 2), (1, date'2024-04-08', 3) t(k, d, id)"
    )
    rest = rolling.rest_days(df, ["k"], ["d", "id"]).orderBy("d").collect()
    assert [r.rest_days for r in rest] == [None, 186, 7]
    days = rolling.season_day(df, "d").orderBy("d").collect()
    assert [r.days_into_season for r in days] == [0, 0, 7]


def test_windows_do_not_cross_keys_or_see_the_future(spark):
    pdf = game_log(200)
    df = as_spark(spark, pdf)
    before = rolling.rolling_bundle(df, ["k"], ["d", "id"], ["x"], windows=(3,), halflife=7)
    later = spark.sql("select 1L k, date'2031-01-01' d, 10000L id, 999D x, 1D y")
    after = rolling.rolling_bundle(df.union(later), ["k"], ["d", "id"], ["x"], windows=(3,), halflife=7)
    a = before.toPandas().sort_values("id", ignore_index=True)
    b = after.where("id < 10000").toPandas().sort_values("id", ignore_index=True)
    pd.testing.assert_frame_equal(a, b)
    first = a.sort_values(["k", "d", "id"]).groupby("k").head(1)
    assert first["x_mean_3"].isna().all()


def test_clustered_order_values_are_cut_evenly(spark):
    near = spark.range(3000).select(F.col("id"))
    far = spark.range(5).select((F.col("id") * 10**13 + 10**14).alias("id"))
    df = near.union(far).select(F.lit(1).alias("k"), F.lit("2024-01-01").cast("date").alias("d"), "id")
    layout = sequence.lay_out(df, ["k"], ["d", "id"], before=5, max_rows=100)
    ranked = layout.finish(layout.df.withColumn("p", F.col("_pos")))
    assert ranked.where("id < 3000 and p != id").count() == 0
    assert ranked.count() == 3005
    assert layout.df.groupBy(*layout.partition).count().agg(F.max("count")).first()[0] <= 105


@pytest.mark.parametrize("max_rows", [None, 2])
def test_undated_rows_are_in_no_day_sum(spark, max_rows):
    rows = [(1, None, "5"), (1, None, "6"), (1, "2024-04-01", "10"), (1, "2024-04-03", "20")]
    df = spark.createDataFrame(rows, "k long, d string, x string").selectExpr("k", "cast(d as date) d", "cast(x as decimal(10,2)) x")
    out = rolling.sum_last_days(df, ["k"], "d", {"s": ("x", 7)}, max_rows=max_rows)
    assert out.schema["s"].dataType.simpleString() == "decimal(20,2)"
    assert {(r.x, r.s) for r in out.collect()} == {(5, None), (6, None), (10, None), (20, 10)}


@pytest.mark.parametrize("kind", ["string", "double", "decimal(12,3)", "boolean"])
def test_any_order_type_can_be_cut(spark, kind):
    value = {"string": "concat('2024-01-', lpad(id % 28, 2, '0'), ' ', id % 24)", "double": "(id * 37 % 100) / 7 - 6", "decimal(12,3)": "id * 31 % 97 - 40.5", "boolean": "id % 2 = 0"}[kind]
    df = spark.range(60).selectExpr("id % 2 as k", f"cast({value} as {kind}) as o", "id", "cast(id as double) as x")
    df = df.withColumn("o", F.when(F.col("id") % 13 != 0, F.col("o")))
    want = rolling.sum_last_rows(df, ["k"], ["o", "id"], {"s": ("x", 3)}, max_rows=None)
    got = rolling.sum_last_rows(df, ["k"], ["o", "id"], {"s": ("x", 3)}, max_rows=20)
    assert sorted(map(str, got.select("id", "s").collect())) == sorted(map(str, want.select("id", "s").collect()))
