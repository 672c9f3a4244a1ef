"""Tables of hundreds of columns: what a task holds must not grow with them."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lagwise import session
from lagwise.operators import encode, rolling

VALUES = [f"v{i}" for i in range(6)] + ["n"]


def rows(spark):
    return spark.range(2000).select(
        "id", (F.col("id") % 3).alias("k"), F.expr("case when id % 13 > 0 then concat('g', id % 4) end").alias("place"),
        F.expr("date'2021-01-01' + cast(id * 37 % 700 as int)").alias("day"),
        *[F.expr(f"case when id % {i + 4} > 0 then sin(id * {i + 1}) end").alias(f"v{i}") for i in range(5)],
        F.expr("if(id % 9 = 0, double('nan'), 2.5D)").alias("v5"), (F.col("id") * 11 % 17).alias("n"),
    )


def window_widths(df):
    found, todo = [], [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Window":
            found.append(node.output().size())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_windows_of_a_wide_bundle_hold_narrow_rows(spark):
    """Else the rows that a task sorts and buffers for a group grow with the columns."""
    made = rolling.rolling_bundle(rows(spark), ["k"], ["day", "id"], VALUES, halflife=7)
    assert max(window_widths(made)) < 80 < 17 * len(VALUES)


@pytest.mark.parametrize("max_rows, keep", [(None, True), (300, False)])
def test_a_wide_bundle_equals_one_by_columns(spark, monkeypatch, max_rows, keep):
    """Long windows put together from shorter ones, hot keys, missing keys and values."""
    made = []
    for least in (10**6, 0):
        monkeypatch.setattr(rolling, "WIDE_OUTPUTS", least)
        made.append(rolling.rolling_bundle(
            rows(spark), ["place"], ["day", "id"], ["v0", "v5", "n"], (3, 5, 10, 20), 7, "p_", max_rows, keep))
    plain, wide = ({r["id"]: r.asDict() for r in df.collect()} for df in made)
    assert plain.keys() == wide.keys() and set(made[0].columns) == set(made[1].columns)
    for i, row in plain.items():
        for c, value in row.items():
            want = pytest.approx(value, rel=1e-12, abs=1e-12) if isinstance(value, float) else value
            assert wide[i][c] == want, (i, c)


def test_bundles_together_equal_bundles_in_turn(spark):
    df = rows(spark)
    bundles = [rolling.Bundle((k,), ("day", "id"), VALUES, (3, 5, 10), 7, f"{k}_", None, True) for k in ("place", "k")]
    both, turn = rolling.rolling_bundles(df, bundles), rolling.rolling_bundles(rolling.rolling_bundles(df, bundles[:1]), bundles[1:])
    assert both.columns == turn.columns and both.dtypes == turn.dtypes
    assert both.exceptAll(turn).isEmpty() and both.count() == turn.count() == 2000


def test_wide_scratch_tables_have_no_dictionaries(spark):
    """A dictionary per column and task is memory that grows with the columns."""
    wide = spark.range(50).select(*[(F.col("id") % 3).cast("double").alias(f"c{i}") for i in range(session.DICTIONARY_COLUMNS + 1)])
    for df, kept in ((wide, False), (wide.select("c0"), True)):
        group = pq.ParquetFile(session.settle(df).inputFiles()[0].removeprefix("file:")).metadata.row_group(0)
        assert any("DICTIONARY" in e for e in group.column(0).encodings) == kept


def test_encodings_are_joined_to_few_columns(spark):
    df = rows(spark).selectExpr("*", *[f"v0 * {i} as w{i}" for i in range(40)])
    maps = encode.fit_target_means(df, ["place"], "n")
    done = encode.apply_target_means(df, ["place"], maps)
    assert done.columns == [*df.columns, "place_enc"]
    assert done.drop("place_enc").exceptAll(df).isEmpty() and done.count() == 2000
