"""Windows over orders per customer and events per user or type."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagwise.functions import aggregates as A
from lagwise.operators import folds, intervals, rolling
from lagwise.operators.joins import last_row
from lagwise.streaming.incremental import refresh
from lagwise.session import scratch_path
from workload.common import d, i, orders, r, table, tidy

KEY, ORDER = ["o_custkey"], ["day", "o_orderkey"]
BASE = ["o_orderkey", "o_custkey", "day"]
WINDOWS = (3, 5, 10, 20, 50)


def rolling_customer(spark, sf_dir):
    # Log prices: a mean of 2-decimal prices can lie exactly between two rounded values.
    df = orders(spark, sf_dir).select(*BASE, F.log("o_totalprice").alias("log_price"))
    return tidy(rolling.rolling_bundle(df, KEY, ORDER, ["log_price"], windows=WINDOWS))


def _rolling_sql() -> str:
    cells = []
    for k in WINDOWS:
        w = f"over (partition by o_custkey order by day, o_orderkey rows between {k} preceding and 1 preceding)"
        cells += [
            r(f"avg(log_price) {w}", f"log_price_mean_{k}"),
            r(f"stddev_samp(log_price) {w}", f"log_price_std_{k}"),
            r(f"lag(log_price) over w - avg(log_price) {w}", f"log_price_momentum_{k}"),
        ]
    return f"""
    with o as (select *, cast(o_orderdate as date) as day, ln(o_totalprice) as log_price from orders where o_custkey is not null)
    select o_orderkey, o_custkey, {d('day', 'day')}, {r('log_price', 'log_price')}, {', '.join(cells)}
    from o window w as (partition by o_custkey order by day, o_orderkey)"""


def ewm_customer(spark, sf_dir):
    df = orders(spark, sf_dir).select(*BASE, "o_totalprice")
    return tidy(rolling.rolling_bundle(df, KEY, ORDER, ["o_totalprice"], windows=(), halflife=7), 4)


def ewm_event_type(spark, sf_dir):
    """Few keys with long groups, not cut; ``rolling_hot_key`` is the same with a cut."""
    df = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    out = rolling.rolling_bundle(df, ["event_type"], ["ts", "event_id"], ["value"], windows=(), halflife=7)
    return tidy(out.drop("ts"), 4)


def _ewm_sql(source: str, key: str, order: str, value: str, keep: str) -> str:
    # Closed form with weights 2^(row / h); the past only.
    past = f"over (partition by {key} order by rn rows between unbounded preceding and 1 preceding)"
    ewm = f"sum({value} * w) {past} / sum(case when {value} is not null then w end) {past}"
    return f"""
    with n as (select *, row_number() over (partition by {key} order by {order}) as rn from {source}),
    x as (select *, pow(2.0::double, rn / 7.0::double) as w from n)
    select {keep}, {r(value, value, 4)}, {r(ewm, value + '_ewm_7', 4)},
      {r(f'lag({value}) over (partition by {key} order by rn) - {ewm}', value + '_momentum_ewm_7', 4)}
    from x"""


def rest_days(spark, sf_dir):
    return tidy(rolling.rest_days(orders(spark, sf_dir).select(*BASE), KEY, ORDER))


def sum_last_rows(spark, sf_dir):
    df = orders(spark, sf_dir).select(*BASE, "o_totalprice")
    columns = {"last_7_rows": ("o_totalprice", 7), "last_30_rows": ("o_totalprice", 30)}
    return tidy(rolling.sum_last_rows(df, KEY, ORDER, columns), 2)


def sum_last_days(spark, sf_dir):
    df = orders(spark, sf_dir).select(*BASE, "o_totalprice")
    columns = {"last_90_days": ("o_totalprice", 90), "last_365_days": ("o_totalprice", 365)}
    return tidy(rolling.sum_last_days(df, KEY, "day", columns), 2)


def season_day(spark, sf_dir):
    return tidy(rolling.season_day(orders(spark, sf_dir).select(*BASE), "day"))


def next_event_rate(spark, sf_dir):
    """Share of views that the same user's next event turns into a purchase."""
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    ahead = rolling.shifted(df, ["user_id"], ["ts", "event_id"], {"next_type": "event_type"}, offset=-1)
    hit = A.share_within("event_type = 'view' and next_type = 'purchase'", "next_type is not null")
    return tidy(
        ahead.groupBy("user_id").agg(
            F.count("*").alias("n_events"), F.expr(hit).alias("view_then_purchase")
        )
    )


def last_event_per_user(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return tidy(last_row(df, ["user_id"], ["ts", "event_id"]).drop("ts"), 4)


def _marks(spark, sf_dir):
    action = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "end")
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", action.alias("action"))


def stints(spark, sf_dir):
    return tidy(intervals.stints_from_events(_marks(spark, sf_dir), ["user_id"], ["ts", "event_id"], "action"))


STINTS_SQL = """
    marks as (select user_id, ts, event_id, case event_type when 'signup' then 'start' else 'end' end as action
              from events where event_type in ('signup', 'error') and user_id is not null),
    paired as (select *, lead(action) over w as nxt, lead(ts) over w as nxt_ts
               from marks window w as (partition by user_id order by ts, event_id)),
    stints as (select user_id, cast(ts as date) as start_date, cast(nxt_ts as date) as end_date
               from paired where action = 'start' and (nxt is null or nxt = 'end'))"""


def stint_state(spark, sf_dir):
    found = intervals.stints_from_events(_marks(spark, sf_dir), ["user_id"], ["ts", "event_id"], "action")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("day"))
    return tidy(intervals.stint_state(rows, found, "user_id", "day", "user_id", "on_stint", "days_since_stint"))


def time_folds(spark, sf_dir):
    return tidy(folds.time_folds(orders(spark, sf_dir).select(*BASE), ["day", "o_orderkey"], 5))


def time_folds_integer(spark, sf_dir):
    """Folds over whole numbers that are the order on their own."""
    return tidy(folds.time_folds(orders(spark, sf_dir).select("o_orderkey", "day"), ["o_orderkey"], 7, max_rows=CUT))


def incremental_append(spark, sf_dir):
    """Two loads of the same table, the second past the first one's high-water mark."""
    source = orders(spark, sf_dir).select(*BASE, "o_totalprice")
    target = scratch_path(spark, "increment")

    def compute(df):
        return rolling.rolling_bundle(df, KEY, ORDER, ["o_totalprice"], windows=(3,))

    first_load = source.where(F.col("day") < F.lit("1999-01-01").cast("date"))
    for rows in (first_load, source):
        refresh(spark, rows, target, compute, ["o_orderkey"], KEY, date="day")
    return tidy(spark.read.parquet(target).drop("season"), 4)


# So few rows a key that every event type is cut into blocks.
CUT = 300


def _events(spark, sf_dir):
    """Events with a day that every 50th row lacks, and the time as text."""
    day = F.when(F.col("event_id") % 50 != 0, F.to_date("ts"))
    return table(spark, sf_dir, "events").select(
        "event_id", "event_type", "ts", F.col("ts").cast("string").alias("ts_text"), "value", day.alias("day")
    )


def rolling_hot_key(spark, sf_dir):
    df = _events(spark, sf_dir).select("event_id", "event_type", "ts", "value")
    out = rolling.rolling_bundle(df, ["event_type"], ["ts", "event_id"], ["value"], windows=(3, 10), halflife=7, max_rows=CUT)
    return tidy(out.drop("ts"), 4)


def rolling_hot_key_text(spark, sf_dir):
    """The order is a text; the result must not depend on the cut."""
    df = _events(spark, sf_dir).select("event_id", "event_type", "ts_text", "value")
    out = rolling.rolling_bundle(df, ["event_type"], ["ts_text", "event_id"], ["value"], windows=(3, 10), halflife=7, max_rows=CUT)
    return tidy(out.drop("ts_text"), 4)


def rolling_hot_key_number(spark, sf_dir):
    df = _events(spark, sf_dir).select("event_id", "event_type", "value")
    out = rolling.sum_last_rows(df, ["event_type"], ["value", "event_id"], {"last_7_rows": ("value", 7)}, max_rows=CUT)
    return tidy(out, 4)


def sum_last_days_hot(spark, sf_dir):
    df = _events(spark, sf_dir).select("event_id", "event_type", "day", "value")
    return tidy(rolling.sum_last_days(df, ["event_type"], "day", {"last_7_days": ("value", 7)}, max_rows=CUT), 4)


def sum_last_days_undated(spark, sf_dir):
    df = _events(spark, sf_dir).select("event_id", "event_type", "day", "value")
    return tidy(rolling.sum_last_days(df, ["event_type"], "day", {"last_7_days": ("value", 7)}), 4)


def rest_days_hot(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "event_type", F.to_date("ts").alias("day"))
    return tidy(rolling.rest_days(df, ["event_type"], ["day", "event_id"], max_rows=CUT))


def _incremental(spark, sf_dir, loads):
    source = orders(spark, sf_dir).select(*BASE, "o_totalprice")
    target = scratch_path(spark, "increment")

    def compute(df):
        return rolling.rolling_bundle(df, KEY, ORDER, ["o_totalprice"], windows=(3,))

    for change in (*loads, lambda df: df):
        refresh(spark, change(source), target, compute, ["o_orderkey"], KEY, date="day")
    return tidy(spark.read.parquet(target).drop("season"), 4)


def incremental_late(spark, sf_dir):
    """Every seventh order arrives only with the second load."""
    return _incremental(spark, sf_dir, [lambda df: df.where("o_orderkey % 7 <> 0")])


def incremental_corrected(spark, sf_dir):
    """The first load has wrong prices for every fifth order."""
    wrong = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") * 10).otherwise(F.col("o_totalprice"))
    return _incremental(spark, sf_dir, [lambda df: df.withColumn("o_totalprice", wrong.cast(df.schema["o_totalprice"].dataType))])


QUERIES = {
    "rolling_hot_key": rolling_hot_key,
    "rolling_hot_key_text": rolling_hot_key_text,
    "rolling_hot_key_number": rolling_hot_key_number,
    "sum_last_days_hot": sum_last_days_hot,
    "sum_last_days_undated": sum_last_days_undated,
    "rest_days_hot": rest_days_hot,
    "incremental_late": incremental_late,
    "incremental_corrected": incremental_corrected,
    "rolling_customer": rolling_customer,
    "ewm_customer": ewm_customer,
    "ewm_event_type": ewm_event_type,
    "rest_days": rest_days,
    "sum_last_rows": sum_last_rows,
    "sum_last_days": sum_last_days,
    "season_day": season_day,
    "next_event_rate": next_event_rate,
    "last_event_per_user": last_event_per_user,
    "stints": stints,
    "stint_state": stint_state,
    "time_folds": time_folds,
    "time_folds_integer": time_folds_integer,
    "incremental_append": incremental_append,
}

_O = "(select *, cast(o_orderdate as date) as day from orders where o_custkey is not null)"
_W = "partition by o_custkey order by day, o_orderkey"

ORACLE = {
    "rolling_customer": _rolling_sql(),
    "ewm_customer": _ewm_sql(_O, "o_custkey", "day, o_orderkey", "o_totalprice", f"o_orderkey, o_custkey, {d('day', 'day')}"),
    "ewm_event_type": _ewm_sql("events", "event_type", "ts, event_id", "value", "event_id, event_type"),
    "rest_days": f"""select o_orderkey, o_custkey, {d('day', 'day')},
        {i(f"date_diff('day', lag(day) over ({_W}), day)", 'rest_days')} from {_O}""",
    "sum_last_rows": f"""select o_orderkey, o_custkey, {d('day', 'day')}, {r('o_totalprice', 'o_totalprice', 2)},
        {r(f'sum(o_totalprice) over ({_W} rows between 7 preceding and 1 preceding)', 'last_7_rows', 2)},
        {r(f'sum(o_totalprice) over ({_W} rows between 30 preceding and 1 preceding)', 'last_30_rows', 2)} from {_O}""",
    "sum_last_days": f"""select o_orderkey, o_custkey, {d('day', 'day')}, {r('o_totalprice', 'o_totalprice', 2)},
        {r("sum(o_totalprice) over (partition by o_custkey order by day range between interval 90 days preceding and interval 1 day preceding)", 'last_90_days', 2)},
        {r("sum(o_totalprice) over (partition by o_custkey order by day range between interval 365 days preceding and interval 1 day preceding)", 'last_365_days', 2)} from {_O}""",
    "season_day": f"""select o_orderkey, o_custkey, {d('day', 'day')},
        {i("date_diff('day', min(day) over (partition by year(day)), day)", 'days_into_season')} from {_O}""",
    "next_event_rate": f"""with a as (select user_id, event_type,
          lead(event_type) over (partition by user_id order by ts, event_id) as nxt from events where user_id is not null)
        select user_id, {i('count(*)', 'n_events')},
          {r("avg(case when nxt is not null then case when event_type = 'view' and nxt = 'purchase' then 1 else 0 end end)", 'view_then_purchase')}
        from a group by user_id""",
    "last_event_per_user": f"""select event_id, user_id, event_type, {r('value', 'value', 4)} from events
        qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""",
    "stints": f"with {STINTS_SQL} select user_id, {d('start_date', 'start_date')}, {d('end_date', 'end_date')} from stints",
    "stint_state": f"""with {STINTS_SQL}, e as (select event_id, user_id, cast(ts as date) as day from events)
        select event_id, user_id, {d('day', 'day')},
          {i('''case when exists (select 1 from stints s where s.user_id = e.user_id and s.start_date <= e.day
             and (s.end_date is null or e.day < s.end_date)) then 1 else 0 end''', 'on_stint')},
          {i('''date_diff('day', (select max(s.end_date) from stints s where s.user_id = e.user_id and s.end_date <= e.day), e.day)''', 'days_since_stint')}
        from e""",
    "time_folds": f"""with n as (select *, row_number() over (order by day, o_orderkey) - 1 as rk, count(*) over () as n from {_O}),
        s as (select *, n // 6 as size, n - 5 * (n // 6) as first_rows from n)
        select o_orderkey, o_custkey, {d('day', 'day')},
          {i('case when rk < first_rows then 0 else (rk - first_rows) // size + 1 end', 'fold')} from s""",
    "time_folds_integer": f"""with n as (select *, row_number() over (order by o_orderkey) - 1 as rk, count(*) over () as n from {_O}),
        s as (select *, n // 8 as size, n - 7 * (n // 8) as first_rows from n)
        select o_orderkey, {d('day', 'day')}, {i('case when rk < first_rows then 0 else (rk - first_rows) // size + 1 end', 'fold')} from s""",
    "incremental_append": f"""select o_orderkey, o_custkey, {d('day', 'day')}, {r('o_totalprice', 'o_totalprice', 4)},
        {r(f'avg(o_totalprice) over ({_W} rows between 3 preceding and 1 preceding)', 'o_totalprice_mean_3', 4)},
        {r(f'stddev_samp(o_totalprice) over ({_W} rows between 3 preceding and 1 preceding)', 'o_totalprice_std_3', 4)},
        {r(f'lag(o_totalprice) over ({_W}) - avg(o_totalprice) over ({_W} rows between 3 preceding and 1 preceding)', 'o_totalprice_momentum_3', 4)}
        from {_O}""",
}

_E = "(select *, case when event_id % 50 <> 0 then cast(ts as date) end as day from events where event_type is not null)"
_DAYS = f"""select event_id, event_type, {d('day', 'day')}, {r('value', 'value', 4)},
    {r("case when day is not null then sum(value) over (partition by event_type order by day range between interval 7 days preceding and interval 1 day preceding) end", 'last_7_days', 4)}
    from {_E}"""


def _hot_sql() -> str:
    w = "over (partition by event_type order by ts, event_id rows between {} preceding and 1 preceding)"
    cells = []
    for k in (3, 10):
        mean = f"avg(value) {w.format(k)}"
        cells += [
            r(mean, f"value_mean_{k}", 4),
            r(f"stddev_samp(value) {w.format(k)}", f"value_std_{k}", 4),
            r(f"lag(value) over (partition by event_type order by ts, event_id) - {mean}", f"value_momentum_{k}", 4),
        ]
    ewm = _ewm_sql("events", "event_type", "ts, event_id", "value", "event_id, event_type")
    return f"with plain as (select event_id, {', '.join(cells)} from events), ewm as ({ewm}) select * from ewm join plain using (event_id)"


ORACLE |= {
    "rolling_hot_key": _hot_sql(),
    "rolling_hot_key_text": _hot_sql(),
    "rolling_hot_key_number": f"""select event_id, event_type, {r('value', 'value', 4)},
        {r('sum(value) over (partition by event_type order by value, event_id rows between 7 preceding and 1 preceding)', 'last_7_rows', 4)}
        from events where event_type is not null""",
    "sum_last_days_hot": _DAYS,
    "sum_last_days_undated": _DAYS,
    "rest_days_hot": f"""select event_id, event_type, {d('day', 'day')},
        {i("date_diff('day', lag(day) over (partition by event_type order by day, event_id), day)", 'rest_days')}
        from (select event_id, event_type, cast(ts as date) as day from events where event_type is not null)""",
    "incremental_late": ORACLE["incremental_append"],
    "incremental_corrected": ORACLE["incremental_append"],
}
