"""Joins, aggregates, cleaning, scalars and encodings over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagwise.functions import aggregates as A
from lagwise.functions import scalars as X
from lagwise.operators import aggregates as G
from lagwise.operators import clean, encode, joins
from lagwise.plans import baseball as B
from lagwise.session import scratch_path
from lagwise.sources import tables as S
from workload.common import d, i, orders, r, table, tidy


def starters_having(spark, sf_dir):
    """Orders with a condition on their lines: the group filter of the starter rule."""
    rule = F.expr("min(l_linenumber) = 1 and count(*) > 3 and max(l_linenumber) > 3")
    return tidy(G.groups_having(table(spark, sf_dir, "lineitem"), ["l_orderkey"], rule))


def order_metrics(spark, sf_dir):
    """Conditional metrics per order, kept for orders that pass the group filter."""
    lines = table(spark, sf_dir, "lineitem")
    chosen = G.groups_having(lines, ["l_orderkey"], F.expr("count(*) > 3"))
    metrics = {
        "n_lines": "count(*)",
        "n_parts": "count(distinct l_partkey)",
        "returned_rate": A.share("l_returnflag = 'R'"),
        "open_discount": "avg(case when l_linestatus = 'O' then l_discount end)",
        "returned_to_open": A.ratio("count_if(l_returnflag = 'R')", "count_if(l_linestatus = 'O')"),
        "big_line_rate_open": A.share_within("l_quantity >= 25", "l_linestatus = 'O'"),
    }
    kept = joins.only_listed(lines, chosen, ["l_orderkey"])
    return tidy(kept.groupBy("l_orderkey").agg(*[F.expr(e).alias(n) for n, e in metrics.items()]))


def _lines_by_nation(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return joins.lookup_join(lines, suppliers, ["l_suppkey"], "inner")


def team_rollup(spark, sf_dir):
    """Lines rolled up per supplier nation: sums, ratio of sums, splits by line status."""
    cells = {
        "qty": A.total("l_quantity"),
        "revenue": A.total("l_extendedprice"),
        "qty_O": A.total("case when l_linestatus = 'O' then l_quantity end"),
        "qty_F": A.total("case when l_linestatus = 'F' then l_quantity end"),
        "price_per_unit": A.ratio("sum(l_extendedprice)", "sum(l_quantity)"),
    }
    rows = _lines_by_nation(spark, sf_dir)
    return tidy(rows.groupBy("s_nationkey").agg(*[F.expr(e).alias(n) for n, e in cells.items()]), 3)


def weighted_means(spark, sf_dir):
    """The two weighted means: rows without a value leave the weights, or stay in them."""
    lines = table(spark, sf_dir, "lineitem").withColumn("disc", F.expr("nullif(l_discount, 0D)"))
    return tidy(
        lines.groupBy("l_suppkey").agg(
            F.expr(A.weighted_mean("disc", "l_quantity")).alias("mean_present"),
            F.expr(A.ratio_of_sums("disc", "l_quantity")).alias("mean_all"),
        )
    )


def hand_split(spark, sf_dir):
    from lagwise.plans.pitch_log import by_hand

    rows = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", F.expr("case l_linestatus when 'O' then 'L' else 'R' end").alias("hand"))
        .agg(F.avg("l_tax").alias("tax"))
    )
    return tidy(by_hand(rows, {"tax": "tax"}, hand="hand"))


def pivot_status(spark, sf_dir):
    totals = orders(spark, sf_dir).groupBy("o_custkey", "o_orderstatus").agg(F.sum("o_totalprice").alias("total"))
    wide = G.pivot_first(
        totals, ["o_custkey"], "o_orderstatus", {"O": "open", "F": "done", "P": "partial"}, {"total": "total_{}"}
    )
    return tidy(wide, 2)


def pivot_slots(spark, sf_dir):
    lines = joins.dedup(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
    values = {"l_quantity": "slot{}_quantity", "l_discount": "slot{}_discount"}
    return tidy(G.pivot_first(lines, ["l_orderkey"], "l_linenumber", {n: n for n in range(1, 8)}, values))


def mean_of_numeric(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_tax", "l_discount", "l_returnflag")
    return tidy(G.mean_of_numeric(rows, ["l_suppkey"], "mean_"))


def group_mean_joined(spark, sf_dir):
    """A group mean put on every row of the group."""
    rows = orders(spark, sf_dir).select("o_orderkey", "o_custkey", F.log("o_totalprice").alias("log_price"))
    means = G.mean_of_numeric(rows, ["o_custkey"], "customer_", ["log_price"])
    return tidy(rows.join(means, ["o_custkey"], "left"))


def coalesce_join(spark, sf_dir):
    """Left join where an overlapping column takes the left value, else the right one."""
    left = orders(spark, sf_dir).select(
        "o_orderkey",
        F.col("o_custkey").alias("c_custkey"),
        F.expr("case when o_orderstatus = 'F' then o_totalprice end").alias("c_acctbal"),
    )
    right = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return tidy(joins.coalescing_join(left, right, ["c_custkey"]), 2)


def merge_suffixed(spark, sf_dir):
    """Columns left by repeated joins folded back to one per name."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "case when l_returnflag = 'R' then l_tax end as rate_x",
        "case when l_returnflag = 'N' then l_discount end as rate_y",
        "case when l_linestatus = 'O' then l_quantity end as rate_x_y",
        "l_shipdate as ship_x",
    )
    return tidy(joins.merge_suffixed(rows))


def left_on_right_on(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    right = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return tidy(joins.coalescing_join(left, right, ["c_nationkey"], right_on=["n_nationkey"]))


def anti_join(spark, sf_dir):
    """Customers without a finished order this far: keys not yet processed."""
    done = orders(spark, sf_dir).where("o_orderstatus = 'F' and o_totalprice > 300000")
    existing = S.existing_keys(done.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])
    return tidy(joins.not_yet_processed(table(spark, sf_dir, "customer"), existing, ["c_custkey"]))


def semi_join(spark, sf_dir):
    listed = orders(spark, sf_dir).where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return tidy(joins.only_listed(table(spark, sf_dir, "customer"), listed, ["c_custkey"]))


def fill_dates(spark, sf_dir):
    """Add a date to lines from their order; an order is reduced to one row first."""
    source = orders(spark, sf_dir).select(F.col("o_orderkey").alias("l_orderkey"), F.col("day").alias("game_date"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return tidy(joins.fill_from(lines, source, ["l_orderkey"], "game_date"))


def union_by_name(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), "c_mktsegment")
    b = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    return tidy(joins.union_rows([a, b]))


def stack_sides(spark, sf_dir):
    """Order and line price of each line as two rows."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_tax", "l_discount")
    sides = {"home": {"rate": "l_tax"}, "away": {"rate": "l_discount"}}
    return tidy(joins.stack_sides(lines, ["l_orderkey", "l_linenumber", "l_partkey"], sides))


def names_by_latest(spark, sf_dir):
    """Last status seen per customer: the id-to-name map built from schedule rows."""
    rows = orders(spark, sf_dir).select("o_custkey", "o_orderstatus", "day", "o_orderkey")
    return tidy(joins.latest_value(rows, "o_custkey", "o_orderstatus", ["day", "o_orderkey"]))


def dedup_keys(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return tidy(joins.dedup(lines, ["l_orderkey", "l_linenumber"]))


def duplicate_report(spark, sf_dir):
    return tidy(G.duplicate_groups(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]))


def quantiles(spark, sf_dir):
    """Interpolated quantiles of several columns, one row per column."""
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    found = G.column_quantiles(table(spark, sf_dir, "lineitem"), columns, (0.01, 0.5, 0.99))
    return tidy(spark.createDataFrame([(c, *q) for c, q in found.items()], "name string, q01 double, q50 double, q99 double"), 4)


def winsor_log(spark, sf_dir):
    rows = orders(spark, sf_dir).select("o_orderkey", "o_totalprice")
    clipped = encode.winsorize(rows, encode.winsor_bounds(rows, ["o_totalprice"]))
    return tidy(encode.add_logs(clipped, encode.log_columns(clipped, ["o_totalprice"])), 3)


def target_encode(spark, sf_dir):
    """Mean log price per category, fitted on the years before 2000 and applied to all rows."""
    rows = orders(spark, sf_dir).withColumn("log_price", F.log("o_totalprice"))
    columns = ["o_orderpriority", "o_custkey"]
    fitted = encode.fit_target_means(rows.where("year(day) < 2000"), columns, "log_price")
    out = encode.apply_target_means(rows, columns, fitted)
    return tidy(out.select("o_orderkey", "o_orderpriority_enc", "o_custkey_enc"))


def lookup_skewed(spark, sf_dir):
    """Three rows in five have no category and one in five the same one; the table of
    categories is joined and encoded as one too large to broadcast."""
    category = F.expr("case when o_orderkey % 5 < 3 then null when o_orderkey % 5 = 3 then -1 else o_custkey end")
    rows = orders(spark, sf_dir).select("o_orderkey", category.alias("category"), "o_totalprice")
    table = rows.where("category is not null").groupBy("category").agg(F.count("*").alias("n"))
    joined = joins.lookup_join(rows, table, ["category"], broadcast_rows=0)
    means = {"category": rows.where("category is not null").groupBy("category").agg(F.avg("o_totalprice").alias("enc"))}
    return tidy(encode.apply_target_means(joined, ["category"], means, broadcast_rows=0), 4)


def split_by_year(spark, sf_dir):
    rows = orders(spark, sf_dir).select("o_orderkey", "day")
    parts = clean.split_by_year(rows, "day", (1996, 1997, 1998, 1999), (2000, 2001), holdout_year=1998)
    named = [p.withColumn("part", F.lit(n)) for n, p in zip(("train", "test", "holdout"), parts)]
    return tidy(joins.union_rows(named))


def calendar_days(spark, sf_dir):
    """Days between the first and last order, without off-season and skipped years."""
    span = orders(spark, sf_dir).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    return tidy(days.where(clean.in_season("day", (1998,))))


def quarantine(spark, sf_dir):
    """Lines rejected with a reason; the accepted ones are counted per status."""
    lines = table(spark, sf_dir, "lineitem")
    good, bad = clean.quarantine(
        lines, {"tiny": F.col("l_quantity") < 3, "untaxed": F.col("l_tax") == 0, "no date": F.col("l_shipdate").isNull()}
    )
    counted = good.withColumn("reason", F.lit("accepted")).unionByName(bad)
    return tidy(counted.groupBy("reason", "l_linestatus").agg(F.count("*").alias("n")))


def cleaned_numbers(spark, sf_dir):
    """Text to numbers, bad text to NULL, rows without a number dropped."""
    parts = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.expr("case when p_size % 5 = 0 then 'n/a' else cast(p_size as string) end").alias("size"),
        F.regexp_replace("p_brand", "Brand#", "").alias("brand"),
    )
    rows = clean.require_columns(clean.as_numbers(parts, ["size", "brand", "absent"]), ["size"])
    return tidy(clean.with_constants(rows, {"season": 2024}))


def id_lookup(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        F.expr("case when p_size % 7 = 0 then 'x' else cast(p_partkey as string) end").alias("raw_id"), "p_name"
    )
    return tidy(S.id_lookup(parts, "pitcher_id", {"pitcher_id": "raw_id", "name": "p_name"}, ["name"]))


def text_scalars(spark, sf_dir):
    """First number in text, pair keys, JSON list head, link id, transaction text."""
    events = table(spark, sf_dir, "events")
    text = F.concat(F.col("event_id").cast("string"), F.lit(" mph, Out"))
    link = F.concat(F.lit("/player/some-name-"), F.col("user_id").cast("string"))
    ids = F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit(", 5]"))
    deal = F.concat(
        F.when(F.col("event_type") == "signup", "Placed").when(F.col("event_type") == "error", "Activated").otherwise("Signed"),
        F.when(F.col("value") > 10, " on 15-day Injured List").otherwise(" to a contract"),
    )
    return tidy(
        events.select(
            "event_id",
            X.first_number(text).alias("speed"),
            X.first_number("event_type").alias("no_number"),
            X.pair_key("user_id", "event_type").alias("pair"),
            X.first_of_json_list(ids).alias("first_id"),
            X.first_of_json_list("event_type").alias("bad_list"),
            X.player_id_from_link(link).alias("link_id"),
            X.stint_action(deal).alias("action"),
            X.round_half_even("value").alias("rounded"),
            X.clip("value", F.lit(2.0), F.lit(15.0)).alias("clipped"),
        )
    )


def date_scalars(spark, sf_dir):
    rows = orders(spark, sf_dir)
    return tidy(
        rows.select(
            "o_orderkey",
            X.month_bucket("day").alias("bucket"),
            X.day_of_week("day").alias("weekday"),
            X.age_years("day", F.lit("1970-05-17").cast("date")).alias("age"),
            X.clock_time(F.col("o_orderdate").cast("string")).alias("clock"),
            X.clock_time(F.col("o_orderpriority")).alias("not_a_clock"),
            X.date_from_dashed_id(F.concat(F.lit("id-"), F.col("day").cast("string")), F.lit("x")).alias("dashed"),
            X.date_from_dashed_id(F.lit("id-x"), F.concat(F.col("day").cast("string"), F.lit("T17:10:00Z"))).alias("fallback"),
        )
    )


def distances(spark, sf_dir):
    """Distance between the ballparks assigned to customer and supplier nations."""
    number = F.create_map(*[F.lit(x) for n, park in enumerate(sorted(B.BALLPARKS)) for x in (park[0], n)])
    parks = B.ballparks(spark).withColumn("n", number[F.col("team")])
    nations = table(spark, sf_dir, "nation").join(F.broadcast(parks), F.col("n") == F.col("n_nationkey"))
    place = nations.select("n_nationkey", "latitude", "longitude", "stadium", "park_factor")
    home = place.toDF("c_nationkey", "lat1", "lon1", "stadium", "park_factor")
    away = place.select("n_nationkey", "latitude", "longitude").toDF("away", "lat2", "lon2")
    rows = table(spark, sf_dir, "customer").withColumn("away", F.expr("(c_nationkey + c_custkey) % 27"))
    rows = joins.lookup_join(joins.lookup_join(rows, home, ["c_nationkey"]), away, ["away"])
    miles = X.haversine_miles(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return tidy(rows.select("c_custkey", "stadium", "park_factor", miles.alias("miles")), 4)


def feature_groups(spark, sf_dir):
    """Group of a feature name by exact name and prefix, over names made from the tables."""
    names = table(spark, sf_dir, "events").select(
        F.concat(
            F.element_at(F.array(*[F.lit(p) for p in _NAME_PREFIXES]), (F.col("event_id") % len(_NAME_PREFIXES) + 1).cast("int")),
            F.col("event_type"),
        ).alias("feature")
    )
    group = X.group_by_name("feature", B.FEATURE_NAME_GROUPS, B.FEATURE_PREFIX_GROUPS, B.DEFAULT_FEATURE_GROUP)
    return tidy(names.groupBy("feature", group.alias("grp")).agg(F.count("*").alias("n")))


_NAME_PREFIXES = ["opp_", "slot1_", "wx_", "fastball_then_", "team_hand_", "fip_", "zone_", "rest_days_", "spin_"]


def json_flatten(spark, sf_dir):
    """Typed field of a JSON text column."""
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    return tidy(rows.select("event_id", "p.k"))


def table_stats(spark, sf_dir):
    return tidy(S.date_span(orders(spark, sf_dir), "day"))


def season_table(spark, sf_dir):
    """Written by season, read back with a year filter on the partition and a projection."""
    path = scratch_path(spark, "orders")
    rows = orders(spark, sf_dir).select("o_orderkey", "o_custkey", "day", "o_totalprice")
    S.write_table(rows, path, date="day", unique=["o_orderkey"])
    return tidy(S.read_table(spark, path, ["o_orderkey", "day", "o_totalprice", "absent"], year=1999, date="day"), 2)


def leakage_guard(spark, sf_dir):
    """Column rules on a rolled table: stale windows and unlisted numbers go."""
    from lagwise.operators.rolling import rolling_bundle

    rows = orders(spark, sf_dir).select(
        F.col("o_orderkey").alias("game_pk"), F.col("o_custkey").alias("pitcher_id"), F.col("day").alias("game_date"),
        F.log("o_totalprice").alias("strikeouts"), F.lit(1.5).alias("temp"), F.lit(2.5).alias("leak"), "o_orderstatus",
    )
    rolled = rolling_bundle(rows, ["pitcher_id"], ["game_date", "game_pk"], ["strikeouts"], windows=(3, 4), halflife=7)
    kept = clean.leakage_guard(
        clean.drop_stale_windows(clean.drop_matching(rolled, "^order"), (3,)), "strikeouts", B.ALLOWED_BASE_NUMERIC, ["game_pk"]
    )
    return tidy(kept, 5)


_QUERY_FUNCTIONS = [
    lookup_skewed,
    starters_having, order_metrics, team_rollup, weighted_means, hand_split, pivot_status, pivot_slots,
    mean_of_numeric, group_mean_joined, coalesce_join, merge_suffixed, left_on_right_on, anti_join, semi_join,
    fill_dates, union_by_name, stack_sides, names_by_latest, dedup_keys, duplicate_report, quantiles, winsor_log,
    target_encode, split_by_year, calendar_days, quarantine, cleaned_numbers, id_lookup, text_scalars,
    date_scalars, distances, feature_groups, json_flatten, table_stats, season_table, leakage_guard,
]
QUERIES = {f.__name__: f for f in _QUERY_FUNCTIONS}

_PARKS = ", ".join(
    f"({n}, '{park}', {lat}::double, {lon}::double, {factor})"
    for n, (_, park, lat, lon, factor) in enumerate(sorted(B.BALLPARKS))
)
_PREFIX_CASES = " ".join(f"when starts_with(feature, '{p}') then '{g}'" for p, g in B.FEATURE_PREFIX_GROUPS.items())
_EXACT_CASES = " ".join(f"when feature = '{p}' then '{g}'" for p, g in B.FEATURE_NAME_GROUPS.items())
_LW = "over (partition by pitcher_id order by game_date, game_pk"
_LINE_COLUMNS = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"

ORACLE = {
    "starters_having": "select l_orderkey from lineitem group by 1 having min(l_linenumber) = 1 and count(*) > 3 and max(l_linenumber) > 3",
    "order_metrics": f"""select l_orderkey, {i('count(*)', 'n_lines')}, {i('count(distinct l_partkey)', 'n_parts')},
        {r("avg(case when l_returnflag = 'R' then 1 else 0 end)", 'returned_rate')},
        {r("avg(l_discount) filter (l_linestatus = 'O')", 'open_discount')},
        {r("cast(count(*) filter (l_returnflag = 'R') as double) / nullif(count(*) filter (l_linestatus = 'O'), 0)", 'returned_to_open')},
        {r("avg(case when l_quantity >= 25 then 1 else 0 end) filter (l_linestatus = 'O')", 'big_line_rate_open')}
        from lineitem group by l_orderkey having count(*) > 3""",
    "team_rollup": f"""select {i('s_nationkey', 's_nationkey')}, {r('sum(l_quantity)', 'qty', 3)}, {r('sum(l_extendedprice)', 'revenue', 3)},
        {r("coalesce(sum(l_quantity) filter (l_linestatus = 'O'), 0)", 'qty_O', 3)},
        {r("coalesce(sum(l_quantity) filter (l_linestatus = 'F'), 0)", 'qty_F', 3)},
        {r('sum(l_extendedprice) / sum(l_quantity)', 'price_per_unit', 3)}
        from lineitem join supplier on l_suppkey = s_suppkey group by s_nationkey""",
    "weighted_means": f"""select l_suppkey, {r('sum(x * l_quantity) / sum(l_quantity) filter (x is not null)', 'mean_present')},
        {r('sum(x * l_quantity) / sum(l_quantity)', 'mean_all')}
        from (select *, nullif(l_discount, 0) as x from lineitem) group by l_suppkey""",
    "hand_split": f"""select l_orderkey, hand, {r('t', 'tax')}, {r("case when hand = 'L' then t end", 'tax_vs_LHP')}, {r("case when hand = 'R' then t end", 'tax_vs_RHP')}
        from (select l_orderkey, case l_linestatus when 'O' then 'L' else 'R' end as hand, avg(l_tax) as t from lineitem group by 1, 2)""",
    "pivot_status": f"""select o_custkey, {', '.join(r(f"sum(case when o_orderstatus = '{s}' then o_totalprice end)", f'total_{n}', 2) for s, n in (('O', 'open'), ('F', 'done'), ('P', 'partial')))}
        from orders group by o_custkey""",
    "pivot_slots": f"""with k as (select * from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by {_LINE_COLUMNS}) = 1)
        select l_orderkey, {', '.join(r(f'max(case when l_linenumber = {n} then l_{c} end)', f'slot{n}_{c}') for n in range(1, 8) for c in ('quantity', 'discount'))}
        from k group by l_orderkey""",
    "mean_of_numeric": f"select l_suppkey, {r('avg(l_quantity)', 'mean_l_quantity')}, {r('avg(l_tax)', 'mean_l_tax')}, {r('avg(l_discount)', 'mean_l_discount')} from lineitem group by 1",
    "group_mean_joined": f"""select o_orderkey, o_custkey, {r('ln(o_totalprice)', 'log_price')},
        {r('avg(ln(o_totalprice)) over (partition by o_custkey)', 'customer_log_price')} from orders""",
    "coalesce_join": f"""select o_orderkey, o_custkey as c_custkey, c_mktsegment,
        {r("coalesce(case when o_orderstatus = 'F' then o_totalprice end, c_acctbal)", 'c_acctbal', 2)}
        from orders left join customer on o_custkey = c_custkey""",
    "merge_suffixed": f"""select l_orderkey, {i('l_linenumber', 'l_linenumber')}, l_partkey, l_suppkey, {d('l_shipdate', 'ship')},
        {r("coalesce(case when l_returnflag = 'R' then l_tax end, case when l_returnflag = 'N' then l_discount end, case when l_linestatus = 'O' then l_quantity end)", 'rate')} from lineitem""",
    "left_on_right_on": f"""select c_custkey, {i('c_nationkey', 'c_nationkey')}, {i('n_nationkey', 'n_nationkey')}, n_name
        from customer left join nation on c_nationkey = n_nationkey""",
    "anti_join": f"""select c_custkey, c_name, {i('c_nationkey', 'c_nationkey')}, {r('c_acctbal', 'c_acctbal')}, c_mktsegment from customer
        where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F' and o_totalprice > 300000)""",
    "semi_join": f"""select c_custkey, c_name, {i('c_nationkey', 'c_nationkey')}, {r('c_acctbal', 'c_acctbal')}, c_mktsegment from customer
        where c_custkey in (select o_custkey from orders where o_totalprice > 450000)""",
    "fill_dates": f"""select l_orderkey, l_partkey, l_suppkey, {i('l_linenumber', 'l_linenumber')}, {d('o_orderdate', 'game_date')}
        from lineitem left join orders on l_orderkey = o_orderkey""",
    "union_by_name": f"""select c_name as name, {r('c_acctbal', 'balance')}, c_mktsegment from customer
        union all select s_name, {r('s_acctbal', 'balance')}, null from supplier""",
    "stack_sides": f"""select l_orderkey, {i('l_linenumber', 'l_linenumber')}, l_partkey, 'home' as side, {r('l_tax', 'rate')} from lineitem
        union all select l_orderkey, {i('l_linenumber', 'l_linenumber')}, l_partkey, 'away', {r('l_discount', 'rate')} from lineitem""",
    "names_by_latest": "select o_custkey, o_orderstatus from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1",
    "dedup_keys": f"""select l_orderkey, l_partkey, l_suppkey, {i('l_linenumber', 'l_linenumber')},
        {', '.join(r(c, c) for c in ('l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'))}, l_returnflag, l_linestatus, {d('l_shipdate', 'l_shipdate')}
        from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by {_LINE_COLUMNS}) = 1""",
    "duplicate_report": f"select l_orderkey, {i('l_linenumber', 'l_linenumber')}, {i('count(*)', 'n')} from lineitem group by l_orderkey, l_linenumber having count(*) > 1",
    "quantiles": " union all ".join(
        f"select '{c}' as name, {r(f'quantile_cont({c}, 0.01)', 'q01', 4)}, {r(f'quantile_cont({c}, 0.5)', 'q50', 4)}, {r(f'quantile_cont({c}, 0.99)', 'q99', 4)} from lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount")
    ),
    "winsor_log": f"""with q as (select quantile_cont(o_totalprice, 0.01) as lo, quantile_cont(o_totalprice, 0.99) as hi from orders),
        c as (select o_orderkey, least(greatest(o_totalprice, lo), hi) as v from orders, q)
        select o_orderkey, {r('v', 'o_totalprice', 3)}, {r('ln(1 + v)', 'log_o_totalprice', 3)} from c""",
    "lookup_skewed": f"""with t as (select *, case when o_orderkey % 5 < 3 then null when o_orderkey % 5 = 3 then -1 else o_custkey end as category from orders)
        select o_orderkey, category, {r('o_totalprice', 'o_totalprice', 4)},
        case when category is not null then {'count(*) over (partition by category)'} end as n,
        case when category is not null then round(cast(avg(o_totalprice) over (partition by category) as double), 4) + 0.0 end as category_enc from t""",
    "target_encode": f"""with t as (select * from orders where year(o_orderdate) < 2000),
        p as (select o_orderpriority, avg(ln(o_totalprice)) as e from t group by 1), k as (select o_custkey, avg(ln(o_totalprice)) as e from t group by 1)
        select o_orderkey, {r('p.e', 'o_orderpriority_enc')}, {r('k.e', 'o_custkey_enc')}
        from orders left join p using (o_orderpriority) left join k using (o_custkey)""",
    "split_by_year": f"""select o_orderkey, {d('o_orderdate', 'day')},
        case when year(o_orderdate) = 1998 then 'holdout' when year(o_orderdate) in (1996, 1997, 1999) then 'train' else 'test' end as part
        from orders where year(o_orderdate) between 1996 and 2001""",
    "calendar_days": f"""with s as (select min(cast(o_orderdate as date)) as a, max(cast(o_orderdate as date)) as b from orders),
        c as (select unnest(generate_series(a, b, interval 1 day)) as day from s)
        select {d('day', 'day')} from c where year(day) <> 1998 and month(day) * 100 + day(day) >= 307 and month(day) * 100 + day(day) < 1105""",
    "quarantine": f"""select case when l_quantity < 3 then 'tiny' when l_tax = 0 then 'untaxed' when l_shipdate is null then 'no date' else 'accepted' end as reason,
        l_linestatus, {i('count(*)', 'n')} from lineitem group by 1, 2""",
    "cleaned_numbers": f"""select p_partkey, {r('p_size', 'size')}, {r("try_cast(replace(p_brand, 'Brand#', '') as double)", 'brand')}, cast(2024 as bigint) as season
        from part where p_size % 5 <> 0""",
    "id_lookup": "select p_partkey as pitcher_id, p_name as name from part where p_size % 7 <> 0",
    "text_scalars": f"""select event_id, {r('event_id', 'speed')}, {r('null', 'no_number')}, user_id::varchar || '_' || event_type as pair,
        user_id as first_id, cast(null as bigint) as bad_list, user_id as link_id,
        case when value > 10 then case event_type when 'signup' then 'start' when 'error' then 'end' end end as action,
        {r('round_even(value, 0)', 'rounded')}, {r('least(greatest(value, 2.0), 15.0)', 'clipped')} from events""",
    "date_scalars": f"""select o_orderkey, case when month(o_orderdate) <= 4 then 'early' when month(o_orderdate) <= 8 then 'mid' else 'late' end as bucket,
        {i('isodow(o_orderdate) - 1', 'weekday')}, {r("date_diff('day', date '1970-05-17', cast(o_orderdate as date)) / 365.25::double", 'age')},
        strftime(o_orderdate, '%I:%M %p') as clock, o_orderpriority as not_a_clock, {d('o_orderdate', 'dashed')}, {d('o_orderdate', 'fallback')} from orders""",
    "distances": f"""with parks(n, stadium, lat, lon, factor) as (values {_PARKS}),
        p as (select * from parks where n < 25)
        select c_custkey, h.stadium, {i('h.factor', 'park_factor')},
          {r('''2 * 3958.8::double * asin(sqrt(pow(sin((radians(a.lat) - radians(h.lat)) / 2), 2)
            + cos(radians(h.lat)) * cos(radians(a.lat)) * pow(sin((radians(a.lon) - radians(h.lon)) / 2), 2)))''', 'miles', 4)}
        from customer left join p h on h.n = c_nationkey left join p a on a.n = (c_nationkey + c_custkey) % 27""",
    "feature_groups": f"""with f as (select list_extract({_NAME_PREFIXES!r}, (event_id % {len(_NAME_PREFIXES)})::int + 1) || event_type as feature from events)
        select feature, case {_EXACT_CASES} {_PREFIX_CASES} else '{B.DEFAULT_FEATURE_GROUP}' end as grp, {i('count(*)', 'n')} from f group by 1, 2""",
    "json_flatten": f"select event_id, {i('json_extract(props, $$$.k$$)', 'k')} from events",
    "table_stats": f"select {d('min(o_orderdate)', 'earliest')}, {d('max(o_orderdate)', 'latest')}, {i('count(*)', 'n_rows')} from orders",
    "season_table": f"select o_orderkey, {d('o_orderdate', 'day')}, {r('o_totalprice', 'o_totalprice', 2)} from orders where year(o_orderdate) = 1999",
    "leakage_guard": f"""with o as (select o_orderkey as game_pk, o_custkey as pitcher_id, cast(o_orderdate as date) as game_date, ln(o_totalprice) as v, o_orderstatus from orders),
        n as (select *, row_number() {_LW}) as rn from o), x as (select *, pow(2.0::double, rn / 7.0::double) as w from n),
        y as (select *, sum(v * w) {_LW} rows between unbounded preceding and 1 preceding) / sum(w) {_LW} rows between unbounded preceding and 1 preceding) as e,
          lag(v) {_LW}) as l, avg(v) {_LW} rows between 3 preceding and 1 preceding) as m,
          stddev_samp(v) {_LW} rows between 3 preceding and 1 preceding) as s from x)
        select game_pk, {d('game_date', 'game_date')}, {r('v', 'strikeouts', 5)}, 1.5::double as temp, o_orderstatus,
          {r('m', 'strikeouts_mean_3', 5)}, {r('s', 'strikeouts_std_3', 5)}, {r('l - m', 'strikeouts_momentum_3', 5)},
          {r('e', 'strikeouts_ewm_7', 5)}, {r('l - e', 'strikeouts_momentum_ewm_7', 5)} from y""",
}
