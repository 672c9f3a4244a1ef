"""Training and evaluation on a matrix made from orders; metrics of a plain predictor in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagwise.models import features as MF
from lagwise.models import training as MT
from lagwise.operators.clean import fill_categories, split_by_year
from lagwise.operators.rolling import rest_days, rolling_bundle
from lagwise.session import settle
from workload.common import i, orders, r, tidy

ORDER = ["game_date", "game_pk"]
TARGET = "strikeouts"
TRAIN, TEST = (1995, 1996, 1997, 1998, 1999), (2000, 2001)
SMALL = {"maxIter": 5, "maxDepth": 3}


def _matrix(spark, sf_dir):
    rows = orders(spark, sf_dir).select(
        F.col("o_orderkey").alias("game_pk"),
        F.col("o_custkey").alias("pitcher_id"),
        F.col("day").alias("game_date"),
        F.expr("cast(o_totalprice / 50000 as bigint)").alias(TARGET),
        F.col("o_orderpriority").alias("weather"),
    )
    rows = rest_days(rows, ["pitcher_id"], ORDER)
    return settle(rolling_bundle(rows, ["pitcher_id"], ORDER, [TARGET], windows=(3, 10), halflife=7), "matrix")


def _features(df):
    return MF.select_features(df, TARGET)[0]


def _cells(spark, sf_dir):
    """Few-valued features. A deep tree on one of them, or a Poisson model on the one with two
    values, predicts group means, so that SQL can say what each model must give."""
    o = orders(spark, sf_dir)
    return settle(
        o.select(
            F.col("o_orderkey").alias("game_pk"),
            F.col("day").alias("game_date"),
            F.expr("case when o_custkey % 11 <> 0 then cast(o_custkey % 7 as double) end").alias("opp_mean_3"),
            F.expr("case when o_custkey % 3 = 0 then 1D else 0D end").alias("wx_mean_3"),
            F.expr("case when o_orderkey % 5 <> 0 then o_orderpriority end").alias("weather"),
            F.expr(
                "cast(o_totalprice / 50000 as bigint) + 2 * (o_custkey % 7) + case when o_custkey % 3 = 0 then 3 else 0 end"
            ).alias(TARGET),
        ),
        "cells",
    )


ONE_TREE = {"numTrees": 1, "bootstrap": False, "featureSubsetStrategy": "all", "maxDepth": 14}
DEEP = {"maxDepth": 8, "subsamplingRate": 1.0}  # 500 rounds by default
EXACT = {"regParam": 0.0, "tol": 1e-12}
CLOSED = (("boosted", "opp_mean_3", DEEP), ("poisson", "wx_mean_3", EXACT), ("forest", "opp_mean_3", ONE_TREE))


def _by_model(frames):
    marked = [f.withColumn("model", F.lit(kind)) for (kind, _, _), f in zip(CLOSED, frames)]
    return tidy(marked[0].unionByName(marked[1]).unionByName(marked[2]))


def importance_pruning(spark, sf_dir):
    """A stump gives all importance to the feature with the best split."""
    kept, found = MF.select_features(
        _cells(spark, sf_dir), TARGET, prune=True, trees=1, params={"maxDepth": 1, "bootstrap": False}
    )
    table = MF.importance_table(spark, list(found), list(found.values()))
    return tidy(table.withColumn("kept", F.col("feature").isin(kept)))


def train_eval(spark, sf_dir):
    """Test metrics of the three kinds of model; boosting stops by patience."""
    past, test = split_by_year(_cells(spark, sf_dir), "game_date", TRAIN, TEST)
    fitted = [MT.train(past, [c], TARGET, kind, test, params=p, patience=4) for kind, c, p in CLOSED]
    return _by_model([f.evaluate(test) for f in fitted])


def train_categorical(spark, sf_dir):
    """A boosted stump chooses between a number and a category with missing values."""
    past, test = split_by_year(_cells(spark, sf_dir), "game_date", TRAIN, TEST)
    stump = {"maxDepth": 1, "maxIter": 1, "subsamplingRate": 1.0}
    fitted = MT.train(past, ["wx_mean_3"], TARGET, "boosted", test, categorical=["weather"], params=stump)
    return tidy(fitted.importances(spark))


KEEP, SHARED = 20, 16


def _many_categories(spark, sf_dir):
    """Five categories that half the rows have, and as many others as there are other rows."""
    name = F.expr("case when game_pk % 2 = 0 then concat('big', game_pk % 10) when game_pk % 21 <> 0 then concat('k', game_pk) end")
    return _cells(spark, sf_dir).withColumn("weather", name)


def category_folding(spark, sf_dir):
    """Frequent values by name, all others under shared labels; chosen on the training rows."""
    df = fill_categories(_many_categories(spark, sf_dir), ["weather"])
    past, _ = split_by_year(df, "game_date", TRAIN, TEST)
    folded = MF.fold_values(df, MF.frequent_values(past, ["weather"], KEEP), SHARED)
    return tidy(folded.groupBy("weather").agg(F.count("*").alias("n"), F.avg(TARGET).alias("mean")))


def train_categorical_wide(spark, sf_dir):
    """A deep tree on a category with very many values predicts the means of its labels."""
    past, test = split_by_year(_many_categories(spark, sf_dir), "game_date", TRAIN, TEST)
    fitted = MT.train(past, [], TARGET, "forest", categorical=["weather"], params=ONE_TREE, keep=KEEP, buckets=SHARED)
    return tidy(fitted.evaluate(test))


def cross_validation(spark, sf_dir):
    """RMSE of five expanding folds for the three kinds of model."""
    df = _cells(spark, sf_dir)
    scores = [
        MT.cross_validate(df, [c], ORDER, TARGET, kind=kind, params={**p, "maxIter": 2} if kind == "boosted" else p)
        for kind, c, p in CLOSED
    ]
    return _by_model([spark.createDataFrame(list(enumerate(s, 1)), "fold int, rmse double") for s in scores])


def parameter_search(spark, sf_dir):
    """Fifty trials over five folds; depth 0 knows only the mean, depth 1 both groups."""
    _, trials = MT.random_search(
        _cells(spark, sf_dir), ["wx_mean_3"], ORDER, TARGET, kind="forest", space={"maxDepth": ("int", 0, 1)},
        fixed={"numTrees": 1, "bootstrap": False},
    )
    return tidy(trials)


def holdout_evaluation(spark, sf_dir):
    _, scored = MT.evaluate_holdout(
        _cells(spark, sf_dir), ["opp_mean_3"], 1998, TARGET, train_years=TRAIN, test_years=TEST, params={**DEEP, "maxIter": 3}
    )
    return tidy(scored)


def permutation_importance(spark, sf_dir):
    past, test = split_by_year(_cells(spark, sf_dir), "game_date", TRAIN, TEST)
    fitted = MT.train(past, ["opp_mean_3", "wx_mean_3"], TARGET, "forest", params=ONE_TREE)
    return tidy(MT.permutation_importance(fitted, test, ORDER))


def train_rolled(spark, sf_dir):
    """Test metrics of the three kinds of model on rolled features."""
    df = _matrix(spark, sf_dir)
    past, test = split_by_year(df, "game_date", TRAIN, TEST)
    frames = []
    for kind, params in (("boosted", SMALL), ("poisson", {}), ("forest", {"numTrees": 10, "maxDepth": 4})):
        frames.append(MT.train(past, _features(df), TARGET, kind, test, params=params).evaluate(test))
    return _by_model(frames)


def plain_metrics(spark, sf_dir):
    """Metrics of the lagged mean of 10 as the prediction."""
    rows = _matrix(spark, sf_dir).where("strikeouts_mean_10 is not null")
    return tidy(MT.metrics(rows, TARGET, "strikeouts_mean_10"))


_QUERY_FUNCTIONS = [
    category_folding, train_categorical_wide, importance_pruning, train_eval, train_categorical, cross_validation, parameter_search, holdout_evaluation,
    permutation_importance, train_rolled, plain_metrics,
]
QUERIES = {f.__name__: f for f in _QUERY_FUNCTIONS}


# --- the same in SQL ---------------------------------------------------------------

_G = """g as (select o_orderkey as game_pk, cast(o_orderdate as date) as day, year(cast(o_orderdate as date)) as yr,
      case when o_custkey % 11 <> 0 then (o_custkey % 7)::double end as k, case when o_custkey % 3 = 0 then 1.0::double else 0.0::double end as b,
      case when o_orderkey % 5 <> 0 then o_orderpriority end as weather,
      cast(trunc(o_totalprice / 50000) as bigint) + 2 * (o_custkey % 7) + case when o_custkey % 3 = 0 then 3 else 0 end as y
    from orders)"""
_SCORES = f"""{r('sqrt(avg((p - y) * (p - y)))', 'rmse')}, {r('avg(abs(p - y))', 'mae')},
    {r('avg(case when abs(round_even(p, 0) - y) <= 1 then 1 else 0 end)', 'within_1')}"""
_PAST = "yr between 1995 and 1999"
_AHEAD = "yr between 2000 and 2001"


def _means(by: str, past: str, rows: str) -> str:
    """Rows with the mean of their group among past rows as ``p``."""
    return f"""(select a.*, m.p from (select * from g where {rows}) a
      join (select {by}, avg(y) as p from g where {past} group by {by}) m on a.{by} is not distinct from m.{by})"""


def _models(sql) -> str:
    return " union all ".join(sql(kind, "b" if kind == "poisson" else "k") for kind, _, _ in CLOSED)


# Best split by the squared sums that it explains; v is a feature's value in split order.
_SPLITS = """s as (select feature, v, sum(y) as t, count(*) as n from f group by feature, v),
    c as (select feature, sum(t) over w as tl, sum(n) over w as nl, sum(t) over (partition by feature) as ta,
        sum(n) over (partition by feature) as na from s window w as (partition by feature order by v)),
    best as (select feature, max(tl * tl / nl + (ta - tl) * (ta - tl) / (na - nl)) as gain from c where nl < na group by feature),
    won as (select feature, case when gain = max(gain) over () then 1.0::double else 0.0::double end as importance from best)"""
_FOLDS = """z as (select *, row_number() over (order by day, game_pk) - 1 as at0, count(*) over () as n from g),
    f as (select *, case when at0 < n - 5 * (n // 6) then 0 else (at0 - (n - 5 * (n // 6))) // (n // 6) + 1 end as fold from z)"""


def _fold_rmse(by: str) -> str:
    return f"""select v, sqrt(avg((p - y) * (p - y))) as rmse from (select f.fold as v, f.y, m.p from f join
      (select v, {by} as grp, avg(y) as p from f join range(1, 6) r(v) on f.fold < v group by all) m
      on m.v = f.fold and m.grp is not distinct from {by}) group by v"""


# The seeded draws of the search, 0 or 1 by trial.
DRAWN = "00110011001110001000010111111010001011111110101010"

_FOLDED = f"""{_G}, h as (select yr, y, coalesce(case when game_pk % 2 = 0 then 'big' || game_pk % 10 when game_pk % 21 <> 0 then 'k' || game_pk end, 'NA') as w from g),
    top as (select w from h where {_PAST} group by w order by count(*) desc, w limit {KEEP}),
    l as (select yr, y, case when top.w is not null then h.w else '~' || (('0x' || substr(md5(h.w), 1, 8))::bigint % {SHARED}) end as weather
      from h left join top on h.w = top.w)"""

ORACLE = {
    "category_folding": f"with {_FOLDED} select weather, {i('count(*)', 'n')}, {r('avg(y)', 'mean')} from l group by weather",
    "train_categorical_wide": f"""with {_FOLDED}, m as (select weather, avg(y) as p from l where {_PAST} group by weather)
        select {_SCORES} from l join m using (weather) where {_AHEAD}""",
    "importance_pruning": f"""with {_G}, means as (select avg(k) as e from g),
        f as (select 'opp_mean_3' as feature, coalesce(k, e) as v, y from g, means union all select 'wx_mean_3', b, y from g), {_SPLITS}
        select feature, importance, case feature when 'opp_mean_3' then 'Opponent' else 'Context' end as "group",
        {i("importance >= 0.01", 'kept')} from won""",
    "train_eval": f"with {_G} {_models(lambda kind, by: f"select {_SCORES}, '{kind}' as model from {_means(by, _PAST, _AHEAD)}")}",
    "train_categorical": f"""with {_G}, h as (select coalesce(weather, 'NA') as w, b, y from g where {_PAST}),
        f as (select 'wx_mean_3' as feature, b as v, y from h union all
          select 'weather', m.v, y from h join (select w, row_number() over (order by avg(y)) as v from h group by w) m using (w)), {_SPLITS}
        select feature, importance, case feature when 'weather' then 'Performance' else 'Context' end as "group" from won""",
    "cross_validation": f"with {_G}, {_FOLDS} {_models(lambda kind, by: f"select v as fold, {r('rmse', 'rmse')}, '{kind}' as model from ({_fold_rmse(by)})")}",
    "parameter_search": f"""with {_G}, {_FOLDS}, depth as (select 0 as d, avg(rmse) as rmse from ({_fold_rmse('0')}) union all select 1, avg(rmse) from ({_fold_rmse('b')})),
        drawn as (select t, cast(substr('{DRAWN}', t::int + 1, 1) as int) as d from range(50) x(t))
        select t as trial, {r('rmse', 'rmse')}, '{{"maxDepth": ' || d || '}}' as params from drawn join depth using (d)""",
    "holdout_evaluation": f"""with {_G} select {_SCORES}, 'test' as part from {_means('k', f'{_PAST} and yr <> 1998', _AHEAD)}
        union all select {_SCORES}, 'holdout' from {_means('k', f'{_PAST} and yr <> 1998', 'yr = 1998')}""",
    "permutation_importance": f"""with {_G}, m as (select k, b, avg(y) as p from g where {_PAST} group by k, b),
        t as (select k, b, y, row_number() over (order by day, game_pk) - 1 as at0, count(*) over () as n from g where {_AHEAD}),
        st as (select n, (select min(s) from range(1, 100000000) q(s) where s >= floor(n * 0.6180339887) and s < floor(n * 0.6180339887) + 1000 and gcd(s, n) = 1) as step
          from (select count(*) as n from t)),
        o as (select (at0::hugeint * step + step // 3) % st.n as at0, k as ok, b as ob from t, st),
        x as (select t.y, a.p as p, ak.p as pk, ab.p as pb from t join o using (at0)
          join m a on a.k is not distinct from t.k and a.b = t.b
          join m ak on ak.k is not distinct from o.ok and ak.b = t.b
          join m ab on ab.k is not distinct from t.k and ab.b = o.ob),
        e as (select sqrt(avg((p - y) ** 2)) as base, sqrt(avg((pk - y) ** 2)) as by_k, sqrt(avg((pb - y) ** 2)) as by_b from x)
        select feature, {r('rise', 'importance')}, "group" from (
          select 'opp_mean_3' as feature, by_k - base as rise, 'Opponent' as "group" from e union all select 'wx_mean_3', by_b - base, 'Context' from e) where rise > 0""",
    "plain_metrics": f"""with o as (select o_custkey, cast(o_orderdate as date) as day, o_orderkey, cast(trunc(o_totalprice / 50000) as bigint) as y from orders),
        p as (select y, avg(y) over (partition by o_custkey order by day, o_orderkey rows between 10 preceding and 1 preceding) as p from o)
        select {r('sqrt(avg((p - y) * (p - y)))', 'rmse')}, {r('avg(abs(p - y))', 'mae')},
        {r('avg(case when abs(round_even(p, 0) - y) <= 1 then 1 else 0 end)', 'within_1')} from p where p is not null""",
}
