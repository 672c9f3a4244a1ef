"""Files in and out: documents and CSV with bad records, sorted splits, saved models and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagwise.models import features as MF
from lagwise.models import training as MT
from lagwise.operators import clean, nested
from lagwise.session import scratch_path
from lagwise.sources import files as S
from lagwise.sources import tables as T
from workload import documents, modelled
from workload.common import d, i, orders, r, tidy
from workload.games import CHAIN

BASE = ["o_orderkey", "o_custkey", "day", "o_totalprice"]
TRAIN, TEST, HOLDOUT = (1995, 1996, 1997, 1998), (1999, 2000), 2001


def _document_files(spark, sf_dir):
    """Feeds as files, one each; some are cut short, some empty, some of another shape."""
    feeds = documents._feeds(spark, sf_dir)
    k = F.col("game_pk")
    bad = feeds.where(k % 5 == 0).withColumn(
        "body",
        F.when(k % 3 == 0, F.substring("body", 1, 60)).when(k % 3 == 1, F.lit("  ")).otherwise(F.lit('{"game_pk": "none", "doc": [1]}')),
    )
    path = scratch_path(spark, "feeds")
    named = feeds.select(F.to_json(F.struct("game_pk", F.col("body").alias("doc"))).alias("body"))
    S.write_documents(named.union(bad.select("body")), path)
    return S.read_json_files(spark, path, "game_pk long, doc string")


def document_files(spark, sf_dir):
    rows, _ = _document_files(spark, sf_dir)
    return tidy(nested.game_feed_rows(rows.select("game_pk", F.col("doc").alias("body")))[0])


def document_files_rejected(spark, sf_dir):
    _, rejected = _document_files(spark, sf_dir)
    return tidy(rejected.groupBy("reason").agg(F.count("*").alias("n_files"), F.count_distinct("path").alias("n_paths")))


def _csv(spark, sf_dir):
    """Orders as CSV lines; some have a word for a price, some a field too many or too few."""
    k = F.col("o_orderkey")
    line = F.concat_ws(
        ",", k, "o_custkey", F.col("day").cast("string"),
        F.when(k % 31 == 1, F.lit("dear")).otherwise(F.col("o_totalprice").cast("string")),
        F.when(k % 31 == 2, F.lit("more")),
    )
    line = F.when(k % 31 == 3, F.concat(k, F.lit(",7"))).otherwise(line)
    path = scratch_path(spark, "csv")
    orders(spark, sf_dir).select(line.alias("line")).write.text(path)
    return S.read_csv_files(spark, path, "o_orderkey long, o_custkey long, day date, o_totalprice double", header=False)


def csv_files(spark, sf_dir):
    return tidy(_csv(spark, sf_dir)[0], 4)


def csv_files_rejected(spark, sf_dir):
    bad = _csv(spark, sf_dir)[1]
    return tidy(bad.select("line", "reason"))


def split_sorted(spark, sf_dir):
    """Train, test and hold-out tables in date order: each row with its place in its table."""
    rows = orders(spark, sf_dir).select(*BASE)
    path, order = scratch_path(spark, "split"), ["day", "o_orderkey"]
    parts = dict(zip(("train", "test", "holdout"), clean.split_by_year(rows, "day", TRAIN, TEST, HOLDOUT)))
    S.split_to(parts, path, order)
    out = [S.read_sorted(spark, f"{path}/{name}", order).withColumn("part", F.lit(name)) for name in parts]
    return tidy(out[0].unionByName(out[1]).unionByName(out[2]), 4)


def matrix_load(spark, sf_dir):
    """One year of a few columns of a matrix that is stored in date order."""
    path = scratch_path(spark, "matrix")
    stored = modelled._matrix(spark, sf_dir).withColumn("n", F.lit(1))
    S.write_sorted(stored, path, ["game_date", "game_pk"])
    return tidy(S.load_matrix(spark, path, ["strikeouts_mean_3", "absent"], "strikeouts", year=1997))


def saved_model(spark, sf_dir):
    """The hold-out scores of a model that was saved and loaded."""
    df = modelled._cells(spark, sf_dir)
    past, test = clean.split_by_year(df, "game_date", modelled.TRAIN, modelled.TEST)
    path = scratch_path(spark, "model")
    MT.train(past, ["opp_mean_3"], modelled.TARGET, "forest", params=modelled.ONE_TREE).save(path)
    return tidy(MT.Trained.load(spark, path).evaluate(test))


def saved_importances(spark, sf_dir):
    """Importances as a CSV file, largest first, and the features that they keep."""
    df = modelled._cells(spark, sf_dir)
    found = MF.forest_importances(df, ["opp_mean_3", "wx_mean_3"], modelled.TARGET, 1, {"bootstrap": False, "featureSubsetStrategy": "all", "maxDepth": 1})
    path = scratch_path(spark, "importances")
    S.write_sorted(MF.importance_table(spark, list(found), list(found.values())).withColumn("order", -F.col("importance")), path, ["order", "feature"])
    ranked = S.read_sorted(spark, path, ["order", "feature"], "place").drop("order")
    T.write_csv(ranked, f"{path}-csv")
    back, _ = S.read_csv_files(spark, f"{path}-csv", ranked.schema)
    kept = MF.keep_important(list(found), back)
    return tidy(back.withColumn("kept", F.col("feature").isin(kept)))


def saved_trials(spark, sf_dir):
    """The trial log of a search, written as JSON and read back."""
    path = scratch_path(spark, "trials")
    trials = modelled.parameter_search(spark, sf_dir)
    T.write_json(trials, path)
    return tidy(spark.read.schema(trials.schema).json(path))


def column_choices(spark, sf_dir):
    """Regular-season rows only, columns renamed, and which are texts for a model to index."""
    rows = orders(spark, sf_dir).select(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", F.when(F.col("o_orderkey") % 4 != 0, "R").otherwise("S").alias("game_type")
    )
    some = clean.regular_season(rows)
    texts = clean.categorical_columns(some, ["o_custkey"], "o_orderkey", ["game_type", "o_orderstatus"])
    return tidy(clean.prefixed(some, "x_", ["o_orderkey"]).withColumn("texts", F.lit(",".join(texts))))


_QUERY_FUNCTIONS = [
    document_files, document_files_rejected, csv_files, csv_files_rejected, split_sorted, matrix_load, saved_model,
    saved_importances, saved_trials, column_choices,
]
QUERIES = {f.__name__: f for f in _QUERY_FUNCTIONS}

_PRICE = "cast(o_totalprice as double)"
_LINE = """o_orderkey || ',' || case when o_orderkey % 31 = 3 then '7' else o_custkey || ',' || strftime(cast(o_orderdate as date), '%Y-%m-%d') || ','
    || case when o_orderkey % 31 = 1 then 'dear' else cast(o_totalprice as varchar) || ',more' end end"""
_PART = f"""case when yr = {HOLDOUT} then 'holdout' when yr in {TRAIN} then 'train' when yr in {TEST} then 'test' end"""
ORACLE = {
    "document_files": documents.ORACLE["game_feed"],
    "document_files_rejected": f"""{CHAIN} select case game_pk % 3 when 0 then 'not JSON' when 1 then 'empty file' else 'other shape' end as reason,
        count(*) as n_files, count(*) as n_paths from box where game_pk % 5 = 0 group by 1""",
    "csv_files": f"""select o_orderkey, o_custkey, {d('o_orderdate', 'day')}, {r(_PRICE, 'o_totalprice', 4)} from orders where o_orderkey % 31 not in (1, 2, 3)""",
    "csv_files_rejected": f"select {_LINE} as line, 'does not fit the schema' as reason from orders where o_orderkey % 31 in (1, 2, 3)",
    "split_sorted": f"""select o_orderkey, o_custkey, {d('o_orderdate', 'day')}, {r(_PRICE, 'o_totalprice', 4)}, {_PART} as part,
        row_number() over (partition by {_PART} order by cast(o_orderdate as date), o_orderkey) - 1 as rank
        from (select *, year(cast(o_orderdate as date)) as yr from orders) where {_PART} is not null""",
    "matrix_load": f"""select o_orderkey as game_pk, o_custkey as pitcher_id, {d('o_orderdate', 'game_date')}, y as strikeouts, {r('m', 'strikeouts_mean_3')} from (
        select *, avg(y) over (partition by o_custkey order by cast(o_orderdate as date), o_orderkey rows between 3 preceding and 1 preceding) as m
        from (select *, cast(trunc(o_totalprice / 50000) as bigint) as y from orders)) where year(cast(o_orderdate as date)) = 1997""",
    "saved_model": f"with {modelled._G} select {modelled._SCORES} from {modelled._means('k', modelled._PAST, modelled._AHEAD)}",
    "saved_importances": f"""with {modelled._G}, means as (select avg(k) as e from g),
        f as (select 'opp_mean_3' as feature, coalesce(k, e) as v, y from g, means union all select 'wx_mean_3', b, y from g), {modelled._SPLITS}
        select feature, importance, case feature when 'opp_mean_3' then 'Opponent' else 'Context' end as "group",
        row_number() over (order by importance desc, feature) - 1 as place, {i('importance > 0', 'kept')} from won""",
    "saved_trials": modelled.ORACLE["parameter_search"],
    "column_choices": """select o_orderkey, o_custkey as x_o_custkey, o_orderpriority as x_o_orderpriority, o_orderstatus as x_o_orderstatus, 'R' as x_game_type,
        'o_orderpriority' as texts from orders where o_orderkey % 4 <> 0""",
}
