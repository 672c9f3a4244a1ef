"""Mixing sources to target weights by subset-sum budget fitting.

1. Sizes are summed by source; weights share the budget, and no source's target exceeds
   ``max_repeat`` times its size (the excess is shared anew until none does).
2. Whole repeats of a source are taken as often as they fit.
3. The rest of the budget is filled by documents counted by exact length: first each length
   in proportion, then single documents until the gap is under ``WINDOW`` words, then a
   bounded-knapsack programme over the remaining counts closes the gap.
4. Of each length, the chosen number of documents is picked by seeded hash rank.

A source's table of lengths has as many rows as it has distinct lengths, not documents,
which is all that one task ever holds. Ranks are taken in hashed sub-groups, so a length
that a third of all documents share is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.llm.common import positions, ranked, settle, whole, whole_order, word_count

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
WINDOW = 1 << 14
SEED = 17


def targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) with each source's ``target``.

    Sources in order of code points, null last, get the weights in turn. The common level
    per unit of weight rises until every source is either at it or at its own bound.
    """
    placed, _ = positions(totals.select("source", "source_size"), [F.col("source").asc_nulls_last()], "_place")
    weighted = settle(
        placed.withColumn(
            "_weight", F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_place") % len(weights)).cast("int"))
        ),
        "weights",
    )
    bound = F.col("source_size") * max_repeat
    total = float(weighted.agg(F.sum("source_size")).first()[0] or 0) * share
    level, at_bound = 0.0, None
    while True:
        full = (F.col("_weight") * F.lit(level) >= bound) if at_bound is not None else F.lit(False)
        s = weighted.agg(
            F.sum(F.when(full, bound).otherwise(0)).alias("fixed"),
            F.sum(F.when(full, 0).otherwise(F.col("_weight"))).alias("weight"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if s.n == at_bound or not s.weight:
            break
        at_bound = s.n
        level = max(level, (total - float(s.fixed)) / s.weight)
    return weighted.select(
        "source", "source_size", F.least(F.col("_weight") * F.lit(level), bound.cast("double")).alias("target")
    )


def fit_budget(size: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take so that their sizes sum to about ``budget``.

    The sum is the reachable one nearest to the budget within the last ``WINDOW`` words,
    given the proportional start.
    """
    taken = np.zeros(len(size), dtype=np.int64)
    total = int((size * count).sum())
    if budget <= 0 or total <= 0:
        return taken
    if budget >= total:
        return count.copy()
    part = count * (budget / total)
    taken = np.minimum(np.floor(part).astype(np.int64), count)
    gap = budget - int((taken * size).sum())
    for i in np.lexsort((size, taken - part)):  # largest fraction left first
        if gap <= WINDOW:
            break
        if taken[i] < count[i] and size[i] <= gap:
            taken[i] += 1
            gap -= int(size[i])
    for i in np.argsort(-size, kind="stable"):  # lengths beyond one more document each
        if gap <= WINDOW:
            break
        more = min(int(count[i] - taken[i]), (gap - WINDOW // 2) // int(size[i]))
        if more > 0:
            taken[i] += more
            gap -= more * int(size[i])
    return taken + _knapsack(size, count - taken, gap)


def _knapsack(size: np.ndarray, left: np.ndarray, gap: int) -> np.ndarray:
    """Bounded knapsack over sums as a bit set, one step per power of two of a count."""
    more = np.zeros(len(size), dtype=np.int64)
    usable = np.flatnonzero(left > 0)
    if gap <= 0 or not len(usable):
        return more
    room = gap + int(size[usable].min())
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for i in usable[np.argsort(-size[usable], kind="stable")]:
        n, unit = min(int(left[i]), room // int(size[i])), 1
        while n > 0:
            k = min(unit, n)
            steps.append((int(i), k, reach))
            reach |= (reach << (k * int(size[i]))) & full
            n, unit = n - k, unit * 2
        if reach >> gap & 1:
            break
    below = (reach & ((1 << (gap + 1)) - 1)).bit_length() - 1
    above = reach >> (gap + 1)
    at = below
    if above:
        over = gap + (above & -above).bit_length()
        at = over if over - gap < gap - below else below
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            more[i] += k
            at -= k * int(size[i])
    return more


def _chosen(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("size")
    taken = fit_budget(group["size"].to_numpy(), group["_n"].to_numpy(), int(round(group["_rest"].iloc[0])))
    return pd.DataFrame({"_key": group["_key"], "size": group["size"], "_n": group["_n"], "_take": taken})


def _key(source: Column) -> Column:
    """Sources as never-null text; null is unlike every name."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.0,
    max_repeat: int = MAX_REPEAT,
    seed: int = SEED,
    text: str = "text",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``.

    ``taken`` is the size times the number of copies that the mix holds, 0 to ``max_repeat``.
    Null and empty texts have size 0 and are taken 0 words. A null source is a source.
    Repeated rows are documents of their own. Reruns give the same rows. Other columns are
    not read; no rows give no rows.
    """
    sizes = settle(
        docs.select("doc_id", "source", word_count(F.col(text)).alias("size")).withColumn("_key", _key(F.col("source"))), "sizes"
    )
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = targets(totals, weights, share, max_repeat)
    ratio = F.col("target") / F.greatest("source_size", F.lit(1))
    aims = settle(
        aims.withColumn("_repeat", F.least(F.floor(ratio + 1e-12), F.lit(max_repeat)))
        .withColumn("_rest", F.col("target") - F.col("_repeat") * F.col("source_size"))
        .withColumn("_key", _key(F.col("source")))
        .drop("source"),
        "targets",
    )
    lengths = sizes.where("size > 0").groupBy("_key", "size").agg(F.count("*").alias("_n")).join(aims.select("_key", "_rest"), "_key")
    chosen = settle(
        lengths.groupBy("_key").applyInPandas(_chosen, "_key string, size long, _n long, _take long"), "lengths"
    )
    rows = sizes.join(chosen, ["_key", "size"], "left").join(aims, "_key").drop("_rest")
    part = (F.col("_take") > 0) & (F.col("_take") < F.col("_n"))
    picked = ranked(settle(rows, "mixed"), ["_key", "size"], "_n", [F.col("doc_id")], seed, "_rank", where=part)
    extra = F.when(F.col("_take") >= F.col("_n"), 1).when(F.coalesce(F.col("_rank") < F.col("_take"), F.lit(False)), 1).otherwise(0)
    return picked.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("size") * (F.col("_repeat") + extra)).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as it is taken, all its columns.

    Rows that agree in doc_id, source and size share what is taken of them, in the order of
    all their columns, so that reruns agree.
    """
    names = ["doc_id", "source", "size"]
    plan = mix_sources(docs, text=text, **options).where("taken > 0").select(*names, (F.col("taken") / F.col("size")).cast("int").alias("n"))
    plan = plan.groupBy(*names).agg(F.sum("n").alias("_n"), F.count("*").alias("_rows"))
    plan = plan.select(F.xxhash64(*names).alias("_k"), *(F.col(c).alias(f"_{c}") for c in names), "_n", "_rows")
    keyed = whole(docs).withColumn("_key", F.xxhash64("_row.doc_id", "_row.source", word_count(F.col(f"_row.`{text}`"))))
    doc_id, source = keyed["_row"]["doc_id"], keyed["_row"]["source"]
    same = (keyed["_key"] == plan["_k"]) & doc_id.eqNullSafe(plan["_doc_id"]) & source.eqNullSafe(plan["_source"])
    found = keyed.join(plan, same)
    place = F.row_number().over(Window.partitionBy("_k", "_doc_id", "_source").orderBy(*whole_order(docs)))
    # Equal rows take turns; nearly always there is one.
    copies = F.floor(F.col("_n") / F.col("_rows")) + F.when(F.col("_rows") > 1, (place <= F.col("_n") % F.col("_rows")).cast("int")).otherwise(0)
    return found.withColumn("_copies", copies.cast("int")).where("_copies > 0").select(
        "_row", F.explode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_copy")
    ).select("_row.*")
