"""Quality classifier: histogram gradient-boosted trees over document statistics.

Texts are measured once, vectorised, in the executors. The trees are fitted on the driver
on at most ``MAX_TRAIN`` labelled rows, chosen by a hash of the identifier; that bound is
the only place where rows are left out. The fitted arrays, a few kilobytes, go back to the
executors, where every row is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.llm.boosting import Trees, fit
from lagwise.llm.common import settle
from lagwise.llm.textstats import MEASURES, measured

MAX_TRAIN = 20_000
SEED = 11
THRESHOLD = 0.3
FOLDS = 5


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, measurements), written once and read by training and scoring."""
    found = docs.select("doc_id", measured(F.col(text)).alias("_m"))
    return settle(found.select("doc_id", *(F.col(f"_m.{n}").alias(n) for n in MEASURES)), "statistics")


def features(columns: dict[str, np.ndarray]) -> np.ndarray:
    """Size-free ratios, and the size itself; a text without words has ratios 0."""
    c = {k: np.asarray(v, dtype=np.float64) for k, v in columns.items()}
    words, lines, chars = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1), np.maximum(c["word_chars"], 1)
    return np.stack(
        [
            np.log1p(c["n_words"]),
            c["word_chars"] / words,
            c["n_symbols"] / words,
            c["n_dup_lines"] / lines,
            c["n_repeat_words"] / words,
            c["n_lines"] / words,
            c["n_upper"] / chars,
            c["n_exclaim"] / words,
            c["n_digits"] / chars,
            c["n_ends"] / words,
            c["n_punct"] / words,
            c["n_upper_words"] / words,
            c["n_long_words"] / words,
            c["n_distinct"] / words,
            c["n_rare_bytes"] / chars,
            c["n_first_lower"] / words,
        ],
        axis=1,
    )


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the identifier as text is divisible by ``FOLDS``; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(stats: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN) -> Trees:
    """Trees fitted on labelled rows outside the held-out fold.

    Labels other than 0 and 1 are left out. Without labels every score is 0.5; if all
    labels agree, it is their value, near enough.
    """
    known = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("double").alias("_y"))
    rows = stats.join(known.where(~held_out(F.col("doc_id"))), "doc_id")
    order = [F.xxhash64("doc_id", F.lit(SEED)), F.col("doc_id"), F.col("_y"), F.col("n_words")]
    chosen = rows.orderBy(*order).limit(max_train).select("_y", *MEASURES).toArrow()
    x = features({n: chosen[n].to_numpy() for n in MEASURES})
    return fit(x, chosen["_y"].to_numpy())


def score(stats: DataFrame, trees: Trees) -> Column:
    @F.arrow_udf("double")
    def run(*columns: pa.Array) -> pa.Array:
        x = features({n: c.to_numpy(zero_copy_only=False) for n, c in zip(MEASURES, columns)})
        return pa.array(trees.score(x))

    return run(*(F.col(n) for n in MEASURES))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Scores use the text alone. Null and empty texts are scored like any other. Repeated
    rows get equal scores; a null doc_id is not held out and is never a training row, as
    it matches no label. Columns other than doc_id and text are not read. No rows give no
    rows.
    """
    stats = statistics(docs)
    trees = train(stats, labels.select("doc_id", "quality"))
    return stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(stats, trees).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
