"""Files as sources, with bad records set aside, and sorted Parquet as a sink.

A file that cannot be read must not end a load, and must not vanish either: readers return
the rows that fit the schema and, apart, what did not, with the file's path and a reason.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagwise.session import settle
from lagwise.sources.tables import read_documents, read_table

_BAD = "_bad"
# Opening and closing a file takes milliseconds, so a task gets few of them.
DOCUMENTS_PER_FOLDER = 500
_FOLDER = "_folder"


def _with_bad(schema: T.StructType | str) -> T.StructType:
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    return T.StructType([*fields.fields, T.StructField(_BAD, T.StringType())])


def write_documents(df: DataFrame, path: str, body: str = "body") -> None:
    """A text file per row, in folders of about ``DOCUMENTS_PER_FOLDER`` files.

    Rows are dealt evenly, and a folder is written by a task of its own: tasks grow with the
    number of rows, however few bytes these have, and a folder is put in place as a whole
    instead of file by file.
    """
    rows = settle(df.select(body), "documents")
    # A number of its own: the adaptive plan would join such small parts again.
    dealt = rows.repartition(max(1, -(-rows.count() // DOCUMENTS_PER_FOLDER)))
    placed = dealt.withColumn(_FOLDER, F.spark_partition_id())
    placed.write.partitionBy(_FOLDER).option("maxRecordsPerFile", 1).text(path)


def read_json_files(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """One JSON document per file, over any number of lines: ``(rows, rejected)``.

    ``rows`` has the path, the body and the columns of the schema; ``rejected`` the path, the
    body and the reason: ``empty file`` (white space only), ``not JSON`` or ``other shape``
    (JSON whose values do not fit the schema). Files of no bytes at all hold no record.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    blank = F.trim(F.regexp_replace("body", r"\s+", " ")) == ""
    read = read_documents(spark, path).withColumn("_doc", F.from_json("body", _with_bad(schema), options))
    reason = (
        F.when(blank, "empty file")
        .when(F.col(f"_doc.{_BAD}").isNotNull() | F.col("_doc").isNull(), F.when(F.expr("try_parse_json(body)").isNull(), "not JSON").otherwise("other shape"))
    )
    marked = read.withColumn("reason", reason)
    rows = marked.where(F.col("reason").isNull()).select("path", "body", "_doc.*").drop(_BAD)
    return rows, marked.where(F.col("reason").isNotNull()).select("path", "body", "reason")


def read_csv_files(
    spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True, multi_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """CSV by an explicit schema: ``(rows, rejected)``, the latter with path, line and reason.

    A line with too few or too many fields, or a field that does not fit its type, is
    rejected. With a header its names must be those of the schema. The files are read once.
    """
    full = _with_bad(schema)
    reader = spark.read.schema(full).option("columnNameOfCorruptRecord", _BAD).option("mode", "PERMISSIVE")
    df = reader.csv(path, header=header, enforceSchema=not header, multiLine=multi_line)
    read = settle(df.withColumn("path", F.col("_metadata.file_path")), "csv")
    rows = read.where(F.col(_BAD).isNull()).select(*full.names[:-1])
    rejected = read.where(F.col(_BAD).isNotNull()).select("path", F.col(_BAD).alias("line"), F.lit("does not fit the schema").alias("reason"))
    return rows, rejected


def write_sorted(df: DataFrame, path: str, order: Sequence[str], mode: str = "overwrite", files: int | None = None) -> None:
    """Parquet in one order over all files, without a single task for the whole sort.

    Rows are ranged by ``order`` and sorted inside each range, so a file covers a narrow span
    and readers that filter on the first columns skip the others by their statistics.
    """
    ranged = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.mode(mode).parquet(path)


def read_sorted(spark: SparkSession, path: str, order: Sequence[str], rank: str = "rank") -> DataFrame:
    """A table of ``write_sorted`` with each row's 0-based place in it, as the files lie.

    Files are numbered by name and rows by their index in the file; only the files' row
    counts are put in order on one task, and nothing is sorted again.
    """
    df = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    sizes = {r["_file"]: r["count"] for r in df.groupBy("_file").count().collect()}  # a row per file
    starts, total = [], 0
    for name in sorted(sizes):
        starts.append((name, total))
        total += sizes[name]
    before = F.broadcast(spark.createDataFrame(starts, "_file string, _start long"))
    return df.join(before, "_file").withColumn(rank, F.col("_start") + F.col("_index")).drop("_file", "_index", "_start")


def split_to(parts: dict[str, DataFrame], path: str, order: Sequence[str]) -> None:
    """Each part (train, test, hold-out) as a sorted table in a folder of its name."""
    for name, df in parts.items():
        write_sorted(df, f"{path}/{name}", order)


def load_matrix(
    spark: SparkSession,
    path: str,
    features: Sequence[str],
    target: str,
    ids: Sequence[str] = ("game_pk", "pitcher_id", "game_date"),
    year: int | None = None,
    date: str = "game_date",
) -> DataFrame:
    """The model's columns of a stored matrix, of one year if given.

    Only these columns are read, and the year's condition reaches the files' statistics.
    """
    return read_table(spark, path, [*ids, target, *features], year, date)
