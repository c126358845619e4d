"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrasift.session import cut_lineage

#: White space of every text contract here: space and U+0009 to U+000D.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Columns of ``documents`` that the operators rely on.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: survives lost executors."""
    return cut_lineage(df, name)


def text_of(column: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def row_mark() -> Column:
    """64-bit mark of a raw text; with ``doc_id`` it names a row without carrying the text."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())


def fold(column: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null ids fall in fold 0."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus, F.lit(0)).cast("int")


def ranged_positions(df: DataFrame, order: list[Column], partitions: int, name: str) -> DataFrame:
    """``df`` with ``_at`` (0-based place in the total order) and ``_all`` (number of rows).

    Two passes: rows are cut into ranges of the sort key and written in order with their
    place inside the range; the ranges' row counts, one row each, give the offsets.
    """
    low = (1 << 33) - 1
    placed = stage(
        df.repartitionByRange(partitions, *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(low))),
        name,
    )
    starts = stage(offsets(placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))), f"{name}-offsets")
    return placed.join(starts, "_part").select(
        *df.columns, (F.col("_place") + F.col("_before")).alias("_at"), "_all"
    )


def offsets(totals: DataFrame) -> DataFrame:
    """``totals(_part, _n)``, one row per range, with the sum before it and the sum of all."""
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return totals.select(
        "_part",
        F.coalesce(F.sum("_n").over(upto), F.lit(0)).cast("long").alias("_before"),
        F.sum("_n").over(every).cast("long").alias("_all"),
    )


def ranges_for(rows: int, each: int = 1_000_000) -> int:
    """Number of sort ranges for so many small rows; grows with the input."""
    return max(8, -(-rows // each))


def keep_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows of ``docs`` that ``decisions(doc_id, mark, kept, repeats)`` keeps.

    ``decisions`` has one row per distinct (doc_id, raw text). Dropped and repeated ones go
    in one anti-join, so the texts of rows that stay meet a small table; of a kept row that
    occurs several times, one copy comes back.
    """
    names = docs.columns
    marked = docs.select(F.struct(*names).alias("_row"), F.col("doc_id").alias("_id"), row_mark().alias("_mark"))

    def matched(side: DataFrame, how: str) -> DataFrame:
        key = side.select(F.col("doc_id").alias("_i"), F.col("mark").alias("_m"))
        return marked.join(key, marked["_id"].eqNullSafe(key["_i"]) & (marked["_mark"] == key["_m"]), how)

    single = matched(decisions.filter(~F.col("kept") | (F.col("repeats") > 1)), "left_anti")
    again = matched(decisions.filter(F.col("kept") & (F.col("repeats") > 1)), "left_semi")
    return single.select("_row").unionByName(
        again.dropDuplicates(["_id", "_mark"]).select("_row")
    ).select(*[F.col("_row").getField(c).alias(c) for c in names])
