"""Exact duplicates by an extendible-hash index whose files lie in the shared folder.

The hash of the normalised text is the key. A directory over the leading bits of the key
doubles until no bucket holds more than ``capacity`` different keys; each directory entry
names a bucket and its local depth. Each text is sent to its bucket through its slot of the
directory. There equal bytes collapse (each task collapses its own before the shuffle, so a
text that fills a third of the table is one row a task), and different texts under one key are
numbered as a chain; the index lies in the shared folder in ranges of buckets. Rows are looked
up the same way: slot, bucket, key, then the entry of the chain with the same digest.
Everything runs as DataFrame functions. The directory has one row for ``capacity`` keys, so
Spark can send it to every task as long as its size allows that.

Defined cases: a null text counts as empty; null ids never win over an id, and a group with
null ids only keeps one of its rows under ``keep_id`` null; of fully repeated rows (same id,
equal text) exactly one is kept, of several raw texts under the kept id that of the smallest
mark; an empty table gives an empty result; other columns of the input are ignored by
``groups`` and carried along by ``deduplicate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.llm.common import BLANK, keep_rows, row_mark, stage, text_of

#: Different keys that a bucket holds at most.
CAPACITY = 20_000
KEY_BITS = 64


def normalised(text: str | Column = "text") -> Column:
    return F.regexp_replace(text_of(text), BLANK, " ")


def leading_bits(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, KEY_BITS - bits) if bits else F.lit(0).cast("long")


def entries(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, key, text_sha256) of every row, written once."""
    rows = docs.select("doc_id", row_mark().alias("mark"), normalised().alias("_norm"))
    return stage(
        rows.select("doc_id", "mark", F.xxhash64("_norm").alias("key"), F.sha2("_norm", 256).alias("text_sha256")),
        "dedup-entries",
    )


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """Directory rows (slot, bucket, local_depth) over different ``keys(key)``; its depth.

    Only the greatest fill of a bucket comes to the driver in each round of doubling.
    """
    total = keys.count()
    depth = max(0, (max(total, 1) - 1) // capacity).bit_length()
    while True:
        fill = keys.groupBy(leading_bits(F.col("key"), depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
        fullest = fill.agg(F.max("n")).first()[0] or 0
        if fullest <= capacity or depth >= KEY_BITS - 1:
            break
        depth += 1
    # A bucket's local depth is the shortest prefix whose keys fit, so sparse neighbours share one.
    slots = keys.sparkSession.range(1 << depth).select(F.col("id").alias("slot"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d")
    prefix = F.expr(f"shiftright(slot, cast({depth} - d as int))").alias("prefix")
    fits = (
        fill.select("slot", "n", levels).select(prefix, "d", "n")
        .groupBy("d", "prefix").agg(F.sum("n").alias("n")).filter(F.col("n") > capacity)
    )
    over = slots.select("slot", levels).select("slot", "d", prefix).join(fits, ["d", "prefix"], "left_semi")
    deepest = over.groupBy("slot").agg(F.max("d").alias("deep"))
    rows = slots.join(deepest, "slot", "left").select(
        "slot", F.least(F.coalesce(F.col("deep") + 1, F.lit(0)), F.lit(depth)).alias("local_depth")
    )
    bucket = F.expr(f"shiftleft(1L, local_depth) + shiftright(slot, cast({depth} - local_depth as int))")
    return stage(rows.select("slot", bucket.alias("bucket"), "local_depth"), "dedup-directory"), depth


def owned(rows: DataFrame, places: DataFrame, depth: int) -> DataFrame:
    """``rows(key, ...)`` with the bucket that the directory gives their slot."""
    return rows.withColumn("slot", leading_bits(F.col("key"), depth)).join(places.select("slot", "bucket"), "slot").drop("slot")


def index(docs: DataFrame, places: DataFrame, depth: int) -> DataFrame:
    """Index rows (bucket, key, text_sha256, keep_id, keep_mark, group_size, chain), written by bucket."""
    texts = docs.select("doc_id", row_mark().alias("mark"), normalised().alias("_norm")).withColumn("key", F.xxhash64("_norm"))
    # Ids before no id, then the smallest; bytes are compared by the grouping itself.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("least")
    equal = owned(texts, places, depth).groupBy("bucket", "key", "_norm").agg(least, F.count(F.lit(1)).alias("group_size"))
    # Written without the texts, so that the sampling of the ranges does not read them again.
    entry = stage(equal.select(
        "bucket", "key", F.sha2("_norm", 256).alias("text_sha256"), F.col("least.doc_id").alias("keep_id"),
        F.col("least.mark").alias("keep_mark"), "group_size",
    ), "dedup-owned").repartitionByRange("bucket", "key")
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy(F.col("keep_id").asc_nulls_last(), "text_sha256"))
    return stage(entry.withColumn("chain", chain).sortWithinPartitions("bucket", "key", "chain"), "dedup-index")


def groups(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, mark, keep_id, group_size, kept, text_sha256, bucket, chain."""
    listed = entries(docs)
    places, depth = directory(listed.select("key").distinct(), capacity)
    found = index(docs, places, depth)
    # Fully repeated rows travel as one with their count.
    rows = listed.groupBy("doc_id", "mark", "key", "text_sha256").agg(F.count(F.lit(1)).alias("repeats"))
    wins = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("mark") == F.col("keep_mark"))
    return (
        owned(rows, places, depth)
        .join(found, ["bucket", "key", "text_sha256"])
        .select("*", F.explode(F.sequence(F.lit(1).cast("long"), "repeats")).alias("copy"))
        .select("doc_id", "mark", "keep_id", "group_size", (wins & (F.col("copy") == 1)).alias("kept"), "text_sha256", "bucket", "chain")
    )


def deduplicate(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    decided = stage(
        groups(docs, capacity).groupBy("doc_id", "mark").agg(
            F.max("kept").alias("kept"), F.count(F.lit(1)).alias("repeats")
        ),
        "dedup-decisions",
    )
    return keep_rows(docs, decided)
