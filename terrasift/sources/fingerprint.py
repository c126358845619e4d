"""Content fingerprint of a folder: every file's relative path and bytes.

A file of at most ``WHOLE`` bytes is the SHA-256 of its content. A larger one is read in the
splits that Spark cuts, as lines ended by a newline byte: the lines' SHA-256 are digested in
runs of ``RUN`` lines, and the runs with the file's length, which tells whether a newline ends
the file. So the digest depends on the bytes alone, not on where the splits lie. Bytes are
never decoded; a stretch without a newline byte has to fit a task.
"""

from __future__ import annotations

import os
import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrasift.session import cut_lineage

WHOLE = 64 << 20
RUN = 4096
_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def _name(folder: str) -> Column:
    """Path below ``folder``."""
    inner = re.sub(_SCHEME, "", folder)
    root = posixpath.normpath(inner if inner.startswith("/") else os.path.abspath(inner)).rstrip("/") + "/"
    # Spark gives the path as a URI, in which a plus sign stands for itself.
    path = F.regexp_replace(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), _SCHEME, "")
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 20)).otherwise(last)


def _ordered(column: str) -> str:
    """Digests ``h`` of a group, hex digits in one text, in the order of a column."""
    return f"array_join(transform(array_sort(collect_list(struct({column}, h))), e -> lower(hex(e.h))), '')"


def file_digests(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``name, h`` for the files of a folder and of the folders in it, but for empty files."""
    find = {"pathGlobFilter": pattern, "recursiveFileLookup": "true"}
    files = spark.read.format("binaryFile").options(**find).load(folder).filter(F.col("length") <= WHOLE)
    small = files.select(_name(folder).alias("name"), F.sha2("content", 256).alias("h"))
    text = spark.read.options(**find, lineSep="\n").text(folder).filter(F.col("_metadata.file_size") > WHOLE)
    lines = cut_lineage(
        text.select(
            _name(folder).alias("name"), F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_block_start").alias("start"), F.unhex(F.sha2("value", 256)).alias("h"),
            F.monotonically_increasing_id().alias("i"),
        ),
        "lines",
    )
    # A split's lines have successive numbers; what the splits before it hold makes them the file's.
    splits = lines.groupBy("name", "start").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("name").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    shifts = splits.select("name", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    numbered = lines.join(F.broadcast(shifts), ["name", "start"]).selectExpr("name", "size", "i + shift AS i", "h")
    runs = numbered.groupBy("name", "size", F.expr(f"i div {RUN} AS run")).agg(F.expr(f"unhex(sha2({_ordered('i')}, 256)) AS h"))
    large = runs.groupBy("name", "size").agg(F.expr(f"{_ordered('run')} AS runs"))
    return small.unionByName(large.select("name", F.expr("sha2(concat(size, '|', runs), 256) AS h")))


def dataset_fingerprint(files: DataFrame) -> DataFrame:
    """One ``fingerprint`` over ``name, h``; files meet in up to 256 groups first."""
    each = files.selectExpr("name", "h", "substr(sha2(name, 256), 1, 2) AS shard")
    shards = each.groupBy("shard").agg(F.expr("sha2(array_join(transform(array_sort(collect_list(struct(name, h))), e -> concat(e.name, e.h)), '|'), 256) AS h"))
    return shards.agg(F.expr("sha2(array_join(transform(array_sort(collect_list(struct(shard, h))), e -> e.h), '|'), 256) AS fingerprint"))
