"""Shards cut from a Hilbert curve through several metadata dimensions.

Size, source and language of a row are quantised to equal numbers of cells; rows are sorted
by the Hilbert index of their cell and cut into runs of equal row counts. A run covers a small
box in every dimension, so the minima and maxima of its file prune filters on any of them.

Law: ``rows``: the counts of two shards differ by at most one. A group of equal texts lies at
one place of the curve, the least of its rows' places, so the group stays together whatever its
sources and languages; only a group that a cut between two shards meets runs on into the next.

Defined cases: a null text has 8 bytes and the checksum of an empty one; null source or
language is the last cell of its dimension; ties on the curve go by checksum, then id; fully
repeated rows take neighbouring slots; fewer rows than shards leave shards empty; an empty
table gives an empty result; other columns are ignored by ``place`` and carried by ``write``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import ranged_positions, ranges_for, row_mark, stage, text_of

SHARDS = 24
#: Bits of a dimension on the curve.
BITS = 6
OVERHEAD = 8


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the curve of integer ``cells`` (rows x dimensions), after Skilling (2004)."""
    x = cells.astype(np.int64).T.copy()
    dimensions = len(x)
    for level in range(bits - 1, 0, -1):
        high, low = np.int64(1 << level), np.int64((1 << level) - 1)
        for i in range(dimensions):
            set_here = (x[i] & high) != 0
            swap = np.where(set_here, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_here, low, swap)
            x[i] ^= swap
    for i in range(1, dimensions):
        x[i] ^= x[i - 1]
    turned = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turned ^= np.where((x[-1] & (1 << level)) != 0, (1 << level) - 1, 0)
    x ^= turned
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dimensions):
            index = index << 1 | x[i] >> level & 1
    return index


def curve_index(*columns: str) -> Column:
    def index(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(hilbert_index(np.stack([c.to_numpy() for c in part], axis=1)))

    # The hints name the kind of vectorised function.
    index.__annotations__ = {"parts": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return F.pandas_udf(index, "long")(*columns)


def metadata(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, size, text_crc32, source, lang) of every row, written once."""
    return stage(
        docs.select(
            "doc_id", row_mark().alias("mark"), "source", "lang",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text_of().cast("binary")).alias("text_crc32"),
        ),
        "shard-metadata",
    )


def cell(column: Column, cells: int = 1 << BITS) -> Column:
    return F.least(F.greatest(column, F.lit(0)), F.lit(cells - 1)).cast("int")


def quantised(rows: DataFrame, name: str, bits: int = BITS) -> DataFrame:
    """(name, cell): the different values of a column in order, cut into equal runs."""
    values = rows.select(name).distinct()
    places = ranged_positions(values, [F.col(name).asc_nulls_last()], 8, f"shard-{name}")
    return stage(
        places.select(name, cell(F.floor(F.col("_at") * (1 << bits) / F.col("_all")), 1 << bits).alias("cell")),
        f"shard-{name}-cells",
    )


def place(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, mark, size, text_crc32, curve, shard, slot."""
    rows = metadata(docs)
    # Half octaves of the size: fixed cells, so equal sizes never part.
    size_cell = cell(F.floor(F.log2(F.col("size").cast("double")) * 2), 1 << BITS)
    celled = rows.withColumn("_size", size_cell)
    for name in ("source", "lang"):
        cells = quantised(rows, name).select(F.col(name).alias("_value"), F.col("cell").alias(f"_{name}"))
        celled = celled.join(cells, celled[name].eqNullSafe(cells["_value"])).drop("_value", name)
    curve = stage(
        celled.select("doc_id", "mark", "size", "text_crc32", curve_index("_size", "_source", "_lang").alias("curve")),
        "shard-curve",
    )
    celled_rows = curve.count()
    # Equal texts have one mark; narrow rows, so a large group costs a pass and no text.
    home = stage(curve.groupBy("mark").agg(F.min("curve").alias("_home")), "shard-groups")
    curve = curve.join(home, "mark").select("doc_id", "mark", "size", "text_crc32", F.col("_home").alias("curve"))
    order = [F.col("curve").asc(), F.col("text_crc32").asc(), F.col("mark").asc(), F.col("doc_id").asc()]
    at = ranged_positions(curve, order, ranges_for(celled_rows), "shard-order")
    base, extra = F.expr(f"_all div {shards}"), F.col("_all") % shards
    longer = extra * (base + 1)
    rest = F.col("_at") - longer
    first = F.col("_at") < longer
    shard = F.when(first, F.expr(f"_at div (_all div {shards} + 1)")).otherwise(extra + F.floor(rest / F.greatest(base, F.lit(1))))
    slot = F.when(first, F.col("_at") % (base + 1)).otherwise(rest % F.greatest(base, F.lit(1)))
    return at.select(
        "doc_id", "mark", "size", "text_crc32", "curve", shard.cast("int").alias("shard"), slot.cast("long").alias("slot")
    )


def write(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write ``docs`` as one folder per shard under ``path``, in slot order inside a file."""
    placed = place(docs, shards).groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.struct("shard", "slot"))).alias("_to"))
    names = docs.columns
    rows = docs.select(
        F.struct(*names).alias("_row"), F.col("doc_id").alias("_id"), row_mark().alias("_mark"),
    )
    joined = rows.join(placed, rows["_id"].eqNullSafe(placed["doc_id"]) & (rows["_mark"] == placed["mark"]))
    # A fully repeated row stands for all its slots once.
    once = joined.dropDuplicates(["_id", "_mark"]).select("_row", F.explode("_to").alias("_to"))
    once.select(F.col("_to.shard").alias("shard"), F.col("_to.slot").alias("slot"), F.col("_row").alias("row")) \
        .repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
