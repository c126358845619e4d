"""Ranks, ordinals and bands over whole tables without a single-task window.

A global ``row_number`` would pull the table into one task, and one per district would do
the same for a hot district. Instead Spark's range partitioner cuts the rows into ranges of
the sort key, rows are numbered inside each range and shifted by the counts of the ranges
before. The cuts only balance the work: any choice of them gives the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.session import cut_lineage


def in_ranges(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Add ``_range``, the key range a row falls in; equal keys share a range, nulls come first.

    Spark's range partitioner cuts the ranges, as many as the shuffle has partitions, and
    small ones are merged at run time. The rows are written with the number of their range:
    a second reading of the plan would cut elsewhere.
    """
    keyed = df.withColumn("_keys", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]))
    return cut_lineage(keyed.repartitionByRange("_keys").drop("_keys").withColumn("_range", F.spark_partition_id()), "ranges")


def _same_group(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``names``, null groups included; the columns come from ``left`` once."""
    renamed = right.withColumnsRenamed({c: f"_same_{c}" for c in names})
    condition = F.lit(True)
    for c in names:
        condition &= left[c].eqNullSafe(renamed[f"_same_{c}"])
    return left.join(renamed, condition, how).drop(*[f"_same_{c}" for c in names])


def ordinal(
    df: DataFrame,
    order: Sequence[Column],
    by: Sequence[str] = (),
    name: str = "ordinal",
    weight: str | None = None,
) -> DataFrame:
    """Add the 1-based position within ``by`` in ascending ``order``.

    ``order`` should identify a row (end it with an id); nulls come first. With
    ``weight`` the column is the running total of ``weight`` including the row.
    """
    keys = [F.col(c) for c in by] + list(order)
    ranged = in_ranges(df, keys)
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    totals = ranged.groupBy("_range", *by).agg(amount.alias("_amount"))
    # One row per range and group: small, since groups are contiguous across ranges.
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_range", *by, F.coalesce(F.sum("_amount").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("_range", *by).orderBy(*order)
    local = (
        F.row_number().over(inside)
        if weight is None
        else F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        _same_group(ranged, offsets, ["_range", *by])
        .withColumn(name, local + F.col("_before"))
        .drop("_range", "_before")
    )


def previous_row(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], columns: Sequence[str]
) -> DataFrame:
    """Add ``prev_<column>`` from the row before within ``by``; null on the first row.

    Like ``lag``, but a hot key is spread over ranges: only each range's first row looks
    at the last row of the range before it.
    """
    keys = [F.col(c) for c in by] + list(order)
    ranged = in_ranges(df, keys)
    carried = F.struct(*[F.col(c) for c in columns])
    last = ranged.groupBy("_range", *by).agg(
        F.max_by(carried, F.struct(*order)).alias("_last")
    )
    steps = Window.partitionBy(*by).orderBy("_range")
    edge = last.select("_range", *by, F.lag("_last").over(steps).alias("_edge"))
    inside = Window.partitionBy("_range", *by).orderBy(*order)
    joined = _same_group(ranged, edge, ["_range", *by]).withColumns(
        {"_prior_row": F.lag(carried).over(inside), "_opens_range": F.row_number().over(inside) == 1}
    )
    source = F.when(F.col("_opens_range"), F.col("_edge")).otherwise(F.col("_prior_row"))
    return joined.select(
        *df.columns, *[source[c].alias(f"prev_{c}") for c in columns]
    )


def value_positions(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct value: ``n`` peers, ``before`` rows below it, ``total`` rows.

    Ties collapse before any ordering, so one value held by a third of the rows costs one
    row here.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("n")
    )
    running = ordinal(counts, [F.col(value)], by, name="_upto", weight="n")
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    placed = running.select(
        *by, value, "n", (F.col("_upto") - F.col("n")).alias("before")
    )
    if by:
        return placed.join(totals, list(by))
    return placed.withColumn("total", totals.scalar())


def percentile_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Average rank divided by the row count, with zeros forced to zero."""
    places = value_positions(df, value).select(
        value,
        ((F.col("before") + (F.col("n") + 1) / 2.0) / F.col("total")).alias("_share"),
    )
    return (
        df.join(places, value, "left")
        .withColumn(name, F.when(F.col(value) == 0, F.lit(0.0)).otherwise(F.col("_share")))
        .select(*df.columns, name)
    )


def min_max(df: DataFrame, value: str, name: str) -> DataFrame:
    """Scale to [0, 1]; a constant column becomes zero."""
    low = df.agg(F.min(value)).scalar()
    high = df.agg(F.max(value)).scalar()
    span = high - low
    scaled = F.when(span == 0, F.lit(0.0)).otherwise(F.try_divide(F.col(value) - low, span))
    return df.withColumn(name, scaled)


NORMALISERS = {"percentile_rank": percentile_rank, "minmax": min_max}


def normalise(df: DataFrame, value: str, name: str, method: str = "percentile_rank") -> DataFrame:
    if method not in NORMALISERS:
        raise ValueError(f"Unsupported exposure normalization: {method}")
    return NORMALISERS[method](df, value, name)


def rank_descending(df: DataFrame, value: str, name: str) -> DataFrame:
    """Rank from the highest value; ties share the smallest rank."""
    places = value_positions(df, value).select(
        value, (F.col("total") - F.col("before") - F.col("n") + 1).alias(name)
    )
    return df.join(places, value, "left").select(*df.columns, name)


def quantile_bands(
    df: DataFrame,
    order: Sequence[Column],
    edges: Sequence[float],
    labels: Sequence[str],
    by: Sequence[str] = (),
    name: str = "band",
) -> DataFrame:
    """Cut ordinal positions at ``1 + (n - 1) q``; a position on an edge goes below it."""
    placed = ordinal(df, order, by, name="_ordinal")
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    if by:
        placed = placed.join(totals, list(by))
    else:
        placed = placed.withColumn("_n", totals.scalar())
    band = F.lit(labels[-1])
    for q, label in reversed(list(zip(edges, labels))):
        band = F.when(F.col("_ordinal") <= 1 + (F.col("_n") - 1) * F.lit(q), F.lit(label)).otherwise(band)
    return placed.withColumn(name, band).select(*df.columns, name)


def priority_bands(df: DataFrame, value: str, key: str, name: str = "priority_band") -> DataFrame:
    """Bottom 40 / middle 40 / top 20 per cent, ties in key order."""
    return quantile_bands(
        df, [F.col(value), F.col(key)], (0.4, 0.8), ("Low", "Medium", "High"), name=name
    )


def terciles_within(df: DataFrame, value: str, key: str, by: str, name: str) -> DataFrame:
    return quantile_bands(
        df, [F.col(value), F.col(key)], (1 / 3, 2 / 3), ("low", "mid", "high"), [by], name
    )


def value_terciles(df: DataFrame, value: str, name: str = "tercile") -> DataFrame:
    """Terciles by value; equal edges merge, so heavy ties give fewer bands.

    The exact percentile keeps one count per distinct value, so it runs on the distinct
    values that ``value_positions`` has already ordered in ranges.
    """
    places = value_positions(df, value)
    edges = places.agg(
        *[_interpolated(value, q).alias(f"q{i}") for i, q in enumerate((1 / 3, 2 / 3))]
    )
    low, high = edges.select("q0").scalar(), edges.select("q1").scalar()
    band = (
        F.when(F.col(value) <= low, F.lit("low"))
        .when(F.col(value) <= high, F.lit("mid"))
        .when(F.col(value).isNotNull(), F.lit("high"))
    )
    return df.withColumn(name, band)


def _interpolated(value: str, q: float) -> Column:
    """Linear-interpolation quantile from (value, before, n, total) rows."""
    at = (F.col("total") - 1) * F.lit(q)
    lower, upper = F.floor(at), F.ceil(at)

    def pick(index):
        holds = (F.col("before") <= index) & (index < F.col("before") + F.col("n"))
        return F.max(F.when(holds, F.col(value)))

    fraction = F.max(at - lower)
    return pick(lower) + (pick(upper) - pick(lower)) * fraction


def relative_thirds(df: DataFrame, order: Sequence[Column], valid: Column, name: str) -> DataFrame:
    """High / Medium / Low by thirds of the rows that have a rank; others are unknown."""
    known = ordinal(df.filter(valid), order, name="_ordinal")
    n = df.filter(valid).agg(F.count(F.lit(1)).alias("n")).scalar()
    band = (
        F.when(F.col("_ordinal") <= F.ceil(n / 3.0), F.lit("High"))
        .when(F.col("_ordinal") <= F.ceil(2.0 * n / 3.0), F.lit("Medium"))
        .otherwise(F.lit("Low"))
    )
    rest = df.filter(~F.coalesce(valid, F.lit(False))).withColumn(name, F.lit("Unknown / not available"))
    return known.withColumn(name, band).select(*df.columns, name).unionByName(rest)


def band_from_rank(rank: Column, total: Column) -> Column:
    """Band of a stored rank within a page of ``total`` rows."""
    high = F.greatest(F.lit(1), F.ceil(total / F.lit(3.0)))
    medium = F.greatest(high, F.ceil(total * F.lit(2.0) / F.lit(3.0)))
    return (
        F.when(rank.isNull(), F.lit("Unknown"))
        .when(rank <= high, F.lit("High"))
        .when(rank <= medium, F.lit("Medium"))
        .otherwise(F.lit("Low"))
    )


def sample_order(key: Column, seed: int) -> Column:
    """Repeatable shuffle key, the same in any engine with MD5."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def sample_per_group(
    df: DataFrame, key: str, by: Sequence[str], size: Column | int, seed: int = 42
) -> DataFrame:
    """Keep ``size`` rows of every group in shuffled order (all when the group is smaller)."""
    wanted = F.lit(size) if isinstance(size, int) else size
    placed = ordinal(df, [sample_order(F.col(key), seed), F.col(key)], by, name="_pick")
    return placed.filter(F.col("_pick") <= wanted).select(*df.columns)


def first_per_key(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key, by an aggregate that combines map-side."""
    rest = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_best")
    )
    return best.select(*by, *[F.col("_best")[c].alias(c) for c in rest]).select(*df.columns)


def strided(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """Evenly strided down-sample to at most ``limit`` rows; all rows when they fit."""
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    step = F.greatest(F.lit(1), F.ceil(n / F.lit(float(limit))))
    placed = ordinal(df, order, name="_ordinal")
    return placed.filter(F.pmod(F.col("_ordinal") - 1, step) == 0).select(*df.columns)
