"""Image chips: names, cells, splits, labels, leakage between splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.functions import geo
from terrasift.operators import ranking, spatial

# File-name pattern, class maps, split names and thresholds.
NAME_PATTERN = r"^(-?\d+\.\d+)_(-?\d+\.\d+)\.png$"
CLASS_REMAP = {0: 0, 1: 0, 2: 1}
CLASS_NAMES = {0: "FCBK", 1: "Zigzag"}
SPLITS = ("train", "val", "test")
FILTERED_SPLITS = ("val", "test")
CELL_DEGREES = 0.25
LEAKAGE_METRES = 1300.0


def parse_names(df: DataFrame, name: str = "image_name", check_range: bool = False) -> DataFrame:
    """Add ``lat, lon`` from ``lat_lon.png`` (a path is fine); null when it does not match."""
    base = f"element_at(split({name}, '/'), -1)"

    def part(i: int) -> str:
        return f"try_cast(nullif(regexp_extract({base}, r'{NAME_PATTERN}', {i}), '') AS double)"

    out = df.selectExpr("*", f"{part(1)} AS lat", f"{part(2)} AS lon")
    if check_range:
        ok = "lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180"
        out = out.withColumns({"lat": F.expr(f"CASE WHEN {ok} THEN lat END"), "lon": F.expr(f"CASE WHEN {ok} THEN lon END")})
    return out


def add_cells(df: DataFrame, size: float = CELL_DEGREES) -> DataFrame:
    return df.selectExpr("*", f"floor(lat / {size}D) AS cell_row", f"floor(lon / {size}D) AS cell_col")


def remap_lines(labels: str = "labels") -> str:
    """Label lines with the class id mapped; coordinates stay verbatim."""
    first = "split(trim(l), '\\\\s+')[0]"
    mapped = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CLASS_REMAP.items())
    rest = "array_join(slice(split(trim(l), '\\\\s+'), 2, size(split(trim(l), '\\\\s+'))), ' ')"
    return (
        f"transform(filter({labels}, l -> l <> ''), l -> concat_ws(' ', CASE {first} {mapped} ELSE {first} END, nullif({rest}, '')))"
    )


def class_name(column: str) -> str:
    named = " ".join(f"WHEN {k} THEN '{v}'" for k, v in CLASS_NAMES.items())
    return f"CASE {column} {named} ELSE concat('unknown_', {column}) END"


def class_counts(df: DataFrame, by: str = "split", labels: str = "labels") -> DataFrame:
    """Label counts per split and class, zero-filled; ids without a name count as ``unknown``."""
    names = [*CLASS_NAMES.values(), "unknown"]
    lines = df.selectExpr(by, f"explode({remap_lines(labels)}) AS line").selectExpr(
        by, class_name("cast(split(line, ' ')[0] AS int)") + " AS class"
    ).withColumn("class", F.when(F.col("class").isin(*CLASS_NAMES.values()), F.col("class")).otherwise("unknown"))
    counts = lines.groupBy(by).pivot("class", names).count()
    everything = df.select(by).distinct().join(counts, by, "left")
    return everything.fillna(0, names)


def assign_blocks(df: DataFrame, ratios=(0.70, 0.15), seed: int = 42) -> DataFrame:
    """Cell to split map: shuffled distinct cells, floor shares, the rest is test."""
    cells = df.select("cell_row", "cell_col").distinct().selectExpr(
        "*", f"md5(concat('{seed}|', cell_row, '_', cell_col)) AS _mix"
    )
    placed = ranking.ordinal(cells, [F.col("_mix")], name="_pos")
    n = cells.agg(F.expr("count(1) AS n")).scalar()
    return placed.withColumn("_n", n).selectExpr(
        "cell_row", "cell_col",
        f"CASE WHEN _pos <= floor(_n * {ratios[0]}D) THEN 'train' "
        f"WHEN _pos <= floor(_n * {ratios[0]}D) + floor(_n * {ratios[1]}D) THEN 'val' ELSE 'test' END AS block_split",
    )


def contamination(df: DataFrame) -> DataFrame:
    """Cells whose chips come from more than one shipped split, and the risk level."""
    cells = df.groupBy("cell_row", "cell_col").agg(F.expr("count(DISTINCT split) AS n"))
    return cells.selectExpr("count_if(n > 1) AS contaminated_cells", "count(1) AS total_cells").selectExpr(
        "*", "coalesce(round(try_divide(contaminated_cells * 100D, total_cells), 2), 0D) AS contaminated_pct"
    ).selectExpr(
        "*", "CASE WHEN contaminated_pct > 50 THEN 'HIGH' WHEN contaminated_pct > 10 THEN 'MEDIUM' ELSE 'LOW' END AS risk"
    )


def leaking(df: DataFrame, key: str, threshold: float = LEAKAGE_METRES) -> DataFrame:
    """Keys of val/test chips within ``threshold`` (Chebyshev, inclusive) of another split.

    ``df`` has projected ``x, y``. Train chips never leak; distances use the original rows,
    so a close val/test pair loses both.
    """
    others = ", ".join(f"'{s}'" for s in SPLITS)
    own = ", ".join(f"'{s}'" for s in FILTERED_SPLITS)
    asked = df.filter(f"split IN ({own})").selectExpr(
        key, "x", "y", f"explode(filter(array({others}), s -> s <> split)) AS split"
    )
    best = spatial.nearest_best(asked, df, [key, "split"], (), ["split"], threshold, "chebyshev")
    return best.select(key).distinct()


def drop_leaking(df: DataFrame, key: str, threshold: float = LEAKAGE_METRES) -> DataFrame:
    return df.join(leaking(df, key, threshold), key, "left_anti")


def dropped_per_split(df: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """Dropped chips per split, zero-filled."""
    splits = df.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    counts = df.join(dropped, key, "left_semi").groupBy("split").agg(F.expr("count(1) AS dropped"))
    return splits.join(counts, "split", "left").fillna(0, ["dropped"])


def closest_splits(df: DataFrame, key: str) -> DataFrame:
    """Smallest Chebyshev distance between chips of different splits; null under two splits."""
    listed = ", ".join(f"'{s}'" for s in SPLITS)
    # Each unordered pair of splits is asked once, from the split listed first.
    asked = df.selectExpr(
        key, "x", "y",
        f"explode(filter(array({listed}), s -> array_position(array({listed}), s) > array_position(array({listed}), split))) AS split",
    )
    best = spatial.nearest_best(asked, df, [key, "split"], (), ["split"], None, "chebyshev")
    return best.agg(F.expr("min(_best.d) AS min_distance_m"))


def balanced_sample(df: DataFrame, key: str, bucket: str, buckets: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Equal shares per bucket, topped up from the rest when a bucket is short."""
    mixed = df.withColumn("_mix", ranking.sample_order(F.col(key), seed))
    share = n // len(buckets)
    own = ranking.ordinal(mixed, [F.col("_mix"), F.col(key)], [bucket], "_own")
    first = own.selectExpr("*", f"CASE WHEN _own <= {share} THEN 0 ELSE 1 END AS _late")
    return first.orderBy("_late", "_mix", key).limit(n).select(*df.columns)


def project_chips(df: DataFrame) -> DataFrame:
    return geo.project(df)


def readiness(df: DataFrame, minimum: int) -> DataFrame:
    """Per split: chips, labelled chips and whether both reach ``minimum``."""
    return df.groupBy("split").agg(
        F.expr("count(1) AS images"), F.expr("count_if(size(labels) > 0) AS labelled")
    ).selectExpr("*", f"images >= {minimum} AND labelled >= {minimum} AS ready")
