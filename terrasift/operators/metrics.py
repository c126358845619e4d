"""Training metric tables: best epochs, stage choice, epoch windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_epoch(df: DataFrame, by: str = "stage", metric: str = "map50", fitness: str = "fitness") -> DataFrame:
    """Metric at the epoch of highest fitness (first on ties, NaN ignored)."""
    valid = df.filter(f"{fitness} IS NOT NULL AND NOT isnan({fitness})")
    order = f"named_struct('f', {fitness}, 'e', -epoch)"
    return valid.groupBy(by).agg(F.expr(f"max_by(struct(epoch, {metric}), {order}) AS b")).selectExpr(
        by, "b.epoch AS epoch", f"b.{metric} AS {metric}"
    )


def best_stage(df: DataFrame, metric: str = "map50") -> DataFrame:
    """Stage with the highest metric; the first name wins ties."""
    return df.orderBy(F.desc(metric), "stage").limit(1)


def epoch_windows(df: DataFrame, interval: int) -> DataFrame:
    return df.selectExpr("*", f"floor((epoch - 1) / {interval}) AS window")


def archive_windows(df: DataFrame, path: str, interval: int, include_partial: bool = False) -> None:
    """Write complete epoch windows not archived yet; earlier windows stay untouched."""
    placed = epoch_windows(df, interval)
    full = placed.groupBy("stage", "window").agg(F.expr("count(DISTINCT epoch) AS n"))
    if not include_partial:
        full = full.filter(f"n = {interval}")
    fresh = placed.join(full.select("stage", "window"), ["stage", "window"], "left_semi")
    try:
        have = df.sparkSession.read.parquet(path).select("stage", "window").distinct()
        fresh = fresh.join(have, ["stage", "window"], "left_anti")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    fresh.write.mode("append").partitionBy("stage", "window").parquet(path)
