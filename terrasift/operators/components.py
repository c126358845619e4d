"""Near-duplicate groups: points linked by steps of at most ``reach``, transitively."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.operators import spatial
from terrasift.session import cut_lineage

MAX_ROUNDS = 64


def connected(edges: DataFrame) -> DataFrame:
    """Label the nodes of ``edges(a, b)`` with the smallest node of their component.

    Alternates large-star and small-star steps (Kiveris et al., 2014), which flatten a long
    chain in logarithmically many rounds. Each round is two aggregates and two joins to one
    row per node; nothing is gathered per component.
    """
    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.filter(F.col("b") < F.col("a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"))
        joined = both.join(low, "a")
        if large:
            linked = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            linked = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                low.select("a", F.col("m").alias("b"))
            )
        return linked.filter(F.col("a") != F.col("b")).distinct()

    current = cut_lineage(edges.select("a", "b").filter("a <> b").distinct(), "links")
    mark = None
    for _ in range(MAX_ROUNDS):
        current = cut_lineage(star(star(current, True), False), "links")
        now = current.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if tuple(now) == mark:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = tuple(now)
    raise RuntimeError(f"Components did not settle in {MAX_ROUNDS} rounds")


def near_duplicates(points: DataFrame, key: str, reach: float, leaf: int = spatial.LEAF) -> DataFrame:
    """Add ``component`` (the smallest key of the group) to every row with ``x, y``.

    Points in one cell of side ``reach / sqrt(2)`` are always linked, so only cells need
    linking: two nearby cells join when some pair of their points is within ``reach``. That
    is asked through the pruned nearest join, never by listing pairs.
    """
    size = reach / math.sqrt(2.0) * (1 - 1e-9)
    cell = F.concat_ws("_", F.floor(F.col("x") / size), F.floor(F.col("y") / size))
    placed = points.withColumns(
        {"_gx": F.floor(F.col("x") / size), "_gy": F.floor(F.col("y") / size), "_cell": cell}
    )
    names = placed.groupBy("_cell", "_gx", "_gy").agg(F.min(key).alias("_low"))
    # Half of the ring of cells within two steps: the other half sees the same pairs.
    steps = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3) if (dx, dy) > (0, 0)]
    ring = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in steps])
    spots = placed.select("_cell", "_gx", "_gy", "x", "y").distinct()
    asked = (
        names.select("_cell", "_gx", "_gy", F.explode(ring).alias("s"))
        .select("_cell", F.concat_ws("_", F.col("_gx") + F.col("s.dx"), F.col("_gy") + F.col("s.dy")).alias("_other"))
        .join(names.select(F.col("_cell").alias("_other")), "_other", "left_semi")
    )
    probes = (
        spots.select("_cell", "x", "y")
        .join(asked, "_cell")
        .select("_cell", F.col("_other").alias("_grp"), "x", "y")
        .withColumn("_probe", F.struct("_cell", "_grp", "x", "y"))
    )
    targets = spots.select(F.col("_cell").alias("_grp"), "x", "y")
    linked = (
        spatial.nearest(cut_lineage(probes, "probes"), targets, "_probe", (), ["_grp"], distance="_d", leaf=leaf)
        .filter(F.col("_d") <= reach)
        .select("_cell", "_grp")
        .distinct()
    )
    low = names.select("_cell", "_low")
    links = (
        linked.join(low, "_cell")
        .withColumnRenamed("_low", "a")
        .join(low.select(F.col("_cell").alias("_grp"), F.col("_low").alias("b")), "_grp")
        .select("a", "b")
    )
    labels = connected(links)
    cells = low.join(labels, low["_low"] == labels["node"], "left").select(
        "_cell", F.coalesce("component", "_low").alias("component")
    )
    return placed.join(cells, "_cell").select(*points.columns, "component")


def best_of_component(df: DataFrame, confidence: str, key: str) -> DataFrame:
    """The most confident row of every component (smallest key on ties)."""
    rest = [c for c in df.columns if c != "component"]
    best = df.groupBy("component").agg(
        F.min_by(F.struct(*rest), F.struct((-F.col(confidence)).alias("c"), F.col(key).alias("k"))).alias("_b")
    )
    return best.select(*[F.col("_b")[c].alias(c) if c != "component" else F.col(c) for c in df.columns])
