"""Oriented boxes: suppression and matching.

A box is ``box_id``, a ``scene`` (chip or raster), ``xy array<double>(8)`` and, for
detections, ``conf``. Boxes meet through grids whose cells double in size: a box lies on the
grid of its own size, where it touches at most four cells, and visits the coarser grids that
are in use. A pair meets on the grid of its larger box, so one giant box does not widen the
cells of all others, and a crowded scene is spread over cells and never gathered into one group.
Scenes of at most ``CROWD`` boxes need no grid: their boxes meet by the scene, once each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.functions.overlap import iou, most_iou
from terrasift.session import cut_lineage

TOP = 8
#: Candidate pairs of a scene that are matched in one pass without rounds before it.
PASS = 200_000
#: Boxes of a scene that meet each other without a grid.
CROWD = 64


def _bounds(df: DataFrame) -> DataFrame:
    """Bounding box and area; ``_xy`` holds the corners of a box that does not fill its bounding box."""
    xs, ys = (", ".join(f"xy[{i}]" for i in range(k, 8, 2)) for k in (0, 1))
    twice = " + ".join(
        f"(xy[{2 * i}] * xy[{(2 * i + 3) % 8}] - xy[{(2 * i + 2) % 8}] * xy[{2 * i + 1}])" for i in range(4)
    )
    return df.selectExpr(
        "*", f"least({xs}) AS _x0", f"greatest({xs}) AS _x1", f"least({ys}) AS _y0", f"greatest({ys}) AS _y1",
        f"abs({twice}) / 2 AS _area",
    ).selectExpr(
        "*", "CASE WHEN _area <> (_x1 - _x0) * (_y1 - _y0) THEN xy END AS _xy",
        # The least power of two that the longer side does not exceed; a point counts as very small.
        "cast(ceil(log2(greatest(_x1 - _x0, _y1 - _y0, 1e-9D))) AS int) AS _own",
    )


BOX = ("_xy", "_x0", "_x1", "_y0", "_y1", "_area")


def _bound(a: str, b: str) -> str:
    """IoU of the bounding boxes: not below the real one, and equal to it when both boxes fill theirs."""
    shared = (
        f"greatest(0D, least({a}_x1, {b}_x1) - greatest({a}_x0, {b}_x0)) * "
        f"greatest(0D, least({a}_y1, {b}_y1) - greatest({a}_y0, {b}_y0))"
    )
    most = f"least({shared}, {a}_area, {b}_area)"
    return f"coalesce(try_divide({most}, {a}_area + {b}_area - {most}), 0D)"


def _corners(a: str) -> str:
    return f"coalesce({a}_xy, array({a}_x0, {a}_y0, {a}_x1, {a}_y0, {a}_x1, {a}_y1, {a}_x0, {a}_y1))"


def _upright(*frames: DataFrame) -> bool:
    """Whether all boxes fill their bounding boxes, so that no pair needs to be clipped."""
    return _union([df.select("_xy") for df in frames]).filter("_xy IS NOT NULL").isEmpty()


def _with_iou(pairs: DataFrame, a: str, b: str, keep: list[str], floor: str, upright: bool = False) -> DataFrame:
    """``keep`` and ``iou`` for the pairs that pass ``floor``, a test on ``iou``.

    Only turned boxes that pass the bound are clipped in Python.
    """
    a, b = f"{a}.", f"{b}."
    if upright:
        return pairs.selectExpr(*keep, f"{_bound(a, b)} AS iou").filter(floor)
    slim = pairs.selectExpr(
        *keep, f"{_bound(a, b)} AS iou", f"{a}_xy IS NULL AND {b}_xy IS NULL AS _exact",
        f"CASE WHEN {a}_xy IS NOT NULL OR {b}_xy IS NOT NULL THEN {_corners(a)} END AS _pa",
        f"CASE WHEN {a}_xy IS NOT NULL OR {b}_xy IS NOT NULL THEN {_corners(b)} END AS _pb",
    )
    names = [k.split(" AS ")[-1].split(".")[-1] for k in keep]
    flat = slim.filter("_exact").filter(floor).select(*names, "iou")
    turned = slim.filter("NOT _exact").filter(floor.replace("iou", "iou * (1 + 1e-9D)")).withColumn("iou", iou("_pa", "_pb"))
    return flat.unionByName(turned.filter(floor).select(*names, "iou"))


def _crowded(*frames: DataFrame) -> DataFrame | None:
    """Scenes of more than ``CROWD`` boxes, or none: those of all others are paired as they are."""
    scenes = _union([df.select("scene") for df in frames]).filter("scene IS NOT NULL")
    found = cut_lineage(scenes.groupBy("scene").count().filter(F.col("count") > CROWD).select("scene"), "crowded")
    return None if found.isEmpty() else found


def levels(*frames: DataFrame) -> list[int]:
    """The box sizes in use, as powers of two: at most as many as a double has exponents."""
    found: set[int] = set()
    for df in frames:
        found.update(r["_own"] for r in df.select("_own").distinct().collect() if r["_own"] is not None)
    return sorted(found)


def _cells(df: DataFrame, level: Column) -> DataFrame:
    """One row per cell of the grid ``level`` that a box touches."""
    rows = df.withColumn("_level", level)
    size = F.pow(F.lit(2.0), F.col("_level"))

    def span(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size)))

    return rows.withColumn("_cx", span("_x0", "_x1")).withColumn("_cy", span("_y0", "_y1"))


def at_home(df: DataFrame) -> DataFrame:
    return _cells(df, F.col("_own"))


def on_coarser(df: DataFrame, used: list[int]) -> DataFrame:
    """Rows on the grids in use that are coarser than the box's own."""
    coarser = F.filter(F.array(*[F.lit(u) for u in used]), lambda u: u > F.col("_own"))
    return _cells(df, F.explode(coarser)) if len(used) > 1 else _cells(df.limit(0), F.col("_own"))


def _overlap(a: str, b: str) -> Column:
    """Their bounding boxes overlap."""
    return F.expr(f"{a}._x0 < {b}._x1 AND {b}._x0 < {a}._x1 AND {a}._y0 < {b}._y1 AND {b}._y0 < {a}._y1")


def _touch(a: str, b: str) -> Column:
    """Their bounding boxes overlap, and the overlap starts in this cell: a pair may share several."""
    size = F.pow(F.lit(2.0), F.col("_level"))
    x = F.greatest(F.col(f"{a}._x0"), F.col(f"{b}._x0"))
    y = F.greatest(F.col(f"{a}._y0"), F.col(f"{b}._y0"))
    return _overlap(a, b) & (F.floor(x / size) == F.col("_cx")) & (F.floor(y / size) == F.col("_cy"))


def meetings(left: DataFrame, right: DataFrame, a: str, b: str, keys: list[str], used: list[int], names: tuple[list[str], list[str]]) -> list[DataFrame]:
    """Touching pairs of ``left`` and ``right``, by which of the two sizes decides the grid.

    ``names`` are the columns of each side beside ``BOX``.
    """
    on = [*keys, "_level", "_cx", "_cy"]
    l_home, r_home = at_home(left).select(*on, *BOX, *names[0]), at_home(right).select(*on, *BOX, *names[1])
    parts = [l_home.alias(a).join(r_home.alias(b), on)]
    if len(used) > 1:
        l_up, r_up = on_coarser(left, used).select(*on, *BOX, *names[0]), on_coarser(right, used).select(*on, *BOX, *names[1])
        parts += [l_up.alias(a).join(r_home.alias(b), on), l_home.alias(a).join(r_up.alias(b), on)]
    return [part.filter(_touch(a, b)) for part in parts]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def suppress(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Keep a box iff no box ahead of it in its scene overlaps above ``threshold``.

    "Ahead" is higher confidence, then smaller id; a box that is itself suppressed still
    suppresses others. The boxes of a scene see each other in one window, after one shuffle;
    those of crowded scenes meet on grids. A box without a scene has no rivals.
    """
    boxes = df.filter("scene IS NOT NULL")
    crowded = _crowded(df)
    if crowded is None:
        return _unrivalled(boxes, threshold).unionByName(df.filter("scene IS NULL"))
    few, many = (boxes.join(crowded, "scene", how).select(*df.columns) for how in ("left_anti", "left_semi"))
    return _union([_unrivalled(few, threshold), _suppressed_by_cells(many, threshold), df.filter("scene IS NULL")])


def _unrivalled(df: DataFrame, threshold: float) -> DataFrame:
    """Suppression in scenes of at most ``CROWD`` boxes."""
    rows = _bounds(df).withColumn("_rank", F.struct((-F.col("conf")).alias("c"), F.col("box_id").alias("i")))
    box = F.struct("_rank", *BOX)
    rivals = (
        "filter(_all, o -> o._rank < _rank AND o._x0 < _x1 AND _x0 < o._x1 AND o._y0 < _y1 AND _y0 < o._y1 "
        f"AND {_bound('', 'o.')} * (1 + 1e-9D) > {threshold!r}D)"
    )
    seen = rows.withColumn("_all", F.collect_list(box).over(Window.partitionBy("scene"))).withColumn("_all", F.expr(rivals))
    # Two boxes that fill their bounding boxes overlap by just the bound.
    sure = seen.filter(f"NOT exists(_all, o -> _xy IS NULL AND o._xy IS NULL AND {_bound('', 'o.')} > {threshold!r}D)")
    doubt = "filter(_all, o -> _xy IS NOT NULL OR o._xy IS NOT NULL)"
    asked = sure.withColumn("_all", F.expr(f"transform({doubt}, o -> {_corners('o.')})")).withColumn("_own", F.expr(_corners("")))
    clear = asked.filter("size(_all) = 0")
    turned = asked.filter("size(_all) > 0").withColumn("_most", most_iou("_own", "_all")).filter(f"_most <= {threshold!r}D")
    return clear.select(*df.columns).unionByName(turned.select(*df.columns))


def _suppressed_by_cells(df: DataFrame, threshold: float) -> DataFrame:
    """Suppression in crowded scenes.

    Identical boxes are reduced to the one ahead of all its copies, which neither saves nor dooms
    any other box. Victims of the ``TOP`` leading boxes of their cell are settled first, so a pile
    of near copies is not compared pair by pair.
    """
    rank = F.struct((-F.col("conf")).alias("c"), F.col("box_id").alias("i"))
    solo = cut_lineage(_bounds(df).groupBy("scene", *BOX, "_own").agg(F.min(rank).alias("rank")), "solo")
    used = levels(solo)

    def doomed(victims: DataFrame, suppressors: DataFrame) -> DataFrame:
        ahead = F.col("s.rank") < F.col("v.rank")
        found = meetings(victims, suppressors, "v", "s", ["scene"], used, (["rank"], ["rank"]))
        hits = [_with_iou(pairs.filter(ahead), "v", "s", ["scene", "v.rank.i AS _i"], f"iou > {threshold!r}D") for pairs in found]
        return _union([h.select("scene", "_i") for h in hits]).distinct()

    def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
        return rows.join(gone, (rows["scene"].eqNullSafe(gone["scene"])) & (rows["rank"]["i"] == gone["_i"]), "left_anti")

    leaders = cut_lineage(_leading(at_home(solo)).select("scene", *BOX, "_own", "rank").distinct(), "leaders")
    alive = cut_lineage(without(solo, doomed(solo, leaders)), "alive")
    kept = without(alive, doomed(alive, solo)).select("scene", F.col("rank.i").alias("box_id"))
    return df.join(kept, ["scene", "box_id"], "left_semi").select(*df.columns)


def _leading(boxes: DataFrame) -> DataFrame:
    """The ``TOP`` best boxes of every cell."""
    # Shards bound what one task sorts; each keeps TOP, then the shards are merged.
    keys = ["scene", "_level", "_cx", "_cy"]
    shard = F.pmod(F.xxhash64("rank.i"), F.lit(64))
    inner = Window.partitionBy(*keys, "_shard").orderBy("rank")
    outer = Window.partitionBy(*keys).orderBy("rank")
    best = (
        boxes.withColumn("_shard", shard)
        .withColumn("_n", F.row_number().over(inner)).filter(F.col("_n") <= TOP)
        .withColumn("_n", F.row_number().over(outer)).filter(F.col("_n") <= TOP)
    )
    return best.drop("_n", "_shard")


def candidate_pairs(preds: DataFrame, truths: DataFrame, floor: float, same_class: bool = True, rank: str = "-conf") -> DataFrame:
    """Prediction / truth pairs of a scene with IoU of at least ``floor`` (> 0), and the prediction's ``rank``."""
    return _pairs(preds, truths, floor, same_class, rank, _crowded(preds, truths))


def _pairs(preds: DataFrame, truths: DataFrame, floor: float, same_class: bool, rank: str, crowded: DataFrame | None) -> DataFrame:
    keys = ["scene"] + (["class_id"] if same_class else [])
    left = _bounds(preds).selectExpr(*keys, "box_id AS pred", f"{rank} AS rank", *BOX, "_own")
    right = _bounds(truths).selectExpr(*keys, "box_id AS truth", *BOX, "_own")
    few, found, upright = (left, right), [], _upright(left, right)
    if crowded is not None:
        few = [side.join(crowded, "scene", "left_anti") for side in (left, right)]
        many = [cut_lineage(side.join(crowded, "scene", "left_semi"), name) for side, name in ((left, "preds"), (right, "truths"))]
        found = meetings(*many, "p", "t", keys, levels(*many), (["pred", "rank"], ["truth"]))
    found.append(few[0].alias("p").join(few[1].alias("t"), keys).filter(_overlap("p", "t")))
    return _union([_with_iou(pairs, "p", "t", ["scene", "pred", "rank", "truth"], f"iou >= {float(floor)!r}D", upright) for pairs in found])


def match_greedy(preds: DataFrame, truths: DataFrame, threshold: float = 0.5, rank: str = "-conf") -> DataFrame:
    """One-to-one matching: predictions choose in the order of ``rank`` and id their best free truth.

    Returns ``scene, pred, truth, iou``. The pairs of a scene pass one task once, in order, with
    the truths taken so far as the only state. Scenes of more than ``PASS`` pairs, which only
    crowded ones have, go through rounds before, in which every prediction settles that no
    undecided one ahead of it could disturb; rounds end as soon as they no longer take a tenth of
    the pairs away.
    """
    crowded = _crowded(preds, truths)
    edges = _pairs(preds, truths, threshold, True, rank, crowded)
    if crowded is None:
        return _in_order(edges)
    edges = cut_lineage(edges, "edges")
    settled, before = [], None
    while True:
        counts = edges.groupBy("scene").count()
        large = cut_lineage(counts.filter(F.col("count") > PASS), "large")
        left = large.agg(F.sum("count")).first()[0] or 0
        if not left or (before is not None and left > 0.9 * before):
            break
        before = left
        found = _settled(edges.join(large, edges["scene"].eqNullSafe(large["scene"]), "left_semi"))
        settled.append(found)
        edges = cut_lineage(_free(edges, found), "edges")
    return _union([*settled, _in_order(edges)])


def _settled(edges: DataFrame) -> DataFrame:
    """Choices that no undecided prediction ahead could take."""
    ahead = F.struct("rank", "pred")
    choice = edges.groupBy("scene", "pred").agg(F.max(F.struct("iou", "truth")).alias("_pick"), F.min(ahead).alias("_rank"))
    claims = edges.groupBy(F.col("scene").alias("_scene"), F.col("truth").alias("_truth")).agg(F.min(ahead).alias("_first"))
    same = choice["scene"].eqNullSafe(claims["_scene"]) & (F.col("_pick.truth") == F.col("_truth")) & (F.col("_rank") == F.col("_first"))
    return cut_lineage(choice.join(claims, same).selectExpr("scene", "pred", "_pick.truth AS truth", "_pick.iou AS iou"), "settled")


def _free(edges: DataFrame, settled: DataFrame) -> DataFrame:
    """Pairs of predictions and truths that are both undecided."""
    for side in ("pred", "truth"):
        done = settled.select(F.col("scene").alias("_scene"), F.col(side).alias("_side"))
        edges = edges.join(done, edges["scene"].eqNullSafe(done["_scene"]) & (edges[side] == done["_side"]), "left_anti")
    return edges


def _in_order(edges: DataFrame) -> DataFrame:
    """Matches of every scene, prediction after prediction."""
    ordered = edges.repartition("scene").sortWithinPartitions("scene", "rank", "pred", F.desc("iou"), F.desc("truth"))
    names = ["scene", "pred", "truth", "iou"]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scene, pred, taken, first, done = None, None, set(), True, False
        for batch in batches:
            chosen = []
            columns = (batch.column(c).to_pylist() for c in names[:3])
            for i, (s, p, t) in enumerate(zip(*columns)):
                if first or s != scene:
                    scene, pred, taken, first = s, None, set(), False
                if p != pred:
                    pred, done = p, False
                if not done and t not in taken:
                    taken.add(t)
                    chosen.append(i)
                    done = True
            yield batch.take(pa.array(chosen, pa.int64()))

    return ordered.select(*names).mapInArrow(take, edges.select(*names).schema)


def best_overlap(preds: DataFrame, truths: DataFrame, floor: float = 0.5) -> DataFrame:
    """Matching in the order of the predictions: each takes its best free truth of its class."""
    return match_greedy(preds, truths, floor, rank="box_id")


def false_positives(preds: DataFrame, matched: DataFrame) -> DataFrame:
    keys = matched.select("scene", F.col("pred").alias("box_id"))
    return preds.join(keys, ["scene", "box_id"], "left_anti")


def missed(truths: DataFrame, matched: DataFrame) -> DataFrame:
    keys = matched.select("scene", F.col("truth").alias("box_id"))
    return truths.join(keys, ["scene", "box_id"], "left_anti")
