"""Nearest neighbours by inner product from a forest of random-projection trees.

Largest inner product becomes smallest angle by one more component: every vector is scaled by
the greatest norm M and completed to the unit sphere, a query gets zero there. Each tree
splits a bounded sample at the median of a random projection until nodes are small; every
vector of the table is then routed to its leaf in every tree and stored there. A query
searches all trees through one priority queue ordered by the smallest margin on the way, until
it has visited its share of the leaves; the candidates of those leaves are scored exactly.

Leaves are matched with the queries that visit them leaf by leaf, each leaf in blocks, so
neither a leaf nor a query list is held whole; what leaves a block are its best ``k`` rows per
query, and the best ``k`` over all blocks follow by a grouped rank.

Of equal vectors only the ``k + 1`` smallest ids can be an answer; later copies are left out
of the index exactly for that reason (ties go to the smaller id), so a vector that fills a
third of the table cannot fill a leaf. Equal queries share one search.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold a null
or non-finite component take no part; fewer candidates than ``k`` give them all; rows that
repeat an id are one candidate, the one with the smallest vector; null ids are left out; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.llm.common import stage

K = 20
TREES = 12
#: Share of all trees' leaves that a query visits. Near-isotropic vectors need this much for a recall of 0.9.
VISITED = 0.075
#: Rows that the trees are fitted on at most, and of those in a leaf.
SAMPLE, LEAF = 16_384, 256
#: Rows of a leaf, and queries, that meet in one task at once.
BLOCK = 4096
QUERIES = 100_000
SEED = 29


class Forest:
    """Trees as arrays: node i splits by normals[i] . x >= cuts[i] into children, or is a leaf."""

    def __init__(self, points: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = SEED):
        random = np.random.default_rng(seed)
        self.trees = [self._tree(points, random, leaf) for _ in range(trees)]

    @staticmethod
    def _tree(points: np.ndarray, random: np.random.Generator, leaf: int) -> tuple[np.ndarray, ...]:
        normals, cuts, left, right = [], [], [], []

        def grow(rows: np.ndarray) -> int:
            node = len(normals)
            normals.append(np.zeros(points.shape[1]))
            cuts.append(0.0)
            left.append(-1)
            right.append(-1)
            if len(rows) <= leaf:
                return node
            # The direction between two sampled rows follows the data; a random one where they agree.
            pair = points[rows[random.integers(0, len(rows), 2)]]
            normal = pair[0] - pair[1]
            normal = normal + random.standard_normal(len(normal)) * 1e-9
            normal /= np.linalg.norm(normal)
            along = points[rows] @ normal
            cut = float(np.median(along))
            over = along >= cut
            if over.all() or not over.any():
                return node
            normals[node], cuts[node] = normal, cut
            left[node] = grow(rows[~over])
            right[node] = grow(rows[over])
            return node

        grow(np.arange(len(points)))
        return np.array(normals), np.array(cuts), np.array(left), np.array(right)

    def route(self, points: np.ndarray) -> np.ndarray:
        """Leaf numbers, rows x trees."""
        out = np.zeros((len(points), len(self.trees)), np.int64)
        for t, (normals, cuts, left, right) in enumerate(self.trees):
            at = np.zeros(len(points), np.int64)
            active = np.flatnonzero(left[at] >= 0)
            while len(active):
                here = at[active]
                over = np.einsum("ij,ij->i", points[active], normals[here]) >= cuts[here]
                at[active] = np.where(over, right[here], left[here])
                active = active[left[at[active]] >= 0]
            out[:, t] = at
        return out

    def leaves(self) -> int:
        return sum(int((left < 0).sum()) for _, _, left, _ in self.trees)

    def search(self, point: np.ndarray, leaves: int) -> list[tuple[int, int]]:
        """(tree, leaf) in order of the greatest smallest margin, from one queue over all trees."""
        margins = [normals @ point - cuts for normals, cuts, _, _ in self.trees]
        queue = [(-np.inf, t, 0) for t in range(len(self.trees))]
        found: list[tuple[int, int]] = []
        while queue and len(found) < leaves:
            least, t, node = heapq.heappop(queue)
            _, _, left, right = self.trees[t]
            while left[node] >= 0:
                margin = margins[t][node]
                near, far = (right[node], left[node]) if margin >= 0 else (left[node], right[node])
                heapq.heappush(queue, (max(least, abs(margin)), t, far))
                node = near
            found.append((t, int(node)))
        return found


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, in their own precision."""
    rows = vectors.select("vec_id", F.col("embedding").alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    )
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.coalesce(fine, F.lit(False)))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))


def lifted(points: np.ndarray, greatest: float) -> np.ndarray:
    """Table vectors on the unit sphere with one component more."""
    scaled = points / greatest
    rest = np.sqrt(np.maximum(0.0, 1.0 - (scaled**2).sum(1)))
    return np.concatenate([scaled, rest[:, None]], axis=1)


def query_points(points: np.ndarray) -> np.ndarray:
    length = np.sqrt((points**2).sum(1, keepdims=True))
    return np.concatenate([points / length, np.zeros((len(points), 1))], axis=1)


def inner_products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums over the components in order, so that equal vectors get equal scores."""
    total = np.zeros((len(queries), len(rows)))
    for i in range(queries.shape[1]):
        total += queries[:, i, None] * rows[None, :, i]
    return total


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch in double precision."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def nearest(vectors: DataFrame, is_query: Column, k: int = K, trees: int = TREES, visited: float = VISITED) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row where ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = stage(usable(vectors).groupBy("vec_id").agg(F.min("v").alias("v")), "ann-rows")
    shape = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(norm(F.col("v"))).alias("norm")) \
        .orderBy(F.desc("n"), "d").first()
    out = "query_id long, rank int, vec_id long, score double"
    if shape is None:
        return spark.createDataFrame([], out)
    width, greatest, kind = shape["d"], shape["norm"], dict(rows.dtypes)["v"]
    rows = rows.filter(F.size("v") == width)
    copies = Window.partitionBy("v").orderBy("vec_id")
    index = stage(rows.withColumn("_n", F.row_number().over(copies)).filter(F.col("_n") <= k + 1).drop("_n"), "ann-index")

    share = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "vec_id"), 11) / F.lit(float(1 << 53))
    sampled = index.filter(share * shape["n"] < SAMPLE * 0.98).orderBy("vec_id").limit(SAMPLE).select("v").toPandas()["v"]
    forest = Forest(lifted(np.stack(sampled.to_numpy()).astype(float) if len(sampled) else np.zeros((0, width)), greatest), trees)
    shared = spark.sparkContext.broadcast(forest)  # at most SAMPLE / LEAF * 4 nodes a tree
    leaves = max(trees, int(np.ceil(visited * forest.leaves())))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.route(lifted(matrix(batch.column("v")), greatest))
            take = pa.array(np.repeat(np.arange(batch.num_rows), leaf.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(leaf.shape[1]), batch.num_rows), pa.int32()), pa.array(leaf.reshape(-1)),
                 batch.column("vec_id").take(take), batch.column("v").take(take)],
                ["tree", "leaf", "vec_id", "v"],
            )

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix(batch.column("v"))
            found = [shared.value.search(p, leaves) for p in query_points(points)]
            take = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for f in found for t, _ in f], pa.int32()), pa.array([n for f in found for _, n in f], pa.int64()),
                 batch.column("query").take(take), batch.column("v").take(take)],
                ["tree", "leaf", "query", "v"],
            )

    stored = index.mapInArrow(routed, f"tree int, leaf long, vec_id long, v {kind}")
    asked = rows.filter(is_query).select("vec_id", "v")
    # Equal query vectors are searched once, under their smallest id, and share what is found.
    reps = asked.groupBy("v").agg(F.min("vec_id").alias("query"))
    named = stage(asked.join(reps, "v").select(F.col("vec_id").alias("query_id"), "query", "v"), "ann-queries")
    once = named.filter(F.col("query_id") == F.col("query")).select("query", "v")
    visits = once.mapInArrow(visiting, f"tree int, leaf long, query long, v {kind}")

    def best(key, found: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(found) and len(here):
            ids, points = here["vec_id"].to_numpy(), np.stack(here["v"].to_numpy()).astype(float)
            order = np.argsort(ids, kind="stable")
            ids, points = ids[order], points[order]
            for at in range(0, len(found), BLOCK // 8):
                part = found.iloc[at:at + BLOCK // 8]
                scores = inner_products(np.stack(part["v"].to_numpy()).astype(float), points)
                # k + 1: the query itself may be among them. Ids ascend, so a stable order breaks ties.
                top = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
                parts.append(pd.DataFrame({
                    "query": np.repeat(part["query"].to_numpy(), top.shape[1]), "vec_id": ids[top].reshape(-1),
                    "score": np.take_along_axis(scores, top, 1).reshape(-1),
                }))
        return pd.concat(parts) if parts else pd.DataFrame({"query": [], "vec_id": [], "score": []}).astype({"query": "int64", "vec_id": "int64"})

    # Leaves grow with the table and query lists with the queries: both are dealt into parts of
    # bounded size, and every part of a leaf meets every part of its queries.
    row_parts = -(-shape["n"] * 2 * LEAF // (min(shape["n"], SAMPLE) * BLOCK))
    query_parts = -(-named.count() // QUERIES)
    dealt = stored.withColumn("rows", F.pmod(F.xxhash64("vec_id"), F.lit(row_parts))).withColumn(
        "asked", F.explode(F.sequence(F.lit(0), F.lit(max(query_parts, 1) - 1)))
    )
    asking = visits.withColumn("asked", F.pmod(F.xxhash64("query"), F.lit(max(query_parts, 1))).cast("int")).withColumn(
        "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_parts - 1).cast("long")))
    )
    by = ["tree", "leaf", "rows", "asked"]
    met = asking.groupBy(by).cogroup(dealt.groupBy(by)).applyInPandas(best, "query long, vec_id long, score double")
    per_query = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = (
        met.dropDuplicates(["query", "vec_id"]).withColumn("_n", F.row_number().over(per_query))
        .filter(F.col("_n") <= k + 1).drop("_n")
    )
    # Copies of a query vector differ only in which candidate is the query itself.
    joined = named.select("query_id", "query").join(found, "query").filter(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return joined.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
