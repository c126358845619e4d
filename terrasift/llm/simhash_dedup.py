"""SimHash near-duplicates found by covering locality-sensitive hashing.

Every bit position carries a vector of ``radius + 1`` bits. For each non-zero vector v, one
table keeps the positions whose vector has odd overlap with v. The differing positions of a
pair within the radius span at most ``radius`` dimensions, so some v is orthogonal to all of
them and that table's key is equal for both: no such pair is missed. Buckets that stay large
are split by the same construction over the positions their key leaves out, until the key
leaves so few positions that the bucket is small by itself; nothing is capped.

Equal fingerprints are one node, so copies never meet pairwise.

Defined cases: a null or blank text has fingerprint zero and links like any other; texts of
fewer than three words are hashed whole; repeated rows share a node; an empty table gives an
empty result; other columns are ignored by ``components`` and carried by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import keep_rows, row_mark, stage, text_of
from terrasift.operators.components import connected

BITS = 64
SHINGLE = 3
RADIUS = 2
SEED = 42
#: Buckets up to this size are compared directly; larger ones are split further.
DIRECT = 64
ALL_BITS = (1 << BITS) - 1
HASHES_AT_ONCE = 1 << 15


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint of one text: a bit is set if over half of the hashes set it."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), HASHES_AT_ONCE):
        pairs = zip(starts[at:at + HASHES_AT_ONCE].tolist(), ends[at:at + HASHES_AT_ONCE].tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in pairs], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(counts * 2 > len(starts)).tolist())


def signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, mark, fp) of every row, written once; fp as a signed long."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [signed(fingerprint(t.as_py(), shingle, seed)) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array(prints, pa.int64())], ["doc_id", "mark", "fp"]
            )

    rows = docs.select("doc_id", row_mark().alias("mark"), text_of().alias("_text"))
    kind = dict(docs.dtypes)["doc_id"]
    return stage(rows.mapInArrow(marked, f"doc_id {kind}, mark long, fp long"), "simhash-prints")


def covering_masks(free: int, radius: int = RADIUS) -> list[int]:
    """Masks over the positions of ``free`` such that any ``radius`` of them are avoided by one mask."""
    places = [i for i in range(BITS) if free >> i & 1]
    vectors = {p: k % ((1 << (radius + 1)) - 1) + 1 for k, p in enumerate(places)}
    return [
        sum(1 << p for p in places if (vectors[p] & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))
    ]


def links(prints: DataFrame, radius: int = RADIUS, direct: int = DIRECT) -> DataFrame:
    """Pairs (a < b) of different fingerprints ``prints(fp)`` within ``radius`` bits."""
    found = []
    masks = [0]
    level = prints.select("fp", F.lit(0).cast("long").alias("mask"))
    while True:
        children = {m: [m | c for c in covering_masks(ALL_BITS & ~m, radius)] for m in masks}
        masks = sorted({c for kids in children.values() for c in kids})
        table = F.create_map(*[
            x for m, kids in children.items()
            for x in (F.lit(signed(m)), F.array(*[F.lit(signed(c)) for c in sorted(set(kids))]))
        ])
        rows = level.select("fp", F.explode(F.element_at(table, F.col("mask"))).alias("mask")).select(
            "fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key")
        )
        full = stage(
            rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1), "simhash-buckets"
        )
        members = stage(rows.join(full, ["mask", "key"]), "simhash-members")
        # Keys that leave out b positions hold at most 2^b different fingerprints.
        last = all(1 << (ALL_BITS & ~m).bit_count() <= direct for m in masks)
        small = members if last else members.filter(F.col("n") <= direct)
        left, right = small.alias("l"), small.select("mask", "key", F.col("fp").alias("fp2")).alias("r")
        near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius
        found.append(stage(
            left.join(right, ["mask", "key"]).filter((F.col("fp") < F.col("fp2")) & near)
            .select(F.col("fp").alias("a"), F.col("fp2").alias("b")).distinct(),
            "simhash-links",
        ))
        level = members.filter(F.col("n") > direct).select("fp", "mask")
        if last or level.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def components(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, mark, fp, component_id (smallest id reachable), root.

    ``root``, a fingerprint, names the component; ids need not be unique.
    """
    rows = fingerprints(docs, shingle, seed)
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    labels = connected(links(nodes, radius))
    placed = nodes.join(labels, nodes["fp"] == labels["node"], "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("root")
    )
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    roots = stage(placed.join(lowest, "root").select("fp", "component_id", "root"), "simhash-roots")
    return rows.join(roots, "fp").select("doc_id", "mark", "fp", "component_id", "root")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicate(docs: DataFrame, **how) -> DataFrame:
    """One row of each component with all its columns: the smallest id, then the smallest text mark."""
    rows = stage(components(docs, **how), "simhash-components")
    ids = rows.groupBy("doc_id", "mark", "component_id", "root").agg(F.count(F.lit(1)).alias("repeats"))
    # Several texts of a component may carry its smallest id: the smallest mark stays.
    best = ids.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(
        F.col("root").alias("_root")
    ).agg(F.min("mark").alias("_best"))
    decided = ids.join(best, F.col("root") == F.col("_root")).select(
        "doc_id", "mark", "repeats",
        (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("mark") == F.col("_best"))).alias("kept"),
    )
    return keep_rows(docs, stage(decided, "simhash-decisions"))
