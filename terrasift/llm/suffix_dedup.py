"""Repeated byte strings, found by sorting suffixes the deep-shallow way.

A byte goes when a string of ``LENGTH`` bytes that covers it starts anywhere else too. The
starts of such strings are suffixes to be ordered up to that length. To let tasks own disjoint
sets of suffixes, each start belongs to an anchor: the least hashed gram within its string,
which equal strings share. Runs of starts under one anchor travel together as a *piece*, the
bytes of all its strings.

Per level: pieces are listed by hash only; anchors that occur once drop out, and equal pieces
collapse to one with its count. What is left, different pieces under a common anchor, is cut
from the texts and sorted by the task that owns the anchor. Starts are ordered to a shallow
depth by multikey sorting with symbols of eight bytes, groups that stay together deeper are
ordered by blind tries, and those that end in one leaf are the repeats. An anchor with more
than ``CROWD`` different pieces is not sorted in one task: its pieces become the strings of the
next level, with longer grams, which part them further; at the last level a gram is the whole
string.

Defined cases: a null text is empty and loses nothing; texts under ``LENGTH`` bytes lose
nothing; equal texts (repeated rows too) repeat each other, so all of them go whole; null ids
are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import stage, text_of

LENGTH = 200
#: Bytes of a gram at each level.
GRAMS = (64, 150, 190, LENGTH)
#: Different pieces of an anchor that one task sorts.
CROWD = 4096
#: Depth of the shallow sort in bytes, and the width of its symbols.
SHALLOW, SYMBOL = 32, 8
#: Bytes hashed at once, starts of a longer text that form a block, and bytes sorted at once.
BUFFER, BLOCK, SORTED = 1 << 20, 1 << 19, 1 << 22
#: A place holds the first start of a run and, in its lowest bits, how many there are.
RUN_BITS = 8
MASK = (1 << RUN_BITS) - 1
PLACE_BITS = 21

RUNS = "array<struct<gram: long, span: long, place: long>>"


class Anchors:
    """Anchors of all starts of a buffer, by grams of ``gram`` bytes."""

    def __init__(self, gram: int, length: int = LENGTH):
        self.gram, self.length = gram, length
        base = 0x9E3779B97F4A7C15
        size = 1 << PLACE_BITS

        def powers(of: int) -> np.ndarray:
            out = np.full(size, of, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        # An odd base has an inverse modulo 2^64, so sums of prefixes give every gram's hash.
        self.power, self.inverse = powers(base), powers(pow(base, -1, 1 << 64))

    def grams(self, data: np.ndarray) -> np.ndarray:
        terms = (data.astype(np.uint64) + np.uint64(1)) * self.power[:len(data)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        h = (sums[self.gram:] - sums[:-self.gram]) * self.inverse[:len(data) - self.gram + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(29)

    def of(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per start of ``data`` the place of its anchor; and the hash of every gram."""
        h = self.grams(data)
        width = self.length - self.gram + 1
        # Hash first, place last: the least is the leftmost of the least hashes.
        low = np.uint64(PLACE_BITS)
        key = (h >> low << low) | np.arange(len(h), dtype=np.uint64)
        blocks = -(-len(key) // width)
        wide = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
        wide[:len(key)] = key
        wide = wide.reshape(blocks, width)
        ahead = np.minimum.accumulate(wide, axis=1).ravel()
        behind = np.minimum.accumulate(wide[:, ::-1], axis=1)[:, ::-1].ravel()
        count = len(data) - self.length + 1
        least = np.minimum(behind[:count], ahead[width - 1:width - 1 + count])
        return (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64), h

    def runs(self, strings: list[memoryview]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(gram, span, place) arrays of each string's runs of starts."""
        data = np.frombuffer(b"".join(strings), np.uint8)
        if len(data) < self.length:
            return [(np.zeros(0, np.int64),) * 3 for _ in strings]
        anchor, h = self.of(data)
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        begins = np.cumsum(sizes) - sizes
        out = []
        for string, begin, size in zip(strings, begins.tolist(), sizes.tolist()):
            count = size - self.length + 1
            if count < 1:
                out.append((np.zeros(0, np.int64),) * 3)
                continue
            own = anchor[begin:begin + count]
            first = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
            many = np.diff(first, append=count)
            grams = h[own[first]].view(np.int64)
            spans = np.array([
                xxhash.xxh3_64_intdigest(string[a:a + n + self.length - 1]) for a, n in zip(first.tolist(), many.tolist())
            ], np.uint64).view(np.int64)
            out.append((grams, spans, first << RUN_BITS | many))
        return out


def buffers(sizes: list[int], limit: int = BUFFER) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to about ``limit`` or less; a larger row stands alone."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def scanned(strings: DataFrame, gram: int, length: int, block: int = BLOCK) -> DataFrame:
    """(k1, k2, size, row, runs) per row of ``strings(k1, k2, body)``, written once; ``row`` is a new id."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(gram, length)
        for batch in batches:
            bodies = [memoryview(b.as_buffer()) for b in batch.column("body")]
            sizes = [len(b) for b in bodies]
            for a, b in buffers(sizes):
                if b - a == 1 and sizes[a] > block + length:
                    # A long text goes block by block; blocks share the bytes of the last string.
                    parts = []
                    for at in range(0, sizes[a] - length + 1, block):
                        (g, s, p), = anchors.runs([bodies[a][at:at + block + length - 1]])
                        parts.append((g, s, p + (at << RUN_BITS)))
                    found = [tuple(np.concatenate(x) for x in zip(*parts))]
                else:
                    found = anchors.runs(bodies[a:b])
                ends = np.cumsum([0, *(len(f[0]) for f in found)]).astype(np.int32)
                columns = [pa.array(np.concatenate([f[i] for f in found])) for i in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k1")[a:b], batch.column("k2")[a:b], pa.array(sizes[a:b], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, ["gram", "span", "place"]))],
                    ["k1", "k2", "size", "runs"],
                )

    rows = strings.select("k1", "k2", "body").mapInArrow(scan, f"k1 long, k2 long, size long, runs {RUNS}")
    return stage(rows.withColumn("row", F.monotonically_increasing_id()), "suffix-runs")


def shallow_groups(data: np.ndarray, starts: np.ndarray, depth: int = SHALLOW) -> list[np.ndarray]:
    """Groups of two and more ``starts`` with equal first ``depth`` bytes, in the order of those bytes.

    Multikey sorting: all groups of one depth are sorted by the next symbol at once, and split
    where it changes; a start alone in its group is in place and leaves.
    """
    symbols = np.ndarray((len(data) - SYMBOL + 1,), ">u8", data, strides=(1,))
    group = np.zeros(len(starts), np.int64)
    for at in range(0, depth, SYMBOL):
        if not len(starts):
            return []
        key = symbols[starts + at].astype(np.uint64)
        order = np.lexsort((key, group))
        starts, key, group = starts[order], key[order], group[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        group = np.cumsum(new)
        stays = np.bincount(group)[group] > 1
        starts, group = starts[stays], group[stays]
    return np.split(starts, np.flatnonzero(np.diff(group)) + 1) if len(starts) else []


def mismatch(a: bytes, b: bytes) -> int:
    """First place at which two different strings of one length differ."""
    apart = int.from_bytes(a) ^ int.from_bytes(b)
    return len(a) - (apart.bit_length() + 7) // 8


class Leaf:
    __slots__ = ("text", "members")

    def __init__(self, text: bytes, member: int):
        self.text, self.members = text, [member]


class Branch:
    __slots__ = ("depth", "children")

    def __init__(self, depth: int, children: dict):
        self.depth, self.children = depth, children


def deep_order(data: bytes, starts: list[int], known: int, length: int) -> list[list[int]]:
    """``starts`` in the order of their strings of ``length`` bytes, equal ones together.

    A blind trie: branches keep only the place and the byte in which strings differ. A string
    goes down by those bytes alone, is compared once with the leaf it comes to, and is hung in
    where the two first differ.
    """
    root: Leaf | Branch = Leaf(data[starts[0] + known:starts[0] + length], starts[0])
    for start in starts[1:]:
        text = data[start + known:start + length]
        node, path = root, []
        while isinstance(node, Branch):
            path.append(node)
            node = node.children.get(text[node.depth]) or next(iter(node.children.values()))
        if node.text == text:
            node.members.append(start)
            continue
        at = mismatch(node.text, text)
        leaf = Leaf(text, start)
        above = [b for b in path if b.depth <= at]
        if above and above[-1].depth == at:
            above[-1].children[text[at]] = leaf
            continue
        below = path[len(above)] if len(above) < len(path) else node
        fork = Branch(at, {node.text[at]: below, text[at]: leaf})
        if above:
            above[-1].children[text[above[-1].depth]] = fork
        else:
            root = fork
    out, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        if isinstance(node, Leaf):
            out.append(node.members)
        else:
            waiting += [child for _, child in sorted(node.children.items(), reverse=True)]
    return out


def repeated_starts(bodies: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Per body a mask over its starts: whether the string there starts elsewhere in ``bodies`` too."""
    data = b"".join(bodies)
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    begins = np.cumsum(sizes) - sizes
    counts = sizes - length + 1
    ends = np.cumsum(counts)
    starts = np.arange(ends[-1]) + np.repeat(begins - (ends - counts), counts)
    again = np.zeros(len(data), bool)
    known = min(SHALLOW, length // SYMBOL * SYMBOL)
    for group in shallow_groups(np.frombuffer(data, np.uint8), starts, known):
        for equal in deep_order(data, group.tolist(), known, length):
            if len(equal) > 1:
                again[equal] = True
    return [again[b:b + n] for b, n in zip(begins.tolist(), counts.tolist())]


def ones(mask: np.ndarray) -> Iterator[tuple[int, int]]:
    """Half-open ranges of the set places."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    yield from zip(edges[::2].tolist(), edges[1::2].tolist())


def sorted_pieces(pieces: DataFrame, length: int) -> DataFrame:
    """(gram, span, low, high): ranges of repeated starts of ``pieces(gram, span, n, body)`` with n = 1."""

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size, last = 0, None

        def judged() -> pa.RecordBatch:
            rows = [
                (gram, span, low, high)
                for (gram, span, n, _), mask in zip(held, repeated_starts([h[3] for h in held], length)) if n == 1
                for low, high in ones(mask)
            ]
            columns = zip(*rows) if rows else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["gram", "span", "low", "high"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "span", "n", "body"))):
                # Pieces of one anchor stay together; they are at most CROWD.
                if size > SORTED and row[0] != last:
                    yield judged()
                    held.clear()
                    size = 0
                held.append(row)
                size, last = size + len(row[3]), row[0]
        if held:
            yield judged()

    owned = pieces.select("gram", "span", "n", "body").repartition("gram").sortWithinPartitions("gram")
    return owned.mapInArrow(order, "gram long, span long, low long, high long")


def cut_pieces(wanted: DataFrame, length: int) -> DataFrame:
    """(gram, span, n, different, body) out of ``wanted(body, pieces)``, written once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in buffers([len(x) for x in batch.column("pieces")], 4096):
                lists = batch.column("pieces")[a:b]
                flat = lists.flatten()
                fields = {name: flat.field(name) for name in ("gram", "span", "place", "n", "different")}
                bodies = [memoryview(x.as_buffer()) for x in batch.column("body")[a:b]]
                owner = np.repeat(np.arange(b - a), [len(x) for x in lists]).tolist()
                bytes_of = [
                    bytes(bodies[i][p >> RUN_BITS:(p >> RUN_BITS) + (p & MASK) + length - 1])
                    for i, p in zip(owner, fields["place"].to_pylist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [fields["gram"], fields["span"], fields["n"], fields["different"], pa.array(bytes_of, pa.binary())],
                    ["gram", "span", "n", "different", "body"],
                )

    return stage(
        wanted.select("body", "pieces").mapInArrow(cut, "gram long, span long, n long, different long, body binary"),
        "suffix-pieces",
    )


def repeats(
    strings: DataFrame, length: int = LENGTH, grams: tuple[int, ...] = GRAMS, crowd: int = CROWD, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Runs of ``strings(k1, k2, body)`` and (row, low, high), the ranges of starts that occur again.

    Rows of equal keys are equal strings; they count as often as they occur.
    """
    runs = scanned(strings, grams[0], length, block)
    every = runs.select("row", F.inline("runs"))
    often = stage(every.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("gram"), "suffix-grams")
    near = stage(every.join(often, "gram", "left_semi"), "suffix-near")
    kinds = stage(
        near.groupBy("gram", "span").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "place")).alias("first")), "suffix-kinds"
    )
    different = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("different")).filter(F.col("different") > 1)
    shared = kinds.join(different, "gram").select("gram", "span", "n", "different", "first.row", "first.place")
    listed = shared.groupBy("row").agg(F.collect_list(F.struct("gram", "span", "place", "n", "different")).alias("pieces"))
    wanted = stage(runs.select("row", "k1", "k2").join(listed, "row").drop("row"), "suffix-wanted")
    # Rows of equal strings may each be asked for pieces; one body serves them all.
    keys = ["k1", "k2"]
    bodies = strings.join(wanted.select(keys), keys, "left_semi").groupBy(keys).agg(F.first("body").alias("body"))
    pieces = cut_pieces(bodies.join(wanted, keys), length)

    last = len(grams) == 1
    found = [kinds.filter(F.col("n") > 1).select("gram", "span", F.lit(0).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))]
    found.append(stage(sorted_pieces(pieces if last else pieces.filter(F.col("different") <= crowd), length), "suffix-sorted"))
    crowded = pieces.filter(F.col("different") > crowd)
    if not last and not crowded.isEmpty():
        again = crowded.select(F.col("gram").alias("k1"), F.col("span").alias("k2"), "body")
        deeper, ranges = repeats(again, length, grams[1:], crowd, block)
        found.append(
            ranges.join(deeper.select("row", "k1", "k2"), "row")
            .join(crowded.filter(F.col("n") == 1).select(F.col("gram").alias("k1"), F.col("span").alias("k2")), keys, "left_semi")
            .select(F.col("k1").alias("gram"), F.col("k2").alias("span"), "low", "high")
        )
    ranges = near.join(reduce(DataFrame.unionByName, found), ["gram", "span"])
    at, many = F.shiftright("place", RUN_BITS), F.col("place").bitwiseAND(F.lit(MASK))
    return runs, stage(
        ranges.select("row", (at + F.col("low")).alias("low"), (at + F.coalesce("high", many)).alias("high")), "suffix-ranges"
    )


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, body): two hashes together name a text."""
    text: Column = text_of()
    return docs.select("doc_id", F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(LENGTH), text).alias("k2"), text.cast("binary").alias("body"))


def removed_parts(starts: list[dict], size: int, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by the strings that begin in the ranges ``starts``."""
    out: list[tuple[int, int]] = []
    for low, high in sorted((s["low"], s["high"] + length - 1) for s in starts):
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(high, out[-1][1])
        else:
            out.append((low, high))
    return out


def deduplicate(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, parts array<struct<start, end>> and the kept bytes of every row."""
    rows = keyed(docs)
    runs, ranges = repeats(rows, length, **how)
    sizes = runs.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("row").alias("row"))
    sizes = stage(sizes, "suffix-texts")
    # Equal texts go whole, whatever else they share.
    whole = sizes.filter((F.col("copies") > 1) & (F.col("size") >= length)).select(
        "k1", "k2", F.array(F.struct(F.lit(0).cast("long").alias("low"), (F.col("size") - length + 1).alias("high"))).alias("starts")
    )
    parts = (
        ranges.join(sizes.filter(F.col("copies") == 1).select("k1", "k2", "row"), "row")
        .groupBy("k1", "k2").agg(F.collect_list(F.struct("low", "high")).alias("starts"))
    )
    marks = stage(whole.unionByName(parts), "suffix-marks")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, kept, found = batch.column("body"), [], []
            for body, starts in zip(bodies, batch.column("starts").to_pylist()):
                body = memoryview(body.as_buffer())
                cut = removed_parts(starts or [], len(body), length)
                found.append([{"start": a, "end": b} for a, b in cut])
                edges = zip([0, *(b for _, b in cut)], [*(a for a, _ in cut), len(body)])
                kept.append(b"".join(body[a:b] for a, b in edges))
            sizes = pa.array([b.as_buffer().size for b in bodies], pa.int64())
            gone = pa.array([sum(p["end"] - p["start"] for p in f) for f in found], pa.int64())
            spans = pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), sizes, gone, spans, pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "parts", "kept"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return rows.join(marks, ["k1", "k2"], "left").select("doc_id", "body", "starts").mapInArrow(
        remove, f"doc_id {kind}, n_bytes long, n_removed long, parts array<struct<start: long, end: long>>, kept binary"
    )
