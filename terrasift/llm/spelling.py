"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

One replaced letter moves the letter-count vector by L1 distance two, one inserted or deleted
letter by one. So a word of length L searches the tree over the words of its own length within
two, and the tree over the words of length L + 1 within one; what the boxes do not prune is
verified letter by letter.

The trees are built in two parts. Cells that hold more than ``CELL`` words are split, all at
once, by a small tree that is fitted on about ``FIT`` of the cell's words; every word goes to
one cell, a search goes to every cell whose box it reaches. This repeats until each cell fits a
task. Inside a task the cell's words form a tree with tight boxes down to leaves of ``LEAF``
words. Words with one and the same vector cannot be split; they are dealt into chunks and
verified through an index of their patterns, never pair by pair.

Defined cases: a null text has no words; in a row without an id no letter is deleted, as the
rule needs the id; repeated rows count each; runs that lose their letter so that fewer than
``SHORTEST`` remain are no words; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import stage, text_of

RUN = "[a-zÀ-ÿ]"
SHORTEST, RARE, CHANCE, FACTOR = 6, 5, 199, 5
#: Letters a word can hold: a-z and U+00C0 to U+00FF.
FIRST, LATIN, SIZE = ord("a"), 0xC0, 26 + 64
#: Words of a cell, words a tree is fitted on, words of a leaf inside a task, levels of a fitted tree.
CELL, FIT, LEAF, DEPTH = 16_384, 4096, 64, 6
#: Counts of a letter that are told apart by bits, and letters of a word that lie in a row of an array.
LEVELS, WIDEST = 7, 64
#: Different words that a task counts before it hands the counts on.
HELD = 200_000


class WordCounts:
    """Counts of the words of many texts, by numbers of the words seen so far.

    The crc32 of ``<doc_id>:<word>`` is the crc32 of the prefix, moved on by the word's bytes,
    xor the crc32 of the word alone; so each word's own is taken once.
    """

    def __init__(self, shortest: int, chance: int):
        # A longer run may lose a letter, a shorter one never counts.
        self.runs = re.compile(RUN + "{%d,}" % shortest)
        self.shortest, self.chance = shortest, chance
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, step >> 1 ^ np.uint32(0xEDB88320), step >> 1)
        self.step = step
        self.clear()

    def clear(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        self.crc, self.bytes = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.counts, self.cut = np.zeros(0, np.int64), Counter()

    def add(self, ids: list[str | None], texts: list[str]) -> None:
        # bytes.lower() touches A-Z only.
        found = [self.runs.findall(text.encode().lower().decode()) for text in texts]
        words = list(itertools.chain.from_iterable(found))
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        new = [w.encode() for w in itertools.islice(self.number, len(self.crc), None)]
        self.crc = np.concatenate([self.crc, np.array([zlib.crc32(w) for w in new], np.uint32)])
        self.bytes = np.concatenate([self.bytes, np.array([len(w) for w in new], np.int64)])
        self.counts = np.concatenate([self.counts, np.zeros(len(new), np.int64)])

        doc = np.repeat(np.arange(len(ids)), [len(f) for f in found])
        moved = np.array([0 if i is None else zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
        sizes = self.bytes[at]
        order = np.argsort(sizes, kind="stable")
        h = np.zeros(len(at), np.uint32)
        shifts = 0
        for size, index in zip(*groups_of(sizes, order)):
            if size - shifts > 4096:  # a very long run: byte by byte is as well done at once
                moved = np.array([0 if i is None else zlib.crc32(b"\0" * size, zlib.crc32(f"{i}:".encode())) ^ zlib.crc32(b"\0" * size) for i in ids], np.uint32)
            else:
                for _ in range(size - shifts):
                    moved = self.step[moved & 0xFF] ^ moved >> 8
            shifts = size
            h[index] = moved[doc[index]] ^ self.crc[at[index]]
        named = np.array([i is not None for i in ids], bool)
        lost = (h % self.chance == 0) & named[doc]
        self.counts += np.bincount(at[~lost], minlength=len(self.counts))
        for i in np.flatnonzero(lost).tolist():
            word = words[i]
            place = int(h[i]) % len(word)
            self.cut[word[:place] + word[place + 1:]] += 1

    def taken(self) -> pa.RecordBatch:
        """(word, n) counted so far; counting starts anew."""
        whole = np.flatnonzero(self.counts)
        listed = list(self.number)
        cut = [(w, n) for w, n in self.cut.items() if len(w) >= self.shortest]
        words = [listed[i] for i in whole.tolist()] + [w for w, _ in cut]
        counts = [*self.counts[whole].tolist(), *(n for _, n in cut)]
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])


def groups_of(values: np.ndarray, order: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Different ``values``, rising, and the places of each; ``order`` sorts them."""
    ordered = values[order]
    edges = np.flatnonzero(np.diff(ordered)) + 1
    return ordered[np.concatenate([[0], edges])].tolist() if len(ordered) else [], np.split(order, edges) if len(ordered) else []


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, rare: int = RARE, chance: int = CHANCE) -> DataFrame:
    """(word, n, length) of every word with at least ``rare`` occurrences, written once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = WordCounts(shortest, chance)
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                held.add(part.column("_id").to_pylist(), part.column("_text").to_pylist())
                if len(held.number) > HELD:
                    yield held.taken()
        yield held.taken()

    rows = docs.select(F.col("doc_id").cast("string").alias("_id"), text_of().alias("_text"))
    words = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stage(words.filter(F.col("n") >= rare).withColumn("length", F.length("word")), "spelling-words")


def letter_counts(words: list[str]) -> np.ndarray:
    """One row of letter counts per word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    letters = np.where(codes >= LATIN, codes - LATIN + 26, codes - FIRST)
    flat = np.bincount(np.repeat(np.arange(len(words)), lengths) * SIZE + letters, minlength=len(words) * SIZE)
    return flat.reshape(len(words), SIZE).astype(np.int32)


def split(points: np.ndarray) -> tuple[int, int] | None:
    """(dimension, greatest value of the lower side) that halves the points best; None if all are equal."""
    spread = points.var(axis=0)
    at = int(spread.argmax())
    if not spread[at]:
        return None
    values = np.sort(points[:, at])
    middle = values[len(values) // 2]
    # The cut lies below or at the middle value, on the side that is more even and leaves no side empty.
    below = int((values < middle).sum())
    upto = int((values <= middle).sum())
    if upto == len(values) or (below and abs(2 * below - len(values)) < abs(2 * upto - len(values))):
        return at, int(values[below - 1])
    return at, int(middle)


def fitted(points: np.ndarray, depth: int = DEPTH) -> list:
    """Nested [dimension, cut, lower, upper]; a leaf is an empty list."""
    cut = split(points) if depth and len(points) > 1 else None
    if cut is None:
        return []
    low = points[:, cut[0]] <= cut[1]
    return [*cut, fitted(points[low], depth - 1), fitted(points[~low], depth - 1)]


def leaves(tree: list, points: np.ndarray, reach: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """(path, indices) of the leaves whose box lies within ``reach`` (L1) of each point."""
    out = []

    def walk(node: list, path: str, low: dict[int, int], high: dict[int, int], index: np.ndarray) -> None:
        away = np.zeros(len(index), np.int64)
        for at, value in low.items():
            away += np.maximum(value - points[index, at], 0)
        for at, value in high.items():
            away += np.maximum(points[index, at] - value, 0)
        index = index[away <= reach[index]]
        if not len(index):
            return
        if not node:
            out.append((path, index))
            return
        at, cut, lower, upper = node
        walk(lower, path + "0", low, high | {at: min(cut, high.get(at, cut))}, index)
        walk(upper, path + "1", low | {at: max(cut + 1, low.get(at, 0))}, high, index)

    walk(tree, "", {}, {}, np.arange(len(points)))
    return out


def fit_cells(words: DataFrame, cell: int) -> DataFrame:
    """(cell, tree) over ``words(cell, word, size)``, a bounded share of each cell of ``size`` words."""

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        # As many leaves as bring the cell down to half of what fits.
        depth = min(DEPTH, int(2 * frame["size"].iloc[0] // cell).bit_length())
        tree = fitted(letter_counts(frame["word"].tolist()), depth)
        return pd.DataFrame({"cell": [frame["cell"].iloc[0]], "tree": [json.dumps(tree)]})

    return words.select("cell", "word", "size").groupBy("cell").applyInPandas(fit, "cell string, tree string")


def routed(rows: DataFrame, trees: DataFrame) -> DataFrame:
    """``rows(cell, word, n, reach)``, each in every leaf of its cell's tree that it reaches."""

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for tree, part in frame.groupby("tree", dropna=False):
                if not isinstance(tree, str) or tree == "[]":
                    yield part.drop(columns="tree")
                    continue
                points = letter_counts(part["word"].tolist())
                for path, index in leaves(json.loads(tree), points, part["reach"].to_numpy()):
                    yield part.iloc[index].assign(cell=lambda f, path=path: f["cell"] + path).drop(columns="tree")

    return rows.join(trees, "cell", "left").mapInPandas(go, "cell string, word string, n long, reach int")


def one_edit(a: str, b: str) -> bool:
    """Whether one replaced, or one inserted letter of the longer ``b``, leads from ``a`` to ``b``."""
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:] and a != b


def letters_of(words: list[str], width: int) -> np.ndarray:
    """Code points of each word, one row per word, zeros behind its end."""
    codes = np.zeros((len(words), width), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes[np.arange(width) < lengths[:, None]] = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    return codes


def in_order(a: np.ndarray, b: np.ndarray, longer: bool) -> np.ndarray:
    """Row by row whether the letters ``a`` and ``b`` are one edit apart; ``b`` may be one ``longer``."""
    if not longer:
        return (a != b).sum(axis=1) == 1
    size = b.shape[1] - 1
    head = np.logical_and.accumulate(a[:, :size] == b[:, :size], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a[:, :size] == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= size


def by_pattern(queries: list[str], stored: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs of places one edit apart, by the words with one letter left out at each place."""
    index = defaultdict(list)
    for j, v in enumerate(stored):
        for i in range(len(v)):
            index[v[:i], v[i + 1:]].append(j)
    for k, u in enumerate(queries):
        longer = len(stored[0]) > len(u)
        # Inserting between equal letters reaches the same word by several places.
        found = {j for i in range(len(u) + longer) for j in index.get((u[:i], u[i:] if longer else u[i + 1:]), ())}
        yield from ((k, j) for j in found if stored[j] != u)


def scales(points: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Each count as so many leading set bits of its letter's ``levels``, 64 of all bits to an array.

    The L1 distance of two points is then the number of differing bits, and a box is the bits
    common to all its points and the bits of any.
    """
    bits = np.concatenate([points[:, [at]] > np.arange(n) for at, n in enumerate(levels.tolist()) if n], axis=1)
    packed = np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1)
    # One array for each 64 bits: numpy is slow along a short last axis.
    return np.ascontiguousarray(packed.view(np.uint64).T)


def differing(words: Iterator[np.ndarray]) -> np.ndarray:
    """Set bits of each place over all ``words``."""
    total = None
    for word in words:
        count = np.bitwise_count(word).astype(np.uint16)
        total = count if total is None else total + count
    return total


def search(queries: list[str], reach: np.ndarray, stored: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, stored) one edit apart, as arrays of places.

    All ``stored`` have one length; ``reach`` is 2 for queries of that length, 1 for those one shorter.
    """
    points, q = letter_counts(stored), letter_counts(queries)
    # Counts above the highest level look equal, which brings points nearer and loses none.
    levels = np.minimum(np.maximum(points.max(axis=0), q.max(axis=0)), LEVELS)
    held_bits, asked_bits = scales(points, levels), scales(q, levels)
    width = len(stored[0])
    short = width <= WIDEST
    if short:
        held_letters, asked_letters = letters_of(stored, width), letters_of(queries, width)

    def verified(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not short:
            right = np.array([one_edit(queries[a], stored[b]) for a, b in zip(i.tolist(), j.tolist())], bool)
            yield i[right], j[right]
            return
        for r in (1, 2):
            a, b = i[reach[i] == r], j[reach[i] == r]
            right = in_order(asked_letters[a], held_letters[b], r == 1)
            yield a[right], b[right]

    waiting = [(np.arange(len(stored)), np.arange(len(queries)))]
    while waiting:
        held, asking = waiting.pop()
        outside = (
            np.bitwise_and.reduce(own[held]) & ~near | near & ~np.bitwise_or.reduce(own[held])
            for own, near in ((own, asked[asking]) for own, asked in zip(held_bits, asked_bits))
        )
        asking = asking[differing(outside) <= reach[asking]]
        if not len(asking):
            continue
        cut = split(points[held]) if len(held) > LEAF else None
        if cut:
            lower = points[held, cut[0]] <= cut[1]
            waiting += [(held[lower], asking), (held[~lower], asking)]
        elif len(held) > LEAF:
            # One vector for all: which of them are near is told by patterns, not pair by pair.
            for r in (1, 2):
                exact = asking[(np.abs(q[asking] - points[held[0]]).sum(axis=1) == r) & (reach[asking] == r)]
                if len(exact):
                    pairs = np.array(list(by_pattern([queries[i] for i in exact], [stored[j] for j in held])), np.int64).reshape(-1, 2)
                    yield exact[pairs[:, 0]], held[pairs[:, 1]]
        else:
            for block in (asking[i:i + 2048] for i in range(0, len(asking), 2048)):
                distance = differing(asked[block][:, None] ^ own[held] for own, asked in zip(held_bits, asked_bits))
                a, b = np.nonzero(distance <= reach[block][:, None])
                yield from verified(block[a], held[b])


def links(words: DataFrame, cell: int = CELL, fit: int = FIT) -> DataFrame:
    """(word, near, near_n), both ways, for all pairs of ``words(word, n, length)`` one edit apart."""
    stored = words.select(F.col("length").cast("string").alias("cell"), "word", "n", F.lit(0).alias("reach"))
    # A slash ends the length, so that paths of "1" and "11" stay apart.
    stored = stored.withColumn("cell", F.concat("cell", F.lit("/")))
    ways = F.explode(F.array(*(
        F.struct(F.concat((F.col("length") + more).cast("string"), F.lit("/")).alias("cell"), F.lit(2 - more).alias("reach"))
        for more in (0, 1)
    )))
    asked = words.select("word", "n", ways.alias("way")).select("way.cell", "word", "n", "way.reach")
    whole = words.sparkSession.createDataFrame([], "cell string")
    while True:
        sizes = stage(stored.groupBy("cell").agg(F.count(F.lit(1)).alias("size")), "spelling-sizes")
        large = sizes.filter(F.col("size") > cell).join(whole, "cell", "left_anti")
        if large.isEmpty():
            break
        share = F.pmod(F.xxhash64("word"), F.ceil(F.col("size") / fit))
        trees = stage(fit_cells(stored.join(large, "cell").filter(share == 0), cell), "spelling-trees")
        whole = whole.union(trees.filter(F.col("tree") == "[]").select("cell"))
        stored = stage(routed(stored, trees), "spelling-stored")
        asked = stage(routed(asked.join(sizes, "cell", "left_semi"), trees), "spelling-asked")

    # Bounded groups: chunks of what is stored times parts of what is asked.
    counts = stage(
        sizes.join(asked.groupBy("cell").agg(F.count(F.lit(1)).alias("asks")), "cell").select(
            "cell", F.ceil(F.col("size") / cell).cast("int").alias("chunks"), F.ceil(F.col("asks") / (2 * cell)).cast("int").alias("parts"),
        ),
        "spelling-groups",
    )
    own = F.pmod(F.xxhash64("word"), F.col("chunks"))
    part = F.pmod(F.xxhash64("word", F.lit(1)), F.col("parts"))
    left = asked.join(counts, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)).alias("chunk"), part.alias("part"), "word", "n", "reach"
    )
    right = stored.join(counts, "cell").select(
        "cell", own.alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"),
        F.col("word").alias("held"), F.col("n").alias("held_n"),
    )

    def near(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asking) and len(held):
            us, vs = asking["word"].tolist(), held["held"].tolist()
            un, vn, reach = asking["n"].tolist(), held["held_n"].tolist(), asking["reach"].to_numpy()
            for places in search(us, reach, vs):
                for i, j in zip(*(p.tolist() for p in places)):
                    out.append((us[i], vs[j], vn[j]))
                    if reach[i] == 1:  # the longer word does not search among shorter ones
                        out.append((vs[j], us[i], un[i]))
        return pd.DataFrame(out, columns=["word", "near", "near_n"]).astype({"near_n": "int64"})

    keys = ["cell", "chunk", "part"]
    return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(near, "word string, near string, near_n long")


def ends(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms(word, form)``: the last word, by doubling the steps each round."""
    steps = stage(forms.select("word", F.col("form").alias("root")), "spelling-steps")
    while True:
        onward = steps.select(F.col("word").alias("_from"), F.col("root").alias("_to"))
        longer = stage(steps.join(onward, steps["root"] == onward["_from"], "left"), "spelling-steps")
        if longer.filter(F.col("_to").isNotNull()).isEmpty():
            return steps
        steps = longer.select("word", F.coalesce("_to", "root").alias("root"))


def variants(docs: DataFrame, factor: int = FACTOR, **how: int) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs``.

    ``form`` is the near word of largest n, ties to the smallest in code-point order, where it
    occurs ``factor`` times as often. Forms grow at each step, so following them ends.
    """
    words = vocabulary(docs, **how)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = links(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    wins = -F.col("best.less") >= factor * F.col("n")
    placed = stage(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(wins, F.col("best.near")).alias("form"), F.when(wins, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = ends(placed.filter(F.col("form").isNotNull()))
    return placed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
