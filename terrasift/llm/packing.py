"""Packing by concatenate and cut: all token streams are one line, cut every ``length`` ids.

Pass one tokenises each input partition and writes ids with their running place inside the
partition. Pass two sums the partitions' totals, one row each, into global offsets. A
document's window numbers then follow by division; a document that crosses windows gives one
boundary record per piece. No row moves between the passes, and no window is gathered.

Defined cases: a null text is empty and yields the closing id alone; an empty table gives no
piece; repeated rows are packed each; very long texts give as many pieces as they need; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from terrasift.llm.common import offsets, stage, text_of

LENGTH = 2048
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CLOSING_ID = 1
#: Pieces that a task remembers; its memory is emptied when they are more.
REMEMBERED = 250_000
#: Longest piece that is remembered; texts with longer ones go to the tokenizer as they are.
LONGEST = 256
#: Characters that are cut into pieces at once.
AT_ONCE = 1 << 18
ID_BYTES = 4
# How the tokenizer cuts lower-case text, its classes written out for Latin-1.
LETTER = "abcdefghijklmnopqrstuvwxyzªµº" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
DIGIT = "0123456789²³¹¼½¾"
SHORT_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Bytes of printable Latin-1; texts of others, and those that may hold special tokens, go to the tokenizer as they are.
PLAIN = bytes([9, 10, *range(0x20, 0x7F), *range(0xA1, 0x100)])
LOWER = bytes(ord(chr(c).lower()) for c in range(256))
BLANKS, LETTERS, DIGITS, OTHERS = range(4)
#: Base of the pieces' hash.
BASE = 0xD6E8FEB86659FD93


def _classes() -> np.ndarray:
    kinds = np.full(256, OTHERS, np.uint8)
    kinds[[9, 10, 32]] = BLANKS
    kinds[[ord(c) for c in LETTER]] = LETTERS
    kinds[[ord(c) for c in DIGIT]] = DIGITS
    return kinds


class WordIds:
    """Ids of whole texts, remembered piece by piece.

    The tokenizer lower-cases, cuts a text into pieces, drops white space and codes each piece
    by itself, so a text's ids are its pieces' ids. Pieces are cut, hashed and looked up as
    arrays, many texts at once; only new ones become strings, which are coded together by the
    tokenizer's own model without the steps that leave them as they are.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED, at_once: int = AT_ONCE):
        self.tokenizer, self.remembered, self.at_once = Tokenizer.from_file(path), remembered, at_once
        self.own = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        blanks, as_bytes = pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        nothing = normalizers.Sequence([])
        self.ascii, self.latin = (nothing, blanks), (nothing, pre_tokenizers.Sequence([blanks, as_bytes]))
        self.kinds = _classes()
        self.power = self.inverse = np.zeros(0, np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.pool, self.begins = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _steps(self, steps: tuple) -> None:
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = steps

    def whole(self, text: str) -> bytes:
        """Ids of one text by the tokenizer with all its steps."""
        self._steps(self.own)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _coded(self, line: str, pieces: int, steps: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the ``pieces`` of a line, one behind the other, and how many each has."""
        self._steps(steps)
        coded = self.tokenizer.encode(line, add_special_tokens=False)
        counts = np.bincount(np.array(coded.word_ids, np.int64), minlength=pieces)
        if len(counts) != pieces or not counts.all():
            raise RuntimeError("The tokenizer cuts pieces further")
        return np.array(coded.ids, "<u4"), counts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = []
        start = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size > self.at_once or i + 1 == len(texts):
                out += self._some(texts[start:i + 1])
                start, size = i + 1, 0
        return out

    def _cut(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last places of the pieces of lower-case Latin-1 ``data``, which ends with a blank."""
        kind = self.kinds[data]
        start = np.ones(len(data), bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGITS)
        start &= kind != BLANKS
        # An apostrophe that begins a piece takes a short ending with it.
        quote = np.flatnonzero(start & (data == ord("'")))
        padded = np.concatenate([data, np.full(2, 32, np.uint8)])
        for ending in SHORT_ENDINGS:
            fits = np.ones(len(quote), bool)
            for k, c in enumerate(ending, 1):
                fits &= padded[quote + k] == ord(c)
            at = quote[fits]
            after = at + 1 + len(ending)
            start[at + 1] = False
            start[after] |= kind[after] == LETTERS
        last = kind != BLANKS
        last[:-1] &= start[1:] | (kind[1:] == BLANKS)
        return np.flatnonzero(start), np.flatnonzero(last)

    def _hashed(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        if len(data) > len(self.power):
            # An odd base has an inverse modulo 2^64, so sums of prefixes give the hash of every piece.
            raised = []
            for base in (BASE, pow(BASE, -1, 1 << 64)):
                powers = np.full(2 * len(data), base, np.uint64)
                powers[0] = 1
                raised.append(np.cumprod(powers, dtype=np.uint64))
            self.power, self.inverse = raised
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:len(data)], out=sums[1:])
        h = (sums[last + 1] - sums[first]) * self.inverse[first]
        h ^= h >> np.uint64(32)
        return h * np.uint64(0x9E3779B97F4A7C15) ^ (last - first).astype(np.uint64)

    def _some(self, texts: list[str]) -> list[bytes]:
        if len(self.slots) > self.remembered:
            self._forget()
        plain: list[int] = []
        bodies: list[bytes] = []
        for i, text in enumerate(texts):
            try:
                body = text.encode("latin-1")
            except UnicodeEncodeError:
                continue
            if b"<|" not in body and not body.translate(None, PLAIN):
                plain.append(i)
                bodies.append(body.translate(LOWER) + b"\n")
        out: dict[int, bytes] = {}
        if plain:
            data = np.frombuffer(b"".join(bodies), np.uint8)
            ends = np.cumsum([len(b) for b in bodies])
            first, last = self._cut(data)
            key, place, which = np.unique(self._hashed(data, first, last), return_index=True, return_inverse=True)
            slot = np.fromiter((self.slots.get(k, -1) for k in key.tolist()), np.int64, len(key))
            new = np.flatnonzero(slot < 0)
            if len(new):
                slot[new] = self._learn(data, first[place[new]], last[place[new]], key[new])
            own = slot[which]
            counts = np.diff(self.begins)[own]
            upto = np.concatenate([[0], np.cumsum(counts)])
            ids = self.pool[np.arange(upto[-1]) + np.repeat(self.begins[own] - upto[:-1], counts)]
            edges = upto[np.searchsorted(first, np.concatenate([[0], ends]))].tolist()
            long = set(np.searchsorted(ends, first[last - first >= LONGEST], side="right").tolist())
            out = {i: ids[edges[k]:edges[k + 1]].tobytes() for k, i in enumerate(plain) if k not in long}
        return [self.whole(t) if i not in out else out[i] for i, t in enumerate(texts)]

    def _learn(self, data: np.ndarray, first: np.ndarray, last: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Slots of new pieces of ``data``; those beyond ``LONGEST`` get one without ids and are not remembered."""
        sizes = last - first + 1
        wide = np.concatenate([[0], np.cumsum(data > 127)])
        latin = wide[last + 1] > wide[first]
        pools, counts, order = [self.pool], [self.begins[-1:]], []
        for steps, at in ((self.ascii, ~latin & (sizes <= LONGEST)), (self.latin, latin & (sizes <= LONGEST))):
            at = np.flatnonzero(at)
            if len(at):
                # The pieces one behind the other, a blank after each.
                ends = np.cumsum(sizes[at] + 1)
                line = data[np.arange(ends[-1]) + np.repeat(first[at] - (ends - sizes[at] - 1), sizes[at] + 1)]
                line[ends - 1] = 32
                ids, many = self._coded(line.tobytes().decode("latin-1"), len(at), steps)
                pools.append(ids)
                counts.append(many)
                order.append(at)
        begin = len(self.begins) - 1
        known = np.concatenate(order) if order else np.zeros(0, np.int64)
        long = np.flatnonzero(sizes > LONGEST)
        self.pool = np.concatenate(pools)
        self.begins = np.concatenate([self.begins[:-1], np.cumsum(np.concatenate([*counts, np.zeros(len(long), np.int64)]))])
        slots = np.empty(len(first), np.int64)
        slots[np.concatenate([known, long])] = np.arange(begin, begin + len(first))
        self.slots.update(zip(keys[known].tolist(), slots[known].tolist()))
        return slots


def tokenised(docs: DataFrame, tokenizer: str = TOKENIZER, closing: int = CLOSING_ID) -> DataFrame:
    """(doc_id, part, place, n, ids) written once; ``place`` counts ids inside the partition."""
    end = np.array([closing], "<u4").tobytes()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, place = WordIds(tokenizer), 0
        for batch in batches:
            for rows in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                ids = [x + end for x in words.encode(rows.column("_text").to_pylist())]
                n = np.fromiter(map(len, ids), np.int64, len(ids)) // ID_BYTES
                start = place + np.cumsum(n) - n
                place += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("part"), pa.array(start), pa.array(n), pa.array(ids, pa.binary())],
                    ["doc_id", "part", "place", "n", "ids"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.spark_partition_id().alias("part"), text_of().alias("_text"))
    return stage(
        rows.mapInArrow(code, f"doc_id {kind}, part int, place long, n long, ids binary"), "pack-tokens"
    )


def pieces(docs: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER, closing: int = CLOSING_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    coded = tokenised(docs, tokenizer, closing)
    # Written, so that its known size lets the ids stay where they are.
    totals = stage(offsets(coded.groupBy(F.col("part").alias("_part")).agg(F.sum("n").alias("_n"))), "pack-offsets")
    at = F.col("place") + F.col("_before")
    placed = coded.join(totals, coded["part"] == totals["_part"]).select("doc_id", "n", "ids", at.alias("at"))
    cut = placed.select(
        "doc_id", "n", "ids", "at",
        F.explode(F.sequence(F.expr(f"at div {length}"), F.expr(f"(at + n - 1) div {length}"))).alias("sequence_id"),
    )
    first = F.greatest(F.col("at"), F.col("sequence_id") * length)
    last = F.least(F.col("at") + F.col("n"), (F.col("sequence_id") + 1) * length)
    return cut.withColumns({"_first": first, "_last": last}).select(
        "doc_id",
        (F.col("_first") - F.col("at")).alias("start"),
        (F.col("_last") - F.col("_first")).alias("length"),
        part_of(F.col("ids"), F.col("_first") - F.col("at"), F.col("_last") - F.col("_first")).alias("ids"),
        F.col("n").alias("doc_tokens"),
        "sequence_id",
        (F.col("_first") - F.col("sequence_id") * length).alias("offset"),
    )


def part_of(ids: Column, start: Column, count: Column) -> Column:
    return F.substring(ids, (start * ID_BYTES + 1).cast("int"), (count * ID_BYTES).cast("int"))


def sequences(cut: DataFrame) -> DataFrame:
    """(sequence_id, ids): each window's pieces joined; a window holds at most its length of pieces."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return cut.groupBy("sequence_id").agg(
        F.aggregate(ordered, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids")
    )
