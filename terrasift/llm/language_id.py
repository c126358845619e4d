"""Language by compression: the language whose dictionary shortens a text most.

One zstandard raw-content dictionary per language is cut from a bounded sample of labelled
rows. A text is lower-cased, reduced to its words and compressed in pieces with every
dictionary, whole; the smallest sum wins. A narrow margin between the two smallest sums is a
rejection.

The fit reads at most ``SAMPLE`` labelled rows per language, chosen by a hash of the id. Each
gives its dictionary one slice, at a place of the whole text that the hash draws; every text is
predicted whole.

Defined cases: a null text and a text without a letter are ``und`` with score 0 and are
rejected; equal sums go to the language with more labelled rows and are rejected; if nothing
is labelled every row is ``und``; repeated rows get the same answer; an empty table gives an
empty result; other columns are ignored by ``identify`` and carried by ``accepted``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrasift.llm.common import fold, stage

FOLDS, HELD_OUT = 4, 2
#: Bounds of the fit: labelled rows per language, characters of a row's slice, bytes of a dictionary.
SAMPLE, SLICE, DICTIONARY = 400, 1024, 64 * 1024
LEVEL, MIN_MATCH, PIECE = 6, 3, 2048
#: Relative gap of the two smallest sums below which a text is rejected.
MARGIN = 0.0005
#: Compressible tail of every piece: zstandard stores short pieces raw without it.
TAIL = bytes(256)
SHARPNESS = 100.0
UNKNOWN = "und"

LETTERS = re.compile(r"[^\W\d_]+")


def plain(text: str | None) -> bytes:
    """Lower-case words joined by spaces; empty if no character is a letter."""
    words = LETTERS.findall((text or "").lower())
    if not any(map(str.isalpha, words)) and not any(c.isalpha() for w in words for c in w):
        return b""
    return " ".join(words).encode("utf-8", "surrogatepass")


def sample(labelled: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """(lang, text, rows): slices of a hash sample of ``per_language`` rows for each language.

    Counts come first, so that only about twice the wanted rows are ranked.
    """
    counts = stage(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "lang-counts")
    place = F.xxhash64(F.lit(5), "doc_id", F.length("text"))
    share = F.shiftrightunsigned(F.col("_place"), 11) / F.lit(float(1 << 53))
    drawn = F.pmod(F.xxhash64("_place"), F.greatest(F.length("text") - SLICE, F.lit(0)) + 1)
    near = (
        labelled.withColumn("_place", place).join(counts, "lang")
        .filter(share <= (2.0 * per_language + 50) / F.col("rows"))
        .select("lang", "rows", "_place", F.substring("text", (drawn + 1).cast("int"), F.lit(SLICE)).alias("text"))
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_place", "text"))
    return near.withColumn("_rank", rank).filter(F.col("_rank") <= per_language).select("lang", "rows", "_rank", "text")


def fit(docs: DataFrame, size: int = DICTIONARY, per_language: int = SAMPLE) -> list[tuple[str, bytes]]:
    """(language, dictionary), most labelled rows first; learns from the training folds only."""
    labelled = docs.select("doc_id", "text", "lang").filter(
        (fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    chosen = sample(labelled, per_language).collect()
    texts: dict[tuple[int, str], list[tuple[int, bytes]]] = {}
    for row in chosen:
        texts.setdefault((-row["rows"], row["lang"]), []).append((row["_rank"], plain(row["text"])))
    model = []
    for (_, lang), parts in sorted(texts.items()):
        parts = [p for _, p in sorted(parts) if p]
        if parts:
            model.append((lang, b" ".join(p[: max(1, size // len(parts))] for p in parts)[-size:]))
    return model


class Sizes:
    """Compressed sizes of a text under every dictionary of a model."""

    def __init__(self, model: list[tuple[str, bytes]]):
        how = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, min_match=MIN_MATCH, write_content_size=0, write_dict_id=0, write_checksum=0
        )
        self.languages = [lang for lang, _ in model]
        self.compressors = []
        for _, content in model:
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(compression_params=how)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=shared, compression_params=how))

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, margin, rejected)."""
        words = plain(text)
        if not words or not self.compressors:
            return UNKNOWN, 0.0, 0.0, True
        pieces = [words[i:i + PIECE] + TAIL for i in range(0, len(words), PIECE)]
        sizes = np.array([sum(len(c.compress(p)) for p in pieces) for c in self.compressors], float)
        order = np.argsort(sizes, kind="stable")
        best = sizes[order[0]]
        margin = float((sizes[order[1]] - best) / best) if len(sizes) > 1 else 1.0
        score = 1.0 / float(np.exp(-SHARPNESS * (sizes - best) / best).sum())
        return self.languages[order[0]], score, margin, margin < MARGIN


def identify(docs: DataFrame, model: list[tuple[str, bytes]] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, margin, rejected."""
    model = fit(docs) if model is None else model

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model)
        for batch in batches:
            rows = [sizes.predict(t.as_py()) for t in batch.column("text")]
            columns = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(columns[0], pa.string()),
                 pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "margin", "rejected"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    held = (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    return docs.select("doc_id", held, "text").mapInArrow(
        predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double, margin double, rejected boolean"
    )


def accepted(docs: DataFrame, model: list[tuple[str, bytes]] | None = None) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    model = fit(docs) if model is None else model
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model)
        for batch in batches:
            yield batch.filter(pa.array([not sizes.predict(t.as_py())[3] for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
