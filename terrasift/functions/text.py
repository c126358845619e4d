"""Name folding and token scores."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that a task holds as Python strings at once.
AT_ONCE = 1 << 20


def _normal_form(column: Column, form: str, casefold: bool = False) -> Column:
    """Unicode normal form, with or without full case folding; Spark has neither built in.

    Texts become Python strings a few at a time, by their bytes: a batch of long texts is held
    as Arrow buffers only.
    """

    def normalise(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            done, start = [pa.array([], pa.string())], 0
            ends = np.cumsum(pc.fill_null(pc.binary_length(part), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            while start < len(part):
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + AT_ONCE, side="right")))
                formed = (None if v is None else unicodedata.normalize(form, v) for v in part.slice(start, stop - start).to_pylist())
                done.append(pa.array([v if v is None or not casefold else v.casefold() for v in formed], pa.string()))
                start = stop
            yield pa.concat_arrays(done)

    normalise.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(normalise, "string")(column)


def fold_name(column: str | Column) -> Column:
    """Lower case without spaces or accents: non-spacing marks go, spacing vowel signs stay."""
    value = F.col(column) if isinstance(column, str) else column
    return F.lower(F.regexp_replace(_normal_form(value, "NFD"), r"[\p{Mn}\s]", ""))


def fold_alphanumeric(column: str | Column) -> Column:
    """Letters and digits of the compatibility form, case folded."""
    value = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(_normal_form(value, "NFKC", casefold=True), r"[^\p{L}\p{N}]", "")


def tokens(column: str) -> str:
    """Distinct lower-case words of two letters or more, as an SQL expression."""
    return f"array_distinct(filter(regexp_extract_all(lower({column}), r'[\\p{{L}}\\p{{N}}_]+', 0), w -> length(w) > 1))"
