"""Explicit schemas and required-column checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

CHIPS = T.StructType([
    T.StructField("image_name", T.StringType()),
    T.StructField("image", T.BinaryType()),
    T.StructField("dota_label", T.ArrayType(T.StringType())),
    T.StructField("yolo_aa_label", T.ArrayType(T.StringType())),
    T.StructField("yolo_obb_label", T.ArrayType(T.StringType())),
])

AUDIT_SHEET = T.StructType([
    T.StructField("kiln_id", T.StringType()),
    T.StructField("district", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("kiln_class", T.StringType()),
])

AUDIT_KEY = T.StructType([
    T.StructField("kiln_id", T.StringType()),
    T.StructField("district", T.StringType()),
    T.StructField("model_confidence", T.DoubleType()),
    T.StructField("band", T.StringType()),
    T.StructField("tercile_within_district", T.StringType()),
    T.StructField("predicted_class", T.StringType()),
    T.StructField("is_overlap", T.StringType()),
    T.StructField("assigned_sheet", T.StringType()),
])

REFERENCE_COUNTS = T.StructType([
    T.StructField("district", T.StringType()),
    T.StructField("reported_count", T.LongType()),
])

CLOSURES = T.StructType([
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("closure_year", T.StringType()),
])

REPORTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("session", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("kind", T.StringType()),
    T.StructField("kiln_id", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("reason", T.StringType()),
    T.StructField("note", T.StringType()),
])


class MissingColumns(ValueError):
    """A table lacks columns an operator needs."""


def require_columns(df: DataFrame, names: Iterable[str], table: str = "table") -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise MissingColumns(f"{table} is missing required columns: {missing}")
    return df
