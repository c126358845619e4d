"""Chip tables: split scans, label text, dataset sink and reports."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from terrasift.operators.chips import SPLITS, remap_lines
from terrasift.schemas import CHIPS


def read_splits(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """Column-pruned scan of the split files; a missing split is skipped."""
    out = None
    for split in SPLITS:
        path = os.path.join(folder, f"{split}.parquet")
        try:
            part = spark.read.schema(CHIPS).parquet(path).select(*columns, F.lit(split).alias("split"))
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            continue
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise FileNotFoundError(f"No split files in {folder}")
    return out


def write_dataset(df: DataFrame, path: str, labels: str = "labels") -> None:
    """Chips with remapped label text, one folder per split."""
    text = f"concat(array_join({remap_lines(labels)}, '\\n'), CASE WHEN size({labels}) > 0 THEN '\\n' ELSE '' END) AS label_text"
    keep = [c for c in df.columns if c != labels]
    df.selectExpr(*keep, text).write.mode("overwrite").partitionBy("split").parquet(path)


def read_boxes(spark: SparkSession, path: str, predictions: bool, strict: bool = True) -> DataFrame:
    """Oriented-box text files: class, eight coordinates and, for predictions, confidence.

    ``strict`` raises on a malformed line; otherwise lines of under nine fields are ignored.
    """
    lines = spark.read.text(path).selectExpr(
        "regexp_extract(input_file_name(), '([^/]+)\\\\.txt$', 1) AS scene", "split(trim(value), '\\\\s+') AS f"
    ).filter("size(f) > 1 OR f[0] <> ''")
    return parse_boxes(lines, predictions, strict)


def parse_boxes(lines: DataFrame, predictions: bool, strict: bool = True) -> DataFrame:
    """Split fields ``f`` into ``class_id, xy[, conf]``."""
    wanted = 10 if predictions else 9
    numbers = "transform(slice(f, 2, 8), v -> try_cast(v AS double))"
    parsed = lines.filter("size(f) >= 9").selectExpr("*", f"{numbers} AS xy", "try_cast(f[0] AS int) AS class_id") if not strict else lines.selectExpr("*", f"{numbers} AS xy", "try_cast(f[0] AS int) AS class_id")
    area = (
        "abs(aggregate(sequence(0, 3), 0D, (acc, i) -> acc + xy[2 * i] * xy[(2 * i + 3) % 8] - xy[(2 * i + 2) % 8] * xy[2 * i + 1])) / 2"
    )
    good = (
        f"size(f) = {wanted} AND class_id IS NOT NULL AND size(xy) = 8 AND "
        f"forall(xy, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity')) AND {area} > 0"
    )
    if strict:
        parsed = parsed.selectExpr(
            *lines.columns, "class_id",
            f"CASE WHEN coalesce({good}, false) THEN xy ELSE raise_error(concat('Malformed box line: ', array_join(f, ' '))) END AS xy",
        )
    conf = ["try_cast(f[9] AS double) AS conf"] if predictions else []
    return parsed.selectExpr(*[c for c in lines.columns if c != "f"], "class_id", "xy", *conf)
