"""Audit sampling, sheets, and agreement and precision statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.functions.stats import wilson
from terrasift.operators import ranking
from terrasift.schemas import require_columns

# Labels, bands, cut-offs.
LABELS = ("TP", "FP", "SKIP")
BANDS = ("low", "mid", "high")
THRESHOLDS = (0.30, 0.35, 0.40, 0.45, 0.50)
MIN_CLASS_SAMPLE = 10


def band_of(column: str) -> str:
    return f"CASE WHEN {column} < 0.25 THEN 'low' WHEN {column} < 0.45 THEN 'mid' ELSE 'high' END"


def normalise_labels(df: DataFrame, column: str = "label") -> DataFrame:
    """Upper-case trimmed labels; a blank or unknown label fails the job."""
    fixed = f"upper(trim({column}))"
    listed = ", ".join(f"'{v}'" for v in LABELS)
    checked = (
        f"CASE WHEN coalesce({fixed}, '') = '' THEN raise_error('Blank label') "
        f"WHEN {fixed} NOT IN ({listed}) THEN raise_error(concat('Invalid label: ', {fixed})) ELSE {fixed} END"
    )
    return df.withColumn(column, F.expr(checked))


def guard_unique(df: DataFrame, keys: Sequence[str], table: str) -> DataFrame:
    """The table itself; a repeated key fails the job when it is read."""
    bad = df.groupBy(*keys).count().filter("count > 1").limit(1).agg(F.expr("count(1) AS n")).scalar()
    return df.withColumn("_bad", bad).filter(
        F.expr(f"CASE WHEN _bad > 0 THEN raise_error('{table} contains duplicate keys') ELSE true END")
    ).drop("_bad")


def join_key(responses: DataFrame, key: DataFrame, on: Sequence[str], probe: str) -> DataFrame:
    """Many-to-one join in which every response must find its key row."""
    joined = responses.join(guard_unique(key, on, "audit key"), list(on), "left")
    return joined.filter(
        F.expr(f"CASE WHEN {probe} IS NULL THEN raise_error('A label row has no matching key entry') ELSE true END")
    )


def reconcile(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """One-to-one join; a key missing on either side or repeated fails the job."""
    a = guard_unique(left, on, "left").withColumn("_l", F.lit(True))
    b = guard_unique(right, on, "right").withColumn("_r", F.lit(True))
    joined = a.join(b, list(on), "full_outer")
    return joined.filter(
        F.expr("CASE WHEN _l IS NULL OR _r IS NULL THEN raise_error('Keys do not match on both sides') ELSE true END")
    ).drop("_l", "_r")


def key_differences(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys found on one side only."""
    a, b = left.select(*on).distinct(), right.select(*on).distinct()
    only_left = a.join(b, list(on), "left_anti").withColumn("side", F.lit("left"))
    return only_left.unionByName(b.join(a, list(on), "left_anti").withColumn("side", F.lit("right")))


def precision(df: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """TP / (TP + FP) with its 95 % interval; SKIP is counted but left out. Null when empty."""
    counts = df.groupBy(*by).agg(
        F.expr(f"count_if({label} IN ('TP', 'FP')) AS n"), F.expr(f"count_if({label} = 'TP') AS tp"),
        F.expr(f"count_if({label} = 'FP') AS fp"), F.expr(f"count_if({label} = 'SKIP') AS skip"),
    )
    low, high = wilson("tp", "n")
    return counts.selectExpr(
        "*", "try_divide(tp, n) AS precision",
        f"CASE WHEN n > 0 THEN {low} END AS ci_95_lower", f"CASE WHEN n > 0 THEN {high} END AS ci_95_upper",
    )


def precision_by_tercile(df: DataFrame, tercile: str = "tercile", label: str = "label") -> DataFrame:
    """Overall and per tercile in one pass; an empty sample has precision 0."""
    valid = df.filter(f"{label} IN ('TP', 'FP')")
    counts = valid.rollup(tercile).agg(
        F.expr("count(1) AS n"), F.expr(f"count_if({label} = 'TP') AS tp"), F.expr(f"grouping({tercile}) AS g")
    )
    low, high = wilson("tp", "n")
    return counts.selectExpr(
        f"CASE WHEN g = 1 THEN 'overall' ELSE {tercile} END AS {tercile}", "n", "tp",
        "round(coalesce(try_divide(tp, n), 0D), 4) AS precision", f"round({low}, 4) AS ci_lower", f"round({high}, 4) AS ci_upper",
    )


def weighted_precision(df: DataFrame, population: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Band precisions weighted by band population; null when a populated band is empty."""
    keys = [*by, "band"]
    bands = df.groupBy(*keys).agg(
        F.expr(f"count_if({label} = 'TP') AS tp"), F.expr(f"count_if({label} IN ('TP', 'FP')) AS n")
    )
    joined = population.join(bands, keys, "left")
    return joined.groupBy(*by).agg(
        F.expr("sum(population) AS population"),
        F.expr("count_if(population > 0 AND coalesce(n, 0) = 0) AS _holes"),
        F.expr("sum(population * try_divide(tp, n)) AS _hit"),
    ).selectExpr(*by, "population", "CASE WHEN _holes = 0 THEN _hit / population END AS precision")


def bootstrap_interval(
    df: DataFrame, population: DataFrame, reps: int = 5000, seed: int = 42, label: str = "label"
) -> DataFrame:
    """95 % interval of the weighted precision over stratified resamples.

    A resample of ``n`` labels of a band with ``tp`` hits is a binomial draw, so a replicate
    needs one number per band, by inversion of a hashed uniform, instead of ``n`` draws.
    """
    bands = df.filter(f"{label} IN ('TP', 'FP')").groupBy("band").agg(
        F.expr(f"count_if({label} = 'TP') AS tp"), F.expr("count(1) AS n")
    ).join(population, "band")
    total = population.agg(F.expr("sum(population) AS t")).scalar()
    draws = bands.withColumn("total", total).selectExpr("*", f"explode(sequence(1, {reps})) AS rep").selectExpr(
        "rep", "band", "n", "population / total AS w", "tp / n AS p",
        f"(pmod(xxhash64({seed}, rep, band), 1000000007L) + 0.5D) / 1000000007D AS u",
    )
    resampled = draws.withColumn("k", _binomial("n", "p", "u"))
    return resampled.groupBy("rep").agg(F.expr("sum(w * k / n) AS estimate")).selectExpr(
        "percentile(estimate, array(0.025D, 0.975D)) AS q"
    ).selectExpr("q[0] AS ci_95_lower", "q[1] AS ci_95_upper")


def _binomial(n: str, p: str, u: str) -> Column:
    @F.pandas_udf("double")
    def draw(n: pd.Series, p: pd.Series, u: pd.Series) -> pd.Series:
        out = np.zeros(len(n))
        for (size, prob), rows in pd.DataFrame({"n": n, "p": p}).groupby(["n", "p"]).groups.items():
            idx = n.index.get_indexer(rows)
            if prob <= 0 or prob >= 1:
                out[idx] = size * prob
                continue
            k = np.arange(int(size) + 1)
            logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, int(size) + 1)))])
            mass = np.exp(logs[-1] - logs - logs[::-1] + k * np.log(prob) + (size - k) * np.log1p(-prob))
            out[idx] = np.searchsorted(np.cumsum(mass), u.to_numpy()[idx] * mass.sum())
        return pd.Series(out)

    return draw(n, p, u)


def agreement(df: DataFrame, first: str, second: str) -> DataFrame:
    """Percent agreement and Cohen's kappa (SKIP is a category); kappa is 1 when chance is 1."""
    pairs = df.groupBy(first, second).agg(F.expr("count(1) AS c"))
    # At most one row per pair of labels from here on.
    a = pairs.groupBy(first).agg(F.expr("sum(c) AS ca")).withColumnRenamed(first, "l")
    b = pairs.groupBy(second).agg(F.expr("sum(c) AS cb")).withColumnRenamed(second, "l")
    total = pairs.agg(F.expr("sum(c)").alias("n")).scalar()
    chance = a.join(b, "l").agg(F.expr("sum(ca * cb) AS s")).scalar()
    agreed = pairs.agg(F.expr(f"sum(c) FILTER (WHERE {first} = {second})").alias("s"))
    return agreed.withColumns({"n": total, "_c": chance}).selectExpr(
        "n", "coalesce(s, 0) / n AS percent_agreement", "coalesce(_c, 0) / (cast(n AS double) * n) AS _e"
    ).selectExpr(
        "n", "percent_agreement", "CASE WHEN _e = 1 THEN 1D ELSE (percent_agreement - _e) / (1 - _e) END AS cohen_kappa"
    )


def two_rater_pivot(responses: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row per item with the first label of sheets A and B."""
    require_columns(responses, [*on, "sheet", "label"], "responses")
    return responses.groupBy(*on).pivot("sheet", ["A", "B"]).agg(F.first("label"))


def class_precision(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Precision per human class, withheld for samples under ten."""
    stats = precision(df.filter("label <> 'SKIP'"), by)
    small = f"n < {MIN_CLASS_SAMPLE}"
    return stats.selectExpr(
        *by, "n", "tp", "fp",
        *[f"CASE WHEN NOT ({small}) THEN {c} END AS {c}" for c in ("precision", "ci_95_lower", "ci_95_upper")],
        f"CASE WHEN {small} THEN 'sample too small' END AS note",
    )


def cutoff_sweep(df: DataFrame, by: Sequence[str] = (), thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Precision of what each confidence cutoff keeps."""
    listed = ", ".join(f"{t!r}D" for t in thresholds)
    kept = df.selectExpr("*", f"explode(filter(array({listed}), c -> confidence >= c)) AS cutoff")
    return precision(kept, [*by, "cutoff"])


def allocate(df: DataFrame, strata: Sequence[str], count: int) -> DataFrame:
    """Largest-remainder allocation of ``count`` over strata (one row per stratum)."""
    sizes = df.groupBy(*strata).agg(F.expr("count(1) AS size"))
    total = df.agg(F.expr("count(1) AS n")).scalar()
    raw = sizes.withColumn("_n", total).selectExpr(
        *strata, "size", f"floor({count} * size / _n) AS base", f"{count} * size / _n - floor({count} * size / _n) AS rest"
    )
    left = raw.agg(F.expr(f"{count} - sum(base) AS r")).scalar()
    order = [F.expr("-rest"), *[F.col(s) for s in strata]]
    return ranking.ordinal(raw, order, name="_pos").withColumn("_left", left).selectExpr(
        *strata, "size", "base + CASE WHEN _pos <= _left THEN 1 ELSE 0 END AS allocated"
    )


def sample_strata(df: DataFrame, key: str, strata: Sequence[str], targets: DataFrame, seed: int = 42) -> DataFrame:
    """Take each stratum's target in shuffled order (everything when short)."""
    placed = ranking.ordinal(df, [ranking.sample_order(F.col(key), seed), F.col(key)], strata, "_pick")
    return placed.join(targets, list(strata)).filter("_pick <= target").select(*df.columns)


def shortfall(df: DataFrame, strata: Sequence[str], targets: DataFrame) -> DataFrame:
    sizes = df.groupBy(*strata).agg(F.expr("count(1) AS available"))
    return targets.join(sizes, list(strata), "left").selectExpr(
        *strata, "target AS requested", "least(target, coalesce(available, 0)) AS sampled",
        "target - least(target, coalesce(available, 0)) AS shortfall",
    )


def assign_sheets(df: DataFrame, key: str, overlap: str, seed: int = 42) -> DataFrame:
    """A+B for overlap rows; the others are halved in shuffled order."""
    mix = ranking.sample_order(F.col(key), seed)
    placed = ranking.ordinal(df, [mix, F.col(key)], [overlap], "_pos")
    n = df.groupBy(overlap).agg(F.expr("count(1) AS _n"))
    return placed.join(n, overlap).selectExpr(
        *df.columns, f"CASE WHEN {overlap} THEN 'A+B' WHEN _pos <= floor(_n / 2) THEN 'A' ELSE 'B' END AS assigned_sheet"
    )


def count_comparison(detected: DataFrame, reported: DataFrame, by: str = "district") -> DataFrame:
    """Detected against reported counts; the ratio is null when nothing was reported."""
    found = detected.groupBy(by).agg(F.expr("count(1) AS detected"))
    return found.join(reported, by, "full_outer").selectExpr(
        by, "coalesce(detected, 0) AS detected", "coalesce(reported_count, 0) AS reported",
        "round(try_divide(coalesce(detected, 0), nullif(coalesce(reported_count, 0), 0)), 4) AS ratio",
    )


def population_table(lines: DataFrame, districts: Sequence[str], column: str = "value") -> DataFrame:
    """District, band and population from the rows of a Markdown table."""
    cells = f"transform(split(trim(BOTH '|' FROM trim({column})), '[|]'), c -> trim(c))"
    listed = ", ".join(f"'{d}'" for d in districts)
    bands = ", ".join(f"'{b}'" for b in BANDS)
    return lines.selectExpr(f"{cells} AS c").filter(f"size(c) >= 6 AND c[0] IN ({listed}) AND c[1] IN ({bands})").selectExpr(
        "c[0] AS district", "c[1] AS band", "try_cast(c[2] AS bigint) AS population"
    ).filter("population IS NOT NULL")
