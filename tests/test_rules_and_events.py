"""Known answers: signals, severity, bands, leakage, audit statistics, rate limits, streams."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrasift import config
from terrasift.functions.stats import wilson
from terrasift.operators import audit, chips, enrich, ranking, rules, score, spatial
from terrasift.operators import serving
from terrasift.operators.area import radius_area
from terrasift.plans import screening
from terrasift.plans.tables import Tables
from terrasift.sources import chips as source
from terrasift.streaming import events


def _site(spark, **distances):
    names = [r.distance for r in config.RULES]
    row = ("k", "FCBK", 0.9, *[distances.get(n) for n in names])
    return spark.createDataFrame([row], "kiln_id string, class string, confidence double, " + ", ".join(f"{n} double" for n in names))


def test_signals_in_configured_order(spark):
    df = rules.with_signals(_site(spark, dist_railways_m=800.0, dist_schools_m=999.999, dist_water_m=1000.0))
    row = score.with_severity(df).first()
    assert row.breached_rules == ["technology_flagged", "near_school", "near_railway"]
    assert row.breach_count == 3 and row.breach_severity_score == 8.0
    assert row.top_rule_signal == "Near school (1,000 m)"
    assert not row.rules_verified
    assert "government_forest: no readable boundary layer" in row.rule_data_notes


def test_bands_split_40_40_20_even_on_ties(spark):
    for values in (range(10), [1] * 10):
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id int, p double")
        got = {r[0]: r[1] for r in ranking.priority_bands(df, "p", "id").groupBy("priority_band").count().collect()}
        assert got == {"High": 2, "Medium": 4, "Low": 4}


def test_leakage_boundaries(spark):
    def drops(rows):
        df = spark.createDataFrame(rows, "name string, split string, x double, y double")
        return {r[0] for r in chips.leaking(df, "name").collect()}

    assert drops([("a", "train", 0.0, 0.0), ("b", "val", 900.0, 0.0)]) == {"b"}
    assert drops([("a", "train", 0.0, 0.0), ("b", "val", 1500.0, 0.0)]) == set()
    assert drops([("a", "train", 0.0, 0.0), ("b", "test", 1000.0, 1000.0)]) == {"b"}
    assert drops([("a", "train", 0.0, 0.0), ("b", "test", 1500.0, 200.0)]) == set()
    assert drops([("a", "val", 0.0, 0.0), ("b", "test", 1300.0, 0.0)]) == {"a", "b"}


def test_chip_names_and_labels(spark):
    df = spark.createDataFrame([("x/24.1_88.3.png", ["0 a b", "1 c", "2 d"]), ("24,1_88.png", [])], "image_name string, labels array<string>")
    rows = chips.add_cells(chips.parse_names(df)).selectExpr("*", f"{chips.remap_lines()} AS l").collect()
    assert (rows[0].cell_row, rows[0].cell_col) == (96, 353)
    assert rows[0].l == ["0 a b", "0 c", "1 d"]
    assert rows[1].lat is None


def test_malformed_box_line_fails(spark):
    lines = spark.createDataFrame([("s", "0 0 0 1 0 1 1".split())], "scene string, f array<string>")
    with pytest.raises(Exception, match="Malformed"):
        source.parse_boxes(lines, predictions=False).collect()
    assert source.parse_boxes(lines, predictions=False, strict=False).count() == 0


def test_weighted_precision_and_kappa(spark):
    rows = [("low", "TP"), ("mid", "FP"), ("high", "TP")]
    df = spark.createDataFrame(rows, "band string, label string")
    pop = spark.createDataFrame([("low", 1), ("mid", 1), ("high", 2)], "band string, population long")
    assert audit.weighted_precision(df, pop).first().precision == 0.75
    two = spark.createDataFrame([("TP", "TP"), ("TP", "FP"), ("FP", "TP")], "a string, b string")
    row = audit.agreement(two, "a", "b").first()
    assert row.percent_agreement == pytest.approx(1 / 3)
    assert row.cohen_kappa == pytest.approx((1 / 3 - 5 / 9) / (1 - 5 / 9))


def test_wilson(spark):
    low, high = wilson("17", "30")
    row = spark.range(1).selectExpr(f"{low} AS a", f"{high} AS b").first()
    assert (round(row.a, 3), round(row.b, 4)) == (0.392, 0.7262)


def test_bad_labels_fail(spark):
    df = spark.createDataFrame([(" tp",), ("maybe",)], "label string")
    with pytest.raises(Exception, match="Invalid label"):
        audit.normalise_labels(df).collect()


def test_public_view_leaks_nothing(spark):
    df = spark.range(1).selectExpr("id", "1 AS priority", "2 AS dist_x_m", "3 AS n_schools_normalized", "4 AS district", "5 AS confidence")
    assert serving.public_view(df).columns == ["id", "district"]


def _reports(spark):
    rng = random.Random(5)
    rows, start = [], dt.datetime(2024, 1, 1)
    for i in range(400):
        who = 1 if i < 200 else rng.randint(2, 6)
        rows.append((i, who, start + dt.timedelta(seconds=rng.randint(0, 60000))))
    return rows, spark.createDataFrame(rows, "id long, session long, created_at timestamp")


def _allowed(rows):
    kept, out = {}, {}
    for i, who, at in sorted(rows, key=lambda r: (r[2], r[0])):
        recent = [t for t in kept.get(who, []) if (at - t).total_seconds() < 3600]
        out[i] = len(recent) < 3
        kept[who] = recent + ([at] if out[i] else [])
    return out


def test_rate_limit_batch_matches_loop(spark):
    rows, df = _reports(spark)
    got = {r.id: r.allowed for r in events.rate_limit(df).collect()}
    assert got == _allowed(rows)


def test_rate_limit_stream_matches_loop(spark, tmp_path):
    rows, df = _reports(spark)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    events.run_once(events.rate_limit_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r.id: r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == _allowed(rows)


def test_rate_limit_keeps_rows_without_session_time_or_id(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, None, start + dt.timedelta(minutes=i)) for i in range(5)] + [(None, 1, start), (None, 1, start), (7, 1, None), (8, None, None)]
    df = spark.createDataFrame(rows, "id long, session long, created_at timestamp")
    want = sorted(
        [(i, None, i < 3) for i in range(5)] + [(None, 1, True)] * 2 + [(7, 1, False), (8, None, False)], key=str
    )
    got = events.rate_limit(df).select("id", "session", "allowed").collect()
    assert sorted(map(tuple, got), key=str) == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    events.run_once(events.rate_limit_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).select("id", "session", "allowed").collect()
    assert sorted(map(tuple, got), key=str) == want


def test_layers_without_a_boundary_are_counted(spark):
    features = spark.createDataFrame([("a", "water"), ("b", "water"), ("b", "water"), (None, "water")], "district string, layer string")
    boundaries = spark.createDataFrame([("a", 90.0, 23.0, 90.1, 23.1)], "shapeName string, west double, south double, east double, north double")
    got = {(r.district, r.n, r.per_km2 is None) for r in enrich.layer_completeness(features, boundaries).collect()}
    assert got == {("a", 1, False), ("b", 2, True), (None, 1, True)}


def test_sensitivity_covers_radii_and_weights(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    sites = t.sites_xy().select("kiln_id", "x", "y").join(screening.signals(t).select("kiln_id", "confidence", "breach_severity_score"), "kiln_id").toPandas()
    mapped = t.features_xy().select("layer", "x", "y").toPandas()
    want, base = {}, None
    for radius in (500.0, 2000.0):
        area = radius_area(t.sites_xy(), t.settlement_polygons(), "kiln_id", radius, "a").select("kiln_id", "a").toPandas().set_index("kiln_id").a
        raw = {"settlement_area": sites.kiln_id.map(area)}
        for layer in ("schools", "hospitals"):
            f = mapped[mapped.layer == layer]
            near = (sites.x.to_numpy()[:, None] - f.x.to_numpy()) ** 2 + (sites.y.to_numpy()[:, None] - f.y.to_numpy()) ** 2 <= radius**2
            raw[f"n_{layer}"] = pd.Series(near.sum(axis=1))
        norm = {c: v.rank(pct=True).where(v != 0, 0.0) for c, v in raw.items()}
        for name in ("baseline", *(f"{c}_doubled" for c in score.COMPONENTS)):
            expo = sum((2.0 if name == f"{c}_doubled" else 1.0) * norm[c] for c in score.COMPONENTS)
            ranked = sites.assign(p=(sites.confidence * sites.breach_severity_score * (1 + expo)).round(9)).sort_values(["p", "kiln_id"], ascending=[False, True])
            top = list(ranked.kiln_id[:20])
            base = base or top
            both = [k for k in base if k in top]
            rho = pd.Series([base.index(k) for k in both]).rank().corr(pd.Series([top.index(k) for k in both]).rank())
            want[radius, name] = (len(both), rho)
    got = {(r.radius_m, r.weights): (r.top20_overlap, r.spearman_rho) for r in screening.sensitivity_grid(t, (500.0, 2000.0)).collect()}
    assert got.keys() == want.keys() and len(config.SCORING.sensitivity_radii_m) == 5
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-6) for k in want)


def test_hull_matches_square(spark):
    rows = [("a", float(x), float(y)) for x in range(0, 1001, 50) for y in range(0, 1001, 50)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    assert serving.hull_km2(df, "g").first().hull_km2 == pytest.approx(1.0)


def test_route_segments_share_ends(spark):
    df = spark.createDataFrame([("d", i, 1.0 * i, 2.0) for i in range(11)], "district string, id int, lat double, lon double")
    got = sorted((r.first_stop, r.last_stop) for r in serving.route_segments(df, "district", "id").collect())
    assert got == [(1, 5), (5, 9), (9, 11)]


def test_weighted_ordinal_and_previous(spark):
    df = spark.createDataFrame([(i, i % 3, i * 7 % 11) for i in range(60)], "id int, g int, v int")
    rows = ranking.ordinal(df, [F.col("v"), F.col("id")], ["g"]).collect()
    for g in range(3):
        mine = sorted((r.v, r.id, r.ordinal) for r in rows if r.g == g)
        assert [m[2] for m in mine] == list(range(1, len(mine) + 1))
    prior = {r.id: r.prev_id for r in ranking.previous_row(df, ["g"], [F.col("v"), F.col("id")], ["id"]).collect()}
    assert sum(p is None for p in prior.values()) == 3


def test_sites_inside_polygons_are_not_searched(spark, monkeypatch):
    def square(x, y, h):
        return [[(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)]]

    woods = spark.createDataFrame(
        [("wood", "*", i, square(x, 0.0, 10.0)) for i, x in ((3, 0.0), (2, 5.0), (7, 100.0))],
        "layer string, scope string, feature_id int, rings array<array<struct<x double, y double>>>",
    )
    edges = spatial.polygon_edges(woods, ["layer", "scope", "feature_id"])
    sites = spark.createDataFrame([(1, "a", 1.0, 1.0), (2, "a", 80.0, 0.0), (3, "a", -9.0, 2.0), (4, "a", None, 0.0)], "id int, district string, x double, y double")
    asked, search = [], spatial.nearest_best

    def watched(left, *args, **kwargs):
        asked.extend(r.id for r in left.collect())
        return search(left, *args, **kwargs)

    monkeypatch.setattr(spatial, "nearest_best", watched)
    out = rules.nearest_by_layer(sites, edges, "id", ["wood"], polygons=woods, global_layers=["wood"]).collect()
    got = {r.id: (r.dist_wood_m, r.dist_wood_m_feature and r.dist_wood_m_feature.feature_id) for r in out}
    assert got == {1: (0.0, 2), 2: (10.0, 7), 3: (0.0, 3), 4: (None, None)}
    assert sorted(asked) == [2, 4]
