"""Nulls, quotes, unnamed classes and whole texts."""

import pytest
from pyspark.sql import functions as F

from terrasift.functions import text
from terrasift.operators import chips, enrich, ranking, rules, serving, spatial
from terrasift.session import scratch_dir
from terrasift.streaming import events


def test_ordinal_keeps_null_groups_and_values(spark):
    rows = [(i, None if i % 4 == 0 else i % 3, None if i % 5 == 0 else float(i % 7)) for i in range(60)] + [(60, 1, float("nan"))]
    df = spark.createDataFrame(rows, "id long, grp long, v double")
    got = ranking.ordinal(df, [F.col("v"), F.col("id")], ["grp"], "pos").collect()
    assert len(got) == len(rows)
    by = {}
    for r in sorted(got, key=lambda r: r.pos):
        by.setdefault(r.grp, []).append(r)
    for members in by.values():
        assert [r.pos for r in members] == list(range(1, len(members) + 1))
        keys = [(r.v is not None, float("inf") if r.v is not None and r.v != r.v else (r.v or 0.0), r.id) for r in members]
        assert keys == sorted(keys)


def test_previous_row_of_null_group(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), ("k", 1, "c")], "grp string, seq int, v string")
    got = {(r.grp, r.seq): r.prev_v for r in ranking.previous_row(df, ["grp"], [F.col("seq")], ["v"]).collect()}
    assert got == {(None, 1): None, (None, 2): "a", ("k", 1): None}


def test_unchanged_all_null_state_is_no_change(spark):
    df = spark.createDataFrame([("k", 1, None), ("k", 2, None), ("k", 3, "x")], "k string, seq int, status string")
    assert [r.seq for r in events.changes(df, ["k"], ["seq"], ["status"]).orderBy("seq").collect()] == [1, 3]


def test_unnamed_classes_are_counted(spark):
    line = "1 " + " ".join(["0.5"] * 8)
    df = spark.createDataFrame([("train", [line, "7 " + line[2:]]), ("val", [])], "split string, labels array<string>")
    counts = {r.split: r.asDict() for r in chips.class_counts(df).collect()}
    assert counts["train"]["unknown"] == 1 and counts["val"]["unknown"] == 0


def test_names_fold_by_normal_form(spark):
    df = spark.createDataFrame([("Łódź Név",), ("রাজশাহী",), ("রজশহ",), (None,)], "name string")
    got = [r.f for r in df.select(text.fold_name("name").alias("f")).collect()]
    assert got[0] == "łodznev" and got[1] != got[2] and got[3] is None
    wide = spark.createDataFrame([("ＡＢ-１２ ﬁ",)], "name string").select(text.fold_alphanumeric("name").alias("f")).first().f
    assert wide == "ab12fi"


def test_quotes_in_names(spark):
    df = spark.createDataFrame([("Cox's Bazar", "Teknaf", 20.9, 92.3), ("Dhaka", "Savar", 23.8, 90.2)], "district string, upazila string, lat double, lon double")
    assert serving.example_origin(df, "Cox's Bazar", "Teknaf").first().district == "Cox's Bazar"


def test_far_rows_open_few_boxes(spark):
    features = spark.range(4000).select(F.rand(1).alias("x"), F.rand(2).alias("y")).selectExpr("x * 1000 AS x", "y * 1000 AS y")
    points, fields = spatial._searched(features, [], "point", [])
    grid = spatial.Grid(points, [], spatial.plan_sizes(points, [], None, 32), fields)
    far = spark.createDataFrame([(5e4, 5e4)], "_px double, _py double")
    leaves = spatial._descend(far, grid, None, 0.0, "euclidean")
    assert 1 <= leaves.count() <= 64


def test_cluster_session_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError):
        scratch_dir(Session())


def test_review_state_keeps_the_other_keys(spark):
    stored = '[{"signal_id":"a","review_state": "unverified_candidate","reviewer":"X","other":5}]'
    df = spark.createDataFrame([(stored, ["z"]), (None, ["q"])], "j string, s array<string>")
    got = df.select(rules.parse_provenance(F.col("j"), F.col("s")).alias("p"), rules.review_states_today(F.col("j")).alias("t")).collect()
    assert got[0].t == stored.replace("unverified", "unscreened")
    assert (got[0].p[0].reviewer, got[0].p[0].review_state) == ("X", "unscreened_candidate")
    assert (got[1].p[0].signal_id, got[1].p[0].review_notes) == ("q", "not recorded")


def test_late_and_repeated_reports_in_several_batches(spark, tmp_path):
    source, extent = str(tmp_path / "in"), (20.0, 80.0, 27.0, 93.0)
    batches = [[(1, "12:00:00"), (2, "12:10:00")], [(3, "12:20:00"), (1, "12:00:00")], [(4, "09:00:00"), (5, "25:00:00")]]
    for rows in batches:
        values = [(i, f"2024-05-01 {t}" if t < "24" else None, 23.0, 90.0, "smoke" if i != 2 else "", "x") for i, t in rows]
        schema = "id long, created_at string, lat double, lon double, kind string, reason string"
        spark.createDataFrame(values, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        events.run_intake(stream, extent, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "mark")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "good")).collect()) == [1, 3, 4, 5]
    assert [r.id for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [2]


def test_text_match_reads_letters_and_digits(spark):
    asked = spark.createDataFrame([(1, "Élan of the river, 12"), (2, "p {L} N"), (3, None)], "id long, text string")
    cands = spark.createDataFrame([(7, "élan river 12"), (8, "other words")], "cand long, text string")
    got = {r.id: (r.cand, r.score) for r in enrich.best_text_match(asked, cands).collect()}
    assert got == {1: (7, 2 * 3 / (5 + 3)), 2: (None, None), 3: (None, None)}


def test_negative_points_come_back_where_sites_leave_no_room(spark):
    ring = [[(90.0, 23.7), (90.1, 23.7), (90.1, 23.8), (90.0, 23.8)]]
    polygon = spark.createDataFrame([("a", ring)], "name string, rings array<array<struct<x double, y double>>>")
    sites = spark.createDataFrame([(505_000.0, 2_627_000.0)], "x double, y double")
    assert enrich.negative_points(spark, polygon, (90.0, 23.7, 90.1, 23.8), sites, 1, 50_000.0).count() == 0
