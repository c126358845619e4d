"""Report, visit and filter events, in batch and as streams run to completion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.operators import ranking
from terrasift.plans.registry import query
from terrasift.plans.tables import Tables
from terrasift.session import scratch_dir
from terrasift.streaming import events as E

EXTENT = (23.6, 89.8, 24.0, 90.2)
_ROUTE = """CASE WHEN NOT (lat BETWEEN 23.6 AND 24.0 AND lon BETWEEN 89.8 AND 90.2) THEN 'coordinates' WHEN reason IS NULL THEN 'reason' ELSE 'accepted' END"""


def _fresh(t: Tables, name: str) -> str:
    return f"{scratch_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


class _StreamTables(Tables):
    """The same tables with the event source read as a stream."""

    def raw(self, name: str) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.dir}/{name}.parquet").schema
        return self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.dir)


def _stream(t: Tables) -> Tables:
    return _StreamTables(t.spark, t.dir)


@query("report_intake", f"SELECT id, {_ROUTE} AS result FROM reports")
def intake(t: Tables) -> DataFrame:
    return E.route_reports(t.reports(), EXTENT).select("id", "result")


@query("report_intake_stream", f"SELECT id, {_ROUTE} AS result FROM reports")
def intake_stream(t: Tables) -> DataFrame:
    good, bad = _fresh(t, "good"), _fresh(t, "bad")
    E.run_intake(_stream(t).reports(), EXTENT, good, bad, _fresh(t, "cp")).awaitTermination()
    return t.spark.read.parquet(good).unionByName(t.spark.read.parquet(bad)).select("id", "result")


@query("report_rate_limit")
def rate(t: Tables) -> DataFrame:
    return E.rate_limit(t.reports(), window_s=86400).select("id", "session", "allowed")


@query("report_rate_limit_stream")
def rate_stream(t: Tables) -> DataFrame:
    path = _fresh(t, "rate")
    E.run_once(E.rate_limit_stream(_stream(t).reports(), window_s=86400), path, _fresh(t, "cp"))
    return t.spark.read.parquet(path)


_LAG = """SELECT *, lag(status) OVER w AS ps, lag(assignee) OVER w AS pa, row_number() OVER w AS n FROM visits WINDOW w AS (PARTITION BY kiln_id ORDER BY updated_at, seq)"""


@query("visit_changes", f"SELECT seq, kiln_id, status, assignee FROM ({_LAG}) WHERE n = 1 OR status <> ps OR assignee <> pa")
def visit_changes(t: Tables) -> DataFrame:
    return E.changes(t.visits(), ["kiln_id"], ["updated_at", "seq"], ["status", "assignee"]).select("seq", "kiln_id", "status", "assignee")


@query("report_status_audit", "SELECT seq AS id, updated_by AS actor, 'report_status' AS action, kiln_id AS entity_id FROM (SELECT *, lag(status) OVER w AS ps FROM visits WINDOW w AS (PARTITION BY kiln_id ORDER BY updated_at, seq)) WHERE ps IS NULL OR status <> ps")
def status_audit(t: Tables) -> DataFrame:
    real = E.changes(t.visits(), ["kiln_id"], ["updated_at", "seq"], ["status"])
    return E.activity(real, "report_status").select("id", "actor", "action", "entity_id")


@query("note_history", "SELECT kiln_id, seq, row_number() OVER (PARTITION BY kiln_id ORDER BY updated_at, seq) AS pos FROM visits")
def notes(t: Tables) -> DataFrame:
    df = t.visits().select("kiln_id", "seq", "updated_at")
    return ranking.ordinal(df, [F.col("updated_at"), F.col("seq")], ["kiln_id"], "pos").select("kiln_id", "seq", "pos")


_OPS = "SELECT event_id AS seq, user_id AS owner, json_extract_string(props, '$.k')::INT % 5 AS name, ts AS op_at, event_type AS payload, CASE event_type WHEN 'error' THEN 'delete' ELSE 'upsert' END AS op FROM events"


@query("saved_filter_state", f"WITH o AS ({_OPS}), g AS (SELECT owner, name, max(seq) AS gone FROM o WHERE op = 'delete' GROUP BY 1, 2) SELECT owner, name, arg_max(payload, seq) AS payload, min(op_at) AS created_at, max(op_at) AS updated_at FROM o LEFT JOIN g USING (owner, name) WHERE op = 'upsert' AND (gone IS NULL OR seq > gone) GROUP BY 1, 2")
def filters(t: Tables) -> DataFrame:
    ops = t.raw("events").selectExpr(
        "event_id AS seq", "user_id AS owner", "cast(get_json_object(props, '$.k') AS int) % 5 AS name", "ts AS op_at",
        "event_type AS payload", "CASE event_type WHEN 'error' THEN 'delete' ELSE 'upsert' END AS op",
    )
    return E.saved_filters(ops, ["owner", "name"])


_LATEST = "SELECT kiln_id, status, assignee, seq FROM visits QUALIFY row_number() OVER (PARTITION BY kiln_id ORDER BY updated_at DESC, seq DESC) = 1"


@query("latest_visit_per_site", _LATEST)
def latest(t: Tables) -> DataFrame:
    return E.latest(t.visits(), ["kiln_id"], ["updated_at", "seq"]).select("kiln_id", "status", "assignee", "seq")


@query("latest_visit_stream", _LATEST)
def latest_stream(t: Tables) -> DataFrame:
    path = _fresh(t, "latest")
    query_ = E.run_upsert(_stream(t).visits(), ["kiln_id"], ["updated_at", "seq"], path, _fresh(t, "cp"))
    query_.awaitTermination()
    last = max(p["batchId"] for p in query_.recentProgress if p["numInputRows"] > 0)
    return t.spark.read.parquet(f"{path}/v={last}").select("kiln_id", "status", "assignee", "seq")


@query("incremental_append_stream", "SELECT seq, status FROM visits")
def append_stream(t: Tables) -> DataFrame:
    path = _fresh(t, "appended")
    E.run_once(_stream(t).visits().select("seq", "status"), path, _fresh(t, "cp"))
    return t.spark.read.parquet(path)


@query("open_report_count", "SELECT count(*) AS open FROM reports WHERE reason % 3 = 0")
def open_count(t: Tables) -> DataFrame:
    return t.reports().filter("reason % 3 = 0").agg(F.expr("count(1) AS open"))


_VISITS = f"(SELECT v.kiln_id, v.status, s.district FROM ({_LATEST}) v JOIN sites s USING (kiln_id))"


@query("visits_with_sites", f"SELECT kiln_id, status, district FROM {_VISITS}")
def visit_sites(t: Tables) -> DataFrame:
    now = E.latest(t.visits(), ["kiln_id"], ["updated_at", "seq"])
    return now.join(t.sites().select("kiln_id", "district"), "kiln_id").select("kiln_id", "status", "district")


@query("report_inbox", "SELECT id, created_at, district FROM reports r LEFT JOIN sites s ON s.kiln_id = r.session")
def inbox(t: Tables) -> DataFrame:
    newest = t.reports().select("id", "created_at", F.col("session").alias("kiln_id"))
    sited = newest.join(t.sites().select("kiln_id", "district"), "kiln_id", "left").select("id", "created_at", "district")
    return sited.orderBy(F.desc("created_at"), F.desc("id"))


@query("newest_activity", "SELECT seq, updated_by FROM visits ORDER BY updated_at DESC, seq DESC LIMIT 200")
def newest(t: Tables) -> DataFrame:
    return t.visits().orderBy(F.desc("updated_at"), F.desc("seq")).limit(200).select("seq", "updated_by")


@query("visits_filtered_sorted", "SELECT seq, kiln_id FROM visits WHERE assignee = 'amin' AND status = 'planned'")
def visits_sorted(t: Tables) -> DataFrame:
    kept = t.visits().filter("assignee = 'amin' AND status = 'planned'")
    return kept.orderBy(F.desc("updated_at"), "kiln_id", "seq").select("seq", "kiln_id")
