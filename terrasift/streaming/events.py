"""Report, visit and filter events: batch functions and the streams that run them.

The same column logic serves both sides; streams add state only where an answer depends on
what came before.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terrasift.operators import ranking

# Accepted reports per session and sliding window.
RATE_LIMIT = 3
RATE_WINDOW_S = 3600


def route_reports(df: DataFrame, extent: Sequence[float]) -> DataFrame:
    """Add ``result``: ``accepted`` or what is wrong; ``status`` starts as ``new``."""
    south, west, north, east = extent
    inside = f"lat BETWEEN {south}D AND {north}D AND lon BETWEEN {west}D AND {east}D"
    return df.selectExpr(
        "*",
        f"CASE WHEN NOT coalesce({inside}, false) THEN 'coordinates' WHEN coalesce(trim(kind), '') = '' THEN 'kind' "
        "WHEN reason IS NULL THEN 'reason' ELSE 'accepted' END AS result",
        "'new' AS status",
    )


def rate_limit(df: DataFrame, session: str = "session", at: str = "created_at", key: str = "id",
               limit: int = RATE_LIMIT, window_s: int = RATE_WINDOW_S) -> DataFrame:
    """Add ``allowed``: fewer than ``limit`` accepted reports in the ``window_s`` before.

    Refused reports do not count. A pause of a whole window forgets everything, so a
    session is cut into bursts at such pauses and each burst is read in time order as a
    stream of batches holding only its last accepted times. Pauses are found on one row per
    session and window-long slot, not on the events.

    Every row comes back once, whatever its id. Reports without a session share one; a report
    without a time fits no window, so it is refused and does not count.
    """
    timed = df.withColumns({"_at": F.expr(f"unix_micros(cast({at} AS timestamp))"), "_slot": F.expr(f"floor(unix_micros(cast({at} AS timestamp)) / {window_s * 1000000})")})
    placed = timed.filter("_at IS NOT NULL")
    slots = placed.groupBy(session, "_slot").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    before = ranking.previous_row(slots, [session], [F.col("_slot")], ["_last"])
    starts = before.withColumn(
        "_cut", F.expr(f"CASE WHEN prev__last IS NULL OR _first - prev__last >= {window_s * 1000000} THEN 1 ELSE 0 END")
    )
    bursts = ranking.ordinal(starts, [F.col("_slot")], [session], "_burst", weight="_cut").select(session, "_slot", "_burst")
    parted = ranking._same_group(placed, bursts, [session, "_slot"]).drop("_slot")
    ordered = parted.repartition(session, "_burst").sortWithinPartitions(session, "_burst", "_at", key)
    flagged = ordered.withColumn("allowed", F.lit(True))
    flags = flagged.mapInArrow(_sliding(session, limit, window_s * 1000000), flagged.schema).select(*df.columns, "allowed")
    return flags.unionByName(timed.filter("_at IS NULL").select(*df.columns, F.lit(False).alias("allowed")))


def _sliding(session: str, limit: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kept = None, []
        for batch in batches:
            allowed = []
            for who, burst, now in zip(*(batch.column(c).to_pylist() for c in (session, "_burst", "_at"))):
                if (who, burst) != current:
                    current, kept = (who, burst), []
                kept = [t for t in kept if now - t < window]
                allowed.append(len(kept) < limit)
                if allowed[-1]:
                    kept.append(now)
            yield batch.set_column(batch.schema.get_field_index("allowed"), "allowed", pa.array(allowed, pa.bool_()))

    return run


def rate_limit_stream(df: DataFrame, limit: int = RATE_LIMIT, window_s: int = RATE_WINDOW_S) -> DataFrame:
    """Streaming twin: the accepted times of a session are its whole state; the same defined cases."""
    span = window_s * 1000000

    def step(key, batches, state: GroupState):
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        allowed = []
        for now in rows["at"]:
            if pd.isna(now):
                allowed.append(False)
                continue
            kept = [t for t in kept if now - t < span]
            allowed.append(len(kept) < limit)
            if allowed[-1]:
                kept.append(int(now))
        state.update((kept,))
        yield pd.DataFrame({"id": rows["id"], "session": rows["session"], "allowed": allowed})

    slim = df.selectExpr("id", "session", "unix_micros(cast(created_at AS timestamp)) AS at")
    return slim.groupBy("session").applyInPandasWithState(
        step, "id long, session long, allowed boolean", "kept array<long>", "append", GroupStateTimeout.NoTimeout
    )


def changes(df: DataFrame, by: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Updates that really change something: the first per key, or any field differing."""
    # A mark tells an earlier row whose fields are all null from no earlier row.
    marked = df.withColumn("_earlier", F.lit(True))
    prior = ranking.previous_row(marked, list(by), [F.col(c) for c in order], [*fields, "_earlier"])
    same = " AND ".join(f"{c} <=> prev_{c}" for c in fields)
    return prior.filter(f"NOT ({same} AND prev__earlier IS NOT NULL)").drop("_earlier", "prev__earlier")


def activity(df: DataFrame, action: str) -> DataFrame:
    """Audit rows for real changes."""
    return df.selectExpr("seq AS id", "updated_by AS actor", f"'{action}' AS action", "kiln_id AS entity_id", "updated_at AS created_at")


def latest(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Current row per key."""
    rest = [c for c in df.columns if c not in by]
    top = df.groupBy(*by).agg(F.expr(f"max_by(struct({', '.join(rest)}), struct({', '.join(order)})) AS _v"))
    return top.selectExpr(*by, *[f"_v.{c} AS {c}" for c in rest])


def saved_filters(ops: DataFrame, by: Sequence[str]) -> DataFrame:
    """State after upserts and deletes: latest payload, creation time since the last delete."""
    dropped = ops.filter("op = 'delete'").groupBy(*by).agg(F.expr("max(seq) AS _gone"))
    alive = ops.filter("op = 'upsert'").join(dropped, list(by), "left").filter("_gone IS NULL OR seq > _gone")
    return alive.groupBy(*by).agg(F.expr("max_by(payload, seq) AS payload"), F.expr("min(op_at) AS created_at"), F.expr("max(op_at) AS updated_at"))


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; restarting continues from the checkpoint."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    query.outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def run_intake(stream: DataFrame, extent: Sequence[float], good: str, bad: str, checkpoint: str) -> StreamingQuery:
    """Route reports to an accepted and a rejected table; however late a report comes, it is routed.

    A report that came before, by its id, is left out: the ids of the tables written so far
    are the memory, so repeats are found without a bound on time.
    """
    timed = stream.withColumn("created_at", F.col("created_at").cast("timestamp"))

    def split(batch: DataFrame, batch_id: int) -> None:
        # Reports without an id are reports of their own.
        unnamed = batch.filter("id IS NULL")
        spark, fresh = batch.sparkSession, batch.filter("id IS NOT NULL").dropDuplicates(["id"])
        ids = f"id {dict(batch.dtypes)['id']}, batch int"
        for path in (good, bad):
            try:
                before = spark.read.schema(ids).parquet(path).filter(F.col("batch") != batch_id)
            except AnalysisException as error:
                if "PATH_NOT_FOUND" not in str(error):
                    raise
                continue
            fresh = fresh.join(before.select("id"), "id", "left_anti")
        routed = route_reports(fresh.unionByName(unnamed), extent).withColumn("batch", F.lit(batch_id))
        # Overwriting the batch's own partition makes a replay harmless.
        for where, path in (("result = 'accepted'", good), ("result <> 'accepted'", bad)):
            routed.filter(where).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return timed.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_upsert(stream: DataFrame, by: Sequence[str], order: Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """Keep a table of the latest row per key, one version per micro-batch.

    A batch is reduced to one row per key, merged with the version before and written as a
    new version; a replayed batch rewrites the same version.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = latest(batch, by, order)
        if batch_id > 0:
            fresh = latest(fresh.unionByName(spark.read.schema(fresh.schema).parquet(f"{path}/v={batch_id - 1}")), by, order)
        fresh.write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
