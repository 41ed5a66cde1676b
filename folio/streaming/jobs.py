"""Progress of jobs as a stream: the last stage named, the first end, and a time to live."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def job_progress(events: DataFrame, ttl: str = "10 minutes") -> DataFrame:
    """State of each job in each session of its events; a session is closed, and its state dropped, `ttl` after its last one.

    events: job_id, ts, event (stage, done or fail) and stage; a stream or a table. An empty stage keeps the one before.
    """
    at = F.struct("ts", "event")
    named, ends = (F.col("event") == "stage") & (F.coalesce("stage", F.lit("")) != ""), F.col("event").isin("done", "fail")
    grouped = events.withWatermark("ts", ttl).groupBy("job_id", F.session_window("ts", ttl).alias("session"))
    rows = grouped.agg(
        F.count("*").alias("events"),
        F.max_by(F.when(named, F.col("stage")), F.when(named, at)).alias("stage"),
        F.min_by(F.when(ends, F.col("event")), F.when(ends, at)).alias("ended_by"),
    )
    state = F.when(F.col("ended_by").isNull(), "running").when(F.col("ended_by") == "fail", "error").otherwise("done")
    return rows.select("job_id", F.col("session.start").alias("first"), "events", "stage", state.alias("state"))
