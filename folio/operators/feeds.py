"""What a subscriber to a job sees: its state at that time, then its events up to the first end, unless it ended too long before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.operators.documents import table

# Fixed value: how long an ended job is still known.
TTL = "10 minutes"
ENDS = ("purchase", "error")


def states_at(rows: DataFrame, subscribers: DataFrame) -> DataFrame:
    """job_id, at and the last event before the end (`last`, null: none) by then, of subscribers by when their job had an event.

    Events and subscribers pass one window, never each other. It spans an hour of a job, and what came before is carried from hour
    to hour, so that a busy job is many small windows.
    """
    state = F.when(~F.col("ends"), F.struct("ts", "event_id", "event"))
    events = rows.select("job_id", F.col("ts").alias("at"), state.alias("state"), F.lit(1).alias("n"))
    nothing = F.lit(None).cast(events.schema["state"].dataType).alias("state")
    both = events.unionByName(subscribers.select("job_id", "at", nothing, F.lit(0).alias("n"))).withColumn("hour", F.date_trunc("hour", "at"))
    hours = both.groupBy("job_id", "hour").agg(F.max("state").alias("state"), F.sum("n").alias("n"))
    before = Window.partitionBy("job_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("job_id", "hour", F.max("state").over(before).alias("old_state"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("old_n"))
    within = Window.partitionBy("job_id", "hour").orderBy("at", F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.select("job_id", "hour", "at", "n", F.max("state").over(within).alias("state"), F.sum("n").over(within).alias("new_n")).where("n = 0")
    return seen.join(hours, ["job_id", "hour"]).where("new_n + old_n > 0").select("job_id", "at", F.coalesce("state", "old_state").alias("last"))


def job_feeds(events: DataFrame, subscribers: DataFrame, ends: tuple[str, ...] = ENDS, ttl: str = TTL) -> DataFrame:
    """job_id, at, event_id (null: the snapshot), kind and stage of what each subscriber gets.

    events: job_id, ts, event_id and event, of which those in `ends` end a job; subscribers: job_id and at, each pair once. A job without
    events by then, or that ended more than `ttl` before, is unknown and gives nothing. An ended job gives its snapshot and its end.
    Jobs without an id or events without a time are none.
    """
    rows = events.where("job_id is not null and ts is not null").withColumn("ends", F.coalesce(F.col("event").isin(*ends), F.lit(False)))
    end = rows.where("ends").groupBy("job_id").agg(F.min(F.struct("ts", "event_id", "event")).alias("end"))
    known = subscribers.join(end, "job_id", "left").where(F.col("end").isNull() | (F.col("at") <= F.col("end.ts") + F.expr(f"interval {ttl}")))
    shots = known.join(states_at(rows, known), ["job_id", "at"])
    none = F.lit(None).cast("long").alias("event_id")
    snapshot = shots.select("job_id", "at", none, F.lit("snapshot").alias("kind"), F.col("last.event").alias("stage"))
    ended = shots.where("end.ts <= at").select("job_id", "at", "end.event_id", F.lit("end").alias("kind"), F.col("end.event").alias("stage"))
    waiting = shots.where("end is null or end.ts > at")
    # events before a job's first live subscriber don't travel; the rest is what is sent
    later = rows.join(waiting.groupBy("job_id").agg(F.min("at").alias("first")), "job_id").where("ts > first").drop("first")
    live = waiting.join(later, "job_id").where((F.col("ts") > F.col("at")) & (F.col("end").isNull() | (F.struct("ts", "event_id") <= F.struct("end.ts", "end.event_id"))))
    return snapshot.unionByName(ended).unionByName(live.select("job_id", "at", "event_id", F.when(F.col("ends"), "end").otherwise("stage").alias("kind"), F.col("event").alias("stage")))


def feeds_of_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each user of a day as a job, with a subscriber some hours into the day of each."""
    day = F.date_format("ts", "yyyyMMdd")
    rows = table(spark, sf_dir, "events").select(F.concat_ws("-", "user_id", day).alias("job_id"), "user_id", "ts", "event_id", F.col("event_type").alias("event"))
    # one subscriber a job, ten minutes or hours behind its first event
    minutes = F.when(F.col("user_id") % 2 == 0, F.lit(5)).otherwise(F.lit(300))
    subscribers = rows.groupBy("job_id").agg((F.min("ts") + F.make_interval(mins=F.first(minutes))).alias("at"))
    return job_feeds(rows.drop("user_id"), subscribers).drop("at")


QUERIES = {"feeds_of_jobs": feeds_of_jobs}
SQL = {
    "feeds_of_jobs": f"""with r as (select user_id || '-' || strftime(ts, '%Y%m%d') job_id, user_id, ts, event_id, event_type event, event_type in {ENDS} ends from events),
      s as (select job_id, min(ts) + to_minutes(case when any_value(user_id) % 2 = 0 then 5 else 300 end) at_ from r group by job_id),
      e as (select job_id, ts end_ts, event_id end_id, event end_event from r where ends qualify row_number() over (partition by job_id order by ts, event_id) = 1),
      k as (select s.*, end_ts, end_id, end_event from s left join e using (job_id) where end_ts is null or at_ <= end_ts + interval {TTL})
      select job_id, null::bigint event_id, 'snapshot' kind, arg_max(event, (ts, event_id)) filter (not ends) stage from k join r using (job_id) where ts <= at_ group by job_id
      union all select job_id, end_id, 'end', end_event from k where end_ts <= at_
      union all select job_id, event_id, case when ends then 'end' else 'stage' end, event from k join r using (job_id) where ts > at_ and (end_ts is null or (end_ts > at_ and (ts, event_id) <= (end_ts, end_id)))""",
}
