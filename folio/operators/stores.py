"""A query over a store of records: the events of all users as patches of a record each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.documents import table
from folio.sources import store
from folio.sources.shared import shared_folder

SCHEMA = "stage string, ended_by string, last_id long, bought long"
DEFAULTS = {"stage": "", "bought": 0}
ENDS = ("purchase", "error")


def patches(events: DataFrame) -> DataFrame:
    """An event changes the last id, and the stage, or what ended the job; a purchase also what was bought."""
    ends, kind = F.col("event_type").isin(*ENDS), F.col("event_type")
    return events.select("user_id", "ts", F.when(~ends, kind).alias("stage"), F.when(ends, kind).alias("ended_by"), F.col("event_id").alias("last_id"), F.when(kind == "purchase", F.col("event_id")).alias("bought"))


def stored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records after two writes, a compaction and a third write, whose patches are older in part."""
    folder, rows = shared_folder(spark, "records"), table(spark, sf_dir, "events")
    for k in range(3):
        store.write(patches(rows.where(F.pmod("event_id", F.lit(3)) == k)), folder, f"{2 * k:04d}", "user_id", "ts")
        if k == 1:
            store.compact(spark, folder, "0003", SCHEMA)
    now = store.read(spark, folder, SCHEMA, "user_id", defaults=DEFAULTS)
    return now.select(F.col("user_id").cast("long").alias("user_id"), "stage", "ended_by", "last_id", "bought")


QUERIES = {"stored_records": stored_records}
SQL = {
    "stored_records": f"""with e as (select *, '000' || (2 * (event_id % 3)) v, event_type in {ENDS} ends from events)
      select user_id, coalesce(arg_max(event_type, (ts, v, event_type)) filter (not ends), '') stage, arg_max(event_type, (ts, v, event_type)) filter (ends) ended_by, arg_max(event_id, (ts, v, event_id)) last_id,
        coalesce(arg_max(event_id, (ts, v, event_id)) filter (event_type = 'purchase'), 0) bought from e group by user_id""",
}
