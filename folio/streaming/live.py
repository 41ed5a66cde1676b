"""Jobs as a live feed: a late subscriber gets a job's state first, then its events up to its end; a job is forgotten some time after it.

One keyed stream carries events and subscriptions. A job's state is its last stage, its end and who listens; a timer in event
time, set when it ends, drops the state. What the stream gives is pushed by `batch_sink`, which writes each batch to a folder of its
number, so that a batch that is run again after a failure replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from folio.operators.feeds import ENDS

TTL = timedelta(minutes=10)
INPUT = "job_id string, ts timestamp, event_id long, event string, subscriber string"
OUTPUT = "job_id string, subscriber string, event_id long, kind string, stage string"
STATE = "stage string, ended_by string, end_id long, ended_at long"
#: A state store that keeps timers and lists.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _millis(at: datetime) -> int:
    return int(at.timestamp() * 1000)


class JobFeed(StatefulProcessor):
    """Rows of one job: events (event is set) and subscriptions (subscriber is set), in time order, events first."""

    def __init__(self, ends: tuple[str, ...] = ENDS, ttl: timedelta = TTL):
        self.ends, self.ttl = ends, int(ttl.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", STATE)
        self.listeners = handle.getListState("listeners", "subscriber string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        batch = sorted(rows, key=lambda r: (r.ts, r.subscriber is not None, r.event_id or 0))
        known = self.state.exists()
        stage, ended_by, end_id, ended_at = self.state.get() if known else (None, None, None, None)
        listening = [row[0] for row in self.listeners.get()] if self.listeners.exists() else []
        out: list[tuple] = []
        for row in batch:
            at = _millis(row.ts)
            if row.subscriber is not None:
                if not known or (ended_at is not None and at > ended_at + self.ttl):
                    continue
                out.append((key[0], row.subscriber, None, "snapshot", stage))
                if ended_by is None:
                    listening.append(row.subscriber)
                else:
                    out.append((key[0], row.subscriber, end_id, "end", ended_by))
                continue
            known = True
            if row.event not in self.ends:
                stage = row.event
            kind = "end" if row.event in self.ends else "stage"
            if ended_by is None:
                out += [(key[0], who, row.event_id, kind, row.event) for who in listening]
                if kind == "end":
                    ended_by, end_id, ended_at, listening = row.event, row.event_id, at, []
                    self.handle.registerTimer(at + self.ttl)
        if known:
            self.state.update((stage, ended_by, end_id, ended_at))
            if listening:
                self.listeners.put([(who,) for who in listening])
            elif self.listeners.exists():
                self.listeners.clear()
        for one in out:
            yield Row(job_id=one[0], subscriber=one[1], event_id=one[2], kind=one[3], stage=one[4])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        if self.listeners.exists():
            self.listeners.clear()
        return iter(())

    def close(self) -> None:
        pass


def live_feed(rows: DataFrame, delay: str = "1 minute", ends: tuple[str, ...] = ENDS, ttl: timedelta = TTL) -> DataFrame:
    """job_id, subscriber, event_id (null: the snapshot), kind and stage of what is pushed. rows: a stream of `INPUT`; rows later than `delay` are dropped."""
    watched = rows.where("job_id is not null and ts is not null").withWatermark("ts", delay)
    return watched.groupBy("job_id").transformWithState(JobFeed(ends, ttl), OUTPUT, "Append", "EventTime")


def frame(kind: Column, payload: Column) -> Column:
    """A frame of an event stream: its name and its data as JSON."""
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), F.to_json(payload), F.lit("\n\n"))


def batch_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that writes each batch once, whatever has run before."""

    def write(batch: DataFrame, number: int) -> None:
        state = F.struct(F.col("stage").alias("state"), "event_id")
        batch.withColumn("frame", frame(F.col("kind"), state)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def pushed(spark: SparkSession, folder: str) -> DataFrame:
    """All that has been pushed, with its batch."""
    return spark.read.parquet(folder)
