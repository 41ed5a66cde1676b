"""The live feed against the batch query, over a restart, a batch run twice, and expiry."""

import random
from datetime import datetime, timedelta

import pytest

from folio.operators.feeds import job_feeds
from folio.streaming import live

START = datetime(2024, 1, 1)


def made(seed):
    """Events in time order of jobs that end at most once, and subscribers."""
    rng = random.Random(seed)
    rows, event_id = [], 0
    for job in range(25):
        at = START + timedelta(minutes=rng.randint(0, 50))
        for step in range(rng.randint(1, 6)):
            last = step == 5 or rng.random() < 0.2
            rows.append((f"j{job}", at, event_id, rng.choice(["purchase", "error"]) if last else rng.choice(["view", "click"]), None))
            event_id += 1
            at += timedelta(seconds=rng.choice([0, 20, 200]))
            if last:
                break
        for _ in range(3):
            rows.append((f"j{job}", START + timedelta(seconds=rng.randint(0, 5400)), None, None, f"s{event_id}-{rng.random()}"))
    return sorted(rows, key=lambda r: (r[1], r[4] is not None, r[2] or 0))


@pytest.fixture
def store(spark):
    for k, v in live.STORE.items():
        spark.conf.set(k, v)
    yield
    for k in live.STORE:
        spark.conf.unset(k)


def run(spark, tmp_path):
    stream = spark.readStream.schema(live.INPUT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = live.batch_sink(str(tmp_path / "out"))

    def twice(batch, number):  # as after a failure between the write and the commit
        sink(batch, number)
        sink(batch, number)

    query = live.live_feed(stream).writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(180)


def test_restarts_and_equals_the_batch_query(spark, tmp_path, store):
    rows = made(1)
    parts = [rows[k::1][: len(rows) // 3] for k in (0, len(rows) // 3)] + [rows[2 * (len(rows) // 3) :]]
    assert sum(map(len, parts)) == len(rows)
    for k, part in enumerate(parts):
        spark.createDataFrame(part, live.INPUT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k != 1:  # two batches in the second run
            run(spark, tmp_path)
    got = [tuple(r) for r in live.pushed(spark, str(tmp_path / "out")).select("job_id", "subscriber", "event_id", "kind", "stage").collect()]
    table = spark.createDataFrame(rows, live.INPUT)
    subscribers = table.where("subscriber is not null").selectExpr("job_id", "ts at", "subscriber")
    fed = job_feeds(table.where("event is not null").select("job_id", "ts", "event_id", "event"), subscribers.select("job_id", "at"))
    want = [tuple(r) for r in fed.join(subscribers, ["job_id", "at"]).select("job_id", "subscriber", "event_id", "kind", "stage").collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[3] for r in got} == {"snapshot", "stage", "end"}
    frames = [r.frame for r in live.pushed(spark, str(tmp_path / "out")).where("kind = 'end'").collect()]
    assert all(f.startswith("event: end\ndata: {") and f.endswith("}\n\n") for f in frames)


def test_ended_jobs_are_forgotten_by_timer(spark, tmp_path, store):
    folder = str(tmp_path / "in")
    steps = [
        [("a", START, 1, "view", None), ("a", START, 2, "purchase", None), ("b", START, 3, "view", None), ("b", START, None, None, "s0")],
        [("c", START + timedelta(minutes=30), 4, "view", None)],
        [("c", START + timedelta(minutes=31), 5, "view", None), ("a", START + timedelta(minutes=31), None, None, "late"), ("b", START + timedelta(minutes=31), None, None, "s1")],
    ]
    for step in steps:
        spark.createDataFrame(step, live.INPUT).coalesce(1).write.mode("append").parquet(folder)
        run(spark, tmp_path)
    state = spark.read.format("statestore").option("stateVarName", "job").load(str(tmp_path / "cp"))
    assert {r.key.job_id for r in state.collect()} == {"b", "c"}
    got = {(r.subscriber, r.kind, r.stage) for r in live.pushed(spark, str(tmp_path / "out")).collect()}
    assert got == {("s0", "snapshot", "view"), ("s1", "snapshot", "view")}
