"""Feeds of jobs with many subscribers over many hours, against a plain loop, and that events and subscribers don't meet before the live part."""

import random
from datetime import datetime, timedelta

from folio.operators.feeds import job_feeds, states_at

ENDS, TTL = ("done", "fail"), timedelta(minutes=10)


def plain_feeds(events, subscribers):
    out = []
    for job, at in subscribers:
        mine = sorted((e for e in events if e[0] == job), key=lambda e: (e[1], e[2]))
        end = next((e for e in mine if e[3] in ENDS), None)
        by_then = [e for e in mine if e[1] <= at]
        if not by_then or (end and at > end[1] + TTL):
            continue
        last = [e for e in by_then if e[3] not in ENDS]
        out.append((job, at, None, "snapshot", last[-1][3] if last else None))
        if end and end[1] <= at:
            out.append((job, at, end[2], "end", end[3]))
            continue
        for e in mine:
            if e[1] > at and (end is None or (e[1], e[2]) <= (end[1], end[2])):
                out.append((job, at, e[2], "end" if e[3] in ENDS else "stage", e[3]))
    return out


def test_many_subscribers_over_hours(spark):
    rng, day = random.Random(4), datetime(2024, 5, 1)
    when = lambda: day + timedelta(minutes=rng.randrange(0, 400, 5))
    kinds = ["queued", "write", "draw", None] * 6 + ["done", "fail"]
    events = [(f"j{rng.randrange(6)}", when(), n, rng.choice(kinds)) for n in range(160)]
    subscribers = sorted({(f"j{rng.randrange(7)}", when()) for _ in range(120)})
    rows = spark.createDataFrame(events, "job_id string, ts timestamp, event_id long, event string")
    got = job_feeds(rows, spark.createDataFrame(subscribers, "job_id string, at timestamp"), ends=ENDS)
    order = lambda r: (r[0], r[1], r[3], r[2] or 0, r[4] or "")
    assert sorted((tuple(r[c] for c in ("job_id", "at", "event_id", "kind", "stage")) for r in got.collect()), key=order) == sorted(plain_feeds(events, subscribers), key=order)


def test_states_are_found_without_pairs(spark):
    rows = spark.createDataFrame([("a", datetime(2024, 1, 1, h), h, "x", False) for h in range(9)], "job_id string, ts timestamp, event_id long, event string, ends boolean")
    at = spark.createDataFrame([("a", datetime(2024, 1, 1, h, 30)) for h in range(9)], "job_id string, at timestamp")
    plan = states_at(rows, at)
    assert sorted(r.last.event_id for r in plan.collect()) == list(range(9))
    assert states_at(rows.limit(0), at).count() == states_at(rows, at.limit(0)).count() == 0
