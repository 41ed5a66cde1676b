"""The job stream gives what the table of its events gives."""

from folio.streaming.jobs import job_progress

ROWS = [
    ("a", "2024-01-01 00:00:00", "stage", "queued"),
    ("a", "2024-01-01 00:01:00", "stage", "write"),
    ("a", "2024-01-01 00:02:00", "stage", ""),
    ("b", "2024-01-01 00:00:30", "stage", "queued"),
    ("a", "2024-01-01 00:03:00", "done", None),
    ("a", "2024-01-01 00:03:30", "fail", None),
    ("c", "2024-01-01 02:00:00", "stage", "queued"),
]


def test_stream_and_table_agree(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, "job_id string, ts string, event string, stage string").selectExpr("job_id", "timestamp(ts) ts", "event", "stage")
    table = {r["job_id"]: (r["events"], r["stage"], r["state"]) for r in job_progress(rows).collect()}
    assert table == {"a": (5, "write", "done"), "b": (1, "queued", "running"), "c": (1, "queued", "running")}
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = job_progress(stream).writeStream.format("memory").queryName("jobs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    streamed = {r["job_id"]: (r["events"], r["stage"], r["state"]) for r in spark.table("jobs").collect()}
    assert streamed == {k: v for k, v in table.items() if k != "c"}  # the watermark hasn't passed c
