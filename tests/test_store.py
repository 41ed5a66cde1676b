"""A store of records: crashes between and within writes, compaction, tolerant reading, and one key's bucket."""

import os

import pytest
from pyspark.sql import functions as F

from folio.sources import store

SCHEMA = "title string, state string, n long"
PATCH = "id string, at timestamp, title string, state string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(k, f"2024-01-01 00:{m:02d}:00", *rest) for k, m, *rest in rows], "id string, at string, title string, state string, n long").withColumn("at", F.col("at").cast("timestamp"))


def records(spark, folder, **more):
    return {r["id"]: tuple(r)[1:] for r in store.read(spark, folder, SCHEMA, "id", **more).collect()}


@pytest.fixture
def folder(spark, tmp_path):
    folder = str(tmp_path / "store")
    store.write(frame(spark, [("a", 1, "A", "new", 1), ("b", 1, "B", "new", None), (None, 1, "x", "x", 9)]), folder, "0001", "id", "at")
    store.write(frame(spark, [("a", 3, None, "done", None), ("a", 2, "A2", "run", 5), ("c", 2, None, None, 7)]), folder, "0002", "id", "at")
    return folder


WANT = {"a": ("A2", "done", 5), "b": ("B", "new", None), "c": (None, None, 7)}


def test_patches_by_field(spark, folder):
    assert records(spark, folder) == WANT
    assert records(spark, folder, defaults={"title": "untitled", "n": 0}) == {"a": ("A2", "done", 5), "b": ("B", "new", 0), "c": ("untitled", None, 7)}


def test_a_write_that_broke_off_is_not_seen_and_one_made_again_replaces_itself(spark, folder):
    store.write(frame(spark, [("a", 9, "lost", "lost", 99)]), folder, "0003", "id", "at")
    os.remove(f"{folder}/version=0003/_SUCCESS")
    assert store.versions(folder) == ["0001", "0002"] and records(spark, folder) == WANT
    for _ in range(2):
        store.write(frame(spark, [("d", 9, "D", None, None)]), folder, "0003", "id", "at")
    assert records(spark, folder) == WANT | {"d": ("D", None, None)}


def test_compaction_at_every_step(spark, folder, monkeypatch):
    late = [("a", 0, "older", "older", 0), ("b", 2, None, "late", 3)]
    calls = []

    def broken(self, path):
        calls.append(path)
        raise OSError("crash")

    monkeypatch.setattr(store, "file_system", lambda path: (type("Broken", (), {"delete_file": broken, "__getattr__": lambda s, n: getattr(store.fs.LocalFileSystem(), n)})(), path))
    with pytest.raises(OSError):
        store.compact(spark, folder, "0005", SCHEMA)
    monkeypatch.undo()
    assert calls
    assert store.versions(folder) == ["0001", "0002", "0005"] and records(spark, folder) == WANT
    store.compact(spark, folder, "0006", SCHEMA)
    assert store.versions(folder) == ["0006"] and records(spark, folder) == WANT
    store.write(frame(spark, late), folder, "0007", "id", "at")
    assert records(spark, folder) == WANT | {"b": ("B", "late", 3)}
    with pytest.raises(ValueError):
        store.compact(spark, folder, "0007", SCHEMA)


def test_broken_lines_and_other_fields(spark, folder):
    bucket = next(d for d in sorted(os.listdir(f"{folder}/version=0002")) if d.startswith("bucket="))
    with open(f"{folder}/version=0002/{bucket}/hand.json", "w") as file:
        file.write('{"_key": "e", "_at": "2024-01-01T00:00:00.000Z", "_version": "0002", "title": "E", "unknown": [1]}\n{"_key": "f", "n": \n\n[]\nwords\n')
    assert records(spark, folder) == WANT | {"e": ("E", None, None)}
    lines = [r.line for r in store.broken_lines(spark, folder, SCHEMA).collect()]
    assert len(lines) >= 2 and any("words" in (x or "") for x in lines)


def test_one_key_reads_its_bucket(spark, folder):
    assert records(spark, folder, only="a") == {"a": WANT["a"]}
    assert records(spark, folder, only="nobody") == {}
    one = store.read(spark, folder, SCHEMA, "id", only="a")
    assert len(one.inputFiles()) < len(store.read(spark, folder, SCHEMA, "id").inputFiles())
    assert records(spark, folder + "-none") == {}
