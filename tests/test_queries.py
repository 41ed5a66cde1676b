"""Every query with SQL gives the rows that DuckDB gives on the shared tables."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from folio.operators import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, name, tmp_path):
    path = str(tmp_path / "out")
    registry.QUERIES[name](spark, SF).write.parquet(path)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    con.sql(f"create table want as {registry.SQL[name]}")
    columns = ", ".join(f'"{r[0]}"' for r in sorted(con.sql("describe want").fetchall()))
    con.sql(f"create table got as select {columns} from '{path}/*.parquet'")
    con.sql(f"create table wanted as select {columns} from want")
    assert con.sql("select count(*) from got").fetchall() == con.sql("select count(*) from wanted").fetchall()
    assert con.sql("select * from got except all select * from wanted").fetchall() == []


@pytest.mark.parametrize("name", ["paper_sections", "paper_structures"])
def test_papers_keep_digits_that_equal_their_place(spark, name, tmp_path):
    said = " ".join(f"{i} and {i * 11} are so many words of {i}!" for i in range(60)) + " call +1 (409) 555-8231"
    rows = [(i, "\n".join([said] * (1 + i % 2 * 5))) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    registry.QUERIES[name](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    con.sql(f"create table want as {registry.SQL[name]}")
    columns = ", ".join(f'"{r[0]}"' for r in con.sql("describe want").fetchall())
    want, got = (con.sql(f"select {columns} from {source}").fetchall() for source in ("want", f"'{tmp_path}/out/*.parquet'"))
    assert len(want) >= 30 and sorted(map(str, got)) == sorted(map(str, want))


def test_entry_imports_and_flagship_runs(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("gone", [("folio/llm",), ("corpus_pipeline.py",), ("folio/llm", "corpus_pipeline.py")])
def test_entry_imports_without_the_training_data_operators(gone, tmp_path):
    here, copy = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), str(tmp_path / "copy")
    os.mkdir(copy)
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "folio"):
        source = os.path.join(here, name)
        if os.path.isdir(source):
            shutil.copytree(source, os.path.join(copy, name))
        elif os.path.exists(source):
            shutil.copy(source, copy)
    for name in gone:
        path = os.path.join(copy, name)
        shutil.rmtree(path) if os.path.isdir(path) else os.path.exists(path) and os.remove(path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": copy}, capture_output=True, text=True, check=False)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[0]) >= len(registry.QUERIES)
