"""Stored feeds: what is pushed to the source, which files are read, and odd entries."""

from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, IsNotNull, LessThan, StringContains

from folio.sources import atom

ENTRY = '<entry><id>{id}</id><published>{day}T00:00:00Z</published><title>{title}</title><summary>{summary}</summary><category term="{cat}"/>{names}</entry>'


def entry(id="http://arxiv.org/abs/2401.00001v2", day="2024-01-02", title="A  title", summary="", cat="cs.DB", names=("Ann", "Bo &amp; Co")):
    return ENTRY.format(id=id, day=day, title=title, summary=summary, cat=cat, names="".join(f"<author><name>{n}</name></author>" for n in names))


def feed_folder(spark, tmp_path):
    days = [f"2024-01-{d:02d}" for d in range(1, 11)]
    rows = [(d, entry(id=f"http://arxiv.org/abs/2401.{k:05d}v1", day=d, title=f"Paper {k} on {'joins' if k % 2 else 'scans'}", cat="cs.DB" if k % 3 else "cs.LG")) for k, d in enumerate(days * 5)]
    folder = (tmp_path / "feeds").as_uri()
    atom.write_feeds(spark.createDataFrame(rows, "published string, entry string"), folder)
    return folder, rows


def test_parsed():
    row = atom.parsed(entry())
    assert (row["paper"], row["title"], row["published"], row["authors"], row["category"]) == ("2401.00001", "A title", "2024-01-02", ["Ann", "Bo & Co"], "cs.DB")
    assert row["url"] == "https://arxiv.org/abs/2401.00001"
    assert row["words"] == "a title ann bo & co"
    assert atom.parsed(entry(title=" \n ")) is None
    assert atom.parsed(entry(id="http://arxiv.org/abs/cs/0101001v1"))["paper"] == "cs/0101001v1"
    assert atom.parsed("<title>only</title>")["authors"] == []


def test_filters_are_pushed_and_days_choose_files(spark, tmp_path):
    folder, _ = feed_folder(spark, tmp_path)
    reader = atom.AtomReader(folder)
    every = len(reader.partitions())
    other = EqualTo(("title",), "x")
    asked = [GreaterThanOrEqual(("published",), "2024-01-04"), LessThan(("published",), "2024-01-06"), EqualTo(("category",), "cs.DB"), StringContains(("words",), "joins"), IsNotNull(("title",)), other]
    assert list(reader.pushFilters(asked)) == [other]
    files = reader.partitions()
    assert {f.path.split("day=")[1][:10] for f in files} == {"2024-01-04", "2024-01-05"} and len(files) < every
    read = [r for f in files for b in reader.read(f) for r in b.to_pylist()]
    assert read and all(r["category"] == "cs.DB" and "joins" in r["words"] and r["published"] in ("2024-01-04", "2024-01-05") for r in read)
    assert list(reader.pushFilters([EqualTo(("category",), "cs.LG")])) == [] and reader.partitions() == []


def test_search_gives_what_spark_filters_give(spark, tmp_path):
    folder, rows = feed_folder(spark, tmp_path)
    every = atom.feeds(spark, folder)
    assert every.count() == len(rows)
    found = atom.search(every, "2024-01-08", 3, "cs.DB", "JOINS")
    got = [(r.paper, r.published) for r in found.collect()]
    want = [(f"2401.{k:05d}", d) for k, (d, _) in enumerate(rows) if "2024-01-05" <= d <= "2024-01-08" and k % 2 and k % 3]
    assert got == sorted(want, key=lambda r: ([-ord(c) for c in r[1]], r[0]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    # what is pushed isn't evaluated again
    assert "Filter (" not in plan
    assert len(atom.search(every, "2024-01-10", 99, most=7).collect()) == 7
    assert {r.published for r in atom.search(every, "2024-01-10", 0).collect()} == {f"2024-01-{d:02d}" for d in range(7, 11)}


def test_entries_over_the_borders_of_pieces(spark, tmp_path, monkeypatch):
    day = tmp_path / "feeds" / "day=2024-01-02"
    day.mkdir(parents=True)
    (day / "a.xml").write_text("<feed><title>é</title>" + "\n".join(entry(title=f"é {k}") for k in range(50)) + "</feed>")
    (day / "b.xml").write_text("<feed><entry>broken")
    monkeypatch.setattr(atom, "PIECE", 7)
    reader = atom.AtomReader(str(tmp_path / "feeds"))
    assert [r["title"] for f in reader.partitions() for b in reader.read(f) for r in b.to_pylist()] == [f"é {k}" for k in range(50)]
