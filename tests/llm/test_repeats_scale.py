"""Repeats where a plain way would take quadratic time: many equal rows, and templated text in order."""

import time

import numpy as np

from folio.llm import repeats


def test_many_equal_rows(spark):
    text = "".join(chr(97 + (k * k * 7 + k // 11) % 26) for k in range(300))
    took = []
    for n in (500, 8000):
        df = spark.createDataFrame([(None, text)] * n + [(1, "another text")], "doc_id long, text string").repartition(4)
        began = time.time()
        got = {(r.doc_id, len(r.removed), len(r.kept)) for r in repeats.without_repeats(df).collect()}
        took.append(time.time() - began)
        assert got == {(None, 1, 0), (1, 0, 12)}
    assert took[1] < 4 * took[0] + 10


def test_templated_text_in_order():
    rng = np.random.default_rng(2)
    header = "".join(map(chr, rng.integers(97, 123, 180)))
    rows = [f"{header}{k:08d}" + "".join(map(chr, rng.integers(97, 123, 200))) for k in range(8000)]
    took = {}
    for name, order in (("sorted", range(len(rows))), ("reversed", range(len(rows) - 1, -1, -1)), ("shuffled", rng.permutation(len(rows)))):
        text = np.frombuffer("".join(rows[k] for k in order).encode(), np.uint8)
        size = len(rows[0])
        start = np.arange(len(rows)) * size
        began = time.process_time()
        found = repeats.repeated(text, start, np.full(len(rows), size - repeats.LENGTH + 1))
        took[name] = time.process_time() - began
        assert not found.any()  # the counters tell all suffixes of 200 bytes apart
    assert max(took.values()) < 4 * took["shuffled"] + 2
