"""Toxicity: a factorization machine over hashed terms.

Terms are the distinct lower-case words of a text and their first 4 to 7 bytes (an insult's stem with any ending). Beside a
weight for each term the model has a short vector, and the product of two terms' vectors is the weight of their meeting,
such as of an insult with a group's name, which no sum of single weights can tell. It is fitted to a bounded sample
of labelled rows, broadcast, and scores whole texts in numpy. Terms of the model are those that tell labels apart in the sample by
more than chance, alone or among the rows of another such term, however many they are: so a group's name that is as frequent in
clean as in toxic rows is kept for what it tells beside an insult. Toxic rows weigh more, as they are few.

Null and empty texts get the score of a text without known terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import Rolling, documents, held_out, row_sums, text_slices, utf8, words

BINS = 1 << 18
FACTORS = 8
PREFIXES = (4, 5, 6, 7)
#: About so many labelled rows are learned from, picked by a hash of their id.
TRAINING_ROWS = 12_000
#: By so many standard deviations a term's labels differ from all rows' labels, or from those of the rows of another term.
APART, APART_BESIDE = 3.0, 8.0
#: So many of the terms that differ most are looked beside.
BESIDE = 400
EPOCHS, BATCH, RATE, DECAY, SEED = 8, 64, 0.03, 0.01, 9
#: What a toxic row weighs against a clean one.
TOXIC_WEIGHT = 3.0
#: Passes are added over a small sample, up to so many steps.
LEAST_STEPS = 1500

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


@dataclass
class Model:
    """bins of the terms (ascending), the value of each (less for common ones), their weights and vectors, and the bias."""

    terms: np.ndarray
    values: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray
    bias: float


def _terms(text: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and bin of each row's distinct terms; known: of these bins alone (a mask)."""
    data, offsets = utf8(pc.utf8_lower(text))
    row, start, end = words(data, offsets, _LETTER)
    rolling, length = Rolling(data), end - start
    found = [(row, rolling.at(start, length))]
    for n in PREFIXES:
        longer = length > n
        found.append((row[longer], rolling.at(start[longer], np.int64(n)) + np.uint64(n)))
    out = []
    for r, h in found:
        b = (h % np.uint64(BINS)).astype(np.int64)
        if known is not None:
            r, b = r[known[b]], b[known[b]]
        out.append(r * BINS + b)
    both = np.unique(np.concatenate(out))
    return both // BINS, both % BINS


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        row, b = _terms(batch.column("text"))
        cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
        b = b.astype("<u4")
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "label": batch.column("label"), "terms": pa.array([b[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})


def fit(docs: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """docs: doc_id, text and label (0 or 1; others are left out). What is collected is bounded by `rows`."""
    labelled = docs.where(F.col("label").isin(0, 1)).select("doc_id", "text", F.col("label").cast("int").alias("label"))
    n = labelled.count()
    share = min(1.0, rows / max(1, n))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000)) < round(share * 1_000_000))
    kind = sample.schema["doc_id"].dataType.simpleString()
    got = sample.mapInArrow(_collected, f"doc_id {kind}, label int, terms binary").toPandas().sort_values(["doc_id", "terms"], kind="stable")
    return train([np.frombuffer(t, "<u4").astype(np.int64) for t in got["terms"]], got["label"].to_numpy(float))


def _apart(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """How many standard deviations the number of toxic rows of each bin is from that of all rows."""
    flat, mean = np.concatenate([np.zeros(0, np.int64), *rows]), labels.mean()
    n = np.bincount(flat, minlength=BINS)
    toxic = np.bincount(flat, weights=np.repeat(labels, [len(r) for r in rows]), minlength=BINS)
    return np.abs(toxic - mean * n) / np.sqrt(n * mean * (1 - mean) + 1)


def telling_terms(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Bins of the terms that tell labels apart, alone or beside another such term."""
    if not len(rows):
        return np.zeros(0, np.int64)
    alone = _apart(rows, labels)
    kept = alone >= APART
    first = np.argsort(-alone, kind="stable")[: min(BESIDE, int(kept.sum()))]
    number = np.full(BINS, -1)
    number[first] = np.arange(len(first))
    beside: list[list[int]] = [[] for _ in first]
    for i, r in enumerate(rows):
        for k in number[r][number[r] >= 0]:
            beside[k].append(i)
    for own in beside:
        kept |= _apart([rows[i] for i in own], labels[own]) >= APART_BESIDE
    return np.flatnonzero(kept)


def train(rows: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS) -> Model:
    """Logistic loss by plain stochastic descent: a term in many rows then learns more than one that only marks a few. Without factors the model only adds."""
    terms = telling_terms(rows, labels)
    frequency = np.bincount(np.concatenate([np.zeros(0, np.int64), *rows]), minlength=BINS)[terms]
    values = np.minimum(1, 2 * np.log(len(rows) / frequency) / np.log(len(rows))) if len(rows) > 1 else np.ones(len(terms))
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.05
    random = np.random.default_rng(SEED)
    weights, vectors, bias = np.zeros(len(terms)), random.normal(0, 0.01, (len(terms), factors)), float(np.log(share / (1 - share)))
    place = np.full(BINS, -1)
    place[terms] = np.arange(len(terms))
    rows = [p[p >= 0] for p in (place[r] for r in rows)]
    for _ in range(max(EPOCHS, LEAST_STEPS * BATCH // max(1, len(labels))) if len(labels) >= BATCH else EPOCHS * bool(len(labels))):
        for batch in np.array_split(random.permutation(len(rows)), max(1, len(rows) // BATCH)):
            at = np.concatenate([rows[i] for i in batch]) if len(batch) else np.zeros(0, np.int64)
            if not len(at):
                continue
            row = np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch])
            x = values[at]
            v = vectors[at] * x[:, None]
            sums = row_sums(v, row, len(batch))
            score = bias + row_sums(weights[at] * x, row, len(batch)) + 0.5 * (sums**2 - row_sums(v**2, row, len(batch))).sum(axis=1)
            error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[batch]
            distinct, where = np.unique(at, return_inverse=True)
            order = np.argsort(where, kind="stable")
            by_term = where[order]
            each = (error * np.where(labels[batch] == 1, TOXIC_WEIGHT, 1.0))[row] * x
            grad_w = row_sums(each[order], by_term, len(distinct)) + DECAY * weights[distinct]
            grad_v = row_sums((each[:, None] * (sums[row] - v))[order], by_term, len(distinct)) + DECAY * vectors[distinct]
            weights[distinct] -= RATE * grad_w
            vectors[distinct] -= RATE * np.clip(grad_v, -1, 1)
            bias -= RATE * float(error.mean())
    return Model(terms, values.astype(np.float32), weights.astype(np.float32), vectors.astype(np.float32), bias)


def predict(model: Model, text: pa.Array) -> np.ndarray:
    known = np.zeros(BINS, bool)
    known[model.terms] = True
    row, b = _terms(text, known)
    at, n = np.searchsorted(model.terms, b), len(text)
    x = model.values[at]
    v = model.vectors[at] * x[:, None]
    sums = row_sums(v, row, n)
    score = model.bias + row_sums(model.weights[at] * x, row, n) + 0.5 * (sums**2 - row_sums(v**2, row, n)).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(predict(shared.value, batch.column("text")), pa.float64())})

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(each, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    model = fit(docs.join(labels, "doc_id").where(~held_out("doc_id", 5, 0)))
    scored = score(docs, model)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
