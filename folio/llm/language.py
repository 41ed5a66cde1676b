"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from a bounded sample of the labelled rows, drawn for each language; the log-probability matrix (bins by languages) is broadcast,
and each task scores its whole texts in numpy. A null text, or one without letters, is `und` with score 0. With
no labelled rows at all every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import documents, held_out, row_sums, text_slices

BINS = 1 << 16
ORDERS = (1, 2, 3)
#: About so many labelled rows are learned from, picked by a hash of their id; but of each language about so many at least, or all it has.
TRAINING_ROWS = 20_000
LANGUAGE_ROWS = 500
UNDETERMINED = "und"


def _grams(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Row of each character, its n-gram's bin for each order (BINS: none), and whether each row has a letter."""
    texts = [t.lower() for t in texts]
    letters = np.array([any(map(str.isalpha, t)) for t in texts], bool)
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), lengths)
    plain = (codes < 128) & ~((codes >= 97) & (codes <= 122))
    codes[plain] = 32
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(codes))
    out, h = [], np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            h = h[:-1]
        h = (h ^ codes[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in ORDERS:
            bins = np.full(len(codes), BINS, np.int32)
            bins[: len(h)] = (((h + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int32)
            bins[left < n] = BINS
            out.append(bins)
    return row, out, letters


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in text_slices(batches):
        langs = np.array(batch.column("lang").to_pylist(), object)
        row, bins, _ = _grams(batch.column("text").to_pylist())
        for lang in set(langs):
            mine = (langs == lang)[row]
            for b in bins:
                totals.setdefault(lang, np.zeros(BINS + 1, np.int64))
                totals[lang] += np.bincount(b[mine], minlength=BINS + 1)
    for lang, total in totals.items():
        at = np.flatnonzero(total[:BINS])
        yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bin": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})


def fit(docs: DataFrame, rows: int = TRAINING_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, and log-probabilities of bins by language with a row of zeros and the priors last.

    docs: doc_id, text and lang. The sample is bounded by `rows` and LANGUAGE_ROWS for each language; what is collected by languages
    times bins. A language without a row in the sample is left out.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    by_lang = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not by_lang:
        return [], np.zeros((BINS + 2, 0), np.float32)
    share = rows / sum(by_lang.values())
    parts = 1 << 40
    shares = F.create_map(*(F.lit(x) for lang, n in by_lang.items() for x in (lang, int(parts * min(1.0, max(share, LANGUAGE_ROWS / n))))))
    sample = labelled.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(parts)) < shares[F.col("lang")])
    counts = sample.select("text", "lang").mapInArrow(_count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(counts["lang"]))
    if not langs:
        return [], np.zeros((BINS + 2, 0), np.float32)
    matrix = np.zeros((BINS, len(langs)))
    matrix[counts["bin"].to_numpy(int), pd.Categorical(counts["lang"], langs).codes.astype(int)] = counts["n"].to_numpy()
    matrix = np.log(matrix + 0.5) - np.log(matrix.sum(axis=0) + 0.5 * BINS)
    priors = np.array([by_lang[x] for x in langs], float)
    return langs, np.vstack([matrix, np.zeros(len(langs)), np.log(priors / priors.sum())]).astype(np.float32)


def _scorer(langs: list[str], shared, column: str, keep_text: bool):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value
        for batch in text_slices(batches, column):
            n = batch.num_rows
            row, bins, letters = _grams(batch.column(column).to_pylist())
            total = np.tile(matrix[BINS + 1].astype(float), (n, 1))
            for b in bins:
                total += row_sums(matrix[b], row, n)
            if langs:
                odds = np.exp(total - total.max(axis=1, keepdims=True))
                best = total.argmax(axis=1)
                sure = np.where(letters, 1 / odds.sum(axis=1), 0.0)
                found = np.where(letters, np.array(langs, object)[best], UNDETERMINED)
            else:
                sure, found = np.zeros(n), np.full(n, UNDETERMINED, object)
            keep = [(k, batch.column(k)) for k in batch.schema.names if keep_text or k != column]
            yield pa.RecordBatch.from_pydict(dict(keep) | {"lang_pred": pa.array(found, pa.string()), "score": pa.array(sure, pa.float64())})

    return score


def _shared(docs: DataFrame, model: tuple[list[str], np.ndarray]):
    return model[0], docs.sparkSession.sparkContext.broadcast(model[1])


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id") -> DataFrame:
    """key, lang_pred and score of each row; the text column is `text`."""
    rows = docs.select(F.col(key), F.col("text"))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(_scorer(*_shared(docs, model), "text", False), f"`{key}` {kind}, lang_pred string, score double")


def with_language(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float = 0.0) -> DataFrame:
    """The rows of docs with letters whose language is told with a score of `least` or more; their `lang` becomes that language.

    Each row goes to Python and back once. Columns travel under names of their own, so that docs may have any.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", lang_pred string, score double"
    text = names[docs.columns.index("text")]
    found = rows.mapInArrow(_scorer(*_shared(docs, model), text, True), schema).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return found.select(*(F.col("lang_pred" if c == "lang" else n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out("doc_id", 4, 2)))
    return identify(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
