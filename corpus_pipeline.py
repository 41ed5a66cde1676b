"""The corpus pipeline: language identification, near-duplicate removal, redaction, mixing, packing.

Each stage works on all that the one before kept. All but the last return the columns of `documents`; a mixed corpus may hold
a document several times (its epochs), and its pieces then come as often.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import jaccard, language, mixing, packing, personal
from folio.llm.common import bounded_batches, checkpointed, documents

#: A document is rejected if it has no letters, or its language is less sure than this.
LEAST_SCORE = 0.5


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; `lang` becomes that language."""
    bounded_batches(spark)
    model = language.fit(docs.select("doc_id", "text", "lang"))
    return language.with_language(docs, model, LEAST_SCORE)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near or exact copies: that of the group's least id. Rows without an id come after all others.

    Rows go by a hash of all their columns, so that rows that share an id or have none are told apart; of equal rows, one.
    """
    bounded_batches(spark)
    columns = docs.columns
    # maps have no hash, but a text
    values = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    # hashes pass over nulls, so they are told where these are
    rows = docs.withColumn("_row", F.xxhash64(*values, *(v.isNull() for v in values)))
    groups = jaccard.similarity_join(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "class_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first")
    keep = groups.distinct().join(rows.select("_row", "doc_id").distinct(), "_row").groupBy("class_id").agg(first).select("first._row")
    return rows.join(keep, "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    bounded_batches(spark)
    return personal.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    bounded_batches(spark)
    return mixing.mixed_texts(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    bounded_batches(spark)
    pieces = packing.token_pieces(docs.select("doc_id", "text")).withColumn("ids_crc32", F.crc32("tokens")).drop("tokens")
    return packing.pack(pieces, blocks=-(-docs.count() // packing.BLOCK_DOCS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", by_language),
    ("near_duplicates", one_of_each),
    ("personal_data", redacted),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's result is written to the checkpoint folder before the next."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs


#: Trained models and tokenizers aren't expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None
