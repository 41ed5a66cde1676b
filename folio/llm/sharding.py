"""Placement of documents on shards by a permutation-filled lookup table of prime size.

Each shard walks the slots in an order of its own; the shards take turns claiming their next free slot until the table
is full. The table's size is fixed, so its broadcast is too. A key's slot is a hash of its text modulo the size. A
null key goes to the slot of the empty text; equal keys go to one shard.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import documents

#: A prime of about a thousand times the shards: then shares differ by under a percent.
SLOTS = 65_537
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[str]:
    """The shard of each slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards have to be distinct, at least one, and no more than the slots")
    walks = []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        walks.append([int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1 if slots > 1 else 1])
    table: list[str | None] = [None] * slots
    free = slots
    while free:
        for name, walk in zip(shards, walks, strict=True):
            while table[walk[0]] is not None:
                walk[0] = (walk[0] + walk[1]) % slots
            table[walk[0]] = name
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots))


def place(df: DataFrame, key: str, shards: list[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """df with `slot` and `shard`; columns of those names are replaced."""
    spark = df.sparkSession
    table = spark.createDataFrame(list(enumerate(lookup_table(shards, slots))), "slot long, shard string")
    return df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(table), "slot")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return place(docs, "doc_id").select("doc_id", "n_bytes", "slot", "shard")
