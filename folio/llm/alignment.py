"""Alignment of two tokenizers over a corpus: which ids of one overlap which ids of the other, and in how many documents.

A is the byte-level vocabulary over a space and the text, B the piece vocabulary over the text (it puts the space before by
itself). No token of either spans the border between a character that is no white space and the space behind it, so a text is
cut there, and a chunk's ids, groups and links are made once for each distinct chunk and worker. Offsets where tokens of both
end cut the tokens into groups; within a group the links are those of a merge, so that a chunk of a A tokens, b B tokens and g
groups has a + b - g of them.

Counting takes the identity map first: the B id of the same bytes as an A id, made once from the vocabularies. A link of an id
with its image is counted in vectors as long as the vocabulary, all others by pair. Sums of these (map-side first) are the counts
of documents. Looking them up goes the same way: images, and pairs that hold at least one of `HOT_SHARE` of all counts, so that
there are at most that many, come from a broadcast table; only what is left enters a shuffle of pairs.

A row is a document of its own, whatever its id. Texts null or empty, and those whose tokens' bytes aren't a space and the text, have no
tokens: zeros, and an empty string for a hash. Equal rows count as often as they come. Columns beside doc_id and text aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import bounded_batches, checkpointed, documents, text_slices

#: Bits of a B id in a pair; the A id is above them.
B_BITS = 15
#: Pairs of at least one in so many of all counts are broadcast.
HOT_SHARE = 1 << 18
#: A worker forgets its chunks beyond so many of them, or so many bytes.
CACHE, CACHE_BYTES = 300_000, 32 << 20
#: Pairs that a task gathers before it counts them.
GATHER = 1 << 21


#: White space before a space belongs to one chunk with it, as does a space at the start.
_HELD = re.compile(r"\s ")


def chunks_of(text: str) -> list[str]:
    """A space and the text, cut before each space that follows a character that is no white space; chunks come without their first space."""
    parts = text.split(" ")
    if text[0] != " " and not _HELD.search(text):
        return parts
    out, held = [], []
    for part in parts:
        held.append(part)
        if part and not part[-1].isspace():
            out.append(" ".join(held))
            held = []
    return [*out, " ".join(held)] if held else out


def merged(ids_a: list[int], ids_b: list[int], length_a: list[int], length_b: list[int]) -> tuple[str, int, list[int]]:
    """The groups as text, their number, and the pairs of all tokens that overlap; both sides have the same number of bytes."""
    groups, pairs, i, j = [], [], 0, 0
    while i < len(ids_a):
        a, b = ids_a[i], ids_b[j]
        i, j = i + 1, j + 1
        pairs.append(a << B_BITS | b)
        ahead = length_a[a] - length_b[b]
        if not ahead:
            groups.append(f"{a}|{b}")
            continue
        from_a, from_b = i - 1, j - 1
        while ahead:
            if ahead < 0:
                a = ids_a[i]
                i, ahead = i + 1, ahead + length_a[a]
            else:
                b = ids_b[j]
                j, ahead = j + 1, ahead - length_b[b]
            pairs.append(a << B_BITS | b)
        groups.append(",".join(map(str, ids_a[from_a:i])) + "|" + ",".join(map(str, ids_b[from_b:j])))
    return ";".join(groups), len(groups), pairs


class Vocabularies:
    """Both tokenizers, the bytes of their ids, and the identity map."""

    def __init__(self) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode_a = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        self.model, self.alone = model, [model.piece_to_id("▁")]
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, k in ranks.items():
            self.bytes_a[k] = token
        self.bytes_b = [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, model.id_to_piece(k)) for k in range(model.get_piece_size()))]
        first: dict[bytes, int] = {}
        for k, token in enumerate(self.bytes_b):
            if not model.is_byte(k) and not model.is_control(k) and not model.is_unknown(k):
                first.setdefault(token, k)
        self.length_a, self.length_b = [len(x) for x in self.bytes_a], [len(x) for x in self.bytes_b]
        #: The B id of the same bytes for each A id; -1 for none.
        self.same = np.array([first.get(token, -1) for token in self.bytes_a], np.int64)

    def encode_b(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks; the model puts their first space before them."""
        return [ids or self.alone for ids in self.model.encode(chunks, num_threads=1)]

    def is_same(self, pairs: np.ndarray) -> np.ndarray:
        return self.same[pairs >> B_BITS] == (pairs & ((1 << B_BITS) - 1))


class Aligner:
    """Sums and links of texts, by chunks that are aligned once and kept."""

    def __init__(self, vocabularies: Vocabularies):
        self.of = vocabularies
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.sums = array("q")  # n_a, n_b, n_groups, whether the bytes are right, of each chunk
        self.starts, self.pairs = array("q", [0]), array("q")
        self.kept_bytes = 0

    def _learn(self, chunks: list[str]) -> None:
        of = self.of
        for chunk, ids_b in zip(chunks, of.encode_b(chunks), strict=True):
            ids_a, raw = of.encode_a(" " + chunk), b" " + chunk.encode()
            if b"".join([of.bytes_a[k] for k in ids_a]) == raw == b"".join([of.bytes_b[k] for k in ids_b]):
                groups, n, pairs = merged(ids_a, ids_b, of.length_a, of.length_b)
                self.sums.extend((len(ids_a), len(ids_b), n, 1))
            else:
                groups, pairs = "", []
                self.sums.extend((0, 0, 0, 0))
            self.known[chunk] = len(self.groups)
            self.groups.append(groups)
            self.pairs.extend(pairs)
            self.starts.append(len(self.pairs))
            self.kept_bytes += len(raw) + len(groups) + 8 * len(pairs)

    def batch(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups (a row each); the groups' hashes; and row, pair and number of each row's different links."""
        if len(self.known) > CACHE or self.kept_bytes > CACHE_BYTES:
            self.forget()
        known, groups = self.known, self.groups
        chunks = [chunks_of(text) if text else [] for text in texts]
        slots = [list(map(known.get, row)) for row in chunks]
        new = [k for k, row in enumerate(slots) if None in row]
        self._learn(list({c for k in new for c, s in zip(chunks[k], slots[k], strict=True) if s is None}))
        for k in new:
            slots[k] = [known[c] for c in chunks[k]]
        slots = [np.array(row, np.int64) for row in slots]
        right = np.frombuffer(self.sums, np.int64)[3::4]
        slots = [x if right[x].all() else x[:0] for x in slots]
        del right
        sizes = [len(x) for x in slots]
        hashes = [hashlib.sha256(";".join([groups[s] for s in mine.tolist()]).encode()).hexdigest() if len(mine) else "" for mine in slots]
        row, slot = np.repeat(np.arange(len(texts)), sizes), np.concatenate([np.zeros(0, np.int64), *slots])
        each = np.frombuffer(self.sums, np.int64).reshape(-1, 4)[slot, :3] if len(slot) else np.zeros((0, 3), np.int64)
        sums = np.stack([np.bincount(row, weights=each[:, k], minlength=len(texts)).astype(np.int64) for k in range(3)], 1)
        # a row's different chunks, then their links
        (key, times), n = np.unique(row * len(groups) + slot, return_counts=True), max(1, len(groups))
        row, slot = key // n, key % n
        starts = np.frombuffer(self.starts, np.int64)
        length = starts[slot + 1] - starts[slot]
        ends = np.cumsum(length)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length - starts[slot], length)
        pairs = np.frombuffer(self.pairs, np.int64)[at] if len(at) else np.zeros(0, np.int64)
        link, which = np.unique(np.repeat(row, length) << (B_BITS + 17) | pairs, return_inverse=True)
        number = np.bincount(which, weights=np.repeat(times, length), minlength=len(link)).astype(np.int64)
        return sums, hashes, link >> (B_BITS + 17), link & ((1 << (B_BITS + 17)) - 1), number


_made: list[Aligner] = []


def aligner() -> Aligner:
    if not _made:
        _made.append(Aligner(Vocabularies()))
    return _made[0]


def _lists(row: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """A list a row of values that come by row."""
    offsets = np.append(0, np.cumsum(np.bincount(row, minlength=n))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 40
    for batch in text_slices(batches):
        n = batch.num_rows
        sums, hashes, row, pair, times = aligner().batch(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_pydict(
            {
                "row": pa.array(np.arange(number, number + n)),
                "doc_id": batch.column("doc_id"),
                "n_a": pa.array(sums[:, 0]),
                "n_b": pa.array(sums[:, 1]),
                "n_groups": pa.array(sums[:, 2]),
                "groups_sha256": pa.array(hashes, pa.string()),
                "pairs": _lists(row, pair, n),
                "times": _lists(row, times, n),
            }
        )
        number += n


def aligned(docs: DataFrame) -> DataFrame:
    """row (a number of its own), doc_id, n_a, n_b, n_groups, groups_sha256 and the different linked `pairs` with how often each is linked."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_aligned, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of = aligner().of
    vector = np.zeros(len(of.same), np.int64)
    others: list[np.ndarray] = []

    def counts(pair: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"pair": pa.array(pair), "docs": pa.array(docs)})

    for batch in batches:
        pairs = batch.column("pairs").flatten().to_numpy(zero_copy_only=False)
        same = of.is_same(pairs)
        vector += np.bincount(pairs[same] >> B_BITS, minlength=len(vector))
        others.append(pairs[~same])
        if sum(map(len, others)) > GATHER:
            yield counts(*np.unique(np.concatenate(others), return_counts=True))
            others = []
    if others:
        yield counts(*np.unique(np.concatenate(others), return_counts=True))
    seen = np.flatnonzero(vector)
    yield counts(seen << B_BITS | of.same[seen], vector[seen])


def link_counts(rows: DataFrame) -> DataFrame:
    """pair, a_id, b_id, docs (rows that hold the pair linked) and is_best (none of that a_id has more)."""
    counts = rows.select("pairs").mapInArrow(_counted, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    counts = counts.select("pair", F.shiftright("pair", B_BITS).alias("a_id"), F.col("pair").bitwiseAND((1 << B_BITS) - 1).alias("b_id"), "docs")
    counts = checkpointed(counts)
    best = counts.groupBy("a_id").agg(F.max("docs").alias("most"))  # at most a row an A id
    return counts.join(F.broadcast(best), "a_id").select("pair", "a_id", "b_id", "docs", (F.col("docs") == F.col("most")).alias("is_best"))


def _looked_up(table):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, docs, best = table.value
        for batch in batches:
            n, lists, times = batch.num_rows, batch.column("pairs"), batch.column("times").flatten().to_numpy(zero_copy_only=False)
            row, pairs = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(pair, pairs), max(0, len(pair) - 1))
            found = pair[at] == pairs if len(pair) else np.zeros(len(pairs), bool)
            sums, cold = np.zeros((2, n), np.int64), ~found
            np.add.at(sums[0], row[found], times[found] * best[at[found]])
            np.add.at(sums[1], row[found], times[found] * docs[at[found]])
            columns = {c: batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")}
            yield pa.RecordBatch.from_pydict(columns | {"hot_best": pa.array(sums[0]), "hot_sum": pa.array(sums[1]), "pairs": _lists(row[cold], pairs[cold], n), "times": _lists(row[cold], times[cold], n)})

    return look


def align(docs: DataFrame, hot_share: int = HOT_SHARE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links that are their A id's most common ones), count_sum (their counts) and groups_sha256, a row a document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = checkpointed(aligned(docs))
    counts = checkpointed(link_counts(rows))
    of = aligner().of
    total = counts.agg(F.sum("docs")).first()[0] or 0
    same = spark.createDataFrame([(k,) for k in (np.flatnonzero(of.same >= 0) << B_BITS | of.same[of.same >= 0]).tolist()], "pair long")
    is_hot = F.col("docs") * hot_share >= total
    # images are at most as many as A ids, hot pairs at most hot_share
    table = counts.where(is_hot).unionByName(counts.where(~is_hot).join(F.broadcast(same), "pair", "left_semi")).select("pair", "docs", "is_best").toArrow()
    order = np.argsort(table["pair"].to_numpy())
    hot = spark.sparkContext.broadcast(tuple(table[c].to_numpy()[order].astype(np.int64) for c in ("pair", "docs", "is_best")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    looked = rows.mapInArrow(_looked_up(hot), f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, hot_best long, hot_sum long, pairs array<long>, times array<long>")
    cold = looked.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    found = cold.join(counts.where(~is_hot).select("pair", "docs", "is_best"), "pair")
    sums = found.groupBy("row").agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("cold_best"), F.sum(F.col("times") * F.col("docs")).alias("cold_sum"))
    none = F.lit(0).cast("long")
    return (
        looked.drop("pairs", "times")
        .join(sums, "row", "left")
        .select(
            "doc_id",
            "n_a",
            "n_b",
            "n_groups",
            (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links"),
            (F.col("hot_best") + F.coalesce("cold_best", none)).alias("n_best"),
            (F.col("hot_sum") + F.coalesce("cold_sum", none)).alias("count_sum"),
            "groups_sha256",
        )
    )


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))
