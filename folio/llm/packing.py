"""Packing of token sequences: best-fit decreasing into windows of a fixed size.

Documents are tokenised once, where they are read. One longer than a window is first cut into full windows; what is left
of it, and every shorter document, is packed by decreasing length into the open window with the least room
that still holds it, found in a segment tree indexed by remaining room. Documents are dealt into blocks by a hash of
their id, each packed alone in one task, so that no task sees more than a block and a lost executor's blocks
come out the same again. A null text is empty and has the end token alone.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import Rolling, documents, text_slices, utf8

WINDOW = 1024
#: Documents in a block; the padding of a block is about a window.
BLOCK_DOCS = 4096
#: Chunks of text whose ids a worker keeps.
CACHE = 250_000
END_ID = 0

_WHITE = np.zeros(256, bool)
_WHITE[list(b" \t\n\r\f\v")] = True
#: Lead bytes of characters that may be white space beyond ASCII; texts with them aren't cut at the spaces that follow.
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


class Encoder:
    """Ids of the 50k byte-level vocabulary as `tokenizers` gives them from its file without adding special tokens; one that
    stands in a text is that token, as it is there.

    No token spans the border before white space that follows other text, nor that of a special token, so a text is cut
    there; the ids of each distinct chunk are made once per worker and kept by its bytes.
    """

    def __init__(self, path: str | None = None, pattern: str | None = None, specials: dict[str, int] | None = None):
        import public_tokenizers
        import tiktoken

        if specials is None:
            with open(public_tokenizers.path("byte_bpe_50k.json")) as file:
                specials = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        self.specials = {k.encode(): v for k, v in specials.items()}
        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("byte_bpe_50k", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _slot(self, chunk: bytes) -> int:
        """Where the chunk's ids are kept."""
        k = self.known.get(chunk)
        if k is not None:
            return k
        ids, k = [self.specials[chunk]] if chunk in self.specials else self.encode(chunk.decode()), len(self.known)
        if k == len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros(k, np.int64)]) for x in (self.starts, self.lengths))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.known[chunk], self.starts[k], self.lengths[k] = k, self.used, len(ids)
        self.used += len(ids)
        return k

    def _cuts(self, data: np.ndarray, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        """Where chunks start."""
        white = _WHITE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = white[1:] & ~white[:-1]
        # a character of two or three bytes before the cut may be white space itself
        for back in (2, 3):
            cut[back:-1] &= ~_LEADS[data[:-back]]
        cut[offsets[:-1]] = True
        for token in self.specials:
            at = raw.find(token)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right"))
                if at + len(token) <= offsets[row]:  # rows lie side by side
                    cut[at + 1 : at + len(token)] = False
                    cut[at] = cut[at + len(token)] = True
                    at = raw.find(token, at + len(token))
                else:
                    at = raw.find(token, at + 1)
        return np.flatnonzero(cut[:-1])

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and each row's count."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        if len(self.known) > CACHE:
            self.forget()
        raw = data.tobytes()
        start = self._cuts(data, raw, offsets)
        length = np.diff(np.append(start, len(data)))
        _, where, which = np.unique(Rolling(data).at(start, length), return_index=True, return_inverse=True)
        slots = np.array([self._slot(raw[a : a + k]) for a, k in zip(start[where].tolist(), length[where].tolist(), strict=True)], np.int64)
        slot = slots[which]
        # chunks of one hash are of one text, or looked up each for itself
        first = where[which]
        same = length == length[first]
        ends = np.cumsum(length)
        within = np.arange(len(data)) - np.repeat(ends - length, length)
        like = data == data[np.minimum(np.repeat(start[first], length) + within, len(data) - 1)]
        same &= np.logical_and.reduceat(like, start)
        for i in np.flatnonzero(~same).tolist():
            slot[i] = self._slot(raw[start[i] : start[i] + length[i]])
        count = self.lengths[slot]
        ends = np.cumsum(count)
        ids = self.ids[np.repeat(self.starts[slot] - (ends - count), count) + np.arange(ends[-1])]
        row = np.searchsorted(offsets, start, "right") - 1
        return ids, np.bincount(row, weights=count, minlength=n).astype(np.int64)


_encoder: list[Encoder] = []


def encoder() -> Encoder:
    if not _encoder:
        _encoder.append(Encoder())
    return _encoder[0]


def _pieces(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            ids, counts = encoder().batch(*utf8(batch.column("text")))
            n = batch.num_rows
            total = counts + 1
            every = np.empty(len(ids) + n, "<u4")
            ends = np.cumsum(total)
            last = np.zeros(len(every), bool)
            last[ends - 1] = True
            every[last], every[~last] = END_ID, ids
            per = -(-total // window)
            row = np.repeat(np.arange(n), per)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
            start = nth * window
            length = np.minimum(window, total[row] - start)
            tokens = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(np.append(0, np.cumsum(length) * 4).astype(np.int32)), pa.py_buffer(every)])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(row)), "start": pa.array(start), "length": pa.array(length), "doc_tokens": pa.array(total[row]), "tokens": tokens})
        encoder().forget()  # the worker may go on to other work

    return cut


def token_pieces(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, doc_tokens and the piece's ids as little-endian 32-bit `tokens`: full windows, and what is left."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_pieces(window), f"doc_id {kind}, start long, length long, doc_tokens long, tokens binary")


class OpenWindows:
    """Open windows by remaining room 1..size: a segment tree over the rooms counts those below each node."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, window: int) -> None:
        if room:
            self.windows[room].append(window)
            self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node, count = room + self.leaves, self.count
        while node:
            count[node] += by
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """The room and number of the fullest window with room for `length`, no longer open; None if there is none."""
        node, count = length + self.leaves, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._change(room, -1)
        return room, self.windows[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each length, longest first; ties keep their order."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_windows, n = OpenWindows(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        found = open_windows.take(length)
        room, at = found or (window, n)
        n += found is None
        where[i], offset[i] = at, window - room
        open_windows.add(room - length, at)
    return where, offset


def pack(pieces: DataFrame, key: str = "doc_id", window: int = WINDOW, blocks: int = 1) -> DataFrame:
    """pieces (key, start, length of 1 to window, any more columns) with sequence_id, offset and the used `sequence_tokens`.

    sequence_id: the block's number times 2^40 plus the window's number in the block.
    """
    columns = [c for c in pieces.columns if c not in ("_block", "sequence_id", "offset", "sequence_tokens")]
    dealt = pieces.select(*columns).withColumn("_block", F.pmod(F.xxhash64(key), F.lit(max(1, blocks))))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema if f.name != "_block") + ", sequence_id long, offset long, sequence_tokens long"

    def block(number: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([key, "start", *[c for c in columns if c not in (key, "start")]], kind="stable", na_position="first").drop(columns="_block")
        length = rows["length"].to_numpy()
        where, offset = best_fit_decreasing(length, window)
        used = np.bincount(where, weights=length).astype(np.int64)
        return rows.assign(sequence_id=(int(number[0]) << 40) + where, offset=offset, sequence_tokens=used[where])

    return dealt.groupBy("_block").applyInPandas(block, schema)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    pieces = token_pieces(docs).withColumn("ids_crc32", F.crc32("tokens")).drop("tokens")
    return pack(pieces, blocks=-(-docs.count() // BLOCK_DOCS)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens")
