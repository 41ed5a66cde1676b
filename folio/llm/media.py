"""Media columns: bytes kept in baseline JPEG files, and what a DC-only decoder reads from them.

A payload byte is the mean of one 8 x 8 block: with a quantiser of 8, the block's quantised DC coefficient is the
byte less 128, exactly, and all other coefficients are 0. So the luminance thumbnail of the picture, a pixel a block, is the
payload. The reader is a general baseline one: it parses the markers, Huffman-decodes every restart interval of a
batch of like files side by side in numpy, skips AC coefficients, and keeps the luminance DC values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import documents, text_slices, utf8

#: Blocks in a row of blocks; payloads are padded to a positive multiple of it.
ROW = 192
PAD = 32
#: Rows of blocks that a JPEG's 16-bit height can hold; a longer payload goes on in the next picture of the same stream.
MAX_ROWS = 65_535 // 8
_QUANTISER = 8
#: Code lengths 1 to 16 and symbols of the DC luminance table of the JPEG standard (ITU-T T.81, table K.3).
DC_LENGTHS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_SYMBOLS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]
#: The AC table has the end of a block alone, as the one-bit code 0.
AC_LENGTHS = [1] + [0] * 15
AC_SYMBOLS = [0]


def _codes(lengths: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """Code and its length of each symbol, in canonical order."""
    out, code, k = {}, 0, 0
    for size, count in enumerate(lengths, 1):
        for _ in range(count):
            out[symbols[k]] = (code, size)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits of a block by its DC difference + 255: the category's code, the difference, the end of the block."""
    dc, (eob, eob_size) = _codes(DC_LENGTHS, DC_SYMBOLS), _codes(AC_LENGTHS, AC_SYMBOLS)[0]
    bits, sizes = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for diff in range(-255, 256):
        category = abs(diff).bit_length()
        code, size = dc[category]
        value = diff if diff >= 0 else diff + (1 << category) - 1
        bits[diff + 255] = ((code << category | value) << eob_size) | eob
        sizes[diff + 255] = size + category + eob_size
    return bits, sizes


_BITS, _SIZES = _block_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    return b"\xff\xd8" + b"".join(
        (
            _segment(0xDB, b"\0" + bytes([_QUANTISER] * 64)),
            _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + b"\x01\x11\0"),
            _segment(0xC4, b"\0" + bytes(DC_LENGTHS) + bytes(DC_SYMBOLS)),
            _segment(0xC4, b"\x10" + bytes(AC_LENGTHS) + bytes(AC_SYMBOLS)),
            _segment(0xDD, struct.pack(">H", ROW)),
            _segment(0xDA, b"\x01\x01\0\0\x3f\0"),
        )
    )


def encode(payload: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """JPEG streams of payloads that lie one after another, of `counts` rows of ROW bytes each."""
    samples = payload.reshape(-1, ROW).astype(np.int64) - 128
    diff = samples.copy()
    diff[:, 1:] -= samples[:, :-1]
    bits, sizes = _BITS[diff + 255], _SIZES[diff + 255]
    used = sizes.sum(axis=1)
    n_bytes = (used + 7) >> 3
    first = np.cumsum(n_bytes) - n_bytes
    at = (np.cumsum(sizes, axis=1) - sizes) + (first << 3)[:, None]
    byte = (at >> 3).ravel()
    window = (bits << (24 - (at & 7) - sizes)).ravel()
    total = int(n_bytes.sum())
    out = np.zeros(total + 3, np.int64)
    for k in range(3):
        out[k : k + total + 1] += np.bincount(byte, weights=(window >> (16 - 8 * k)) & 255, minlength=total + 1)[: total + 1].astype(np.int64)
    out = out[:total].astype(np.uint8)
    out[first + n_bytes - 1] |= ((1 << (n_bytes * 8 - used)) - 1).astype(np.uint8)  # an interval ends in ones
    # a byte of ones is followed by a zero; between intervals stands a marker, counted from 0 in each picture
    owner = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    lasts = np.zeros(len(owner), bool)
    lasts[np.cumsum(counts) - 1] = True
    marked = ~lasts & ((nth + 1) % MAX_ROWS != 0)
    wide = np.ones(total, np.int64)
    wide[out == 255] = 2
    wide[first + n_bytes - 1] += 2 * marked
    place = np.cumsum(wide) - wide
    stream = np.zeros(int(wide.sum()), np.uint8)
    stream[place] = out
    after = place[(first + n_bytes - 1)[marked]] + 1 + (out[(first + n_bytes - 1)[marked]] == 255)
    stream[after] = 255
    stream[after + 1] = 0xD0 + (nth[marked] % MAX_ROWS) % 8
    row_start = np.append(place[first], len(stream))
    files, row = [], 0
    for count in counts.tolist():
        parts = []
        for a in range(row, row + count, MAX_ROWS):
            b = min(a + MAX_ROWS, row + count)
            parts += [_header(b - a), stream[row_start[a] : row_start[b]].tobytes(), b"\xff\xd9"]
        files.append(b"".join(parts))
        row += count
    return files


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """One picture's frame, tables and scan, from its start marker on; and where the next one begins."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of an image")
    out: dict = {"quantisers": {}, "tables": {}, "restart": 0}
    at += 2
    while True:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out["quantisers"][body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                lengths = tuple(body[1:17])
                out["tables"][body[0] >> 4, body[0] & 15] = (lengths, tuple(body[17 : 17 + sum(lengths)]))
                body = body[17 + sum(lengths) :]
        elif marker == 0xC0:
            out["height"], out["width"] = struct.unpack(">HH", body[1:5])
            out["components"] = tuple((body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3))
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("not a baseline JPEG")
        elif marker == 0xDD:
            out["restart"] = int.from_bytes(body, "big")
        elif marker == 0xDA:
            out["scan"] = tuple((body[i], body[i + 1] >> 4, body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2))
            break
    end = data.find(b"\xff\xd9", at)
    out["begin"], out["end"] = at, len(data) if end < 0 else end
    return out, out["end"] + 2


def _lookup(lengths: tuple[int, ...], symbols: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Length and symbol of the code that 16 bits begin with; length 0 where none does."""
    size, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for s, (code, n) in _codes(list(lengths), list(symbols)).items():
        size[code << (16 - n) : (code + 1) << (16 - n)], symbol[code << (16 - n) : (code + 1) << (16 - n)] = n, s
    return size, symbol


class _Lanes:
    """Restart intervals read side by side, each at a bit position of its own."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        padded = np.concatenate([data, np.full(8, 255, np.uint8)]).astype(np.uint64)
        self.word = np.zeros(len(data) + 1, np.uint64)
        for k in range(5):
            self.word |= padded[k : k + len(data) + 1] << np.uint64(32 - 8 * k)
        self.bit = starts.astype(np.int64) << 3

    def peek(self, lanes, n: np.ndarray | int) -> np.ndarray:
        """The next n (up to 16) bits of these lanes."""
        bit = self.bit[lanes]
        word = self.word[np.minimum(bit >> 3, len(self.word) - 1)]
        return ((word >> (np.uint64(40) - (bit & 7).astype(np.uint64) - np.asarray(n).astype(np.uint64))) & ((np.uint64(1) << np.asarray(n).astype(np.uint64)) - np.uint64(1))).astype(np.int64)

    def symbol(self, lanes, table) -> np.ndarray:
        bits = self.peek(lanes, 16)
        size = table[0][bits]
        if not size.all():
            raise ValueError("a code that the table doesn't have")
        self.bit[lanes] += size
        return table[1][bits]


def _decode_alike(files: list[tuple[bytes, dict]]) -> list[np.ndarray]:
    """Luminance DC means, a value a block, of pictures with the same tables, components and width."""
    info = files[0][1]
    scan = info["scan"]
    factors = {c: (h, v, q) for c, h, v, q in info["components"]}
    alone = len(scan) == 1
    h_max, v_max = max(h for h, _, _ in factors.values()), max(v for _, v, _ in factors.values())
    plan = [(j, dc, ac) for j, (c, dc, ac) in enumerate(scan) for _ in range(1 if alone else factors[c][0] * factors[c][1])]
    tables = {key: _lookup(*t) for key, t in info["tables"].items()}
    lum_h, lum_v, lum_q = factors[scan[0][0]]
    units_across = -(-info["width"] // (8 if alone else 8 * h_max))
    intervals, lengths, units, where = [], [], [], []
    for k, (data, own) in enumerate(files):
        raw = np.frombuffer(data, np.uint8)[own["begin"] : own["end"]]
        many = units_across * -(-own["height"] // (8 if alone else 8 * v_max))
        marks = np.flatnonzero((raw[:-1] == 255) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7))
        keep = np.ones(len(raw), bool)
        keep[np.flatnonzero((raw[:-1] == 255) & (raw[1:] == 0)) + 1] = False
        keep[marks] = keep[marks + 1] = False
        bounds = np.concatenate(([0], marks, [len(raw)]))
        sizes = np.add.reduceat(keep, bounds[:-1]).astype(np.int64) if len(raw) else np.zeros(1, np.int64)
        intervals.append(raw[keep])
        lengths.append(sizes)
        step = own["restart"] or many
        units.append(np.minimum(step, many - np.arange(len(sizes)) * step))
        where.append(np.full(len(sizes), k))
    units, where, sizes = np.concatenate(units), np.concatenate(where), np.concatenate(lengths)
    lanes = _Lanes(np.concatenate(intervals), np.cumsum(sizes) - sizes)
    out = np.zeros((len(units), int(units.max()), sum(j == 0 for j, _, _ in plan)), np.int64)
    before = np.zeros((len(scan), len(units)), np.int64)
    for unit in range(out.shape[1]):
        live = np.flatnonzero(units > unit)
        every = slice(None) if len(live) == len(units) else live
        nth = 0
        for j, dc, ac in plan:
            category = lanes.symbol(every, tables[0, dc])
            value = lanes.peek(every, category)
            lanes.bit[every] += category
            before[j][every] += np.where(value < (1 << category) >> 1, value - (1 << category) + 1, value)
            if j == 0:
                out[every, unit, nth] = before[0][every]
                nth += 1
            at, open_ = np.ones(len(live), np.int64), np.arange(len(live))
            while len(open_):
                these = every if len(open_) == len(live) else live[open_]
                both = lanes.symbol(these, tables[1, ac])
                lanes.bit[these] += both & 15
                at[open_] += np.where(both == 0, 64, (both >> 4) + 1)
                open_ = open_[at[open_] < 64]
    means = np.clip((out * info["quantisers"][lum_q] + 4 >> 3) + 128, 0, 255).astype(np.uint8)
    pictures = []
    for k, (_, own) in enumerate(files):
        mine = np.flatnonzero(where == k)
        flat = np.concatenate([means[i, : units[i]] for i in mine]) if len(mine) > 1 and units[mine[-1]] != units[mine[0]] else means[mine][:, : units[mine[0]]].reshape(-1, means.shape[2])
        across, down = (1, 1) if alone else (lum_h, lum_v)
        grid = flat.reshape(-1, units_across, down, across).transpose(0, 2, 1, 3).reshape(-1, units_across * across)
        wide = -(-(-(-own["width"] * lum_h // h_max)) // 8)
        high = -(-(-(-own["height"] * lum_v // v_max)) // 8)
        pictures.append(grid[:high, :wide])
    return pictures


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """The luminance thumbnail, a byte a block, of each stream; the pictures of one stream must be of one width and are stacked."""
    groups, parts = defaultdict(list), defaultdict(list)
    for k, data in enumerate(streams):
        at = 0
        while at < len(data):
            info, after = parse(data, at)
            groups[info["width"], info["components"], info["scan"], tuple(sorted(info["tables"].items())), tuple(sorted(info["quantisers"].items())), info["restart"]].append((k, at, data, info))
            at = after
    for alike in groups.values():
        for (k, at, _, _), grid in zip(alike, _decode_alike([(data, info) for _, _, data, info in alike]), strict=True):
            parts[k].append((at, grid))
    return [np.concatenate([grid for _, grid in sorted(parts[k], key=lambda x: x[0])]) for k in range(len(streams))]


def average_hash(grid: np.ndarray, side: int = 8) -> str:
    """64 bits, in hex: which cells of a side x side reduction are lighter than their mean."""
    grid = grid.astype(np.float64)
    for axis in (0, 1):
        n = grid.shape[axis]
        edges = np.arange(side + 1) * n // side
        sums = np.concatenate([np.zeros_like(grid.take([0], axis)), np.cumsum(grid, axis=axis)], axis=axis)
        low, high = edges[:-1], np.maximum(edges[1:], edges[:-1] + 1)
        width = (high - low).reshape((-1, 1) if axis == 0 else (1, -1))
        grid = (sums.take(high, axis) - sums.take(low, axis)) / width
    return f"{int(''.join('01'[int(x)] for x in (grid > grid.mean() + 1e-9).ravel()), 2):016x}"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        data, offsets = utf8(batch.column("text"))
        size = np.diff(offsets)
        rows = np.maximum(1, -(-size // ROW))
        payload = np.full(int(rows.sum()) * ROW, PAD, np.uint8)
        shift = (np.cumsum(rows) - rows) * ROW - offsets[:-1]
        payload[np.arange(len(data)) + np.repeat(shift, size)] = data
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(size), "media": pa.array(encode(payload, rows), pa.binary())})


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        sizes = np.cumsum(whole.column("n_bytes").to_numpy()) if whole.num_rows else []
        first = 0
        while first < whole.num_rows:
            last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + (2 << 20), "right")))
            batch, first = whole.slice(first, last - first), last
            media = batch.column("media").to_pylist()
            grids = decode(media)
            payloads = [g.tobytes() for g in grids]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": batch.column("n_bytes"),
                    "width": pa.array([g.shape[1] * 8 for g in grids], pa.int32()),
                    "height": pa.array([g.shape[0] * 8 for g in grids], pa.int64()),
                    "payload_bytes": pa.array(map(len, payloads), pa.int64()),
                    "payload_sha256": [hashlib.sha256(p).hexdigest() for p in payloads],
                    "tail_crc32": pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()),
                    "media_bytes": pa.array(map(len, media), pa.int64()),
                    "media_sha256": [hashlib.sha256(m).hexdigest() for m in media],
                    "thumbnail_hash": [average_hash(g) for g in grids],
                }
            )


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the JPEG stream `media` of each text's payload; null text is empty."""
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(_store, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Dimensions, digests and thumbnail hash, from the stored bytes alone."""
    rows = media.select("doc_id", "n_bytes", "media")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_read, f"doc_id {kind}, n_bytes long, width int, height long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, thumbnail_hash string")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = media_features(media_column(documents(spark, sf_dir)))
    feature = F.concat(F.col("width"), F.lit("x"), F.col("height"), F.lit(":"), F.col("thumbnail_hash"))
    return features.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
