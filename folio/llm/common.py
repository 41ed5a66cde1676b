"""What several of these operators share: reading, lineage cuts, and numpy views of Arrow text."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text is worked on in slices of about so many bytes, which bounds a Python worker's memory.
SLICE_BYTES = 1 << 19


#: Rows that Spark hands a Python worker at once; texts are long.
BATCH_ROWS = 500


def bounded_batches(spark: SparkSession) -> None:
    """Keeps the buffers between Spark and its Python workers small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder that the session names; a session on one machine, as in tests, gets a folder of its own if it names none."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="folio-checkpoint-")
        spark.sparkContext.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def held_out(column: str, modulus: int, remainder: int):
    """True for rows whose crc32(column as text) leaves the remainder."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus == remainder, F.lit(False))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about `limit` bytes of text; a longer row is alone. Null text becomes empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        text = pc.fill_null(batch.column(at).cast(pa.string()), "")
        batch = batch.set_column(at, pa.field(column, pa.string()), text)
        ends = utf8(text)[1][1:]
        first = 0
        while first < len(ends):
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(first, last - first)
            first = last
    pa.default_memory_pool().release_unused()  # the worker may go on to other work


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without nulls, and the offsets of its rows in them."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Rolling hashes are polynomials modulo this prime, for two bases at once. (Modulo 2^64 there would be ordinary texts that
#: hash alike whatever the base.)
_PRIME = (1 << 31) - 1
_SHIFT, _LOW = np.uint64(31), np.uint64(_PRIME)
_BASES = {0: (1_586_398_421, 1_017_372_683), 1: (1_879_460_057, 733_907_161)}
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    """A smaller number of the same remainder."""
    return (x & _LOW) + (x >> _SHIFT)


def _least_remainder(x: np.ndarray) -> np.ndarray:
    x = _fold(_fold(x))
    return np.where(x >= _LOW, x - _LOW, x)


def _powers_to(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of base and of its inverse up to n."""
    if base not in _powers or len(_powers[base][0]) < n:
        size, made = max(n, 1 << 16), []
        for b in (base, pow(base, -1, _PRIME)):
            out = np.ones(size, np.uint64)
            have = 1
            while have < size:  # the powers so far times the next one
                more = min(have, size - have)
                out[have : have + more] = _least_remainder(out[:more] * np.uint64(pow(b, have, _PRIME)))
                have += more
            made.append(out)
        _powers[base] = made[0], made[1]
    return _powers[base]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Hashes (62 bits, spread over 64) of any substrings of `data`, in constant time each. Another `seed` gives independent ones."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        self.parts = []
        for k, base in enumerate(_BASES[seed]):
            values = np.random.default_rng((seed, k)).integers(1, _PRIME, 256, dtype=np.int64).astype(np.uint64)
            powers, inverse = _powers_to(len(data) + 1, base)
            sums = np.empty(len(data) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_fold(values[data] * powers[: len(data)]), out=sums[1:])
            self.parts.append((sums, inverse))

    def at(self, start: np.ndarray, length) -> np.ndarray:
        end = start + length
        one, two = (_least_remainder(_fold(_fold(sums[end] - sums[start])) * inverse[start]) for sums, inverse in self.parts)
        return mix(((one << _SHIFT) | two) + np.asarray(length).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edges[::2], edges[1::2]


_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\f\v")] = True


def words(data: np.ndarray, offsets: np.ndarray, letter: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each word: a run of bytes that are no ASCII white space, or of the bytes that `letter` marks. Rows end words."""
    inside = ~_SPACE[data] if letter is None else letter[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    bounds = offsets[(offsets > 0) & (offsets < len(data))]
    first[bounds] = inside[bounds]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[bounds - 1] = inside[bounds - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(offsets, start, "right") - 1, start, end


def row_sums(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sums of values (first axis) by ascending row, for rows 0 to n-1."""
    out = np.zeros((n, *values.shape[1:]), np.float64)
    if len(row):
        at = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        out[row[at]] = np.add.reduceat(values, at, axis=0, dtype=np.float64)
    return out
