"""Removal of byte strings that repeat: suffixes sorted one bucket at a time, with difference-cover samples.

Only the first `LENGTH` bytes of suffixes matter, so suffixes are dealt to buckets by content: by the least hash
among the short strings within those bytes. Neighbouring suffixes mostly share it and travel as one run of text, about
three bytes a suffix, compressed; equal strings always meet in one bucket, whatever documents they are in. A task sorts
one bucket after another in bounded memory:

1. Positions of the bucket's text whose number modulo 133 is in a difference cover are told apart by their next 68 bytes. For any
   two suffixes some shift below 133 takes both to such positions, so a suffix with none that occurs again there can't repeat.
2. The suffixes that are left, a few in a hundred bytes of ordinary text, are sorted by their first 136 bytes.
3. The cover's positions behind those that are still tied are ranked in byte order, with the bytes that neighbours share. The shift
   that takes two tied suffixes into the cover then tells their order, and whether they are equal to the end, without reading on:
   groups are split about a member of theirs until only equal suffixes are together.

All equality is of bytes; hashes only deal suffixes out and rule them out.

A name with more text than a task sorts at once (copies of one text, a very common line) isn't sorted in its group. Its equal runs
are first made one, those of several places being repeated whole; the suffixes of its different runs are then joined by
a name of 124 bits of their bytes, in any number of tasks.

Null text is empty; texts shorter than LENGTH lose nothing. Equal rows are separate occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import SLICE_BYTES, Rolling, checkpointed, documents, mix, runs, text_slices, utf8

LENGTH = 200
#: Length of the strings whose least hash picks a bucket.
SEED_BYTES = 16
#: Most bytes of bucket text with one name that a task works on, and of all buckets of a group.
SORT_BYTES = 3 << 20
#: Text that is dealt at once: the more, the better its runs compress.
DEAL_BYTES = 4 << 20
GROUP_BYTES = 12 << 20
#: Bytes of a group that are sorted at once, or one name's if that has more: smaller parts stay in a processor's cache.
PART_BYTES = 1 << 19
#: Names that leave their groups are fewer than this, whatever the text: only beyond 1 TB of it do larger ones stay.
HOT_NAMES = 1_000_000
#: Text that goes to buckets for each byte of a document, about.
SPREAD = 3.2


def difference_cover(q: int = 11) -> tuple[int, np.ndarray]:
    """v = q^2 + q + 1 and q + 1 residues such that every residue is a difference of two (q a prime).

    They are the powers of a primitive element of the field of q^3 elements that lie in a plane.
    """
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                x, cover = (1, 0, 0), []
                for i in range(q**3 - 1):
                    if i < v and x[2] == 0:
                        cover.append(i)
                    x = (x[2] * c % q, (x[0] + x[2] * b) % q, (x[1] + x[2] * a) % q)
                    if x == (1, 0, 0):
                        break
                if i == q**3 - 2:
                    return v, np.array(cover)
    raise ValueError("q isn't a prime")


V, COVER = difference_cover()
_IN_COVER = np.zeros(V, bool)
_IN_COVER[COVER] = True
#: The least shift that takes residues i and j into the cover.
SHIFT = np.array([[next(k for k in range(V) if _IN_COVER[(i + k) % V] and _IN_COVER[(j + k) % V]) for j in range(V)] for i in range(V)])


def _sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if width > span else h


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as a number in byte order; those behind the end are 0."""
    out = np.concatenate([data, np.zeros(7, np.uint8)]).astype(np.uint64)
    for size in (1, 2, 4):
        out = (out[:-size] << np.uint64(8 * size)) | out[size:]
    return out


def bucket_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring suffixes with one bucket name: row, start in the row, suffixes, name (64 bits)."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    h = _words(data)[: len(data) - SEED_BYTES + 8 + 1]
    h = h[:-8] * np.uint64(0x9E3779B97F4A7C15) ^ (h[8:] * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(7))
    h = mix(h)
    least = _sliding_least(h, length - SEED_BYTES + 1)
    del h
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    whole = np.arange(len(least)) + length <= offsets[row + 1]
    change = np.concatenate(([True], (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (whole[1:] != whole[:-1])))
    start = np.flatnonzero(change)
    many = np.diff(np.append(start, len(least)))
    start, many = start[whole[start]], many[whole[start]]
    return row[start], start - offsets[row[start]], many, least[start]


#: Bytes by which suffixes are sorted before the cover tells the rest: at least all shifts.
DEEP = -(-V // 8) * 8


def _split(where: np.ndarray, head: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions of groups (head: where one starts) in order of the key within each, groups of one key; those of one member go."""
    apart = np.flatnonzero((key[1:] != key[:-1]) & ~head[1:]) + 1
    if len(apart):
        group = np.cumsum(head) - 1
        mixed = np.zeros(int(group[-1]) + 1, bool)
        mixed[group[apart]] = True
        some = np.flatnonzero(mixed[group])
        order = some[np.lexsort((key[some], group[some]))]
        where, key = where.copy(), key.copy()
        where[some], key[some] = where[order], key[order]
        head = head.copy()
        head[1:] |= key[1:] != key[:-1]
    return _without_single(where, head)


def _without_single(where: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    alone = head & np.append(head[1:], True)
    return where[~alone], head[~alone]


def tied_suffixes(words: np.ndarray, where: np.ndarray, depth: int = DEEP) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose next `depth` bytes occur at several of `where`, in byte order, and where each group of equal ones starts."""
    where = where[np.argsort(words[where], kind="stable")]
    key = words[where]
    where, head = _without_single(where, np.concatenate(([True], key[1:] != key[:-1]))[: len(where)])
    for at in range(8, depth, 8):
        if not len(where):
            break
        where, head = _split(where, head, words[where + at])
    return where, head


#: A word's first so many bytes.
_FIRST = np.array([(1 << 64) - (1 << (8 * (8 - k))) for k in range(9)], np.uint64)


def byte_ranks(words: np.ndarray, at: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each string of `size` bytes (at most `length`) in byte order, and, by rank, how many bytes each shares with the one before it."""
    width = -(-length // 8)
    wide = np.empty((len(at), width + 1), ">u8")
    for t in range(width):
        wide[:, t] = words[np.minimum(at + 8 * t, len(words) - 1)] & _FIRST[np.clip(size - 8 * t, 0, 8)]
    wide[:, width] = size  # a shorter string stands before one that goes on with zeros
    order = np.argsort(wide.view(f"S{8 * width + 8}").ravel(), kind="stable")
    shared = np.zeros(len(at), np.int16)
    for a in range(1, len(at), 1 << 14):
        now = order[a : a + (1 << 14)]
        before = order[a - 1 : a - 1 + len(now)]
        apart = wide[now, :width].astype(np.uint64) ^ wide[before, :width].astype(np.uint64)
        first = (apart != 0).argmax(axis=1)
        gap = apart[np.arange(len(now)), first]
        like = np.where(gap == 0, 8 * width, 8 * first + sum((gap >> np.uint64(8 * k) == 0).astype(np.int64) for k in range(1, 8)))
        shared[a : a + len(now)] = np.minimum(like, np.minimum(size[now], size[before]))
    rank = np.empty(len(at), np.int64)
    rank[order] = np.arange(len(at))
    return rank, shared


def _least_between(values: np.ndarray):
    """A function of the least value from i + 1 to j, for i < j."""
    table = [values]
    while 2 << len(table) <= 2 * len(values):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    starts = np.cumsum([0, *map(len, table)])
    flat = np.concatenate(table)

    def least(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        level = np.frexp(j - i)[1] - 1
        return np.minimum(flat[starts[level] + i + 1], flat[starts[level] + j + 1 - (1 << level)])

    return least


def equal_by_cover(where: np.ndarray, head: np.ndarray, rank: np.ndarray, shared: np.ndarray, length: int) -> np.ndarray:
    """Which of the positions equal another of their group in `length` bytes. Groups (head: where one starts) share their first V - 1 bytes;
    rank holds those of the cover's positions, -1 elsewhere."""
    least = _least_between(shared)
    found, own = np.zeros(len(where), bool), np.arange(len(where))
    while len(where):
        # any member will do to split a group about; one picked by a hash splits it well whatever the order of the text
        group, starts = np.cumsum(head) - 1, np.flatnonzero(head)
        sizes = np.diff(np.append(starts, len(where))).astype(np.uint64)
        about = where[starts + (mix(where[starts].astype(np.uint64)) % sizes).astype(np.int64)][group]
        shift = SHIFT[where % V, about % V]
        i, j = rank[where + shift], rank[about + shift]
        same = i == j
        apart = np.flatnonzero(~same)
        same[apart] = least(np.minimum(i, j)[apart], np.maximum(i, j)[apart]) >= length - shift[apart]
        many = np.bincount(group, weights=same)
        found[own[same & (many[group] > 1)]] = True
        # those before the member that the group is split about, and those behind
        rest = np.flatnonzero(~same)
        key = group[rest] * 2 + (i[rest] > j[rest])
        rest = rest[np.argsort(key, kind="stable")]
        key = np.sort(key, kind="stable")
        head = np.concatenate(([True], key[1:] != key[:-1]))[: len(rest)]
        alone = head & np.append(head[1:], True)[: len(rest)]
        where, own, head = where[rest[~alone]], own[rest[~alone]], head[~alone]
    return found


def _covered(start: np.ndarray, size, n: int) -> np.ndarray:
    """Which of n places lie in a span."""
    edges = np.bincount(start, minlength=n + 1) - np.bincount(start + size, minlength=n + 1)[: n + 1]
    return np.cumsum(edges[:n]) > 0


def repeated(text: np.ndarray, start: np.ndarray, many: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether each suffix of a bucket equals another in its first `length` bytes.

    text: runs' bytes one after another, of many + length - 1 each, beginning at start. The suffixes are the first
    `many` positions of each run, in order.
    """
    context = length - V + 1
    n = int(many.sum())
    position = np.repeat(start - (np.cumsum(many) - many), many) + np.arange(n)
    words = _words(text)
    # 1. the cover's positions; those whose bytes occur once rule suffixes out
    size = many + length - 1
    at = np.flatnonzero(_covered(start, size - context + 1, len(text)) & np.resize(_IN_COVER, len(text)))
    h = np.zeros(len(at), np.uint64)
    for k in [*range(0, context - 8, 8), context - 8]:
        h = mix(h + words[at + k])
    _, which, count = np.unique(h, return_inverse=True, return_counts=True)
    marks = np.zeros(len(text) + 1, np.int32)
    marks[1:] = np.cumsum(np.bincount(at[count[which] > 1], minlength=len(text)))
    able = np.flatnonzero(marks[position + V] > marks[position])
    # 2. the rest by their first bytes
    where, head = tied_suffixes(words, position[able])
    if not len(where):
        return np.zeros(n, bool)
    # 3. ties, by the ranks of the cover's positions behind them
    at = at[_covered(where, V, len(text))[at]]
    ends = np.repeat(start + size, size)[at]
    rank = np.full(len(text), -1, np.int64)
    rank[at], shared = byte_ranks(words, at, np.minimum(ends - at, length), length)
    again = np.zeros(len(text), bool)
    again[where[equal_by_cover(where, head, rank, shared, length)]] = True
    return again[position]


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for size[0], then on."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _name_sizes(least: int, length: int):
    """Names with at least so many bytes of runs in the partition, and these bytes."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, size = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in text_slices(batches, limit=DEAL_BYTES):
            _, _, many, name = bucket_runs(*utf8(batch.column("text")), length)
            every, which = np.unique(np.concatenate([names, name]), return_inverse=True)
            total = np.zeros(len(every), np.int64)
            np.add.at(total, which, np.concatenate([size, many + length - 1]))
            names, size = every, total
        some = size >= least
        yield pa.RecordBatch.from_pydict({"name": pa.array(names[some].view(np.int64)), "size": pa.array(size[some])})

    return sizes


def _deal(groups: int, length: int, hot: np.ndarray):
    """Rows of text to a row for each group of buckets: its runs' bytes and where they come from, compressed. Names in hot are left out."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in text_slices(batches, limit=DEAL_BYTES):
            data, offsets = utf8(batch.column("text"))
            row, start, many, name = bucket_runs(data, offsets, length)
            if len(hot):
                row, start, many, name = (x[~np.isin(name, hot)] for x in (row, start, many, name))
            if not len(row):
                continue
            group = (name % np.uint64(groups)).astype(np.int64)
            order = np.lexsort((start, row, group))
            row, start, many, name, group = (x[order] for x in (row, start, many, name, group))
            keys = batch.column("row_key").to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                r, s, m = row[a:b], start[a:b], many[a:b]
                text = data[_ragged(offsets[r] + s, m + length - 1)]
                distinct, which = np.unique(r, return_inverse=True)
                place = np.concatenate([which, s, m]).astype("<i4").tobytes()
                out.append((int(group[a]), b - a, packer.compress(text.tobytes()), packer.compress(place), keys[distinct].astype("<i8").tobytes(), packer.compress(name[a:b].astype("<u8").tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), *[pa.binary()] * 4), strict=True)], ["bucket", "runs", "text", "place", "keys", "names"])

    return deal


def _sort_group(length: int):
    def sort(rows: pd.DataFrame) -> pd.DataFrame:
        """The runs of dealt rows; each span is of suffixes that repeat, with their bytes."""
        packer = zstandard.ZstdDecompressor()
        texts, keys, names, starts, manys = [], [], [], [], []
        for row in rows.itertuples():
            which, start, many = np.frombuffer(packer.decompress(row.place), "<i4").reshape(3, -1).astype(np.int64)
            texts.append(np.frombuffer(packer.decompress(row.text), np.uint8))
            keys.append(np.frombuffer(row.keys, "<i8")[which])
            names.append(np.frombuffer(packer.decompress(row.names), "<u8"))
            starts.append(start)
            manys.append(many)
        every, all_keys, name, all_starts, all_many = map(np.concatenate, (texts, keys, names, starts, manys))
        del texts
        all_size = all_many + length - 1
        first = np.cumsum(all_size) - all_size
        parts = max(1, int(-(-len(every) // min(SORT_BYTES, PART_BYTES))))
        of = ((name >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
        by = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[by], np.arange(parts + 1))
        spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for part in range(parts):
            mine = by[cuts[part] : cuts[part + 1]]
            if not len(mine):
                continue
            key, start, many, size = all_keys[mine], all_starts[mine], all_many[mine], all_size[mine]
            text = every[_ragged(first[mine], size)]
            found = repeated(text, np.cumsum(size) - size, many, length)
            owner = np.repeat(np.arange(len(many)), many)
            new = np.flatnonzero(found & ~(np.concatenate(([False], found[:-1])) & np.concatenate(([False], owner[1:] == owner[:-1]))))
            last = np.flatnonzero(found & ~(np.concatenate((found[1:], [False])) & np.concatenate((owner[1:] == owner[:-1], [False]))))
            within = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
            spans.append((key[owner[new]], start[owner[new]] + within[new], start[owner[last]] + within[last] + length))
        columns = [np.concatenate(x) for x in zip(*spans, strict=True)] if spans else [np.zeros(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("row_key", "first", "past"), columns, strict=True)))

    return sort


def _hot_runs(length: int, hot: np.ndarray):
    """A row for each different run of a slice of text that has a name in hot; if the slice holds it several times, `n` is 2 and each place a row without text."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=DEAL_BYTES):
            data, offsets = utf8(batch.column("text"))
            row, start, many, name = bucket_runs(data, offsets, length)
            row, start, many = (x[np.isin(name, hot)] for x in (row, start, many))
            if not len(row):
                continue
            at, size = offsets[row] + start, many + length - 1
            ends = np.cumsum(size)
            own = data[_ragged(at, size)]
            one, two = (Rolling(own, seed).at(ends - size, size) for seed in (0, 1))
            _, first, which, count = np.unique(one + mix(two), return_index=True, return_inverse=True, return_counts=True)
            key = batch.column("row_key").to_numpy()[row]
            once = count == 1
            again = np.flatnonzero(~once[which])
            yield pa.RecordBatch.from_pydict({
                "run": pa.array(np.concatenate([one[first], one[again]]).view(np.int64)),
                "more": pa.array(np.concatenate([two[first], two[again]]).view(np.int64)),
                "n": pa.array(np.concatenate([np.where(once, 1, 2), np.zeros(len(again), np.int64)])),
                "many": pa.array(np.concatenate([many[first], many[again]])),
                "text": pa.array([*(data[a : a + n].tobytes() for a, n in zip(at[first], size[first], strict=True)), *[None] * len(again)], pa.binary()),
                "row_key": pa.array(np.concatenate([key[first], key[again]]), mask=np.concatenate([~once, np.zeros(len(again), bool)])),
                "start": pa.array(np.concatenate([start[first], start[again]])),
            })

    return deal


def _suffixes(length: int):
    """Name of each suffix of runs, 2 if the run has several places, and else the suffix's own place."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(whole.column("text")), 0).to_numpy()) if whole.num_rows else []
            first = 0
            while first < whole.num_rows:
                last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + SLICE_BYTES, "right")))
                batch, first = whole.slice(first, last - first), last
                text = np.frombuffer(b"".join(batch.column("text").to_pylist()), np.uint8)
                size = pc.binary_length(batch.column("text")).to_numpy().astype(np.int64)
                many = size - length + 1
                at = _ragged(np.cumsum(size) - size, many)
                name, more = (Rolling(text, seed).at(at, np.int64(length)).view(np.int64) for seed in (0, 1))
                run = np.repeat(np.arange(len(many)), many)
                within = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
                start = pc.fill_null(batch.column("start"), 0).to_numpy()
                take = pa.array(run)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(more), batch.column("n").take(take), batch.column("row_key").take(take), pa.array(start[run] + within)], ["name", "more", "n", "row_key", "first"])

    return names


def _hot_spans(docs: DataFrame, length: int, hot: np.ndarray) -> DataFrame:
    """The spans of suffixes with a name in hot; no task holds all runs or suffixes of a name."""
    dealt = checkpointed(docs.mapInArrow(_hot_runs(length, hot), "run long, more long, n long, many long, text binary, row_key long, start long"))
    whole = lambda df: df.select("row_key", F.col("start").alias("first"), (F.col("start") + F.col("many") + length - 1).alias("past"))
    # a run comes once from a slice, so that its list of places has one of each slice at most
    places = F.collect_list(F.when(F.col("row_key").isNotNull(), F.struct("row_key", "start"))).alias("places")
    different = checkpointed(dealt.where("n > 0").groupBy("run", "more").agg(F.least(F.sum("n"), F.lit(2).cast("long")).alias("n"), F.first("many").alias("many"), F.first("text").alias("text"), places))
    among = different.where("n > 1").select("many", F.explode("places").alias("place")).select("many", "place.*")
    own = F.when(F.col("n") == 1, F.col("places")[0])
    suffixes = different.select("n", "text", own["row_key"].alias("row_key"), own["start"].alias("start")).mapInArrow(_suffixes(length), "name long, more long, n long, row_key long, first long")
    again = suffixes.groupBy("name", "more").agg(F.sum("n").alias("total")).where("total > 1").select("name", "more")
    single = suffixes.where("n = 1").join(again, ["name", "more"]).select("row_key", "first", (F.col("first") + length).alias("past"))
    return whole(dealt.where("n = 0")).unionByName(whole(among)).unionByName(single)


def repeat_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """row_key, first and past (bytes; spans of one row may overlap) of the strings that occur elsewhere too.

    docs: text and row_key, a long that only equal rows share.
    """
    total, partitions = docs.select(F.octet_length("text").cast("long").alias("size"), F.spark_partition_id().alias("part")).agg(F.sum("size"), F.count_distinct("part")).first()
    groups = max(1, int(-(-(total or 0) * SPREAD // GROUP_BYTES)))
    # a name's bytes in partitions where it has fewer than these aren't counted: less than `most` in all
    most = max(SORT_BYTES, int((total or 0) * SPREAD / HOT_NAMES))
    sizes = docs.select("text").mapInArrow(_name_sizes(most // max(1, partitions), length), "name long, size long")
    large = sizes.groupBy("name").agg(F.sum("size").alias("size")).where(F.col("size") > most).collect()
    hot = np.array([r["name"] for r in large], np.int64).view(np.uint64)
    dealt = docs.select("row_key", "text").mapInArrow(_deal(groups, length, hot), "bucket long, runs long, text binary, place binary, keys binary, names binary")
    spans = dealt.groupBy("bucket").applyInPandas(_sort_group(length), "row_key long, first long, past long")
    return spans.unionByName(_hot_spans(docs, length, hot)) if len(hot) else spans


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        sizes, removed, kept = [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            raw = np.frombuffer(text.encode(), np.uint8)
            edges = np.zeros(len(raw) + 1, np.int32)
            for s in spans or ():
                edges[s["first"]] += 1
                edges[s["past"]] -= 1
            gone = np.cumsum(edges[:-1]) > 0
            sizes.append(len(raw))
            removed.append([{"first": int(a), "past": int(b)} for a, b in zip(*runs(gone), strict=True)])
            kept.append(raw[~gone].tobytes())
        span = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "removed": pa.array(removed, span), "kept": pa.array(kept, pa.binary())})


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, the maximal `removed` spans of bytes and the bytes `kept` of each row's text."""
    rows = docs.select("doc_id", "text").withColumn("row_key", F.xxhash64("doc_id", "text"))
    spans = checkpointed(repeat_spans(rows, length))
    # equal rows share a key and have the same spans, each of which is kept once
    spans = spans.groupBy("row_key").agg(F.collect_set(F.struct("first", "past")).alias("spans"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    joined = rows.join(spans, "row_key", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_without, f"doc_id {kind}, n_bytes long, removed array<struct<first: long, past: long>>, kept binary")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(documents(spark, sf_dir))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["past"] - s["first"])
    return out.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
