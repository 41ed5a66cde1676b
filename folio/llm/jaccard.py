"""Similarity join of texts on word shingles, by chosen paths.

A text is the set of its runs of five lower-cased words (one of fewer words: that run). Equal texts are one class, which
joins as one set. In each of several runs a set chooses one of its tokens by a seeded least hash; sets that chose
the same token share a bucket, which is split on the next chosen token while it is large. Two sets of similarity s part at
each choice with chance 1 - s, and meet in some run with a chance above RECALL, for s of 0.8 and all splits; RUNS follows from
that. Buckets that are left are compared by brute force: a bucket of any size is cut into blocks, and each pair of
blocks is one tile in one task. A pair counts in the first run in which it meets, so no pairs have to be
written down to tell them apart: tiles give each text its number of links, and a star of links that spans those of the tile.

Sketches (the chosen tokens' low bytes) first rule out tiles and rows that can't have links, far below the
threshold; the texts themselves are then fetched only for rows with a likely link, and compared exactly.

A class goes by a 64-bit hash of its text, so that different texts with one least id stay apart; ids come in at the end.

Null text is empty; texts without words have no links and are each a class of their own, and so are rows with a null id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import Rolling, checkpointed, documents, mix, text_slices, utf8, words

WORDS = 5
SIMILARITY = 0.8
#: Chance that a link of just the least similarity is found although all its buckets were split to the end.
RECALL = 1 - 1e-6
#: A bucket is split while it has more rows than this, but not beyond DEPTH tokens.
BUCKET_ROWS = 256
DEPTH = 3
RUNS = math.ceil(math.log(1 - RECALL) / math.log(1 - SIMILARITY**DEPTH))
#: Buckets with more rows than all rows divided by this get their sizes by a broadcast, of fewer rows than this.
LARGE_BUCKETS = 2000
#: Rows of a block of a large bucket: each of n rows travels n / BLOCK_ROWS times.
BLOCK_ROWS = 512
TOKENS = RUNS * DEPTH
#: Sketches rule a pair out at this many equal tokens or fewer: at a similarity of 0.8 a chance of about 1e-10.
SKETCH_LEAST = int(TOKENS * SIMILARITY - 6.4 * math.sqrt(TOKENS * SIMILARITY * (1 - SIMILARITY)))

_ORDER = np.random.default_rng(11).integers(1, 1 << 63, WORDS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = np.random.default_rng(12).integers(1, 1 << 63, (TOKENS, 2), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of each row's shingles, with repeats, by row."""
    data, offsets = utf8(pc.utf8_lower(text))
    row, start, end = words(data, offsets)
    if not len(row):
        return row, np.zeros(0, np.uint64)
    word = Rolling(data).at(start, end - start)
    n = len(word)
    h, size = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for k in range(min(WORDS, n)):
        on = np.flatnonzero(row[k:] == row[: n - k])
        h[on] += word[on + k] * _ORDER[k]
        size[on] += 1
    first = np.concatenate(([True], row[1:] != row[:-1]))
    keep = (size == WORDS) | first
    return row[keep], mix(h[keep] + size[keep].astype(np.uint64))


def shingle_sets(texts: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each row's distinct shingles, by row and hash; a slice of text at a time."""
    rows, hashes, done = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    for part in text_slices(iter([texts])):
        row, h = shingles(part.column("text"))
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])))[: len(row)]
        rows.append(row[new] + done)
        hashes.append(h[new])
        done += part.num_rows
    return np.concatenate(rows), np.concatenate(hashes)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        row, h = shingles(batch.column("text"))
        tokens = np.zeros((batch.num_rows, TOKENS), "<u4")
        if len(row):
            at = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            for k, (a, b) in enumerate(_SEEDS):
                tokens[row[at], k] = np.minimum.reduceat((h * a + b) >> np.uint64(32), at)
        has = np.isin(np.arange(batch.num_rows), row)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "key": batch.column("key"), "tokens": pa.array([t.tobytes() if ok else None for t, ok in zip(tokens, has, strict=True)], pa.binary())})


def _choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each class and run, with the tokens chosen in it."""
    for batch in batches:
        if batch.num_rows:
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), "<u4").reshape(-1, DEPTH).astype(np.int64)
            run = np.tile(np.arange(RUNS), batch.num_rows)
            node = batch.column("node").take(pa.array(np.repeat(np.arange(batch.num_rows), RUNS)))
            yield pa.RecordBatch.from_arrays([node, pa.array(run, pa.int32()), *(pa.array(np.ascontiguousarray(tokens[:, k])) for k in range(DEPTH))], ["node", "run", *(f"t{k}" for k in range(DEPTH))])


def _with_sizes(rows: DataFrame) -> DataFrame:
    """rows with the size of their bucket, without those that are alone in one. Large buckets' rows stay where they are."""
    sizes = rows.groupBy("path").agg(F.count("*").alias("rows")).where("rows > 1")
    sizes = checkpointed(sizes)
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    # fewer than LARGE_BUCKETS buckets can each hold more than that share of all rows
    large = sizes.where(F.col("rows") > max(BUCKET_ROWS, total // LARGE_BUCKETS))
    marked = rows.join(F.broadcast(large), "path", "left")
    there = F.col("rows").isNotNull()
    return marked.where(there).unionByName(marked.where(~there).drop("rows").join(sizes, "path"))


def leaf_buckets(classes: DataFrame) -> DataFrame:
    """node, run, path and rows of the buckets at which the splitting ends; none of a single row."""
    rows = classes.select("node", "tokens").mapInArrow(_choices, "node long, run int, " + ", ".join(f"t{k} long" for k in range(DEPTH)))
    rows = rows.withColumn("path", F.xxhash64("run", "t0"))
    leaves = None
    for depth in range(1, DEPTH + 1):
        rows = checkpointed(_with_sizes(rows))
        ends = F.lit(True) if depth == DEPTH else F.col("rows") <= BUCKET_ROWS
        done = rows.where(ends).select("node", "run", "path", "rows")
        leaves = done if leaves is None else leaves.unionByName(done)
        if depth < DEPTH:
            rows = rows.where(~ends).withColumn("path", F.xxhash64("path", F.col(f"t{depth}"))).drop("rows")
    return leaves


def tiles(leaves: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of the pairs of blocks of each bucket: path, low, high, node, rep, block, run, n (documents of the class), the class's `paths` of all runs and tokens."""
    own = leaves.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("run", "path"))).alias("by_run"))
    # a pair's first common run is read off the two lists; a run without a bucket of several rows has a null
    own = own.select("node", F.transform(F.sequence(F.lit(0), F.lit(RUNS - 1)), lambda r: F.col("by_run")[r]).alias("paths"))
    full = leaves.join(own.join(classes.select("node", "rep", "key", "n", "tokens"), "node"), "node")
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
    full = full.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    return full.withColumn("_other", other).select("path", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"), "node", "rep", "key", "block", "run", "n", "paths", "tokens")


def _by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of whole tiles: their rows come one after another."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        path, low, high = (batch.column(c).to_numpy() for c in ("path", "low", "high"))
        last = (path == path[-1]) & (low == low[-1]) & (high == high[-1])
        begin = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if begin == 0 and rest:
            p = rest[-1]
            if (p.column("path")[-1].as_py(), p.column("low")[-1].as_py(), p.column("high")[-1].as_py()) == (int(path[0]), int(low[0]), int(high[0])):
                rest.append(batch)
                continue
        whole = [*rest, batch.slice(0, begin)]
        rest = [batch.slice(begin)]
        if any(b.num_rows for b in whole):
            yield pa.Table.from_batches(whole).combine_chunks().to_batches(max_chunksize=1 << 30)[0]
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches(max_chunksize=1 << 30)[0]


def _tile_numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of each row's tile, its block, the paths (rows by runs; 0: none) and sketches."""
    path, low, high, block = (batch.column(c).to_numpy() for c in ("path", "low", "high", "block"))
    tile = np.cumsum(np.concatenate(([False], (path[1:] != path[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))))
    paths = pc.fill_null(pc.list_flatten(batch.column("paths")), 0).to_numpy(zero_copy_only=False).reshape(-1, RUNS)
    tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), "<u4").reshape(-1, TOKENS)
    return tile, block, paths, (tokens & 255).astype(np.uint8)


def _likely_pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the pairs of each tile that first meet in its run and whose sketches don't rule them out."""
    tile, block, paths, sketch = _tile_numbers(batch)
    low, high, run = (batch.column(c).to_numpy() for c in ("low", "high", "run"))
    within = low == high
    nodes = batch.column("node").to_numpy()
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    live, k = np.arange(len(tile)), 1
    while True:
        live = live[live + k < len(tile)]
        live = live[tile[live] == tile[live + k]]
        if not len(live):
            break
        for i in np.array_split(live, max(1, len(live) // 20_000)):
            j = i + k
            ok = (within[i] | (block[i] != block[j])) & (nodes[i] != nodes[j])
            i, j = i[ok], j[ok]
            ok = (sketch[i] == sketch[j]).sum(axis=1) > SKETCH_LEAST
            i, j = i[ok], j[ok]
            met = (paths[i] == paths[j]) & (paths[i] != 0)
            ok = met.argmax(axis=1) == run[i]
            out_i.append(i[ok])
            out_j.append(j[ok])
        k += 1
    return np.concatenate(out_i), np.concatenate(out_j)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _by_tile(batches):
        some = np.zeros(batch.num_rows, bool)
        for rows in _likely_pairs(batch):
            some[rows] = True
        if some.any():
            yield batch.filter(pa.array(some))


def _least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row that each row is linked to, over any number of links."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            return label


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, label (a class it is linked to, the tile's least), links to texts and to documents, from the texts of likely rows."""
    for batch in _by_tile(batches):
        i, j = _likely_pairs(batch)
        if not len(i):
            continue
        row, h = shingle_sets(batch.select(["text"]))
        cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
        size = np.diff(cuts)
        both = _common(row, h, cuts, i, j)
        linked = both >= SIMILARITY * (size[i] + size[j] - both) - 1e-9
        i, j = i[linked], j[linked]
        if not len(i):
            continue
        nodes, n = batch.column("node").to_numpy(), batch.column("n").to_numpy()
        texts = np.bincount(i, minlength=len(n)) + np.bincount(j, minlength=len(n))
        docs = np.bincount(i, weights=n[j], minlength=len(n)) + np.bincount(j, weights=n[i], minlength=len(n))
        by = np.argsort(nodes, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        label = by[_least_labels(len(n), place[i], place[j])][place]
        some = np.flatnonzero(texts)
        yield pa.RecordBatch.from_pydict({"node": pa.array(nodes[some]), "label": pa.array(nodes[label[some]]), "texts": pa.array(texts[some]), "docs": pa.array(docs[some].astype(np.int64))})


def _common(row: np.ndarray, h: np.ndarray, cuts: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the common parts of the sorted sets of rows i and j; rows in many pairs are compared as matrices."""
    out = np.zeros(len(i), np.int64)
    linked = np.unique(np.concatenate([i, j]))
    label = _least_labels(len(linked), np.searchsorted(linked, i), np.searchsorted(linked, j))
    pair_label = label[np.searchsorted(linked, i)]
    order = np.argsort(pair_label, kind="stable")
    ends = np.flatnonzero(np.concatenate((pair_label[order][1:] != pair_label[order][:-1], [True]))) + 1
    for a, b in zip(np.concatenate(([0], ends[:-1])), ends, strict=True):
        pairs = order[a:b]
        members, where = np.unique(np.concatenate([i[pairs], j[pairs]]), return_inverse=True)
        x, y = where[: len(pairs)], where[len(pairs) :]
        if len(members) == 2:
            out[pairs] = len(np.intersect1d(h[cuts[members[0]] : cuts[members[0] + 1]], h[cuts[members[1]] : cuts[members[1] + 1]], assume_unique=True))
            continue
        flat = np.concatenate([h[cuts[m] : cuts[m + 1]] for m in members])
        owner = np.repeat(np.arange(len(members)), cuts[members + 1] - cuts[members])
        _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(count > 1)
        number = np.full(len(count), -1)
        number[shared] = np.arange(len(shared))
        column = number[column]
        owner, column = owner[column >= 0], column[column >= 0]
        order_c = np.argsort(column, kind="stable")
        owner, column = owner[order_c], column[order_c]
        total = np.zeros((len(members), len(members)), np.float32)
        step = 2048
        for first in range(0, len(shared), step):
            p, q = np.searchsorted(column, (first, first + step))
            part = np.zeros((len(members), min(step, len(shared) - first)), np.float32)
            part[owner[p:q], column[p:q] - first] = 1
            total += part @ part.T
        out[pairs] = total[x, y].astype(np.int64)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) from edges a, b. Labels fall along edges and jump to their labels' labels."""
    edges = checkpointed(edges.where("a <> b").select("a", "b").distinct())
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")))
    total = lambda df: df.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
    before = total(labels)
    while before is not None:
        heads = labels.select(F.col("node").alias("b"), F.col("component").alias("_other"))
        near = both.join(heads, "b").groupBy(F.col("a").alias("node")).agg(F.min("_other").alias("_near"))
        lower = labels.join(near, "node").select("node", F.least("component", "_near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("_next"))
        labels = checkpointed(lower.join(jump, "component", "left").select("node", F.least("component", F.coalesce("_next", "component")).alias("component")))
        after = total(labels)
        if after == before:
            break
        before = after
    return labels


def similarity_join(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, class_id (least id of those it is linked to, over any number of links, equal texts among
    them), copy_id (least id of equal texts), n_links (documents that it is linked to) and n_text_links (other texts).

    docs: doc_id (a whole number) and text.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = checkpointed(docs.mapInArrow(_sign, f"doc_id {kind}, key binary, tokens binary"))
    able = F.col("tokens").isNotNull() & F.col("doc_id").isNotNull()
    classes = checkpointed(signed.where(able).groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.min("tokens").alias("tokens")).withColumn("node", F.xxhash64("key")))
    leaves = checkpointed(leaf_buckets(classes))
    tile = ["path", "low", "high"]
    rows = tiles(leaves, classes)
    dealt = lambda df: df.repartition(*tile).sortWithinPartitions(*tile)
    likely = checkpointed(dealt(rows).mapInArrow(_likely, rows.schema))
    texts = likely.select("rep", "key").distinct().join(docs.withColumnRenamed("doc_id", "rep"), ["rep", "key"]).dropDuplicates(["rep", "key"])
    links = checkpointed(dealt(likely.join(texts, ["rep", "key"])).mapInArrow(_compared, "node long, label long, texts long, docs long"))
    linked = links.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    groups = components(links.select(F.col("node").alias("a"), F.col("label").alias("b")))
    least = groups.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("class_id"))
    linked = linked.join(groups, "node").join(least, "component").drop("component")
    found = classes.select("node", "key", "rep", "n").join(linked, "node", "left")
    placed = signed.where(able).select("doc_id", "key").join(found, "key").select(
        "doc_id",
        F.coalesce("class_id", "rep").alias("class_id"),
        F.col("rep").alias("copy_id"),
        (F.coalesce("docs", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"),
    )
    none = F.lit(0).cast("long")
    alone = signed.where(~able).select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), none.alias("n_links"), none.alias("n_text_links"))
    return placed.unionByName(alone)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join(documents(spark, sf_dir))


#: Exact, over all pairs of texts that share a shingle.
OP4_SQL = f"""
with recursive t as (select doc_id, coalesce(text, '') text, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') w from documents),
  c as (select text, min(doc_id) rep, count(*) n, any_value(w) w from t where len(w) > 0 group by text),
  s as (select distinct rep, unnest(case when len(w) < {WORDS} then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) end) g from c),
  z as (select rep, count(*) k from s group by rep),
  p as (select a.rep a, b.rep b, count(*) both_ from s a join s b using (g) where a.rep <> b.rep group by all),
  l as (select p.a, p.b from p join z x on x.rep = a join z y on y.rep = b where both_ >= {SIMILARITY} * (x.k + y.k - both_) - 1e-9),
  r(node, component) as (select a, a from l union select l.b, r.component from r join l on l.a = r.node),
  m as (select node, min(component) component from r group by node),
  k as (select l.a, count(*) texts, sum(c.n) docs from l join c on c.rep = l.b group by l.a)
select t.doc_id, coalesce(m.component, c.rep, t.doc_id) class_id, coalesce(c.rep, t.doc_id) copy_id,
  (coalesce(k.docs, 0) + coalesce(c.n, 1) - 1)::bigint n_links, coalesce(k.texts, 0)::bigint n_text_links
from t left join c on c.text = t.text left join m on m.node = c.rep left join k on k.a = c.rep
"""
