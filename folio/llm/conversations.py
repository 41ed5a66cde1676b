"""Repair of conversations whose rows were dropped, emptied, cut, repeated or given to the wrong role.

A repair is a path through a lattice: a layer for each row, and in it four nodes, for what the roles so far end with (nothing, system,
user, assistant). Keep, Rerole and Delete lead to the next layer, Insert to another node of the same one. An auction finds the least
costs to the end, last layer first: from each node of a layer a path is extended along its cheapest arc while the node's price
equals what that arc asks, and else the price is raised to it and the path contracted; it ends where it leaves the layer, as prices
behind are final. Prices of a layer start at the least price of the next one, which leaves all reduced costs non-negative. What
the auction does depends on the row's class and the differences of the next layer's prices alone; there are few of these, so each is
auctioned once (`layers`). The arcs without reduced cost are then traced from the start, the least letter first: a letter leads
from a node to just one node, so the trace is the least of the cheapest audits.

Rows are sorted by conversation and turn over all tasks. A conversation that lies within a task and has at most `BLOCK` rows is
repaired there. One that is longer or reaches over a task's border goes by blocks of its rows: a block is a map from the prices behind it to
those before it, and from its first node to its last one; these small maps are composed by conversation, and the blocks then
traced side by side. Only its text's hash is made by reading its rows in order, a batch at a time.

Nulls are one space. Rows of one turn go by role, then text; equal rows count as repeated. Columns beside the four aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import bounded_batches, checkpointed

#: Rows of a conversation that a task holds at once.
BLOCK = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
WHITE = " \t\n\v\f\r"
INITIALS = "sua"
#: What a node's roles end with leads, by the next initial, to another node; other initials are illegal there.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLE_AT = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}
#: Class 0 has to be deleted; the others are an initial (or another one) and whether the row is truncated.
CLASSES = 1 + 2 * (len(INITIALS) + 1)


def row_class(initial: str, kind: str) -> int:
    if kind in ("blank", "duplicate"):
        return 0
    return 1 + 2 * (INITIALS.find(initial) if initial and initial in INITIALS else len(INITIALS)) + (kind == "truncated")


def arcs_of(row: int, node: int) -> list[tuple[str, int, int]]:
    """Letter, cost and next node of the arcs that lead from a node over a row."""
    out = [("D", DELETE, node)]
    if row:
        initial, extra = (*INITIALS, "")[(row - 1) // 2], TRUNCATED * ((row - 1) % 2)
        if initial in NEXT[node]:
            out.append(("K", KEEP + extra, NEXT[node][initial]))
        out += [("R", REROLE + extra, NEXT[node][i]) for i in "ua" if i in NEXT[node]]
    return out


def inserts_of(node: int) -> list[int]:
    return [NEXT[node][i] for i in "ua" if i in NEXT[node]]


def auction(leaving: list[int | None]) -> list[int]:
    """The least costs to the end of a layer's nodes, given those over the arcs that leave it."""
    price = [min(x for x in leaving if x is not None)] * len(leaving)
    for origin in range(len(leaving)):
        path = [origin]
        while True:
            node = path[-1]
            offers = [(INSERT + price[to], to) for to in inserts_of(node)]
            if leaving[node] is not None:
                offers.append((leaving[node], -1))
            asked, to = min(offers)
            if price[node] < asked:
                price[node] = asked
                if len(path) > 1:
                    path.pop()
            elif to < 0:
                break
            else:
                path.append(to)
    return price


def _words(price: list[int], leaving: list[list[tuple[str, int, int]]]) -> list[tuple[str, int]]:
    """For each node the least letters along arcs without reduced cost until the layer is left, and the node they lead to."""
    words: list[tuple[str, int]] = []
    for start in range(len(price)):
        node, word, letter = start, "", "I"
        while letter == "I":
            tight = [(name, to) for name, cost, to in leaving[node] if cost == price[node]]
            tight += [("I", to) for to in inserts_of(node) if INSERT + price[to] == price[node]]
            letter, node = min(tight)
            word += letter
        words.append((word.rstrip("."), node))
    return words


class Layers:
    """Differences of prices (numbered), and what a row of each class before them makes of them."""

    def __init__(self) -> None:
        end = [[(".", 0, 0)], [], [], [(".", 0, 3)]]
        price = auction([0, None, None, 0])
        #: Letters at the end from each node.
        self.last = _words(price, end)
        self.prices: list[tuple[int, ...]] = [tuple(price)]
        self.before: list[list[int]] = []
        self.rise: list[list[int]] = []
        self.words: list[list[list[tuple[str, int]]]] = []
        number = {self.prices[0]: 0}
        for behind in self.prices:
            before, rise, words = [], [], []
            for row in range(CLASSES):
                leaving = [[(letter, cost + behind[to], to) for letter, cost, to in arcs_of(row, node)] for node in range(4)]
                price = auction([min(x[1] for x in arcs) for arcs in leaving])
                least = min(price)
                shape = tuple(p - least for p in price)
                if shape not in number:
                    number[shape] = len(self.prices)
                    self.prices.append(shape)
                before.append(number[shape])
                rise.append(least)
                words.append(_words(price, leaving))
            self.before.append(before)
            self.rise.append(rise)
            self.words.append(words)


@cache
def layers() -> Layers:
    return Layers()


def behind_each(rows: list[int], last: int = 0) -> tuple[list[int], int, int]:
    """The number of the prices behind each row, of those before all, and how much the least price rises over them."""
    of, out, rise = layers(), [], 0
    for row in reversed(rows):
        out.append(last)
        rise += of.rise[last][row]
        last = of.before[last][row]
    return out[::-1], last, rise


def traced(rows: list[int], behind: list[int], node: int = 0) -> tuple[list[tuple[str, int]], int]:
    """Letters and first node of each row, and the node behind all."""
    words, out = layers().words, []
    for row, prices in zip(rows, behind, strict=True):
        word, to = words[prices][row][node]
        out.append((word, node))
        node = to
    return out, node


def repaired_lines(word: str, node: int, role: str, text: str) -> list[str]:
    """The lines that a row's letters make of it."""
    lines = []
    for letter in word:
        if letter == "I":
            node = inserts_of(node)[0]
            lines.append(f"{ROLE_AT[node]}:")
        elif letter == "K":
            lines.append(f"{role}:{text}")
        elif letter == "R":
            lines.append(f"{ROLE_AT[inserts_of(node)[0]]}:{text}")
    return lines


def repair(turns: list[int | None], roles: list[str], texts: list[str], kinds: list[str]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit and hash of a conversation whose rows are in order."""
    seen: set[tuple[str, str]] = set()
    told = []
    for role, text, kind in zip(roles, texts, kinds, strict=True):
        told.append("duplicate" if kind != "blank" and (role, text) in seen else kind)
        seen.add((role, text))
    rows = [row_class(role[:1], kind) for role, kind in zip(roles, told, strict=True)]
    behind, before, rise = behind_each(rows)
    words, node = traced(rows, behind)
    lines = [line for (word, at), role, text in zip(words, roles, texts, strict=True) for line in repaired_lines(word, at, role, text)]
    end = layers().last[node][0]
    lines += repaired_lines(end, node, "", "")
    known = [t for t in turns if t is not None]
    illegal = sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:], strict=False))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    cost = rise + layers().prices[before][0]
    return gaps, told.count("blank"), told.count("duplicate"), told.count("truncated"), illegal, cost, "".join(w for w, _ in words) + end, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of conversations after damage by a checksum of `conv_id:turn`, with `kind`; a dropped row stays, of kind dropped, without role and text."""
    space = F.lit(" ")
    of = lambda c: F.coalesce(F.col(c).cast("string"), space)
    fault = F.crc32(F.concat(of("conv_id"), F.lit(":"), of("turn"))) % 20
    rows = conversations.select("conv_id", "turn", of("role").alias("role"), of("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).when(F.col("fault") != 0, F.col("text"))
    role = F.when(F.col("fault") == 4, "user").when(F.col("fault") != 0, F.col("role"))
    times = F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    kind = F.when(F.col("text").isNull(), "dropped").when(bare == "", "blank").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("fine")
    return rows.withColumn("kind", kind)


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
LOOSE = ["turn", "role", "text", "kind", "block", "place"]


def _by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the conversations that lie within the task's sorted rows, and the rows of the others with their block and place."""
    base = TaskContext.get().partitionId() << 40
    state = {"place": base, "block": base, "conv": None, "open": False, "loose": True, "in_block": 0}
    held: list[tuple] = []
    schema: pa.Schema | None = None

    def loose(rows: list[tuple]) -> dict[str, list]:
        out = {c: [] for c in ["conv_id", *RESULT, *LOOSE]}
        for turn, role, text, kind in rows:
            there = kind != "dropped"  # the places of a block's rows have no holes
            if state["in_block"] == BLOCK:
                state["block"], state["in_block"] = state["block"] + 1, 0
            values = {"conv_id": state["conv"], "turn": turn, "role": role, "text": text, "kind": kind, "block": state["block"], "place": state["place"] if there else None}
            for c, column in out.items():
                column.append(values.get(c))
            state["place"] += there
            state["in_block"] += there
        return out

    def finished(rows: list[tuple]) -> dict[str, list]:
        rows = [r for r in rows if r[3] != "dropped"]
        result = repair(*map(list, zip(*rows, strict=True))) if rows else repair([], [], [], [])
        return {"conv_id": [state["conv"]]} | {c: [x] for c, x in zip(RESULT, result, strict=True)} | {c: [None] for c in LOOSE}

    for batch in batches:
        if schema is None:
            kind = batch.schema.field("conv_id").type
            turn = batch.schema.field("turn").type
            types = [kind, *[pa.int64()] * 6, pa.string(), pa.string(), turn, pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            schema = pa.schema(list(zip(["conv_id", *RESULT, *LOOSE], types, strict=True)))
        made: dict[str, list] = {c: [] for c in schema.names}

        def add(more: dict[str, list], made: dict[str, list] = made) -> None:
            for c, column in made.items():
                column.extend(more[c])

        for conv, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "kind")), strict=True):
            if not state["open"] or conv != state["conv"]:
                if state["open"] and not state["loose"]:
                    add(finished(held))
                # the first one may have begun in another task
                state |= {"loose": not state["open"], "open": True, "conv": conv, "block": state["block"] + 1, "in_block": 0}
                held = []
            held.append(tuple(row))
            if state["loose"] or len(held) > BLOCK:
                state["loose"] = True
                add(loose(held))
                held = []
        yield pa.RecordBatch.from_pydict(made, schema)
    if schema is not None:  # the last one may go on in another task
        yield pa.RecordBatch.from_pydict(loose(held), schema)


def _block_map(block: pd.DataFrame) -> pd.DataFrame:
    """What a block of rows makes of the prices behind it and of its first node."""
    block = block.sort_values("place")
    rows, initials, of = block["row"].tolist(), block["initial"].tolist(), layers()
    before, rise, leave = [], [], []
    for last in range(len(of.prices)):
        behind, first, rises = behind_each(rows, last)
        before.append(first)
        rise.append(rises)
        leave += [traced(rows, behind, node)[1] for node in range(4)]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    values = {"conv_id": block["conv_id"].iloc[0], "block": block["block"].iloc[0], "first_place": block["place"].iloc[0], "rows": bytes(rows), "before": before, "rise": rise, "leave": leave, "illegal": illegal, "first": initials[0], "last": initials[-1]}
    return pd.DataFrame({k: [v] for k, v in values.items()})


def _composed(blocks: pd.DataFrame) -> pd.DataFrame:
    """Prices behind each block of a conversation and its first node; the whole's cost and illegal pairs."""
    blocks = blocks.sort_values("block").reset_index(drop=True)
    last, cost, behind = 0, 0, []
    for before, rise in zip(blocks["before"][::-1], blocks["rise"][::-1], strict=True):
        behind.append(last)
        cost += int(rise[last])
        last = int(before[last])
    behind, node, first = behind[::-1], 0, []
    for prices, leave in zip(behind, blocks["leave"], strict=True):
        first.append(node)
        node = int(leave[4 * prices + node])
    borders = blocks["last"].shift().iloc[1:] + blocks["first"].iloc[1:]
    illegal = int(blocks["illegal"].sum()) + int((~borders.isin(LEGAL)).sum())
    return blocks[["conv_id", "block"]].assign(behind=behind, node=first, cost=cost + layers().prices[last][0], illegal=illegal)


def _edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for first, rows, last, node in zip(batch["first_place"], batch["rows"], batch["behind"], batch["node"], strict=True):
            words, _ = traced(list(rows), behind_each(list(rows), int(last))[0], int(node))
            yield pd.DataFrame({"place": np.arange(first, first + len(words)), "word": [w for w, _ in words], "node": [n for _, n in words]})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and hash of conversations whose edited rows come in order; a batch of text is held at a time."""
    conv, open_, node, audit, digest, empty = None, False, 0, [], hashlib.sha256(), True
    schema = None

    def put(lines: list[str]) -> None:
        nonlocal empty
        if lines:
            digest.update((("" if empty else "\n") + "\n".join(lines)).encode())
            empty = False

    def closed() -> pa.RecordBatch:
        end = layers().last[node][0]
        put(repaired_lines(end, node, "", ""))
        return pa.RecordBatch.from_pydict({"conv_id": [conv], "audit": ["".join(audit) + end], "repaired_sha256": [digest.hexdigest()]}, schema)

    for batch in batches:
        schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        for of, role, text, row, word, at in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "row", "word", "node")), strict=True):
            if not open_ or of != conv:
                if open_:
                    yield closed()
                conv, open_, node, audit, digest, empty = of, True, 0, [], hashlib.sha256(), True
            put(repaired_lines(word, at, role, text))
            audit.append(word)
            for letter in word:
                node = next(to for name, _, to in arcs_of(row, node) if name == letter) if letter != "I" else inserts_of(node)[0]
    if open_:
        yield closed()


def _long_ones(rows: DataFrame, kind: str) -> DataFrame:
    """Results of the conversations whose rows have block and place."""
    rows = rows.select("conv_id", *LOOSE)
    there = rows.where("kind != 'dropped'")
    same = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    firsts = there.groupBy("conv_id", same.alias("same")).agg(F.min("place").alias("place")).select("place", F.lit(True).alias("is_first"))
    there = there.join(firsts, "place", "left")
    told = F.when((F.col("kind") != "blank") & F.col("is_first").isNull(), "duplicate").otherwise(F.col("kind"))
    initial = F.substring("role", 1, 1)
    at = F.instr(F.lit(INITIALS), initial)
    number = F.when(told.isin("blank", "duplicate"), 0).otherwise(1 + 2 * F.when((initial != "") & (at > 0), at - 1).otherwise(len(INITIALS)) + (told == "truncated").cast("int"))
    there = checkpointed(there.select("conv_id", "block", "place", "turn", "role", "text", initial.alias("initial"), told.alias("told"), number.cast("int").alias("row")))
    blocks = checkpointed(
        there.select("conv_id", "block", "place", "row", "initial")
        .groupBy("block")
        .applyInPandas(_block_map, f"conv_id {kind}, block long, first_place long, rows binary, before array<int>, rise array<long>, leave array<int>, illegal long, first string, last string")
    )
    plan = checkpointed(blocks.drop("rows", "first_place").groupBy("conv_id").applyInPandas(_composed, f"conv_id {kind}, block long, behind int, node int, cost long, illegal long"))
    edits = blocks.select("block", "first_place", "rows").join(plan.select("block", "behind", "node"), "block").mapInPandas(_edits, "place long, word string, node int")
    ordered = there.select("conv_id", "place", "role", "text", "row").join(edits, "place").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    hashed = ordered.mapInArrow(_hashed, f"conv_id {kind}, audit string, repaired_sha256 string")
    zero = F.lit(0).cast("long")
    distinct = F.count_distinct("turn")
    parts = (
        rows.select("conv_id").distinct()
        .unionByName(there.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - distinct, zero).alias("gaps"), *[F.count_if(F.col("told") == k).alias(k) for k in ("blank", "duplicate", "truncated")]), allowMissingColumns=True)
        .unionByName(plan.groupBy("conv_id").agg(F.max("cost").alias("cost"), F.max("illegal").alias("illegal")), allowMissingColumns=True)
        .unionByName(hashed, allowMissingColumns=True)
    )
    return parts.groupBy("conv_id").agg(*[F.coalesce(F.max(c), zero).cast("long").alias(c) for c in RESULT[:6]], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def repaired(rows: DataFrame) -> DataFrame:
    """gaps, faults, cost, audit and hash of each conversation of rows (conv_id, turn, role, text, kind as `damaged` gives them)."""
    bounded_batches(rows.sparkSession)
    kind, turn = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    # equal rows of one conversation may be more than a task should have, so they are dealt by a number too
    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.select(*order, "kind", F.monotonically_increasing_id().alias("_n")).repartitionByRange(*order, "_n").sortWithinPartitions(*order).drop("_n")
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, turn {turn}, role string, text string, kind string, block long, place long"
    parts = checkpointed(dealt.mapInArrow(_by_task, schema))
    return parts.where("block is null").select("conv_id", *RESULT).unionByName(_long_ones(parts.where("block is not null"), kind).select("conv_id", *RESULT))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
