"""Repair of conversations against a plain search over all edits, by task and by blocks."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from folio.llm import conversations as c

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, place string, kind string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (1 + (code == 3))
    return out


def fix(rows):
    """Contract's columns of one conversation's damaged rows, by a search from the end that keeps the cheapest, then least audit of each place and end of roles."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, kinds = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, end, inserts):
        found = []
        if i == len(rows) and end in ("", "a"):
            found.append((0, "", ()))

        def put(cost, letter, line, rest):
            if rest:
                found.append((cost + rest[0], letter + rest[1], ((line,) if line else ()) + rest[2]))

        for r in follow[end]:
            if r != "s" and inserts < 4:
                put(3, "I", {"u": "user:", "a": "assistant:"}[r], best(i, r, inserts + 1))
        if i < len(rows):
            put(4, "D", None, best(i + 1, end, 0))
            if kinds[i] not in ("blank", "duplicate"):
                extra, (_, _, role, text) = 3 * (kinds[i] == "truncated"), rows[i]
                if role[:1] and role[:1] in follow[end]:
                    put(extra, "K", f"{role}:{text}", best(i + 1, role[:1], 0))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if r in follow[end]:
                        put(3 + extra, "R", f"{name}:{text}", best(i + 1, r, 0))
        return min(found, default=None)

    cost, audit, lines = best(0, "", 0)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def brute(rows):
    kept = {}
    for r in damage(rows):
        kept.setdefault(r[0], []).append(r)
    return {conv: fix(kept.get(conv, [])) for conv in {r[0] for r in rows}}


def got(df):
    return {r["conv_id"]: tuple(r[k] for k in c.RESULT) for r in df.select("conv_id", *c.RESULT).collect()}


def made(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.choice([1, 2, 5, longest])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No", " \t\n", "", None, "Why?", "été!\v", "same text.", f"row {turn}.", "x" * 50, "Go! \x1c"])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), role, text, "p", "k"))
    return rows


@pytest.mark.parametrize(("seed", "block", "parts"), [(1, 4096, 1), (2, 4096, 5), (3, 4, 4), (4, 1, 1), (5, 7, 1)])
def test_against_brute_force(spark, monkeypatch, seed, block, parts):
    rows = made(seed, 60, 40)
    monkeypatch.setattr(c, "BLOCK", block)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        found = got(c.repaired(c.damaged(spark.createDataFrame(rows, SCHEMA))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = brute([r[:4] for r in rows])
    assert found.keys() == want.keys()
    assert {k: (found[k], want[k]) for k in want if found[k] != want[k]} == {}


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(c.op13_conversations(spark, SF)) == brute(rows)


def test_one_long_conversation_and_many_equal_rows(spark):
    rows = [(7, t, "user" if t % 2 else "assistant", f"text {t}.") for t in range(9000)] + [(8, None, "user", "same.")] * 6000 + [(9, 1, "user", "x. " * 200_000)]
    found = got(c.repaired(c.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    kept = damage([r for r in rows if r[0] == 7])
    assert found[7][:2] == (max(r[1] for r in kept) - min(r[1] for r in kept) + 1 - len({r[1] for r in kept}), len([r for r in kept if not r[3]]))
    # the parts of the long one, cut where a cheapest path may be cut, can't be cheaper than it
    assert found[7][6].count("D") * 4 + (found[7][6].count("I") + found[7][6].count("R")) * 3 <= found[7][5]
    assert found[8][2] == len(damage(rows[9000:15000])) - 1
    assert found[8][6].replace("D", "") in ("KI", "IK") or found[8][6].strip("D") == ""


def test_empty_table(spark):
    assert got(c.repaired(c.damaged(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))) == {}


def test_prices_are_least_costs():
    """Each layer's prices against a relaxation to the fixed point."""
    of = c.layers()
    for behind, before, rise in zip(of.prices, of.before, of.rise, strict=True):
        for row in range(c.CLASSES):
            price = [min(cost + behind[to] for _, cost, to in c.arcs_of(row, node)) for node in range(4)]
            for _ in range(8):
                price = [min([price[node], *(c.INSERT + price[to] for to in c.inserts_of(node))]) for node in range(4)]
            assert [rise[row] + p for p in of.prices[before[row]]] == price
