"""Repair of conversations: tables against every repair there is, and whole conversations against a plain dynamic programme."""

import hashlib
import random
import re
import zlib

import pytest

from tests.harness import compare, connect
from vigilia.llm import turn_repair as tr

SCHEMA = "conv_id long, turn long, role string, text string, c string, seg string"


def all_repairs(rows, limit):
    """(cost, audit, roles) of every repair up to a cost; rows are (initial, truncated, gone)."""
    found = []

    def go(i, cost, audit, roles):
        if cost > limit:
            return
        if i == len(rows):
            found.append((cost, audit, roles))
        for r in "ua":
            go(i, cost + 2, audit + "I", roles + r)
        if i < len(rows):
            initial, cut, gone = rows[i]
            go(i + 1, cost + 3, audit + "D", roles)
            if not gone:
                go(i + 1, cost + cut, audit + "K", roles + initial)
                for r in "ua":
                    go(i + 1, cost + 2 + cut, audit + "R", roles + r)

    go(0, 0, "", "")
    return found


def test_table_is_the_least_of_all_repairs():
    rnd = random.Random(5)
    for _ in range(60):
        symbols = "".join(rnd.choice("suaoSUAOX") for _ in range(rnd.randint(0, 3)))
        rows = [(s.lower(), s.isupper(), s == "X") for s in symbols]
        sound = [(c, a) for c, a, r in all_repairs(rows, 9) if re.fullmatch("(s?(ua)+)?", r)]
        assert min(tr.table(symbols)["0" + e] for e in tr.ENDS if "0" + e in tr.table(symbols)) == min(sound), symbols


def plain(symbols):
    """Forward over rows and states, insertions to a fixed point."""
    now = {"0": (0, "")}
    for k in range(len(symbols) + 1):
        for _ in range(4):
            for state, (c, a) in list(now.items()):
                for r in "ua":
                    to = tr.NEXT[state].get(r)
                    if to:
                        now[to] = min(now.get(to, (1e9, "")), (c + 2, a + "I"))
        if k == len(symbols):
            return min(now[e] for e in tr.ENDS if e in now)
        after = {}
        for state, (c, a) in now.items():
            for to, more, letter in tr.edits(symbols[k], state):
                after[to] = min(after.get(to, (1e9, "")), (c + more, a + letter))
        now = after


@pytest.mark.parametrize("size", [1, 7, tr.BLOCK, tr.BLOCK + 1, 1000])
def test_blocks_compose(size):
    rnd = random.Random(size)
    for _ in range(5):
        symbols = "".join(rnd.choice("suaoSUAOXuaua") for _ in range(size))
        whole = tr.table(symbols)
        assert min(whole["0" + e] for e in tr.ENDS if "0" + e in whole) == plain(symbols)
        cuts = sorted(rnd.sample(range(size + 1), min(3, size)))
        parts = [symbols[a:b] for a, b in zip([0, *cuts], [*cuts, size]) if a < b]
        cost, path = tr.best_path([tr.table(p) for p in parts])
        assert (cost, "".join(a for _, a in path)) == plain(symbols)


def slow(rows):
    """conv_id -> the report, for rows (conv_id, turn, role, text) after damage."""
    import xxhash

    signed = lambda x: x - 2**64 if x >= 2**63 else x
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), signed(xxhash.xxh64_intdigest(r[2].encode(), 42))))
        seen, symbols, blank, dup, cut = set(), "", 0, 0, 0
        for _, role, text in mine:
            bare = text.strip(" \t\n\x0b\x0c\r")
            b, d = not bare, (role, text) in seen
            t = not b and not d and bare[-1] not in ".!?"
            blank, dup, cut = blank + b, dup + (d and not b), cut + t
            seen.add((role, text))
            s = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols += "X" if b or d else s.upper() if t else s
        cost, audit = plain(symbols)
        state, lines, i = "0", [], 0
        for letter in audit:
            if letter != "I":
                _, role, text = mine[i]
                i += 1
            if letter == "D":
                continue
            if letter == "K":
                state = tr.NEXT[state][role[0]]
            else:
                state = next(tr.NEXT[state][r] for r in "ua" if r in tr.NEXT[state])
                role = tr.ROLES[state]
            lines.append(f"{role}:{'' if letter == 'I' else text}")
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out[conv] = (gaps, blank, dup, cut, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(repair):
    digests = {r["c"]: r["repaired_sha256"] for r in repair.digests().collect()}
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    empty = hashlib.sha256(b"").hexdigest()
    return {None if r["c"] == " " else int(r["c"]): (*[r[n] for n in names], digests.get(r["c"], empty)) for r in repair.reports().collect()}


def odd_rows(seed, conversations, length):
    rnd = random.Random(seed)
    texts = [None, "", " \t\n", "Yes.", "No!", "cut short", "cut ", "why? \r\n", "é", "漢字。", "x" * 3000, "a.b"]
    rows = []
    for c in [None, *range(conversations)]:
        for _ in range(rnd.randint(1, length)):
            row = (c, rnd.choice([None, *range(-2, length)]), rnd.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "User", "sys"]), rnd.choice(texts))
            rows += [row] * rnd.choice([1, 1, 1, 2, 5])
    return rows


@pytest.mark.parametrize("conversations,length", [(40, 9), (2, 700)])
def test_odd_conversations(spark, conversations, length):
    rows = odd_rows(length, conversations, length)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that a conversation lies in several ranges
    try:
        repair = tr.Repair(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5))
        assert got(repair) == slow(rows)
        segments = repair.plan.groupBy("c").count().agg({"count": "max"}).first()[0]
        assert segments > 1 or conversations > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_many_copies_and_no_rows(spark):
    rows = [(1, 1, "user", "Hi.")] * 3000 + [(1, 2, "assistant", "Ho.")] + [(1, None, "system", "")] * 2000
    assert got(tr.Repair(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA))) == slow(rows)
    assert tr.Repair(spark.createDataFrame([], SCHEMA)).digests().count() == 0


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 3, "user", "cut"), (1, 4, "robot", "Fine.")]
    out = tr.Repair(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)).turns().orderBy("seg", "place").collect()
    assert [(r["edit"], r["role"], r["text"], r["turn"]) for r in out] == [
        ("K", "system", "Be kind.", 0), ("I", "user", "", None), ("K", "assistant", "Hello.", 1), ("K", "user", "cut", 3), ("R", "assistant", "Fine.", 4)]


def test_query(spark, sf_dir):
    out = tr.query(spark, sf_dir)
    assert compare(out, connect(sf_dir), tr.ORACLE_SQL) == []
    kinds = [zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20 for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    assert set(range(5)) <= set(kinds)
