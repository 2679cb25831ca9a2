"""Repair of the turns of conversations by Knuth's lightest derivation.

The roles of a sound conversation are an optional system turn and then pairs of user and assistant. Every row is kept, given another role
or deleted, and turns without text may be inserted; a repair costs the sum of its edits, and of equal ones the one whose initials
(its audit) come first counts. An item ``(i, state)`` says that the first ``i`` rows are repaired and the roles so far leave the grammar
in ``state``. A deduction takes an item and the axiom of the next row, or of an insertion, to another item; the deductions are the hyperedges,
and the value of an item is its lightest (cost, audit). The agenda pops items in the order of their values and finalises them. That is
right because deductions are superior (an edit adds cost, or else only letters behind) and monotone (two audits of one item and one
cost are never one the beginning of the other, so what follows keeps their order). One item has one way to spell an audit: the grammar
says which role each letter stands for.

A conversation may hold any part of all rows. Rows are ordered over the cluster in ranges of equal size, and a run of
one conversation in a range is a segment. The agenda runs over blocks of a segment from every state the rows before may leave; blocks are
composed pairwise into the segment's table of (state before, state after), and the same agenda, with these tables as its axioms,
goes over the segments of a conversation. Each segment then gets its part of the audit and replays it over its own rows. Texts
take no part until the end, where each is fetched once for the row that keeps it; equal rows are counted, not listed. What must go through one
task is what the result has in one row: an audit has a letter for each row, and a digest of a whole conversation is read in order.

Rows come in the order of turn (nulls first), role and a hash of the text; equal rows beside one another, each but the first a duplicate. A null
role or text counts as one space, a null ``conv_id`` is a conversation of its own, and a role is known by its first character, ``s``, ``u`` or
``a``. Deleting is required for blank and duplicate rows. A conversation without rows costs nothing. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, reduce
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, materialize

#: States of the grammar and the state after each role; a derivation may end in ``0`` (no turn yet) or ``a``.
NEXT = {"0": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
ENDS = ("0", "a")
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLOCK = 64
NO_BLANK, END_MARKS = r"[^\x20\x09-\x0D]", ".!?"
CLEAN, BLANK, DUPLICATE, CUT = range(4)
ROW = ["c", "turn", "role", "h1", "h2"]
SUMMARY = ("c string, seg int, rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
           "low long, high long, turns long, first_turn long, last_turn long, spans array<string>, costs array<long>, audits array<string>")
PLAN = "c string, seg int, state string, audit string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
EDIT = "c string, seg int, place long, edit string, new_role string, turn long, role string, h1 long, h2 long"
Value = tuple[int, str]


def lightest(axioms: dict, deduce: Callable[[object], Iterable[tuple[object, int, str]]]) -> tuple[dict, dict]:
    """Values of all items that can be derived, and the item each was derived from.

    ``deduce`` gives for a finalised item what follows from it and an axiom: the conclusion, the cost and the letters added.
    """
    agenda, final, came = [], {}, {}
    for item, value in axioms.items():
        heappush(agenda, (value, item, item))
    while agenda:
        (cost, audit), item, origin = heappop(agenda)
        if item in final:
            continue
        final[item], came[item] = (cost, audit), origin
        for conclusion, more, letters in deduce(item):
            if conclusion not in final:
                heappush(agenda, ((cost + more, audit + letters), conclusion, item))
    return final, came


def edits(symbol: str, state: str) -> Iterator[tuple[str, int, str]]:
    """What may be done with a row: the state after it, cost and letter. A symbol is the initial of a role, ``o`` for others, in
    capitals for a truncated row, and ``X`` for a row that has to go."""
    yield state, DELETE, "D"
    if symbol != "X":
        extra, moves = TRUNCATED if symbol.isupper() else 0, NEXT[state]
        if symbol.lower() in moves:
            yield moves[symbol.lower()], extra, "K"
        for role in ROLES:
            if role in moves:
                yield moves[role], REROLE + extra, "R"


@lru_cache(20_000)
def block_table(symbols: str) -> dict[str, Value]:
    """State before + state after -> the lightest repair of a few rows."""

    def deduce(item):
        i, state = item
        for role in ROLES:
            if role in NEXT[state]:
                yield (i, NEXT[state][role]), INSERT, "I"
        if i < len(symbols):
            for after, cost, letter in edits(symbols[i], state):
                yield (i + 1, after), cost, letter

    out = {}
    for before in NEXT:
        final, _ = lightest({(0, before): (0, "")}, deduce)
        out |= {before + state: value for (i, state), value in final.items() if i == len(symbols)}
    return out


def composed(left: dict[str, Value], right: dict[str, Value]) -> dict[str, Value]:
    """The table of two runs of rows, one after the other."""
    out: dict[str, Value] = {}
    for first, (c1, a1) in left.items():
        for second, (c2, a2) in right.items():
            if first[1] == second[0]:
                span, value = first[0] + second[1], (c1 + c2, a1 + a2)
                if span not in out or value < out[span]:
                    out[span] = value
    return out


def table(symbols: str) -> dict[str, Value]:
    """As ``block_table``, for any number of rows."""
    tables = [block_table(symbols[i : i + BLOCK]) for i in range(0, max(1, len(symbols)), BLOCK)]
    while len(tables) > 1:
        tables = [composed(*tables[i : i + 2]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
    return tables[0]


def best_path(tables: list[dict[str, Value]]) -> tuple[int, list[tuple[str, str]]]:
    """Cost of a conversation of these segments, and for each segment the state before it and its part of the audit."""

    def deduce(item):
        k, state = item
        if k < len(tables):
            for span, (cost, audit) in tables[k].items():
                if span[0] == state:
                    yield (k + 1, span[1]), cost, audit

    final, came = lightest({(0, "0"): (0, "")}, deduce)
    value, item = min((final[k, s], (k, s)) for k, s in final if k == len(tables) and s in ENDS)
    parts = []
    while item[0]:
        before = came[item]
        parts.append((before[1], tables[item[0] - 1][before[1] + item[1]][1]))
        item = before
    return value[0], parts[::-1]


def groups(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of rows equal in ``by``; the rows of a run are read as they come."""
    rows = (row for batch in batches for row in batch.to_pylist())
    row = next(rows, None)

    def run(key):
        nonlocal row
        while row is not None and tuple(row[c] for c in by) == key:
            yield row
            row = next(rows, None)

    while row is not None:
        key = tuple(row[c] for c in by)
        mine = run(key)
        yield key, mine
        for _ in mine:
            pass


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 5000, letters: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= size or weight >= letters:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema)
            held, weight = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema)


def _schema(spec: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in spec.split(", "))])


def _segment(c: str, seg: int, rows: Iterator[dict]) -> tuple:
    """Counts, borders and table of one segment."""
    symbols, faults, illegal, turns = [], [0] * 4, 0, 0
    first = last = low = high = None
    n, start, turn = 0, None, None
    for row in rows:
        initial, copies, fault = row["initial"], row["copies"], row["fault"]
        illegal += (n > 0 and last + initial not in ("su", "ua", "au")) + copies - 1
        faults[fault] += copies if fault in (BLANK, DUPLICATE) else 1
        if fault in (BLANK, DUPLICATE):
            symbols.append("X" * copies)
        else:
            symbol = initial if initial in ("s", "u", "a") else "o"
            symbols.append((symbol.upper() if fault == CUT else symbol) + "X" * (copies - 1))
            faults[DUPLICATE] += copies - 1
        if n == 0:
            first, start = initial, row["turn"]
        turns += row["turn"] is not None and row["turn"] != turn
        last, turn = initial, row["turn"]
        if turn is not None:
            low, high = turn if low is None else low, turn
        n += copies
    spans = table("".join(symbols))
    return (c, seg, n, faults[BLANK], faults[DUPLICATE], faults[CUT], illegal, first, last, low, high, turns, start, turn,
            list(spans), [v[0] for v in spans.values()], [v[1] for v in spans.values()])


def _segments_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches((_segment(*key, rows) for key, rows in groups(batches, "c", "seg")), _schema(SUMMARY))


def _plan(c: str, segments: list[dict]) -> Iterator[tuple]:
    """One row a segment; the counts of the conversation stand in the first."""
    illegal, turns = sum(s["illegal"] for s in segments), sum(s["turns"] for s in segments)
    for a, b in zip(segments, segments[1:]):
        illegal += a["last"] + b["first"] not in ("su", "ua", "au")
        turns -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    low, high = min((s["low"] for s in segments if s["low"] is not None), default=None), max((s["high"] for s in segments if s["high"] is not None), default=None)
    gaps = 0 if low is None else min(high - low + 1 - turns, 2**63 - 1)
    cost, parts = best_path([dict(zip(s["spans"], zip(s["costs"], s["audits"]))) for s in segments])
    counts = [gaps, *(sum(s[f] for s in segments) for f in ("blank", "duplicate", "truncated")), illegal, cost]
    for s, (state, audit) in zip(segments, parts):
        yield c, s["seg"], state, audit, *counts
        counts = [0] * len(counts)


def _plan_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches((row for (c,), segments in groups(batches, "c") for row in _plan(c, list(segments))), _schema(PLAN))


def _replayed(c: str, seg: int, rows: Iterator[dict]) -> Iterator[tuple]:
    """The turns that a segment has after repair; its plan is the first row."""
    plan = next(rows)
    state, audit, at, place = plan["state"], plan["audit"], 0, 0

    def inserted():
        nonlocal state, at, place
        while at < len(audit) and audit[at] == "I":
            at, place, state = at + 1, place + 1, next(NEXT[state][r] for r in ROLES if r in NEXT[state])
            yield c, seg, place, "I", ROLES[state], None, None, None, None

    for row in rows:
        for _ in range(row["copies"]):
            yield from inserted()
            letter, at = audit[at], at + 1
            if letter == "D":
                continue
            state = NEXT[state][row["initial"]] if letter == "K" else next(NEXT[state][r] for r in ROLES if r in NEXT[state])
            place += 1
            yield c, seg, place, letter, row["role"] if letter == "K" else ROLES[state], row["turn"], row["role"], row["h1"], row["h2"]
    yield from inserted()


def _replay_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches((row for key, rows in groups(batches, "c", "seg") for row in _replayed(*key, rows)), _schema(EDIT))


def _digest_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def digests():
        for (c,), rows in groups(batches, "c"):
            whole = hashlib.sha256()
            for k, row in enumerate(rows):
                whole.update(f"{chr(10) if k else ''}{row['role']}:{row['text']}".encode())
            yield c, whole.hexdigest()

    yield from _batches(digests(), _schema("c string, repaired_sha256 string"))


def _same(left: DataFrame, right: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Join on columns of the same name, nulls equal."""
    other = right.withColumnsRenamed({n: f"_r_{n}" for n in columns})
    on = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in columns])
    return left.join(other, on, how).drop(*[f"_r_{n}" for n in columns])


def _conversation() -> Column:
    return F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))


def _rows(turns: DataFrame) -> DataFrame:
    """Rows with their key: conversation, turn, role and two hashes of the text."""
    text = F.coalesce("text", F.lit(" "))
    copies = F.col("copies").cast("long") if "copies" in turns.columns else F.lit(1).cast("long")
    return turns.select(_conversation().alias("c"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.xxhash64(text).alias("h1"),
                        F.xxhash64(F.lit(0x5EED), text, F.lit(7)).alias("h2"), copies.alias("copies"), text.alias("text"))


def _faults(rows: DataFrame) -> DataFrame:
    """Each distinct row once, without its text: how many copies it has, its initial, and the first fault of its first copy."""
    last = F.regexp_extract("text", r"(?s).*([^\x20\x09-\x0D])", 1)
    bare = rows.select(*ROW, "copies", F.when(~F.col("text").rlike(NO_BLANK), BLANK).when(~F.lit(END_MARKS).contains(last), CUT).otherwise(CLEAN).alias("own"))
    entries = bare.groupBy(*ROW).agg(F.sum("copies").alias("copies"), F.max("own").alias("own"))
    spoken = entries.groupBy("c", "role", "h1", "h2").agg(F.min(F.struct("turn")).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    seen = entries.join(spoken, ["c", "role", "h1", "h2"], "left")
    again = F.col("_first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_first.turn"))
    fault = F.when(F.col("own") == BLANK, BLANK).when(again, DUPLICATE).otherwise(F.col("own"))
    return seen.select(*ROW, "copies", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


class Repair:
    """The repair of ``turns`` (``conv_id``, ``turn``, ``role``, ``text`` and, where there are such, ``copies`` of a row)."""

    def __init__(self, turns: DataFrame) -> None:
        self.rows = _rows(turns)
        order = ["c", "turn", "role", "h1", "h2"]
        # Stored: a segment is a run of one conversation in one range, and must stay the same for all later steps.
        ranges = _faults(self.rows).repartitionByRange(*order)
        self.entries = materialize(ranges.withColumn("seg", F.spark_partition_id()), "turns")
        dealt = self.entries.repartition("c", "seg").sortWithinPartitions("c", "seg", *order[1:])
        segments = dealt.mapInArrow(_segments_task, SUMMARY)
        self.plan = materialize(segments.repartition("c").sortWithinPartitions("c", "seg").mapInArrow(_plan_task, PLAN), "turn-plans")

    def reports(self) -> DataFrame:
        """Per conversation with rows: ``c``, the counts of faults, ``cost`` and ``audit``."""
        counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        parts = F.sort_array(F.collect_list(F.struct("seg", "audit")))["audit"]  # a part for each range that the conversation lies in
        return self.plan.groupBy("c").agg(*[F.sum(n).alias(n) for n in counts], F.array_join(parts, "").alias("audit"))

    def turns(self) -> DataFrame:
        """The repaired conversations: ``c``, ``seg`` and ``place`` (their order), ``edit`` (K, R or I), ``role``, ``text``, and the ``turn`` a row had."""
        planned = self.plan.select("c", "seg", "state", "audit").unionByName(self.entries, allowMissingColumns=True)
        dealt = planned.repartition("c", "seg").sortWithinPartitions("c", "seg", F.col("state").asc_nulls_last(), *ROW[1:])
        done = dealt.mapInArrow(_replay_task, EDIT)
        texts = self.rows.groupBy(*ROW).agg(F.max("text").alias("text"))
        kept = _same(done.where("edit <> 'I'"), texts, ROW, "inner").select("c", "seg", "place", "edit", F.col("new_role").alias("role"), "text", "turn")
        added = done.where("edit = 'I'").select("c", "seg", "place", "edit", F.col("new_role").alias("role"), F.lit("").alias("text"), "turn")
        return kept.unionByName(added)

    def digests(self) -> DataFrame:
        """SHA-256 of the lines ``role:text`` of each repaired conversation, read in order in one task, row by row."""
        lines = self.turns().select("c", "seg", "place", "role", "text").repartition("c").sortWithinPartitions("c", "seg", "place")
        return lines.mapInArrow(_digest_task, "c string, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """The damage of the registered query: by the hash of conversation and turn a row is dropped, emptied, robbed of its end marks, repeated or given to the user."""
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind, text = F.crc32(F.concat_ws(":", part("conv_id"), part("turn"))) % 20, part("text")
    changed = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return turns.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(part("role")).alias("role"), changed.alias("text"),
                                         F.when(kind == 3, 2).otherwise(1).alias("copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cost, audit and digest of the repair of every damaged conversation."""
    rows = configure(spark).read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    repair = Repair(damaged(rows))
    every = rows.select("conv_id").distinct().withColumn("c", _conversation())
    found = every.join(repair.reports(), "c", "left").join(repair.digests(), "c", "left")
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _after(v: str, cost: object, letter: str, role: str | None = None, text: str = "''") -> str:
    """SQL: the value ``v`` after one edit, with the line it leaves."""
    line = f"{v}.t || CASE WHEN {v}.t = '' THEN '' ELSE chr(10) END || {role} || ':' || {text}" if role else f"{v}.t"
    return f"CASE WHEN {v} IS NOT NULL THEN {{'c': {v}.c + {cost}, 'a': {v}.a || '{letter}', 't': {line}}} END"


def _least(*values: str) -> str:
    return f"list_min([{', '.join(values)}])"


def _row_sql(state: str, initial: str, befores: str) -> str:
    """SQL: the value of ``state`` after a row that is deleted or, from the states ``befores``, stands as ``initial``."""
    options = [_after(state, DELETE, "D")]
    for before in befores:
        kept = [(f"substr(role, 1, 1) = '{initial}'", "cut", "K", "role")]
        if initial in ROLES:
            kept.append(("true", f"{REROLE} + cut", "R", f"'{ROLES[initial]}'"))
        options += [f"CASE WHEN NOT gone AND {when} THEN {_after(before, cost, letter, role, 'text')} END" for when, cost, letter, role in kept]
    return _least(*options)


ORACLE_SQL = f"""
WITH RECURSIVE steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
named AS (
  SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS key
  FROM conversations),
dealt AS (
  SELECT n.*, xor(list_reduce(list_prepend(4294967295, key), lambda c, b: xor(c // 256, t[(xor(c, b) % 256 + 1)])), 4294967295) % 20 AS kind FROM named n, steps),
harmed AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM dealt WHERE kind <> 0),
placed AS (SELECT *, dense_rank() OVER (ORDER BY conv_id) AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM harmed),
judged AS (
  SELECT *, NOT regexp_matches(text, '{NO_BLANK}') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    NOT contains('{END_MARKS}', regexp_extract(text, '(?s).*({NO_BLANK})', 1)) AS open_end,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au') AS illegal
  FROM placed),
rows AS (SELECT *, blank OR again AS gone, (open_end AND NOT blank AND NOT again)::INT AS cut FROM judged),
counts AS (
  SELECT conv_id, g, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    sum(cut) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM rows GROUP BY conv_id, g),
repair AS (
  SELECT g, 0::BIGINT AS i, n, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS z, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s,
    {{'c': {INSERT}::BIGINT, 'a': 'I', 't': 'user:'}} AS u, {{'c': {2 * INSERT}::BIGINT, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}} AS a
  FROM counts
  UNION ALL
  SELECT g, i, n, z, s, u, {_least("a", _after("u", INSERT, "I", "'assistant'"))}
  FROM (
    SELECT g, i, n, z, s, {_least("u", _after("z", INSERT, "I", "'user'"), _after("s", INSERT, "I", "'user'"), _after("a", INSERT, "I", "'user'"))} AS u, a
    FROM (
      SELECT p.g, r.i, n, {_after("z", DELETE, "D")} AS z, {_row_sql("s", "s", "z")} AS s, {_row_sql("u", "u", "zsa")} AS u, {_row_sql("a", "a", "u")} AS a
      FROM repair p JOIN rows r ON r.g = p.g AND r.i = p.i + 1))),
done AS (SELECT g, {_least("z", "a")} AS best FROM repair WHERE i = n)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN counts c ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done d ON d.g = c.g
"""
