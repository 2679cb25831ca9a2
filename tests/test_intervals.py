"""Interval operators against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vigilia.operators import intervals as I

BASE = dt.datetime(2024, 1, 1)


def make(spark, seed, n, keys, span, events=None, lengths=(0, 1, 5, 30, 60, 120, 400, 3000), hot_key=False):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        start, length = rnd.randrange(span), rnd.choice(lengths)
        key = 0 if hot_key and rnd.random() < 0.5 else rnd.randrange(keys)
        event = rnd.randrange(events) if events else i
        rows.append((key, event, BASE + dt.timedelta(minutes=start), BASE + dt.timedelta(minutes=start + length), i))
    return rows, spark.createDataFrame(rows, "k int, ev long, inicio timestamp_ntz, fim timestamp_ntz, id long")


def container(rows, row):
    k, e, s, f, _ = row
    found = [(b[2], -b[3].timestamp(), b[1], b[3]) for b in rows
             if b[0] == k and b[1] != e and b[2] <= s and b[3] >= f and (b[2] < s or b[3] > f or b[1] < e)]
    return min(found) if found else None


def I_minutes(a, b):
    """Whether a minute mark lies in between."""
    return b.replace(second=0, microsecond=0) > a.replace(second=0, microsecond=0)


CASES = [(1, 150, 3, 4000, None), (2, 150, 3, 300, 30), (3, 120, 2, 60, 8), (4, 200, 4, 9000, 40)]


@pytest.mark.parametrize("seed,n,keys,span,events", CASES)
def test_best_container(spark, seed, n, keys, span, events):
    rows, df = make(spark, seed, n, keys, span, events, hot_key=True)
    out = I.best_container(df.withColumn("o", F.col("ev")), ["k"], "ev", "o").collect()
    got = {r.id: (r.inicio_contem, r.evento_contem, r.fim_contem) for r in out}
    assert len(out) == len(rows)
    for row in rows:
        want = container(rows, row)
        assert got[row[4]] == ((None, None, None) if want is None else (want[0], want[2], want[3])), row


def test_container_of_rows_that_run_backwards(spark):
    rows, df = make(spark, 5, 150, 3, 500, 25, lengths=(-120, -30, 0, 10, 200))
    out = I.contained(df, ["k"], "ev", "ev").collect()
    for r in out:
        assert r.contido == (container(rows, (r.k, r.ev, r.inicio, r.fim, r.id)) is not None)


@pytest.mark.parametrize("seed,n,keys,span,events", CASES)
@pytest.mark.parametrize("shift,step", [(0, 256), (0, 12), (137, 40)])
def test_trim_partial(spark, monkeypatch, seed, n, keys, span, events, shift, step):
    """Small steps, and starts at odd microseconds, make searches climb to the top of the tree and down again."""
    rows, df = make(spark, seed, n, keys, span, events, hot_key=True)
    rows = [(k, e, s + dt.timedelta(microseconds=shift * (i % 7)), f + dt.timedelta(microseconds=shift * (i % 11)), i) for k, e, s, f, i in rows]
    df = spark.createDataFrame(rows, df.schema)
    monkeypatch.setattr(I, "TREE_STEP", step)
    got = {r.id: (r.o_id, r.fim_origem) for r in I.trim_partial(df, ["k"], ["id"], origin={"o_id": "id"}).collect()}
    for k, _, s, f, i in rows:
        found = [(-b[3].timestamp(), b[2], b[4], b[3]) for b in rows if b[0] == k and b[2] < s < b[3] < f]
        found = found if found and I_minutes(s, min(found)[3]) else []
        assert got.get(i) == ((min(found)[2], min(found)[3]) if found else None)
    # A trim never lengthens a record.
    for r in I.trim_partial(df, ["k"], ["id"]).collect():
        assert r.inicio < r.fim_origem < r.fim


@pytest.mark.parametrize("seed,n,keys,span,events", CASES)
def test_overlap_pairs(spark, seed, n, keys, span, events):
    rows, df = make(spark, seed, n, keys, span, events, lengths=(-60, -5, 0, 1, 5, 60, 400, 90000))
    got = sorted(tuple(sorted((r.a_id, r.b_id))) for r in I.overlap_pairs(df, ["k"], "id", ["id"]).collect())
    want = sorted((a[4], b[4]) for a in rows for b in rows
                  if a[4] < b[4] and a[0] == b[0] and a[2] < b[3] and b[2] < a[3])
    assert got == want


@pytest.mark.parametrize("seed,n,keys,span,events", CASES)
def test_islands(spark, seed, n, keys, span, events):
    rows, df = make(spark, seed, n, keys, span, events, lengths=(-30, 0, 5, 60, 400, 3000), hot_key=True)
    got = sorted((r.k, r.inicio, r.fim, r.linhas) for r in I.islands(df, ["k"]).collect())
    want, open_ = [], None
    for k, _, s, f, _ in sorted((r for r in rows if r[3] >= r[2]), key=lambda r: (r[0], r[2], r[3])):
        if open_ and open_[0] == k and s <= open_[2]:
            open_[2], open_[3] = max(open_[2], f), open_[3] + 1
        else:
            open_ = [k, s, f, 1]
            want.append(open_)
    assert got == sorted(map(tuple, want))
    # Islands of a key are disjoint and do not touch.
    for a, b in zip(got, got[1:]):
        assert a[0] != b[0] or a[2] < b[1]


def test_islands_per_class_span_classes(spark):
    t = lambda m: BASE + dt.timedelta(minutes=m)
    df = spark.createDataFrame(
        [("u", "L", t(0), t(10)), ("u", "E", t(5), t(20)), ("u", "L", t(18), t(30)), ("u", "L", t(31), t(32))],
        "uc string, c string, inicio timestamp_ntz, fim timestamp_ntz")
    got = sorted((r.c, r.inicio, r.fim, r.linhas) for r in I.islands(df, ["uc"], per=("c",)).collect())
    assert got == [("E", t(5), t(20), 1), ("L", t(0), t(30), 2), ("L", t(31), t(32), 1)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlap_flags(spark, seed):
    rows, df = make(spark, seed, 150, 5, 400 if seed % 2 else 4000, lengths=(-60, -5, 0, 0, 1, 5, 30, 300))
    hit = lambda a, b: b[4] != a[4] and b[0] == a[0] and a[2] < b[3] and b[2] < a[3]
    for r in I.overlaps_other(df, ["k"]).collect():
        assert r.sobrepoe == any(hit((r.k, r.ev, r.inicio, r.fim, r.id), b) for b in rows), r
    even, odd = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    for r in I.overlaps_any(even, odd, ["k"]).collect():
        assert r.sobrepoe == any(hit((r.k, r.ev, r.inicio, r.fim, r.id), b) for b in rows if b[4] % 2)


def test_temporal_blocks(spark):
    _, df = make(spark, 7, 120, 3, 600)
    out = I.temporal_blocks(df, ["k"], "id")
    leaders = out.where("status_bloco = 'LIDER'").groupBy("k", "bloco").count().collect()
    assert all(r["count"] == 1 for r in leaders)
    assert len(leaders) == I.islands(df, ["k"]).count()
    assert out.where("inicio < inicio_bloco OR fim > fim_bloco").count() == 0


def test_tied_containers_have_one_answer(spark):
    """Equal intervals with equal numbers: the lowest event contains the row, whatever the order of the input."""
    t = lambda m: BASE + dt.timedelta(minutes=m)
    rows = [(1, "B", 7, t(0), t(60)), (1, "A", 7, t(0), t(60)), (1, "C", 9, t(10), t(20))]
    for given in (rows, rows[::-1], rows[1:] + rows[:1]):
        df = spark.createDataFrame(given, "k int, ev string, o long, inicio timestamp_ntz, fim timestamp_ntz")
        found = {r.ev: r.evento_contem for r in I.best_container(df, ["k"], "ev", "o").collect()}
        assert found == {"A": None, "B": None, "C": "A"}


def test_pairs_of_rows_without_an_id(spark):
    rows = [(1, None, BASE, BASE + dt.timedelta(minutes=5)), (1, 2, BASE, BASE + dt.timedelta(minutes=9)), (1, None, BASE, BASE + dt.timedelta(minutes=7))]
    df = spark.createDataFrame(rows, "k int, id long, inicio timestamp_ntz, fim timestamp_ntz")
    assert I.overlap_pairs(df, ["k"], "id", []).count() == 3


def test_absurd_interval_stays_a_handful_of_rows(spark):
    rows = [(1, 1, dt.datetime(1970, 1, 1), dt.datetime(2090, 1, 1), 0), (1, 2, BASE, BASE + dt.timedelta(minutes=5), 1)]
    df = spark.createDataFrame(rows, "k int, ev long, inicio timestamp_ntz, fim timestamp_ntz, id long")
    assert I.overlap_pairs(df, ["k"], "id", []).count() == 1


def test_rows_without_a_key(spark):
    """They form periods of their own but contain and overlap nothing, as equality on the key has it."""
    t = lambda m: BASE + dt.timedelta(minutes=m)
    df = spark.createDataFrame([(None, 1, t(0), t(9)), (None, 2, t(1), t(2)), (1, 3, t(0), t(9)), (1, 4, t(1), t(2))],
                               "k int, ev long, inicio timestamp_ntz, fim timestamp_ntz")
    flags = lambda d, c: sorted((r.ev, r[c]) for r in d.collect())
    assert flags(I.contained(df, ["k"], "ev", "ev"), "contido") == [(1, False), (2, False), (3, False), (4, True)]
    assert flags(I.overlaps_other(df, ["k"]), "sobrepoe") == [(1, False), (2, False), (3, True), (4, True)]
    assert flags(I.overlaps_any(df, df.where("ev % 2 = 0"), ["k"]), "sobrepoe") == [(1, False), (2, False), (3, True), (4, True)]
    assert sorted((r.k or 0, r.linhas) for r in I.islands(df, ["k"]).collect()) == [(0, 2), (1, 2)]
    assert I.temporal_blocks(df, ["k"], "ev").where("status_bloco = 'LIDER'").count() == 2


@pytest.mark.parametrize("light", [0, 5, 256])
def test_keys_of_few_rows_and_of_many_agree(spark, monkeypatch, light):
    """The lists of light keys, the ways for keys of any size, and both in one table give the same rows; nulls in the key included."""
    from pyspark.sql import functions as F

    from vigilia.operators import intervals as I

    rows = spark.range(160).selectExpr(
        "CASE WHEN id % 19 = 0 THEN NULL WHEN id % 3 = 0 THEN 0 ELSE id % 40 END AS k", "CAST(id % 45 AS STRING) AS seq", "id % 45 AS o", "id AS t",
        "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, CAST(pmod(xxhash64(id), 48) AS INT)) AS inicio",
        "CAST(pmod(xxhash64(id, 3), 30) - 3 AS INT) AS h").selectExpr("k", "seq", "o", "t", "inicio", "inicio + make_dt_interval(0, h) AS fim")

    def all_of():
        frames = [I.best_container(rows, ["k"], "seq", "o"), I.trim_partial(rows, ["k"], ["o", "seq"], origin={"de": "seq"}),
                  I.overlap_pairs(rows, ["k"], "seq", ["o", "t"]), I.overlaps_other(rows, ["k"])]
        return [sorted(map(str, f.select(*sorted(f.columns)).collect())) for f in frames]

    monkeypatch.setattr(I, "LIGHT", 10**6)
    lists = all_of()
    monkeypatch.setattr(I, "LIGHT", light)
    assert all_of() == lists and all(lists)
    monkeypatch.setattr(I, "LIGHT", 10**6)
    for out in (I.overlap_pairs(rows, ["k"], "seq", ["o"]), I.best_container(rows, ["k"], "seq", "o")):
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert rows.where(F.col("k").isNull()).count()


def test_lists_of_a_key_do_not_repeat_it(spark):
    """The key moves once for its list, not once more with every row; rows come out as they went in."""
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), (None, 3, "z")], "k string, n int, t string")
    got = I.listed(rows, ["k"])
    assert got.schema["_all"].dataType.elementType.names == ["n", "t"]
    back = got.select("k", F.explode("_all").alias("r")).select(*I._out_of_list(rows, ["k"], "r"))
    assert back.columns == rows.columns and sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
