"""Counts of overlaps and best partners against brute force over all pairs."""

import datetime as dt
import random

import pytest

from vigilia.operators import overlaps as O

BASE = dt.datetime(2024, 1, 1)
MIN = dt.timedelta(minutes=1)


def brute(rows):
    out = {}
    for k, o, e, s, f in rows:
        met = [b for b in rows if k is not None and b[0] == k and b[1] is not None and (o is None or b[1] < o) and None not in (s, f, b[3], b[4])
               and s < b[4] and b[3] < f]
        if met:
            best = max((b[4], b[2]) for b in met)
            out[e] = (len(met), best[1], best[0])
    return out


def make(seed, n, keys, span, lengths, orders):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        s = BASE + rnd.randrange(span) * MIN
        key = "hot" if rnd.random() < 0.4 else rnd.choice([None, *map(str, range(keys))])
        rows.append((key, rnd.choice(orders), i, s, s + rnd.choice(lengths) * MIN))
    rows += [("hot", 1, n, None, BASE), ("hot", 1, n + 1, BASE, None)]
    return rows


FORWARD, ODD = (1, 5, 30, 400, 3000), (-400, -30, 0, 1, 5, 60, 700)


@pytest.mark.parametrize("seed,n,keys,span,lengths,orders", [
    (1, 200, 3, 6000, FORWARD, range(50)), (2, 150, 2, 200, FORWARD, [None, 1, 2, 3, 2**62, -7]), (3, 200, 3, 3000, ODD, [*range(20), None]),
    (4, 150, 2, 60, ODD, [-2**63, -1, 0, 1, 2**63 - 1, None]), (5, 80, 1, 50000, FORWARD, [None]), (6, 120, 1, 90000, FORWARD, range(10**9, 10**9 + 5000, 7)),
])
@pytest.mark.parametrize("light", [1, 64])
def test_overlap_counts(spark, monkeypatch, light, seed, n, keys, span, lengths, orders):
    """Periods of any size by running counts, and small ones by lists."""
    monkeypatch.setattr(O, "LIGHT", light)
    rows = make(seed, n, keys, span, lengths, list(orders))
    df = spark.createDataFrame(rows, "k string, o long, e long, inicio timestamp_ntz, fim timestamp_ntz")
    out = O.overlap_counts(df, ["k"], "o", "e").collect()
    assert len(out) == len({r.e for r in out})
    assert {r.e: (r.sobrepostas, r.e_sobreposta, r.fim_sobreposta) for r in out} == brute(rows)


def test_pairs_of_a_page(spark):
    rows = make(7, 150, 2, 400, ODD, [*range(9), None])
    df = spark.createDataFrame(rows, "k string, o long, e long, inicio timestamp_ntz, fim timestamp_ntz")
    counted = O.overlap_counts(df, ["k"], "o", "e")
    page = counted.orderBy("e").limit(20)
    got = {}
    for r in O.pairs_of(page, df, ["k"], "o", "e").collect():
        got.setdefault(r.e, set()).add(r.e_sobreposta)
    assert {e: len(p) for e, p in got.items()} == {r.e: r.sobrepostas for r in page.collect()}


def test_repeated_rows_and_an_empty_table(spark):
    schema = "k string, o long, e long, inicio timestamp_ntz, fim timestamp_ntz"
    row = ("a", 2, 5, BASE, BASE + 9 * MIN)
    df = spark.createDataFrame([row, row, ("a", 1, 4, BASE + MIN, BASE + 2 * MIN)], schema)
    assert [(r.e, r.sobrepostas, r.e_sobreposta) for r in O.overlap_counts(df, ["k"], "o", "e").collect()] == [(5, 1, 4), (5, 1, 4)]
    assert O.overlap_counts(df.limit(0), ["k"], "o", "e").collect() == []


def test_no_row_for_a_pair(spark):
    """Intervals that all overlap: 1.1 million pairs, but what is grouped stays rows times digits."""
    n = 1500
    df = spark.range(n).selectExpr("'a' k", "id o", "id e", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) inicio",
                                   "timestamp_ntz'2024-01-03 00:00:00' + make_dt_interval(0, 0, 0, id) fim")
    out = {r.e: r.sobrepostas for r in O.overlap_counts(df, ["k"], "o", "e").collect()}
    assert out == {i: i for i in range(1, n)}
    rows = df.selectExpr("k", "o _o", "inicio _i", "fim _f", "1L _c", "struct(fim f, e) _me")
    assert O._placed(O._periods(rows, ["k"], O.DAY), "_o").count() == n * 11
