"""CI/CHI against brute force, for customers with a handful of rows and with many, and what its plan moves."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

from vigilia import schema as S
from vigilia.operators import intervals
from vigilia.plans import indicators

ROWS = ("NUM_INTRP_UCI string, NUM_POSTO_UCI string, NUM_UC_UCI string, NUM_INTRP_INIC_MANOBRA_UCI string, arquivo_origem string, is_expurgo boolean, "
        "is_area_i boolean, DTHR_INICIO_INTRP_UC timestamp_ntz, DATA_HORA_FIM_INTRP timestamp_ntz")
EVENTS = "arquivo_origem string, classificacao string, NUM_OCORRENCIA_ADMS string, PID string"


def uc_rows(hot):
    """Repeated keys by a manoeuvre, blank posts, missing and reversed times, touching rows, three origins for a UC."""
    dice, rows = random.Random(7), []
    for n in range(1200):
        ini = datetime(2024, 1, 1) + timedelta(minutes=dice.randrange(20000), microseconds=n)
        fim = ini + timedelta(minutes=dice.choice([-5, 0, 2, 60, 300]))
        uc = "hot" if hot and n % 3 == 0 else str(n % 40)
        rows.append((str(n), dice.choice(["p", "p", " ", None]), uc, str(n - dice.randrange(1, 90)) if n % 4 == 0 else dice.choice([" ", None]),
                     dice.choice("PLM"), n % 5 == 0, n % 3 == 0, None if n % 50 == 0 else ini, None if n % 70 == 0 else fim))
    touching = [(f"t{i}", "p", "7", None, "P", False, False, datetime(2024, 3, 1, i), datetime(2024, 3, 1, i + 1)) for i in range(4)]
    return [*rows, *touching]


def expected(rows):
    """(level, origin, class) -> number of periods, their hours, long ones and long ones in area one."""
    newest, kept = {}, []
    for r in rows:
        key = ((r[3] or "").strip() or r[0], (r[1] or "").strip(), r[2])
        if "" in key:
            kept.append(r)
        elif key not in newest or (r[8] is not None, r[8]) > (newest[key][8] is not None, newest[key][8]):
            newest[key] = r
    out = defaultdict(lambda: [0, 0.0, 0, 0])
    groups = defaultdict(list)
    for r in [*kept, *newest.values()]:
        if r[7] is not None and r[8] is not None and r[8] >= r[7]:
            groups[r[4], r[2]].append(r)
            groups[S.COMPANY_TITLE, r[2]].append(r)
    for (origin, _), group in groups.items():
        periods = []
        for r in sorted(group, key=lambda r: r[7]):
            if periods and r[7] <= periods[-1][1]:
                last = periods[-1]
                periods[-1] = (last[0], max(last[1], r[8]), last[2] or r[5], last[3] or r[6])
            else:
                periods.append((r[7], r[8], r[5], r[6]))
        for ini, fim, excluded, area in periods:
            minutes, sums = (fim - ini).total_seconds() / 60, out[origin, "Expurgo" if excluded else "Liquido"]
            sums[0], sums[1], sums[2], sums[3] = sums[0] + 1, sums[1] + minutes / 60, sums[2] + (minutes >= 3), sums[3] + (minutes >= 3 and area)
    return {k: (a, round(b, 4), c, d) for k, (a, b, c, d) in out.items()}


def assessed(spark, rows, events=()):
    billed = spark.createDataFrame([(uc,) for uc in {r[2] for r in rows}], "UC_FATURADAS string")
    consumers = spark.createDataFrame([("P", 1.0, 2), ("L", 1.0, 2), ("M", 1.0, 2)], "regional string, consumidores double, mes int")
    return indicators.assess_ci_chi(spark.createDataFrame(list(events), EVENTS), spark.createDataFrame(rows, ROWS), billed, consumers)


def test_ci_chi_of_light_and_hot_customers(spark):
    for hot in (False, True):
        rows = uc_rows(hot)
        assert (max(sum(r[2] == uc for r in rows) for uc in ("hot", "1")) > intervals.LIGHT) is hot
        got = {(r.arquivo_origem, r.classificacao): (r.CI, round(r.CHI, 4), r.qtd_intrp_longas, round(r.FECi * r.consumidores))
               for r in assessed(spark, rows)["resumo"].collect()}
        assert got == expected(rows)


def test_distinct_events_of_both_levels(spark):
    """A number in two origins counts once for the company; a null counts as one value; the two kinds do not mix."""
    events = [("P", "Liquido", "1", "1"), ("P", "Liquido", "1", "2"), ("L", "Liquido", "1", "1"), ("L", "Liquido", None, "3"), ("L", "Liquido", None, None), ("P", "Expurgo", "1", "1")]
    by_origin, company = indicators.distinct_events(spark.createDataFrame(events, EVENTS))
    assert {tuple(r) for r in by_origin.collect()} == {("P", "Liquido", 1, 2), ("L", "Liquido", 2, 3), ("P", "Expurgo", 1, 1)}
    assert {tuple(r) for r in company.collect()} == {("Liquido", 2, 4), ("Expurgo", 1, 1)}


def exchanges(df, of):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and of in line]


def test_rows_of_light_customers_move_once(spark):
    """Repeated keys, periods by origin and periods over all origins take one exchange of the rows, and islands of light keys one."""
    out = assessed(spark, uc_rows(False))
    for level in ("origem", "empresa"):
        assert len(exchanges(out[level], "NUM_UC_UCI")) == 1
    rows = spark.createDataFrame(uc_rows(False), ROWS)
    assert len(exchanges(intervals.islands(rows, ["NUM_UC_UCI"], "DTHR_INICIO_INTRP_UC", "DATA_HORA_FIM_INTRP", flags=("is_expurgo",)), "NUM_UC_UCI")) == 1


def test_islands_of_null_keys(spark):
    """Rows without a key are of one key, few or many of them, and light keys go with hot ones."""
    for n in (5, 2 * intervals.LIGHT):
        at = [datetime(2024, 1, 1) + timedelta(hours=i) for i in range(n)]
        rows = [(k, 1, t, t + timedelta(minutes=m)) for t in at for k, m in ((None, 60), ("a", 59))] + [("b", 1, at[0], at[1]), ("b", 1, at[1], at[2])]
        df = spark.createDataFrame(rows, "k string, n int, inicio timestamp_ntz, fim timestamp_ntz")
        got = sorted((r.k or "", r.linhas) for r in intervals.islands(df, ["k"]).collect())
        assert got == [("", n), *[("a", 1)] * n, ("b", 2)]
