"""Column expressions on literals, with the semantics the tables depend on."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vigilia import schema as S
from vigilia.functions import text as X
from vigilia.functions import time as T


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*columns).collect()]


def one(spark, text, **kw):
    return values(spark, [(text,)], "s string", T.parse_ts("s", **kw))[0][0]


@pytest.mark.parametrize("text,want", [
    ("01/02/2024 03:04:05", dt.datetime(2024, 2, 1, 3, 4, 5)), ("1/2/2024 3:4:5", dt.datetime(2024, 2, 1, 3, 4, 5)),
    (" 2024-02-01 03:04:05 ", dt.datetime(2024, 2, 1, 3, 4, 5)), ("2024-2-1 3:4:5", dt.datetime(2024, 2, 1, 3, 4, 5)),
    ("2024-02-01T03:04:05.25", dt.datetime(2024, 2, 1, 3, 4, 5, 250000)), ("2024-02-01", dt.datetime(2024, 2, 1)),
    ("2026", None), ("31/02/2024 00:00:00", None), ("2024-13-01 00:00:00", None), ("", None), (None, None), ("invalido", None),
    ("01/02/2024 03:04", None), ("01/02/24 03:04:05", None),
])
def test_parse_ts(spark, text, want):
    """Q3: one-digit parts and surrounding blanks count, a bare year does not."""
    assert one(spark, text) == want


def test_parse_ts_formats(spark):
    assert one(spark, "1/2/2024 3:04", formats=(T.DMY, T.DMY_MINUTE), native=False) == dt.datetime(2024, 2, 1, 3, 4)
    assert one(spark, "2024-02-01 03:04:05", formats=(T.DMY,), native=False) is None


@pytest.mark.parametrize("a,b,marks,minutes", [
    ("2024-01-01 10:00:59", "2024-01-01 10:01:00", 1, 1 / 60), ("2024-01-01 10:00:59", "2024-01-01 10:03:00", 3, 121 / 60),
    ("2024-01-01 10:05:00", "2024-01-01 10:00:30", -5, -4.5), ("1969-12-31 23:59:30", "1970-01-01 00:00:10", 1, 40 / 60),
])
def test_minutes(spark, a, b, marks, minutes):
    """Q2: minute marks crossed against elapsed minutes."""
    got = values(spark, [(a, b)], "a string, b string", T.minute_boundaries(T.parse_ts("a"), T.parse_ts("b")),
                 T.elapsed_minutes(T.parse_ts("a"), T.parse_ts("b")))[0]
    assert got[0] == marks and got[1] == pytest.approx(minutes)


def test_minutes_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        df = spark.sql("SELECT TIMESTAMP_NTZ'2017-10-14 23:59:00' a, TIMESTAMP_NTZ'2017-10-15 01:01:00' b")
        assert df.select(T.minute_boundaries("a", "b")).first()[0] == 62
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_month_bounds():
    for bad in ("2024", "202413", "2024a1", ""):
        with pytest.raises(ValueError):
            T.month_bounds(bad)


def test_numbers(spark):
    """Q14: a decimal part rounds half up; text that is no number gives the default."""
    rows = [("12.7",), ("12.5",), ("-3",), (" 7 ",), ("x",), (None,), ("99999999999999999999",)]
    assert [r[0] for r in values(spark, rows, "s string", X.int_or("s", 0))] == [13, 13, -3, 7, 0, 0, 0]
    rows = [("1,5",), ("1.234,5",), ("x",), ("",), (None,)]
    assert [r[0] for r in values(spark, rows, "s string", X.num_br("s"))] == [1.5, None, None, None, None]
    assert [r[0] for r in values(spark, rows, "s string", X.num_br("s", thousands=True))] == [1.5, 1234.5, None, None, None]


def test_regions(spark):
    rows = [("P", None), (" l ", "CSL"), ("", "nro"), (None, "OES"), ("XX", "CSL"), (None, None), (None, "")]
    got = [r[0] for r in values(spark, rows, "a string, b string", X.region("a", "b"))]
    assert got == ["CSL", "NRT", "NRO", "OES", S.COMPANY, S.COMPANY, S.COMPANY]
    names = [("x_CSL.CSV",), ("x_csl.CSV",), ("x_CSL.csv",), ("x_ABC.CSV",), (None,)]
    assert [r[0] for r in values(spark, names, "f string", X.region_from_file("f"))] == ["CSL", *[S.NO_REGION] * 4]


def test_record_keys(spark):
    """Q15: the display key is null when a part is; the slot form keeps the place."""
    rows = [("1", None, "3"), ("1", "2", "3")]
    schema = "NUM_INTRP_UCI string, NUM_POSTO_UCI string, NUM_UC_UCI string"
    assert values(spark, rows, schema, X.record_key(), X.record_key_slots()) == [(None, "1||3"), ("1|2|3", "1|2|3")]


def test_classes(spark):
    rows = [("0", None), ("", "0"), (" 1 ", "0"), (None, "6")]
    assert [r[0] for r in values(spark, rows, "a string, b string", X.net_class("a", "b"))] == ["Liquido", "Liquido", "Expurgo", "Expurgo"]
    rows = [("12", "0"), ("0", "0"), (None, "1"), ("", " 0 ")]
    assert [r[0] for r in values(spark, rows, "m string, p string", X.three_way_class("m", "p"))] == ["Ignorar", "Liquido", "Expurgo", "Liquido"]
    assert [r[0] for r in values(spark, [("6",), ("6.5",), ("x",), (None,)], "a string", X.area_one("a"))] == [True, False, False, False]
    rows = [("A", "2"), ("A", "3a"), ("A", "3A"), ("A", "5"), ("B", "1"), (None, None)]
    assert [r[0] for r in values(spark, rows, "g string, n string", X.kei("g", "n"))] == [108, 40, 40, 0, 34, 0]


def test_target_bands(spark):
    limit, steps = S.TARGET_BANDS["META_DIC"]
    rows = [("A", "1", "U", 99.0), ("A", "S", "U", 5.0), ("A", "S", "U", 5.1), ("A", "4", "R", 99.0), ("B", "x", "U", 50.0), ("B", None, "R", None), ("C", "1", "U", 1.0)]
    got = values(spark, rows, "g string, n string, u string, l double", X.band_value(steps, "g", "n", "u", "l"))
    assert [r[0] for r in got] == [3, 3, 5, 37, 18, 40, None]
    assert limit == "limite_dec"


def test_layout():
    assert len(S.EXPORT_LAYOUT) == 58 and len(set(S.EXPORT_LAYOUT)) == 58
    assert len(S.EVENT_COLUMNS) == 42 and len(S.UC_COLUMNS) == 18
    assert set(S.RECORD_KEY) <= set(S.EXPORT_LAYOUT)
    assert set(S.HISTORY_LAYOUT) <= set(S.EXPORT_LAYOUT)


def test_plan_stays_in_generated_code(spark):
    df = spark.range(10).select(F.lit("01/02/2024 03:04:05").alias("s"), F.col("id").cast("string").alias("n"))
    plan = df.select(T.parse_ts("s"), X.num_br("n"), X.region("n", "s"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_columns_occur_once_in_times_and_regions(spark):
    """A time or region made of other columns is worked out once, and a region of a region does not square its text."""
    df = spark.createDataFrame([("x", "y")], "s string, n string")
    shown = lambda c: df.select(c)._jdf.queryExecution().analyzed().toString().splitlines()[0]
    assert shown(T.parse_ts("s")).count("s#") == 1
    assert shown(X.region("n", "s")).count("s#") <= 2 and shown(X.region("n", X.region("n", "s"))).count("s#") <= 4


@pytest.mark.parametrize("text", ["1/2/2024 3:4:5", " 01/02/2024 03:04:05 ", "2024-2-1 3:4:5", "2024-02-01", "2024-02-01T03:04:05.123", "31/02/2024 00:00:00", "2024", "", "1/2/2024", "12:00:00",
                                  "2024-02-01 03:04:05+01:00", "invalido", None])
def test_parse_ts_by_one_expression(spark, text):
    """The same as by cutting the text at its slashes."""
    rows = spark.createDataFrame([(text,)], "s string")
    s = F.trim("s")
    tail = F.substring_index(s, "/", -1)
    iso = F.concat(F.substring(tail, 1, 4), F.lit("-"), F.substring_index(F.substring_index(s, "/", 2), "/", -1), F.lit("-"), F.substring_index(s, "/", 1), F.substr(tail, F.lit(5)))
    fits = "^(?:" + "|".join([T._FITS[T.DMY], T._FITS[T.ISO], T._NATIVE]) + ")$"
    want = F.when(s.rlike(fits), F.when(s.contains("/"), iso).otherwise(s).try_cast("timestamp_ntz"))
    assert rows.select(T.parse_ts("s")).first()[0] == rows.select(want).first()[0]


def test_stages_of_long_code_are_compiled(spark):
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
