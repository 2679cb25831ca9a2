"""Relational operators and the plans they produce."""

import random

import pytest
from pyspark.sql import functions as F

from vigilia.operators import relational as R


def test_resolve_and_require(spark):
    df = spark.createDataFrame([(1, 2)], "num_UC int, X int")
    out = R.resolve(df, {"uc": ["uc", "NUM_UC"], "valor": ["v"]}, required=("uc",))
    assert out.columns == ["uc", "valor"] and out.first()["uc"] == 1 and out.first()["valor"] is None
    with pytest.raises(ValueError, match="valor"):
        R.resolve(df, {"valor": ["v"]}, required=("valor",))
    with pytest.raises(ValueError, match="A, B"):
        R.require(df, ["B", "A", "X"])
    assert R.backfill(df, {"X": "int", "t": "timestamp_ntz"}).dtypes[-1] == ("t", "timestamp_ntz")


def test_first_per_key_limits_rows_before_the_exchange(spark):
    """A key with a third of the rows reaches the final task as one row per upstream task."""
    df = spark.range(1000).withColumn("k", F.when(F.col("id") < 400, F.lit(0)).otherwise(F.col("id")))
    out = R.first_per_key(df, ["k"], ["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit") and "Partial" in plan
    assert out.count() == 601


def test_dedup_is_deterministic(spark):
    """Q4: ties are broken by the remaining columns, whatever the order of the input."""
    rows = [("a", 1, i, f"v{i % 7}") for i in range(50)]
    picks = set()
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        picks.add(tuple(R.dedup_by_key(spark.createDataFrame(rows, "k string, o int, i int, v string").repartition(4), ["k"], ["o"]).first()))
    assert len(picks) == 1


def test_incomplete_keys_all_stay(spark):
    rows = [("1", "a", 1), ("1", "a", 2), ("1", " ", 3), ("1", " ", 4), (None, "a", 5)]
    df = spark.createDataFrame(rows, "a string, b string, n int")
    out = R.dedup_keep_incomplete(df, ["a", "b"], [F.desc("n")])
    assert sorted(r.n for r in out.collect()) == [2, 3, 4, 5]


def test_update_from(spark):
    df = spark.createDataFrame([("1", "x"), ("2", "y"), (None, "z")], "k string, v string")
    new = spark.createDataFrame([("1", "X"), (None, "Z")], "k string, n string")
    out = R.update_from(df, new, ["k"], {"v": "n"})
    assert sorted((r.k or "", r.v) for r in out.collect()) == [("", "z"), ("1", "X"), ("2", "y")]
    assert out.columns == df.columns


def test_with_latest(spark):
    df = spark.createDataFrame([("1",), ("2",)], "k string")
    log = spark.createDataFrame([("1", 1, "old"), ("1", 5, "new"), ("1", None, "none")], "k string, t int, s string")
    out = R.with_latest(df, log, ["k"], [F.desc_nulls_last("t")], {"s": "pendente"})
    assert sorted(map(tuple, out.select("k", "s").collect())) == [("1", "new"), ("2", "pendente")]


def test_paged(spark):
    df = spark.range(20)
    assert [r.id for r in R.paged(df, [F.desc("id")], 3, 2).collect()] == [17, 16, 15]
    for limit, offset in ((10**9, 0), (0, 0), (5, -5)):
        with pytest.raises(ValueError, match="a page has"):
            R.paged(df, ["id"], limit, offset)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exact_quantiles(spark, seed):
    rnd = random.Random(seed)
    rows = [(g, rnd.choice([rnd.random() * 1e6, float(rnd.randrange(5)), 1e9])) for g in "ab" for _ in range(rnd.randrange(1, 400))]
    rows += [("c", 3.5), ("c", None), ("d", 2.0), ("d", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.p, r.q, r.z) for r in R.exact_quantiles(df, ["g"], "v", {"p": 0.5, "q": 0.9, "z": 0.0}, bins=8).collect()}
    want = df.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.0))).alias("p")).collect()
    for r in want:
        assert got[r.g] == pytest.approx(tuple(r.p))


def test_mode(spark):
    rows = [("a", "x"), ("a", "x"), ("a", "b"), ("b", "z"), ("b", "y"), ("c", None)]
    out = R.mode_per_group(spark.createDataFrame(rows, "g string, v string"), ["g"], "v")
    assert sorted((r.g, r.v, r.ocorrencias) for r in out.collect()) == [("a", "x", 2), ("b", "y", 1)]


def test_dedup_of_a_stored_table(spark, tmp_path):
    """Same rows as the window gives, with nulls in key and order, one hot key, and no exchange or sort of the wide rows."""
    rows = spark.range(4000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE CAST(id % 1500 AS STRING) END AS k", "CASE WHEN id % 7 = 0 THEN NULL ELSE CAST(id % 11 AS STRING) END AS o",
        "id AS t", *[f"concat('wide', {i}, id) AS w{i}" for i in range(12)])
    path = str(tmp_path / "t")
    rows.repartition(5).write.parquet(path)
    table = spark.read.parquet(path)
    assert R.stored_rows(table.where("t > 1").select("k", "o")) and not R.stored_rows(rows) and not R.stored_rows(table.groupBy("k").count())
    whole = lambda d: sorted(map(str, d.collect()))
    assert whole(R.dedup_stored(table, ["k"], ["o"], ["t"])) == whole(R.dedup_by_key(table, ["k"], ["o"], ["t"]))
    assert whole(R.dedup_stored(table.drop("t"), ["k"], ["o"])) == whole(R.dedup_by_key(table.drop("t"), ["k"], ["o"]))
    twice = table.unionByName(table)
    assert not R.stored_rows(twice) or R.dedup_stored(twice, ["k"], ["o"]).count() == R.dedup_by_key(twice, ["k"], ["o"]).count()
    spark.read.parquet(path).unionByName(table).write.parquet(path + "2")
    assert R.dedup_stored(spark.read.parquet(path + "2"), ["k"], ["o"]).count() == R.dedup_by_key(table, ["k"], ["o"]).count()
    plan = R.dedup_stored(table, ["k"], ["o"], ["t"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Sort " not in plan


def test_pages_by_cursor(spark, tmp_path):
    """All pages in a row are the whole listing, with nulls and ties, ascending and descending; the cursor reaches the scan."""
    rows = [(rnd if rnd else None, k % 3 or None, k) for k, rnd in enumerate([random.Random(3).randrange(5) for _ in range(1)] + [k * 7 % 5 for k in range(60)])]
    spark.createDataFrame(rows, "a int, b int, id int").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for up in (True, False):
        order, cursor, got = [("a", up), ("b", not up), ("id", True)], None, []
        while True:
            page = R.page_after(df, order, 7, cursor)
            got += [tuple(r) for r in page.collect()]
            cursor = R.last_of(page, order)
            if cursor is None:
                break
        whole = sorted(rows, key=lambda r: (r[0] is None, (r[0] or 0) * (1 if up else -1), r[1] is None, (r[1] or 0) * (-1 if up else 1), r[2]))
        assert got == whole
    plan = R.page_after(df, [("id", True)], 5, {"id": 40})._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,40)" in plan
    with pytest.raises(ValueError):
        R.page_after(df, order, 0)


def test_dedup_of_a_stored_table_without_small_sides(spark, tmp_path):
    """Most rows repeat and no side counts as small: the table is still neither exchanged nor sorted, and its unused columns are not read."""
    spark.range(3000).selectExpr("CAST(id % 700 AS STRING) AS k", "CAST(id % 11 AS STRING) AS o", "id AS t", "concat('wide', id) AS w").repartition(3).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = R.dedup_stored(table, ["k"], ["o"], ["t"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "Sort " not in plan
        assert "w#" not in out.select("k")._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, out.collect())) == sorted(map(str, R.dedup_by_key(table, ["k"], ["o"], ["t"]).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_alone_with_their_key_move_as_numbers(spark, tmp_path):
    """Only rows whose key repeats are compared by key and order; whether it does is told by four numbers a row."""
    spark.range(900).selectExpr("concat('key', id % 800) AS k", "CASE WHEN id % 5 = 0 THEN NULL ELSE concat('order', id) END AS o").repartition(3).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    located = table.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("arquivo"), F.col("_metadata.row_index").alias("linha")).alias("_lugar"))
    alone = R._alone(located, ["k"])
    assert alone.count() == 700
    plan = alone._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert sorted(map(str, R.dedup_stored(table, ["k"], ["o"]).collect())) == sorted(map(str, R.dedup_by_key(table, ["k"], ["o"]).collect()))


def test_repeated_rows_leave_before_columns_are_worked_out(spark, tmp_path):
    """The rows that stay are told at the scan: no block of places is part of a row, and what is made of stored columns is made after."""
    path = str(tmp_path / "t")
    spark.range(70000).selectExpr("id % 60000 AS n", "id % 3 AS o").repartition(2).write.parquet(path)
    table = spark.read.parquet(path).selectExpr("CAST(n AS STRING) AS k", "CAST(o AS STRING) AS o", "concat('texto ', n) AS w")
    out = R.dedup_stored(table, ["k"], ["o"])
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    join = [i for i, line in enumerate(plan) if "BroadcastHashJoin" in line]
    made = [i for i, line in enumerate(plan) if "concat(texto" in line]
    assert len(join) == 1 and "LeftSemi" in plan[join[0]] and made and max(made) < join[0]
    rows = out.collect()
    assert len(rows) == 60000 and len({r.k for r in rows}) == 60000 and all(r.w == f"texto {r.k}" for r in rows)
