"""One key with half of the rows: the plan ranks no key in one task and its cost follows the rows."""

import time

from pyspark.sql import functions as F

from vigilia.functions.time import microsecond_index
from vigilia.operators import intervals


def events(spark, n, hot):
    key = F.when(F.lit(hot) | (F.col("id") % 2 == 0), F.lit(0)).otherwise(F.col("id") % 500)
    df = spark.range(n).select(
        key.alias("k"), F.col("id").alias("seq"),
        F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(pmod(xxhash64(id), 864000) AS INT))").alias("inicio"))
    return df.withColumn("fim", F.expr("inicio + make_dt_interval(0, 0, 0, CAST(1 + pmod(xxhash64(seq, 3), 90000) AS INT))"))


def test_windows_are_over_cells(spark):
    df = events(spark, 20000, False)
    for out in (intervals.islands(df, ["k"]), intervals.temporal_blocks(df, ["k"], "seq"), intervals.overlaps_any(df, df.where("seq % 3 = 0"), ["k"])):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        keyed = [line for line in plan.splitlines() if "Window [" in line]
        # Over the key alone only the carry runs, which has one row for each cell.
        assert keyed and all("_cell" in line for line in keyed)


def test_trimming_is_linear_in_a_key(spark):
    """Heavy overlap under one key: ten times the rows must not take a hundred times as long."""
    took = []
    for n in (3_000, 30_000):
        began = time.time()
        out = intervals.trim_partial(events(spark, n, True), ["k"], ["seq"])
        out.write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
    assert took[1] < 20 * took[0]


def took(action):
    began = time.time()
    action().write.format("noop").mode("overwrite").save()
    return time.time() - began


def test_containers_of_backward_rows_under_one_key(spark):
    """Half of the rows run backwards and events have many rows: one key costs about what spread keys cost, and nothing is joined on the key alone."""
    def rows(hot):
        return events(spark, 100_000, hot).withColumn("fim", F.when(F.col("seq") % 2 == 0, F.expr("inicio - make_interval(0, 0, 0, 0, 1)")).otherwise(F.col("fim"))).withColumn(
            "seq", F.col("seq") % 30_000).withColumn("k", F.when(F.lit(hot), F.col("k")).otherwise(F.pmod(F.xxhash64("inicio"), F.lit(500))))

    find = lambda hot: intervals.best_container(rows(hot), ["k"], "seq", "seq")
    took(lambda: find(False))
    assert took(lambda: find(True)) < 4 * took(lambda: find(False))
    plan = find(True)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and all("_cell" in line or "fim" in line for line in joins)


def test_trimming_within_one_hour_of_one_key(spark):
    """All rows of one key in one hour, at microseconds of their own: ten times the rows take about ten times as long."""
    def rows(n):
        at = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1_800_000_000))
        start = "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(a AS DECIMAL(18, 6)) / 1000000)"
        return spark.range(n).select(F.lit(0).alias("k"), F.col("id").alias("seq"), at(1).alias("a"), at(2).alias("b")).withColumn("inicio", F.expr(start)).withColumn(
            "fim", F.expr("inicio + make_dt_interval(0, 0, 0, CAST(b AS DECIMAL(18, 6)) / 1000000)"))

    trim = lambda n: intervals.trim_partial(rows(n), ["k"], ["seq"])
    took(lambda: trim(1_000))
    assert took(lambda: trim(40_000)) < 15 * took(lambda: trim(4_000))
    ends = rows(10_000).select("k", microsecond_index("fim").alias("_pu"), microsecond_index("inicio").alias("_ps"))
    low, unit, levels = intervals._grid(ends)
    assert unit == 1
    assert intervals._tree(ends, ["k"], low, unit, levels).agg(F.max(F.size("_kids"))).first()[0] <= intervals.TREE_STEP
