import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from decimal import Decimal

from shelfspark.functions.money import as_money, exact, line_amount, round_half_away
from shelfspark.operators.interval_join import interval_join
from shelfspark.operators.surrogate import surrogate_key


def test_rounding_is_half_away_from_zero(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (0.125,), (1.0049,), (None,)], "x double")
    got = [r[0] for r in df.select(round_half_away("x", 0)).collect()]
    assert got == [3.0, -3.0, 0.0, 1.0, None]
    assert [r[0] for r in df.select(exact("x")).collect()] == [Decimal("2.5"), Decimal("-2.5"), Decimal("0.125"), Decimal("1.0049"), None]


def test_price_is_not_rounded_before_it_is_multiplied(spark):
    df = spark.createDataFrame([(0.125, 1000), (0.1, 3)], "p double, q bigint").withColumn("a", line_amount("p", "q"))
    assert [r[0] for r in df.select(as_money("a")).collect()] == [125.0, 0.3]
    assert df.select(as_money(F.sum("a"))).first()[0] == 125.3


def test_scalable_surrogate_equals_global_row_number(spark):
    df = spark.range(0, 5000).select(((F.col("id") * 7919) % 5003).cast("string").alias("k"))
    numbers = df.withColumn("rn", F.row_number().over(Window.orderBy("k")).cast("bigint"))
    for range_rows in (1_000_000, 600):                   # one range, several
        scalable = surrogate_key(df, ["k"], "sk", range_rows=range_rows)
        joined = scalable.join(numbers, "k")
        assert joined.count() == 5000
        assert joined.filter(F.col("sk") != F.col("rn")).count() == 0
        assert scalable.agg(F.min("sk"), F.max("sk"), F.countDistinct("sk")).first() == (1, 5000, 5000)


def test_surrogate_numbers_go_on_above_a_key_and_need_no_row_window(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3)], "k string, v int")
    assert sorted((r.sk, r.v) for r in surrogate_key(df, ["k", "v"], "sk", above=F.lit(10)).collect()) == [(11, 3), (12, 2), (13, 1)]
    assert surrogate_key(df.limit(0), ["k"], "sk").count() == 0
    for range_rows in (1_000, 10):
        plan = surrogate_key(spark.range(100).withColumnRenamed("id", "k"), ["k"], "sk", range_rows=range_rows)._jdf.queryExecution().toString()
        assert "row_number" not in plan and "Range (" not in plan      # numbered from the written table


def test_interval_join_takes_bounds_from_the_caller(spark):
    left = spark.createDataFrame([("S", dt.date(2024, 1, d)) for d in range(1, 31)], "store_id string, d date")
    right = spark.createDataFrame([(1, "S", dt.date(2024, 1, 5), dt.date(9999, 12, 31))], "pk int, store_id string, s date, e date")
    joined = interval_join(left, right, ["store_id"], "d", "s", "e", dates=(dt.date(2024, 1, 1), dt.date(2024, 1, 30)))
    assert joined.count() == 26
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2     # each side once
    assert interval_join(left.limit(0), right, ["store_id"], "d", "s", "e").count() == 0


def test_interval_join_does_not_explode_open_intervals(spark):
    left = spark.createDataFrame([("S", dt.date(2024, 1, d)) for d in range(1, 31)], "store_id string, d date")
    right = spark.createDataFrame([(1, "S", dt.date(2024, 1, 5), dt.date(9999, 12, 31)), (2, "S", None, dt.date(2024, 2, 1))],
                                  "pk int, store_id string, s date, e date")
    joined = interval_join(left, right, ["store_id"], "d", "s", "e")
    assert joined.count() == 26
    spread = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "least" in spread and "greatest" in spread


def test_interval_join_matches_brute_force(spark):
    base = dt.date(2024, 1, 1)
    left = spark.createDataFrame([(f"S{i % 3}", base + dt.timedelta(days=i)) for i in range(120)],
                                 "store_id string, d date")
    right = spark.createDataFrame(
        [(k, f"S{k % 3}", base + dt.timedelta(days=5 * k), base + dt.timedelta(days=5 * k + (k % 17)))
         for k in range(25)] + [(99, "S0", base + dt.timedelta(days=9), base + dt.timedelta(days=3))],
        "pk int, store_id string, s date, e date")
    got = interval_join(left, right, ["store_id"], "d", "s", "e", bucket_days=4).select("store_id", "d", "pk")
    brute = (left.join(right, (left.store_id == right.store_id) & left.d.between(right.s, right.e))
             .select(left.store_id, "d", "pk"))
    assert sorted(got.collect()) == sorted(brute.collect())
    assert got.count() > 0


def test_scale_conf_sizes_partitions_to_the_data():
    from shelfspark.session import scale_conf
    c = scale_conf(100 * 2**40, total_cores=8000)          # 100 TB on 1000 executors × 8 cores
    assert int(c["spark.sql.shuffle.partitions"]) == 409600
    assert c["buckets"] == 131072                           # ~1 GB per bucket file
    small = scale_conf(10 * 2**20, total_cores=8)
    assert int(small["spark.sql.shuffle.partitions"]) == 16 and small["buckets"] == 8
