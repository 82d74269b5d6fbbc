"""Percentiles, sweeps, bitmaps, split joins, fingerprints and the CSV quarantine, against plain forms."""

import datetime as dt
import random

import duckdb
from pyspark.sql import functions as F

from shelfspark.operators import bitmaps, fingerprints, split_join
from shelfspark.operators.percentile import exact_percentiles
from shelfspark.operators.sweep import class_overlaps
from shelfspark.plans import scaled
from shelfspark.sources.csv_quarantine import read_quarantined
from shelfspark.sources.raw import RawTables
from shelfspark.sources.schemas import RAW
from tests.fixtures import D, item, product, rows, store, tables, tx


def test_percentiles_equal_quantile_cont(spark):
    rng = random.Random(1)
    data = [("ties", float(rng.randrange(3))) for _ in range(500)] + [("wide", rng.choice([1e-9, 1.0, 1e300]) * rng.random()) for _ in range(700)]
    data += [("one", 5.5), ("same", 0.1), ("same", 0.1), ("none", None), ("nan", float("nan")), ("neg", -3.0), ("neg", 7.0), (None, 2.0)]
    df = spark.createDataFrame(data, "g string, v double")
    for bins in (4, 1024):
        got = exact_percentiles(df, ["g"], "v", (0, 0.25, 0.5, 0.999, 1), bins=bins)
        found = {(r.g, r.q): r.percentile for r in got.collect()}
        want = duckdb.connect()
        pdf = df.filter("v IS NOT NULL AND NOT isnan(v)").toPandas()  # noqa: F841
        want.register("t", pdf)
        for g in ("ties", "wide", "one", "same", "neg"):
            for q in (0, 0.25, 0.5, 0.999, 1):
                assert found[g, q] == want.execute(f"SELECT quantile_cont(v, {q}) FROM t WHERE g = ?", [g]).fetchone()[0], (g, q)
        assert ("none", 0.5) not in found and ("nan", 0.5) not in found
    assert exact_percentiles(df.limit(0), ["g"], "v", (0.5,)).count() == 0


def test_percentile_of_one_large_group_moves_bins_not_rows(spark):
    big = spark.range(300_000).select(F.lit("f").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / 7.0).alias("v"))
    found = exact_percentiles(big, ["g"], "v", (0.25,)).first()
    con = duckdb.connect()
    pdf = big.toPandas()  # noqa: F841
    assert found.percentile == con.execute("SELECT quantile_cont(v, 0.25) FROM pdf").fetchone()[0] and found.n == 300_000


def brute_overlaps(data):
    days = {}
    for g, c, a, b in data:
        if a and b and c:
            for n in range((b - a).days + 1):
                days.setdefault((g, a + dt.timedelta(days=n)), set()).add(c)
    out, many = [], sorted(k for k, v in days.items() if len(v) > 1)
    for g, d in many:
        if out and out[-1][0] == g and out[-1][2] == d - dt.timedelta(days=1):
            out[-1][2], out[-1][4] = d, max(out[-1][4], len(days[g, d]))
        else:
            out.append([g, d, d, 0, len(days[g, d])])
    return sorted((g, a, b, (b - a).days + 1, m) for g, a, b, _, m in out)


def test_sweep_equals_day_by_day(spark):
    rng = random.Random(2)
    for _ in range(4):
        data = []
        for _ in range(60):
            a = D("2024-01-01") + dt.timedelta(days=rng.randrange(60))
            data.append((rng.choice("ab"), rng.choice("xyz"), a, a + dt.timedelta(days=rng.choice([0, 1, 2, 5, -3]))))
        data += [("a", None, D("2024-01-01"), D("2024-02-01")), ("a", "x", None, D("2024-02-01")), ("a", "x", D("2024-01-05"), D("2024-01-05"))]
        found = class_overlaps(spark.createDataFrame(data, "g string, c string, s date, e date"), ["g"], "c", "s", "e")
        assert rows(found) == sorted(brute_overlaps(data), key=repr)
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "Join" not in found._jdf.queryExecution().toString()


def test_bitmaps_count_unions_and_intersections(spark):
    rng = random.Random(3)
    data = [(rng.randrange(6), rng.choice([rng.randrange(1, 90), 32_768 + rng.randrange(50), 1_000_000])) for _ in range(400)] + [(0, None)]
    df = spark.createDataFrame(data, "day int, key bigint")
    sets = bitmaps.key_sets(df, ["day"], "key")
    per = {d: {k for day, k in data if day == d and k is not None} for d in range(6)}
    assert rows(bitmaps.counted(sets, ["day"], "n"), "day", "n") == [(d, len(s)) for d, s in per.items()]
    halves = bitmaps.united(sets, [(F.col("day") >= 3).alias("late")])
    late = set().union(*(per[d] for d in (3, 4, 5)))
    assert rows(bitmaps.counted(halves, ["late"], "n").filter("late"), "n") == [(len(late),)]
    both = bitmaps.shared(sets.withColumn("late", F.lit(True)), halves, ["late"], ["day"])
    got = {r.day: r.n for r in bitmaps.counted(both, ["day"], "n").collect()}
    assert {d: n for d, n in got.items() if n} == {d: len(s & late) for d, s in per.items() if s & late}


def test_retention_needs_no_shuffle_of_ids(spark, scratch):
    t = RawTables.from_driver(spark, "/root/testdata/sf0.001")
    from shelfspark.plans.star import Star
    star = Star(t)
    scaled.activity_sets(t, star).write.parquet(f"{scratch}/activity")
    scaled.cohort_sets(star).write.parquet(f"{scratch}/cohorts")
    kept = scaled.retention(spark.read.parquet(f"{scratch}/activity"), spark.read.parquet(f"{scratch}/cohorts"), (0, 1, 2, 3, 6))
    plan = kept._jdf.queryExecution().toString()
    assert "customer" not in plan.lower()
    from shelfspark.plans.reports import loyalty_cohorts
    want = rows(loyalty_cohorts(t), "cohort_month", "cohort_size", "POR_retention_mes_1", "POR_retention_mes_6")
    assert rows(scaled.retention_from_bitmaps(t), "cohort_month", "cohort_size", "POR_retention_mes_1", "POR_retention_mes_6") == want


def test_split_join_equals_join_and_deals_the_hot_key(spark, scratch):
    lines = spark.range(9000).select(F.when(F.col("id") < 6000, "T0").otherwise(F.concat(F.lit("T"), F.col("id") % 200)).alias("t"), F.col("id").cast("string").alias("i"))
    heads = spark.range(210).select(F.concat(F.lit("T"), F.col("id")).alias("t"), "id").unionByName(spark.createDataFrame([(None, 1)], "t string, id bigint"))
    lines = lines.unionByName(spark.createDataFrame([(None, "x")], "t string, i string"))
    assert split_join.hot_keys(lines, "t", 500) == {"T0": 6015}
    spark.sql(f"CREATE DATABASE IF NOT EXISTS split_test LOCATION '{scratch}/db'")
    for name, df in (("lines", lines), ("heads", heads)):
        df.repartition(4, "t").write.mode("overwrite").bucketBy(4, "t").sortBy("t").saveAsTable(f"split_test.{name}")
    want = rows(lines.join(heads, "t"))
    for a, b in ((lines, heads), (spark.table("split_test.lines"), spark.table("split_test.heads"))):
        joined = split_join.split_join(a, b, "t", "i", part_rows=500)
        assert rows(joined) == want
    assert rows(split_join.split_join(lines, heads, "t", "i")) == want                # nothing hot
    parts = lines.filter("t = 'T0'").groupBy(F.pmod(F.xxhash64("i"), F.lit(13))).count()
    assert parts.agg(F.max("count") / F.expr("median(count)")).first()[0] < 2
    assert split_join.hot_keys(lines.limit(0), "t", 1) == {}


def test_fingerprints_find_planted_differences_and_read_no_more(spark):
    same = [(f"k{i}", D("2024-01-01") + dt.timedelta(days=i % 9), i, None if i % 5 else "x") for i in range(400)]
    a = same + [("only a", D("2024-01-03"), 1, None), ("twice", D("2024-01-04"), 1, None), ("null day", None, 1, "y")]
    b = [r if r[0] != "k17" else (*r[:2], 99, r[3]) for r in same] + [("twice", D("2024-01-04"), 1, None)] * 2 + [("only b", D("2024-02-01"), 1, None)]
    fa, fb = (spark.createDataFrame(x, "k string, d date, v bigint, s string") for x in (a, b))
    found = fingerprints.differences(fa, fb, "k", "d", ["v", "s"], buckets=8)
    assert rows(found, "k", "n_a", "n_b", "same") == [("k17", 1, 1, 0), ("null day", 1, 0, 0), ("only a", 1, 0, 0), ("only b", 0, 1, 0), ("twice", 1, 2, 1)]
    assert fingerprints.differences(fa, fa, "k", "d", ["v", "s"]).count() == 0
    by = fingerprints.fingerprints(fa, ["d"], ["k", "v"])
    assert rows(by) == rows(fingerprints.fingerprints(fa.repartition(7), ["d"], ["k", "v"]))
    swapped = spark.createDataFrame([("k", None, "a", "b")], "k string, d date, x string, y string")
    other = spark.createDataFrame([("k", None, "b", "a")], "k string, d date, x string, y string")
    assert fingerprints.differences(swapped, other, "k", "d", ["x", "y"]).count() == 1


def test_quarantine_accounts_for_every_line(spark, scratch):
    import os
    os.makedirs(f"{scratch}/products.csv")
    names = RAW["products"].fieldNames()
    files = {
        "a.csv": [",".join(names), "I1,one,b,V1,C,D,1.5", "I2,two,,V1,C,,2", "I3,three,b,V1,C,D,notanumber", "I4,four,b", ",no id,b,V1,C,D,1.0", 'I5,"five, quoted",b,V1,C,D,3.0'],
        "b.csv": ["cost,item_id,item_name,brand,vendor_id,category,department,extra", "4.5,I6,six,b,V1,C,D,zzz", "x,I7,seven,b,V1,C,D,zzz"],
        "c.csv": ["item_id,item_name", "I8,eight"],
        "d.csv": [],
    }
    for name, body in files.items():
        with open(f"{scratch}/products.csv/{name}", "w") as f:
            f.write("\n".join(body) + ("\n" if body else ""))
    load = read_quarantined(spark, f"{scratch}/products.csv", RAW["products"])
    assert rows(load.rows, "item_id", "item_name", "cost") == [("I1", "one", 1.5), ("I2", "two", 2.0), ("I5", "five, quoted", 3.0), ("I6", "six", 4.5)]
    bad = [(r.source_file.rsplit("/", 1)[1], r.line_number, r.is_header) for r in load.quarantine.orderBy("source_file", "line_number").collect()]
    assert bad == [("a.csv", 4, False), ("a.csv", 5, False), ("a.csv", 6, False), ("b.csv", 1, True), ("b.csv", 3, False), ("c.csv", 1, True), ("c.csv", 2, False)]
    lines = sum(len(body) for body in files.values())
    good_headers = 1
    assert load.rows.count() + load.quarantine.count() + good_headers == lines
    reasons = {r.line: r.reason for r in load.quarantine.collect()}
    assert reasons[",no id,b,V1,C,D,1.0"] == "no value: item_id" and "missing" in reasons["item_id,item_name"] and "lacks" in reasons["I8,eight"]
    t = tables(spark, transactions=[tx("T1")], items=[item("a", "T1")], stores=[store("S1")], products=[product("I1")])
    for name in RAW:
        if name != "products":
            t.table(name).write.option("header", True).csv(f"{scratch}/{name}.csv")
    loaded, bad = RawTables.from_csv_quarantined(spark, scratch)
    assert loaded.transactions.count() == 1 and loaded.products.count() == 4
    assert {r[0] for r in bad.select("table_name").distinct().collect()} == {"products"}


def test_a_numbered_line_keeps_its_place_over_many_blocks(spark, scratch):
    from shelfspark.sources.csv_quarantine import numbered_lines
    with open(f"{scratch}/x.csv", "w") as f:
        f.write("".join(f"line {i}\n" for i in range(1, 5001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = numbered_lines(spark, f"{scratch}/x.csv")
        assert got.count() == 5000
        assert got.filter(F.concat(F.lit("line "), F.col("line_number")) != F.col("line")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_fingerprint_reconciliation_derives_each_side_once(spark):
    t = RawTables.from_driver(spark, "/root/testdata/sf0.001")
    found = scaled.fingerprint_reconciliation(t)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "latest-lines" in " ".join(found.inputFiles())
    assert not any(f.endswith(f"{name}.parquet") for f in found.inputFiles() for name in ("lineitem", "orders", "part"))
