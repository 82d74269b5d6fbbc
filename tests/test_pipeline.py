import datetime as dt
import hashlib
import os

from pyspark.sql import functions as F

from shelfspark.operators.upsert import upsert_versions
from shelfspark.plans import pipeline
from shelfspark.plans.star import Star, build_dimensions
from shelfspark.rules import Rules
from shelfspark.sources.schemas import STAR
from tests.fixtures import D, feed_row, item, product, rows, store, tables, tx


def test_latest_version_wins(spark):
    feed = [feed_row("L1", "2024-03-01 10:00:00", "r1", qty=1),
            feed_row("L1", "2024-03-02 10:00:00", "r2", qty=2),
            feed_row("L1", "2024-03-03 10:00:00", "r3", qty=3),
            feed_row("L2", "2024-03-01 10:00:00", "r4", qty=7),
            feed_row("L2", "2024-03-01 10:00:00", "r5", qty=8)]       # same time: record id decides
    t = tables(spark, feed=feed)
    assert rows(pipeline.latest_versions(t), "transaction_item_id", "quantity", "source_record_id") == \
        [("L1", 3, "r3"), ("L2", 8, "r5")]


def test_late_window_and_flag(spark):
    feed = [feed_row("L1", "2024-03-10 09:00:00", "r1", date="2024-03-09"),     # next day: on time
            feed_row("L2", "2024-03-11 09:00:00", "r2", date="2024-03-09"),     # two days later: late
            feed_row("L3", "2024-03-11 09:00:00", "r3", date="2024-03-07")]     # outside the 48 h window
    t = tables(spark, feed=feed, rules=Rules(run_date=dt.date(2024, 3, 11)))
    assert rows(pipeline.late_window(t), "transaction_item_id", "late_arrival") == [("L1", False), ("L2", True)]


def test_mark_is_inclusive(spark):
    feed = [feed_row("L1", "2024-03-01 00:00:00", "r1"), feed_row("L2", "2024-03-02 00:00:00", "r2")]
    t = tables(spark, feed=feed)
    got = pipeline.new_since_mark(t, dt.datetime(2024, 3, 2))
    assert rows(got, "transaction_item_id") == [("L2",)]


def _fact_rows(spark, data):
    schema = "transaction_item_id string, transaction_date date, v bigint"
    return spark.createDataFrame([(k, D(d), v) for k, d, v in data], schema)


def _upsert(spark, target, data, **how):
    return upsert_versions(spark, target, _fact_rows(spark, data), "transaction_item_id", "transaction_date", ("v",), **how)


def _fact(spark, base, *columns):
    return rows(spark.read.parquet(f"{base}/fact_sales"), *columns)


def test_partition_upsert_is_idempotent_and_handles_moved_rows(spark, scratch):
    target = f"{scratch}/fact"
    _upsert(spark, target, [("a", "2024-03-01", 1), ("b", "2024-03-02", 1), ("c", "2024-03-02", 1)])
    # "a" moves out of its one-row partition; "b" is corrected in place; "d" is new.
    inc = [("a", "2024-03-03", 2), ("b", "2024-03-02", 2), ("d", "2024-03-04", 2)]
    first = _upsert(spark, target, inc)
    read = spark.read.schema("transaction_item_id string, v bigint, transaction_date date")
    after_once = rows(read.parquet(target), "transaction_item_id", "transaction_date", "v")
    _upsert(spark, target, inc)
    after_twice = rows(read.parquet(target), "transaction_item_id", "transaction_date", "v")
    expected = [("a", D("2024-03-03"), 2), ("b", D("2024-03-02"), 2), ("c", D("2024-03-02"), 1),
                ("d", D("2024-03-04"), 2)]
    assert after_once == expected and after_twice == expected
    assert first == {"touched": 4, "emptied": 1}


def test_older_version_arriving_later_does_not_win(spark, scratch):
    target = f"{scratch}/fact"
    _upsert(spark, target, [("a", "2024-03-05", 9)])
    _upsert(spark, target, [("a", "2024-03-05", 1), ("b", "2024-03-05", 1)])
    assert rows(spark.read.parquet(target), "transaction_item_id", "v") == [("a", 9), ("b", 1)]


def test_upsert_leaves_no_scratch_tables_behind(spark, scratch):
    from shelfspark.session import checkpoint_dir
    folder = checkpoint_dir(spark)
    before = set(os.listdir(folder))
    _upsert(spark, f"{scratch}/fact", [("a", "2024-03-01", 1)])
    _upsert(spark, f"{scratch}/fact", [("a", "2024-03-01", 2)])
    assert set(os.listdir(folder)) == before


def test_daily_run_advances_mark_and_loads_fact(spark, scratch):
    t = tables(spark, transactions=[tx("T1")], items=[item("L1", "T1")],
               feed=[feed_row("L1", "2024-03-01 10:00:00", "r1", qty=1),
                     feed_row("L1", "2024-03-02 10:00:00", "r2", qty=4)])
    build_dimensions(t, scratch)
    r1 = pipeline.daily_run(t, scratch)
    assert r1["mark"] == dt.datetime(2024, 3, 2, 10, 0)
    assert _fact(spark, scratch, "transaction_item_id", "quantity", "gmv") == [("L1", 4, 40.0)]
    pipeline.daily_run(t, scratch)                 # re-reading the mark's rows is harmless
    assert len(_fact(spark, scratch, "transaction_item_id")) == 1


def test_a_correction_by_weeks_replaces_the_earlier_version(spark, scratch):
    """Moved far away, and an older version that arrives after the newer one for a far date."""
    runs = [[feed_row("L1", "2024-03-01 10:00:00", "r1", qty=1, date="2024-03-01"),
             feed_row("L2", "2024-03-20 10:00:00", "r4", qty=4, date="2024-03-20")],
            [feed_row("L1", "2024-03-09 10:00:00", "r2", qty=2, date="2024-03-08"),
             feed_row("L2", "2024-03-02 10:00:00", "r3", qty=3, date="2024-03-02")]]
    t = tables(spark, transactions=[tx("T1")], feed=runs[0] + runs[1])
    one_shot = Star(t).fact_from_feed(pipeline.latest_versions(t))
    build_dimensions(t, scratch)
    for part in runs:
        pipeline.apply_increment(t, scratch, tables(spark, feed=part).item_feed)
    loaded = spark.read.schema(STAR["fact_sales"]).parquet(f"{scratch}/fact_sales")
    assert rows(loaded, "transaction_item_id", "transaction_date", "quantity") == \
        [("L1", D("2024-03-08"), 2), ("L2", D("2024-03-20"), 4)]
    assert rows(loaded, *one_shot.columns) == rows(one_shot)


def test_scoped_runs_lose_no_rows(spark, scratch):
    stores = [store("S1", country="CR"), store("S2", country="GT")]
    feed = [feed_row("L1", "2024-03-01 10:00:00", "r1", store_id="S1"),
            feed_row("L2", "2024-02-20 10:00:00", "r2", store_id="S2")]
    t = tables(spark, transactions=[tx("T1")], stores=stores, feed=feed)
    build_dimensions(t, scratch)
    for country in ("CR", "GT"):
        pipeline.daily_run(t, scratch, pipeline.Scope(country, F.col("country") == country))
    assert _fact(spark, scratch, "transaction_item_id") == [("L1",), ("L2",)]
    pipeline.daily_run(t, scratch)
    assert _fact(spark, scratch, "transaction_item_id") == [("L1",), ("L2",)]
    assert set(pipeline.read_marks(spark, scratch)) == {"CR", "GT", "*"}


def test_new_customers_products_and_days_are_added_and_keys_stay(spark, scratch):
    t = tables(spark, transactions=[tx("T5", loyal=True, customer="C5")], items=[item("L0", "T5")],
               feed=[feed_row("L1", "2024-03-02 10:00:00", "r1", loyal=True, customer="C5")])
    build_dimensions(t, scratch)
    pipeline.daily_run(t, scratch)
    key = _fact(spark, scratch, "customer_key")
    later = tables(spark, transactions=[tx("T5", loyal=True, customer="C5")], products=[product("I1"), product("I9")],
                   feed=[feed_row("L2", "2024-04-02 10:00:00", "r2", date="2024-04-01", item_id="I9", loyal=True, customer="C1")])
    result = pipeline.daily_run(later, scratch)
    assert result["added"]["dim_customer"] == 1 and result["added"]["dim_product"] == 1 and result["added"]["dim_date"] > 0
    star = Star.from_written(later, scratch)
    assert len(rows(star.dim_customer, "customer_key")) == len(set(rows(star.dim_customer, "customer_key"))) == 2
    fact = spark.read.parquet(f"{scratch}/fact_sales")
    assert rows(fact.filter("transaction_item_id = 'L1'"), "customer_key") == key
    assert rows(star.clean_sales(fact), "transaction_item_id") == [("L1",), ("L2",)]


def test_lines_of_unknown_products_are_held_back_and_taken_up_later(spark, scratch):
    t = tables(spark, transactions=[tx("T1")], feed=[feed_row("L1", "2024-03-01 10:00:00", "r1", item_id="I7"),
                                                     feed_row("L2", "2024-03-01 11:00:00", "r2")])
    build_dimensions(t, scratch)
    assert pipeline.daily_run(t, scratch)["held_back"] == 1
    assert _fact(spark, scratch, "transaction_item_id") == [("L2",)]
    known = tables(spark, transactions=[tx("T1")], products=[product("I1"), product("I7")],
                   feed=[feed_row("L3", "2024-03-02 10:00:00", "r3")])
    assert pipeline.daily_run(known, scratch)["held_back"] == 0
    assert _fact(spark, scratch, "transaction_item_id") == [("L1",), ("L2",), ("L3",)]


def test_mark_less_reads_take_the_whole_feed(spark):
    feed = [feed_row("L1", "2023-01-01 10:00:00", "r1"), feed_row("L2", "2024-03-01 10:00:00", "r2")]
    assert pipeline.new_since_mark(tables(spark, feed=feed)).count() == 2


def test_search_for_earlier_versions_is_pruned_by_date(spark, scratch):
    import contextlib
    import io

    from shelfspark.operators.upsert import searched
    target = f"{scratch}/fact"
    _upsert(spark, target, [("a", "2024-03-01", 1), ("b", "2024-03-09", 1)])
    found = searched(spark.read.parquet(target), "transaction_date", D("2024-03-09"), D("2024-03-09"), 2)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        found.explain("formatted")
    line = next(x for x in buf.getvalue().splitlines() if x.startswith("PartitionFilters:"))
    assert "2024-03-07" in line and "2024-03-11" in line
    assert rows(found, "transaction_item_id") == [("b",)]


def test_reconciliation_by_date_range_and_store(spark):
    txs = [tx("T1", date="2024-03-01", total=10.0), tx("T2", date="2024-03-05", total=20.0)]
    t = tables(spark, txs, [item("a", "T1"), item("b", "T2")])
    got = pipeline.gmv_reconciliation(t, first=dt.date(2024, 3, 2), last=dt.date(2024, 3, 6), store_ids=["S1"])
    assert rows(got, "transaction_date", "gmv_reportado") == [(D("2024-03-05"), 20.0)]
    assert pipeline.gmv_reconciliation(t, store_ids=["S9"]).count() == 0


def test_silent_store_monitor_includes_never_reporting(spark):
    stores = [store("S1"), store("S2", opening="2024-03-01")]
    t = tables(spark, transactions=[tx("T1", date="2024-03-10")], stores=stores,
               rules=Rules(run_date=dt.date(2024, 3, 11)))
    assert rows(pipeline.silent_stores(t), "store_id", "ultima_fecha_datos", "dias_sin_datos") == \
        [("S2", None, 10)]


def test_pseudonymisation_salt(spark):
    t = tables(spark, transactions=[tx("T1", loyal=True, customer="C1")])
    plain = pipeline.pseudonymised_transactions(t).first()["customer_id_hashed"]
    salted = pipeline.pseudonymised_transactions(t.with_rules(Rules(customer_salt="s"))).first()["customer_id_hashed"]
    assert plain == hashlib.sha256(b"C1").hexdigest() and salted == hashlib.sha256(b"C1s").hexdigest()


def test_reconciliation_returns_in_gross_not_net(spark):
    txs = [tx("T1", total=10.0), tx("T2", total=20.0, status="RETURNED", loyal=True, customer="C1"),
           tx("T3", total=5.0)]
    items = [item("a", "T1", price=10.0), item("b", "T2", price=20.0), item("c", "T1", price=0.0)]
    r = pipeline.gmv_reconciliation(tables(spark, txs, items)).first().asDict()
    assert r["gmv_lealtad"] == 20.0
    assert (r["gmv_reportado"], r["gmv_bruto"], r["gmv_neto"], r["gmv_devoluciones"], r["gmv_valido"],
            r["lineas_precio_cero"], r["diferencia_reportado_vs_lineas"]) == (35.0, 30.0, 10.0, 20.0, 10.0, 1, 5.0)


def test_idle_items(spark):
    txs = [tx("T1", date="2024-01-01"), tx("T2", date="2024-03-10")]
    items = [item("a", "T1", "I1"), item("b", "T2", "I2")]
    t = tables(spark, txs, items, products=[product("I1"), product("I2")], rules=Rules(run_date=dt.date(2024, 3, 11)))
    assert rows(pipeline.idle_items(t), "item_id", "dias_sin_movimiento") == [("I1", 70)]


def test_streaming_loader_equals_batch(spark, scratch):
    from shelfspark.streaming import start_fact_loader
    feed = [feed_row("L1", "2024-03-01 10:00:00", "r1", qty=1), feed_row("L2", "2024-03-01 11:00:00", "r2"),
            feed_row("L1", "2024-03-05 10:00:00", "r3", qty=5, date="2024-03-02")]
    t = tables(spark, feed=feed)
    t.transactions = tables(spark, transactions=[tx("T1")]).transactions
    build_dimensions(t, f"{scratch}/star")
    for i, part in enumerate([feed[:2], feed[2:]]):
        tables(spark, feed=part).item_feed.write.parquet(f"{scratch}/feed/batch={i}")
    q = start_fact_loader(t, f"{scratch}/feed/*", f"{scratch}/star", f"{scratch}/ckpt", max_files_per_trigger=1)
    q.awaitTermination(300)
    read = spark.read.schema("transaction_item_id string, quantity bigint, transaction_date date")
    got = rows(read.parquet(f"{scratch}/star/fact_sales"), "transaction_item_id", "transaction_date", "quantity")
    assert got == [("L1", D("2024-03-02"), 5), ("L2", D("2024-03-01"), 1)]


def test_k_increments_equal_one_load(spark, scratch):
    """Loading the feed in three runs (by ingestion time) gives the fact of one load."""
    feed = [feed_row("L1", "2024-03-01 10:00:00", "r1", qty=1, date="2024-03-01"),
            feed_row("L2", "2024-03-01 12:00:00", "r2", qty=2, date="2024-03-01", item_id="I2"),
            feed_row("L1", "2024-03-03 10:00:00", "r3", qty=3, date="2024-03-02"),      # moves L1 to another day
            feed_row("L3", "2024-03-03 10:00:00", "r4", qty=4, date="2024-03-03", loyal=True, customer="C1"),
            feed_row("L2", "2024-03-05 09:00:00", "r5", qty=5, date="2024-03-01", item_id="I2", status="RETURNED")]
    t = tables(spark, transactions=[tx("T1", loyal=True, customer="C1")],
               products=[product("I1"), product("I2")], feed=feed)
    one_shot = rows(Star(t).fact_from_feed(pipeline.latest_versions(t)).drop("customer_key"))
    build_dimensions(t, scratch)
    full = t.item_feed
    for cut in ("2024-03-02", "2024-03-04", "2100-01-01"):
        t.item_feed = full.filter(F.col("ingestion_timestamp") < F.lit(cut).cast("timestamp"))
        pipeline.daily_run(t, scratch)
    loaded = pipeline.written_fact(t, scratch).drop("customer_key")
    assert rows(loaded) == one_shot
    assert len(one_shot) == 3


def test_upsert_reads_only_touched_partitions(spark, scratch):
    import contextlib
    import io
    target = f"{scratch}/fact"
    _upsert(spark, target, [("a", "2024-03-01", 1), ("b", "2024-03-02", 1)])
    from shelfspark.operators.upsert import touched_partitions
    kept = touched_partitions(spark.read.parquet(target), "transaction_date", [D("2024-03-02")])
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        kept.explain("formatted")
    p = buf.getvalue()
    line = next(x for x in p.splitlines() if x.startswith("PartitionFilters:"))
    assert "isnotnull(transaction_date" in line and "2024-03-02" in line
    assert rows(kept, "transaction_item_id") == [("b",)]


def test_csv_origin_round_trip(spark, scratch):
    from shelfspark.plans import audit
    from shelfspark.sources.raw import RawTables
    from shelfspark.sources.schemas import RAW
    src = RawTables.from_driver(spark, "/root/testdata/sf0.001")
    for name in RAW:
        src.table(name).coalesce(1).write.option("header", True).csv(f"{scratch}/csv_parts/{name}")
        import glob
        import shutil
        part = glob.glob(f"{scratch}/csv_parts/{name}/part-*.csv")[0]
        shutil.copy(part, f"{scratch}/{name}.csv")
    from_csv = RawTables.from_csv(spark, scratch)
    for job in (audit.row_counts, audit.header_line_reconciliation, audit.store_freshness_gaps):
        assert sorted(map(tuple, job(from_csv).collect())) == sorted(map(tuple, job(src).collect()))


def test_streaming_daily_gmv_with_watermark(spark, scratch):
    from shelfspark.streaming import daily_store_gmv, feed_stream
    feed = [feed_row("L1", "2024-03-01 10:00:00", "r1", qty=1, date="2024-03-01"),
            feed_row("L1", "2024-03-01 11:00:00", "r2", qty=9, date="2024-03-01"),   # later version wins
            feed_row("L2", "2024-03-02 10:00:00", "r3", qty=2, date="2024-03-02"),
            feed_row("L3", "2024-03-09 10:00:00", "r4", qty=1, date="2024-03-09")]   # moves the watermark
    tables(spark, feed=feed).item_feed.write.parquet(f"{scratch}/feed")
    q = (daily_store_gmv(feed_stream(spark, f"{scratch}/feed")).writeStream.format("memory")
         .queryName("gmv_test").outputMode("append").option("checkpointLocation", f"{scratch}/ck")
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = rows(spark.table("gmv_test"), "store_id", "transaction_date", "gmv", "lines")
    assert ("S1", D("2024-03-01"), 90.0, 1) in got and ("S1", D("2024-03-02"), 20.0, 1) in got


def test_daily_run_on_a_written_star(spark, scratch):
    from shelfspark.plans.star import build_star
    t = tables(spark, transactions=[tx("T1", loyal=True, customer="C1")], items=[item("L1", "T1")],
               feed=[feed_row("L2", "2024-03-02 10:00:00", "r1", qty=2, loyal=True, customer="C1")])
    build_star(t, f"{scratch}/star")
    pipeline.daily_run(t, f"{scratch}/star")
    assert _fact(spark, f"{scratch}/star", "transaction_item_id", "customer_key", "quantity") == [("L1", 1, 1), ("L2", 1, 2)]


def test_upsert_leaves_untouched_partitions_with_static_session_mode(spark, scratch):
    old = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    try:
        target = f"{scratch}/fact"
        _upsert(spark, target, [("a", "2024-03-01", 1), ("b", "2024-03-02", 1)])
        _upsert(spark, target, [("b", "2024-03-02", 2)])
        assert rows(spark.read.parquet(target), "transaction_item_id", "v") == [("a", 1), ("b", 2)]
        assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == "static"
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", old)


def test_a_cluster_needs_a_shared_checkpoint_folder():
    import types

    import pytest

    from shelfspark.session import checkpoint_dir
    context = types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda key, default=None: default), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(session)


def test_an_increment_of_one_version_per_key_is_not_written_again(spark, scratch, monkeypatch):
    from shelfspark.session import Scratch

    made, keep, counts = [], Scratch.keep, []
    monkeypatch.setattr(Scratch, "keep", lambda self, df, *more: made.append(df) or keep(self, df, *more))
    for name, how in (("plain", {}), ("once", {"latest_only": True})):
        made.clear()
        _upsert(spark, f"{scratch}/{name}", [("a", "2024-01-01", 1), ("b", "2024-01-02", 2)], **how)
        _upsert(spark, f"{scratch}/{name}", [("a", "2024-01-03", 2), ("b", "2024-01-04", 1)], **how)   # b is older than what stands
        counts.append(len(made))
    found = [rows(spark.read.parquet(f"{scratch}/{name}"), "transaction_item_id", "transaction_date", "v") for name in ("plain", "once")]
    assert found[0] == found[1] == [("a", D("2024-01-03"), 2), ("b", D("2024-01-02"), 2)]
    assert counts == [4, 2]


def test_upsert_appends_to_dates_that_lose_no_row(spark, scratch):
    def files(day):
        return {f for f in os.listdir(f"{scratch}/fact/transaction_date={day}") if f.endswith(".parquet")}
    target = f"{scratch}/fact"
    _upsert(spark, target, [("a", "2024-03-01", 1), ("b", "2024-03-02", 1), ("c", "2024-03-03", 1)])
    before = {d: files(f"2024-03-0{d}") for d in (1, 2, 3)}
    # "a" comes again, "b" is corrected, "d" joins "c", an older "c" comes late for another day.
    got = _upsert(spark, target, [("a", "2024-03-01", 1), ("b", "2024-03-02", 2), ("d", "2024-03-03", 1), ("c", "2024-03-09", 0)])
    assert got == {"touched": 4, "emptied": 1}
    assert files("2024-03-01") == before[1] and files("2024-03-03") > before[3]          # what stands is neither read whole nor written again
    assert not files("2024-03-02") & before[2] and not os.path.exists(f"{target}/transaction_date=2024-03-09")
    read = spark.read.schema("transaction_item_id string, v bigint, transaction_date date").parquet(target)
    assert rows(read, "transaction_item_id", "v") == [("a", 1), ("b", 2), ("c", 1), ("d", 1)]


def test_upsert_writes_dates_of_many_files_and_repeated_keys_anew(spark, scratch, monkeypatch):
    from shelfspark.operators import upsert
    target, schema = f"{scratch}/fact", "transaction_item_id string, v bigint, transaction_date date"
    # A table that no upsert has written: "a" stands three times, once without a key, and twice on the date of "n".
    _fact_rows(spark, [("a", "2024-03-01", 1), ("a", "2024-03-01", 2), ("a", "2024-03-02", 3), ("n", "2024-03-02", 1), (None, "2024-03-04", 1)]) \
        .coalesce(1).write.partitionBy("transaction_date").parquet(target)
    _upsert(spark, target, [("x", "2024-03-01", 1), ("y", "2024-03-02", 1), (None, "2024-03-04", 2), ("z", "2024-03-05", 1)])
    expected = [("a", 3, D("2024-03-02")), ("n", 1, D("2024-03-02")), ("x", 1, D("2024-03-01")), ("y", 1, D("2024-03-02")), ("z", 1, D("2024-03-05"))]
    got = spark.read.schema(schema).parquet(target)
    assert rows(got.filter("transaction_item_id IS NOT NULL")) == expected
    assert rows(got.filter("transaction_item_id IS NULL"), "v") == [(2,)]
    monkeypatch.setattr(upsert, "FILES", 3)
    counts = []
    for i in range(5):
        _upsert(spark, target, [(f"z{i}", "2024-03-05", 1)])
        counts.append(len([f for f in os.listdir(f"{target}/transaction_date=2024-03-05") if f.endswith(".parquet")]))
    assert max(counts) <= 3 and spark.read.schema(schema).parquet(target).count() == 11


def _exchanges(df):
    import re
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange (?:hash|range)partitioning\((.*)", plan.split("== Initial Plan ==")[-1])


def test_versions_of_a_dealt_feed_meet_what_stands_in_place(spark, scratch):
    """What stands crosses the shuffle by key, version and date only; the increment not at all."""
    from shelfspark.operators.upsert import newer
    from shelfspark.session import SPARING, Scratch, sparing
    before = {k: spark.conf.get(k) for k in SPARING}
    feed = spark.createDataFrame([("t1", "a", D("2024-03-01"), 2, "w"), ("t1", "b", D("2024-03-01"), 1, "w"), ("t2", "c", D("2024-03-02"), 5, "w")],
                                 "t string, k string, d date, v bigint, wide string")
    old = spark.createDataFrame([("t1", "a", D("2024-02-01"), 1, "o"), ("t1", "b", D("2024-03-01"), 1, "o")], feed.schema)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with Scratch(spark) as s, sparing(spark):
            dealt = spark.table(s.keep(feed, int(spark.conf.get("spark.sql.shuffle.partitions")), ("t",)))
            old.write.parquet(f"{scratch}/old")
            won = newer(dealt, spark.read.schema(feed.schema).parquet(f"{scratch}/old"), "k", "d", ("v",), ("t",))
            assert rows(won.select("t", "k", "v", F.col("_places.at")[0])) == [("t1", "a", 2, D("2024-02-01")), ("t2", "c", 5, None)]
            text = won._jdf.queryExecution().executedPlan().toString()
            assert len(_exchanges(won)) == 1 and "wide" not in text[text.index("Exchange"):]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {k: spark.conf.get(k) for k in SPARING} == before


def test_several_runs_read_the_feed_from_one_table(spark, monkeypatch):
    """The feed is joined together once, and a run writes no line twice before the fact."""
    from shelfspark.session import Scratch, clear_scratch
    from shelfspark.sources.raw import RawTables
    t, made, keep = RawTables.from_driver(spark, "/root/testdata/sf0.001"), [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, *more: made.append(df.columns) or keep(self, df, *more))
    base = pipeline.loaded_in_runs(t, scoped=False)
    whole = [c for c in made if {"transaction_item_id", "payment_method"} <= set(c)]
    assert len([c for c in whole if "_places" not in c and "gmv" not in c]) == 3          # the feed, and what each of two runs holds back
    assert len([c for c in whole if "gmv" in c]) == 2                                     # a run's new lines
    loaded, once = pipeline.written_fact(t, base), Star(t).fact_from_feed(pipeline.latest_versions(t))
    names = ["transaction_item_id", "transaction_date", "quantity", "gmv", "late_arrival"]
    assert rows(loaded.select(names)) == rows(once.select(names))
    clear_scratch(spark)
