"""Type-2 dimensions, kept reports, silence monitors."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import scd2
from shelfspark.plans import kept_reports, pipeline, reports
from shelfspark.plans.star import STORE, Star, build_dimensions
from shelfspark.rules import Rules
from shelfspark.streaming import silence
from tests.fixtures import D, feed_row, product, rows, store, tables, tx

DIM = scd2.Dimension("id", "key", ("a", "b"))
COLUMNS = "key bigint, id string, a string, b string, note string, valid_from date, valid_to date, is_current boolean"


def dim(spark, data):
    return spark.createDataFrame([(k, i, a, b, n, D(f), t and D(t), c) for k, i, a, b, n, f, t, c in data], COLUMNS)


def master(spark, data):
    return spark.createDataFrame(data, "id string, a string, b string, note string")


def test_changes_open_and_close_versions(spark):
    now = dim(spark, [(1, "x", "1", None, "n", "2024-01-01", None, True), (2, "y", "1", "1", "n", "2024-01-01", None, True),
                      (3, "z", "1", "1", "n", "2024-01-01", None, True), (4, "w", "1", "1", "n", "2024-03-01", None, True)])
    state = master(spark, [("x", "1", "null", "m"), ("y", "1", "1", "other note"), ("v", "9", None, "m"), ("w", "2", "2", "m")])
    after = scd2.merge_versions(now, state, dt.date(2024, 3, 1), DIM)
    assert rows(after, "key", "id", "a", "b", "valid_from", "valid_to", "is_current") == [
        (1, "x", "1", None, D("2024-01-01"), D("2024-02-29"), False),     # null became a value
        (2, "y", "1", "1", D("2024-01-01"), None, True),                  # the note is not tracked
        (3, "z", "1", "1", D("2024-01-01"), None, True),                  # missing from the state
        (4, "w", "2", "2", D("2024-03-01"), None, True),                  # began on the day: replaced, key kept
        (5, "v", "9", None, D("2024-03-01"), None, True), (6, "x", "1", "null", D("2024-03-01"), None, True)]
    assert scd2.overlaps(after, DIM).count() == 0
    again = scd2.merge_versions(after, state, dt.date(2024, 3, 1), DIM)
    assert rows(again) == rows(after)
    assert scd2.changes(after, state, DIM).count() == 0
    late = scd2.merge_versions(after, master(spark, [("x", "7", "7", "m")]), dt.date(2024, 2, 1), DIM)
    assert rows(late) == rows(after)                                      # a state from before the current version
    assert scd2.overlaps(dim(spark, [(1, "x", "1", "1", "n", "2024-01-01", "2024-02-01", False), (2, "x", "1", "1", "n", "2024-02-01", None, True)]), DIM).count() == 1


def test_a_fact_finds_the_version_of_its_day(spark):
    d = dim(spark, [(1, "x", "1", "1", "n", "2024-01-10", "2024-01-19", False), (2, "x", "2", "1", "n", "2024-01-20", None, True)])
    facts = spark.createDataFrame([("x", D(f"2024-01-{n}")) for n in ("01", "10", "19", "20", "31")] + [("q", D("2024-01-15"))], "id string, day date")
    assert rows(scd2.version_at(facts, d, "day", DIM, ["key"]), "day", "key") == [
        (D("2024-01-01"), 1), (D("2024-01-10"), 1), (D("2024-01-19"), 1), (D("2024-01-20"), 2), (D("2024-01-31"), 2)]
    assert scd2.version_at(facts, d, "day", DIM, ["key"], "left").filter("key IS NULL").count() == 1


def test_daily_runs_carry_changes_of_stores_and_products(spark, scratch):
    def day(n, size, cost, line):
        return tables(spark, transactions=[tx("T1")], stores=[store("S1", size=size)], products=[product("I1", cost=cost)],
                      feed=[feed_row(line, f"2024-03-0{n} 10:00:00", f"r{n}", date=f"2024-03-0{n}")])
    first = day(1, 100, 5.0, "L1")
    build_dimensions(first, scratch)
    pipeline.daily_run(first, scratch)
    second = day(4, 250, 6.0, "L2")
    result = pipeline.daily_run(second, scratch)
    assert result["added"]["dim_store"] == 1 and result["added"]["changed_products"] == 1
    assert pipeline.daily_run(second, scratch)["added"]["dim_store"] == 0          # once more changes nothing
    star = Star.from_written(second, scratch)
    assert rows(star.dim_store, "store_key", "size_sqm", "valid_to", "is_current") == [(1, 100, D("2024-03-03"), False), (2, 250, None, True)]
    assert rows(star.dim_product, "product_key", "cost") == [(1, 6.0)]
    fact = pipeline.written_fact(second, scratch)
    assert rows(fact, "transaction_item_id", "store_key", "unit_cost") == [("L1", 1, 5.0), ("L2", 2, 6.0)]
    assert rows(star.clean_sales(fact), "transaction_item_id", "size_sqm") == [("L1", 100), ("L2", 250)]
    corrected = day(5, 250, 6.0, "L1")
    corrected.item_feed = tables(spark, feed=[feed_row("L1", "2024-03-05 10:00:00", "r7", qty=3, date="2024-03-02")]).item_feed
    pipeline.daily_run(corrected, scratch)
    assert rows(pipeline.written_fact(second, scratch), "transaction_item_id", "store_key", "quantity") == [("L1", 1, 3), ("L2", 2, 1)]
    assert scd2.overlaps(star.dim_store, STORE).count() == 0


def test_a_dimension_is_replaced_whole_or_not_at_all(spark, scratch, monkeypatch):
    from shelfspark import session
    path = f"{scratch}/d"
    spark.range(3).write.parquet(path)
    with monkeypatch.context() as m:
        m.setattr(session, "recover_folder", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            session.replace_folder(spark.range(5), path)
    session.recover_folder(spark, path)
    assert spark.read.parquet(path).count() == 5


# ---- kept reports ---------------------------------------------------------------------

def full_and_kept(spark, t, scratch):
    kept = kept_reports.KeptReports(t, scratch)
    star, fact = Star.from_written(t, scratch), pipeline.written_fact(t, scratch)
    from dataclasses import replace
    sums = kept_reports.per_day(t, star, fact)
    sales = replace(t, shared_sales=sums)
    return [(rows(reports.comparable_sales(sales)), rows(kept.comparable_sales())),
            (rows(reports.gmroi_by_vendor_category(sales)), rows(kept.gmroi())),
            (rows(reports.stockout_gaps(sales)), rows(kept.stockout_gaps()))]


def test_kept_reports_equal_a_full_run_after_every_increment(spark, scratch):
    import random
    rng = random.Random(3)
    stores, products = [store("S1"), store("S2")], [product("I1"), product("I2")]
    t = tables(spark, transactions=[tx("T1", date="2024-03-30")], stores=stores, products=products, rules=Rules(stockout_min_selling_days=2))
    build_dimensions(t, scratch)
    for run in range(4):
        feed = []
        for n in range(14):
            line = f"L{rng.randrange(30)}"        # corrections move lines between days, pairs and states
            feed.append(feed_row(line, f"2024-04-0{run + 1} 10:{n:02d}:00", f"r{run}.{n}", date=f"2024-03-{rng.randrange(1, 29):02d}",
                                 store_id=rng.choice(["S1", "S2"]), item_id=rng.choice(["I1", "I2"]), qty=rng.randrange(1, 5),
                                 price=rng.choice([0.0, 9.5, 10.25]), status=rng.choice(["COMPLETED", "COMPLETED", "RETURNED"]),
                                 total=rng.choice([100.0, 100.0, 0.0])))
        t.item_feed = tables(spark, feed=feed).item_feed
        pipeline.apply_increment(t, scratch, keep_reports=True)
        for full, kept in full_and_kept(spark, t, scratch):
            assert kept == full
    state = rows(kept_reports.KeptReports(t, scratch).state())
    pipeline.apply_increment(t, scratch, keep_reports=True)          # a run that is repeated
    assert rows(kept_reports.KeptReports(t, scratch).state()) == state


def test_reports_kept_from_a_built_star_on(spark, scratch):
    from shelfspark.plans.star import build_star
    from tests.fixtures import item
    t = tables(spark, transactions=[tx("T1", date="2024-01-05"), tx("T2", date="2024-02-05")], items=[item("A", "T1"), item("B", "T2")],
               feed=[feed_row("L1", "2024-03-02 10:00:00", "r1", date="2024-01-20")], rules=Rules(stockout_min_selling_days=1))
    build_star(t, scratch)
    pipeline.apply_increment(t, scratch, keep_reports=True)
    for full, kept in full_and_kept(spark, t, scratch):
        assert kept == full
    assert rows(kept_reports.KeptReports(t, scratch).stockout_gaps(), "duracion_dias") == [(15,), (16,)]


def test_only_touched_days_and_moved_links_are_rewritten(spark, scratch):
    def run(line, date, n):
        t = tables(spark, transactions=[tx("T1", date="2024-12-30")], feed=[feed_row(line, f"2024-12-01 10:{n:02d}:00", f"r{n}", date=date)])
        if not n:
            build_dimensions(t, scratch)
        result, take = {}, kept_reports.KeptReports.take
        def spy(self, content, days):
            result.update(take(self, content, days))
        kept_reports.KeptReports.take = spy
        try:
            pipeline.apply_increment(t, scratch, keep_reports=True)
        finally:
            kept_reports.KeptReports.take = take
        return result
    for n, (line, date) in enumerate([("L1", "2024-01-01"), ("L2", "2024-06-01"), ("L3", "2024-09-01")]):
        assert run(line, date, n) == {"touched": 1, "relinked": 0}
    assert run("L4", "2024-07-01", 3) == {"touched": 1, "relinked": 1}         # only September points to another day now
    t = tables(spark)
    state = kept_reports.KeptReports(t, scratch).state()
    assert rows(state, "transaction_date", "prev_date") == [
        (D("2024-01-01"), None), (D("2024-06-01"), D("2024-01-01")), (D("2024-07-01"), D("2024-06-01")), (D("2024-09-01"), D("2024-07-01"))]


# ---- silence ------------------------------------------------------------------------------

def test_stream_monitors_equal_the_batch_monitors(spark):
    stores = [store("S1"), store("S2", opening="2024-03-01"), store("S3", opening="2024-12-01"), store("S4")]
    txs = [tx("T1", date="2024-03-10"), tx("T2", "S4", date="2024-03-07"), tx("T3", "S4", date="2024-02-01"), tx("T4", "S9", date="2024-01-01")]
    t = tables(spark, transactions=txs, stores=stores, rules=Rules(run_date=dt.date(2024, 3, 11)))
    assert rows(silence.drain_silent_stores(t)) == rows(pipeline.silent_stores(t)) != []


def test_an_alert_is_raised_by_the_watermark_and_called_off_by_the_next_event(spark, scratch):
    def events(n, data):
        made = spark.createDataFrame([(k, d and D(d), None, dt.datetime.fromisoformat(d or at)) for k, d, at in data], silence.EVENT)
        made.write.mode("append").parquet(f"{scratch}/feed")
    events(0, [("a", "2024-01-01", None), ("b", "2024-01-01", None)])
    events(1, [("b", "2024-01-03", None), ("b", "2024-01-08", None)])
    def drained():
        return rows(silence.drain(spark, f"{scratch}/feed", f"{scratch}/out", f"{scratch}/ck", limit=4, late_days=1, files_per_trigger=1))
    drained()
    events(2, [("b", "2024-01-09", None)])
    assert drained() == [("a", D("2024-01-01"))]         # the clock of the other key's events raised it
    events(3, [("a", "2024-01-09", None)])
    events(4, [(None, None, "2024-01-12")])
    assert drained() == []                               # called off, and not yet too long
    events(5, [(None, None, "2024-01-20")])
    events(6, [(None, None, "2024-01-20")])
    assert drained() == [("a", D("2024-01-09")), ("b", D("2024-01-09"))]
    log = rows(spark.read.schema(silence.ALERT).parquet(f"{scratch}/out").filter("key = 'a'"), "seq", "silent")
    assert log == [(1, True), (2, False), (3, True)]


def test_versions_of_a_feed_dealt_by_transaction_are_not_shuffled_again(spark):
    import re

    from shelfspark.plans import pipeline
    from shelfspark.sources.raw import RawTables

    t = RawTables.from_driver(spark, "/root/testdata/sf0.001")
    latest = pipeline.latest_versions(t)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = latest.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)", plan)
    assert not any("transaction_item_id" in d for d in dealt), dealt
    plain = pipeline.latest_versions(RawTables(**{**t.__dict__, "versions_share": ()}))
    assert latest.exceptAll(plain).isEmpty() and plain.exceptAll(latest).isEmpty()


def test_customer_hashes_do_not_cross_the_shuffle(spark):
    from shelfspark.plans import pipeline
    from shelfspark.plans.star import Star
    from shelfspark.sources.raw import RawTables

    t = RawTables.from_driver(spark, "/root/testdata/sf0.001")
    rows = pipeline.latest_versions(t)
    plan = Star(t).customer_lookup(rows)._jdf.queryExecution().optimizedPlan()
    columns = plan.toString().split("Join LeftOuter")[1].split("\n")[1]
    assert "sha2" not in columns
