"""Hand-made retail tables for operator tests (FIXTURES.md §2).

Each helper fills in the columns a test does not care about, so a test lists
only the rows and values that matter for its expectation.
"""

from __future__ import annotations

import datetime as dt

from shelfspark.rules import DEFAULT_RULES, Rules
from shelfspark.sources.raw import RawTables
from shelfspark.sources.schemas import ITEM_FEED, RAW

D = dt.date.fromisoformat


def store(store_id, opening="2023-01-01", fmt="F1", size=100, country="CR", name=None):
    return dict(store_id=store_id, store_name=name or store_id, country=country, city="c", format=fmt,
                size_sqm=size, opening_date=D(opening), region="r")


def tx(tid, store_id="S1", date="2024-03-01", total=100.0, loyal=False, customer=None, status="COMPLETED",
       payment="cash"):
    return dict(transaction_id=tid, store_id=store_id, customer_id=customer, transaction_date=D(date),
                total_amount=total, payment_method=payment, loyalty_card=loyal, status=status)


def item(iid, tid, item_id="I1", qty=1, price=10.0, promo=False):
    return dict(transaction_item_id=iid, transaction_id=tid, item_id=item_id, quantity=qty, unit_price=price,
                was_on_promo=promo)


def product(item_id, vendor="V1", category="C1", cost=5.0):
    return dict(item_id=item_id, item_name=f"name {item_id}", brand="b", vendor_id=vendor, category=category,
                department="d", cost=cost)


def vendor(vendor_id, name=None):
    return dict(vendor_id=vendor_id, vendor_name=name or vendor_id, country="CR", tier="A", is_shared_catalog=True)


def promo(store_id, name="P", variant="CONTROL", start="2024-01-01", end="2024-12-31"):
    return dict(store_id=store_id, promo_name=name, variant=variant, start_date=D(start), end_date=D(end),
                promo_type="AB")


def _frame(spark, rows, schema):
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema=schema)


def tables(spark, transactions=(), items=(), stores=None, products=None, vendors=None, promotions=None,
           feed=None, rules: Rules = DEFAULT_RULES) -> RawTables:
    stores = [store("S1")] if stores is None else stores
    products = [product("I1")] if products is None else products
    vendors = [vendor("V1")] if vendors is None else vendors
    promotions = [] if promotions is None else promotions
    data = dict(transactions=transactions, transaction_items=items, stores=stores, products=products,
                vendors=vendors, store_promotions=promotions)
    frames = {name: _frame(spark, list(data[name]), RAW[name].__class__(
        [f.__class__(f.name, f.dataType, True) for f in RAW[name].fields])) for name in RAW}
    t = RawTables(spark=spark, rules=rules, **frames)
    if feed is not None:
        t.item_feed = _frame(spark, list(feed), ITEM_FEED.__class__(
            [f.__class__(f.name, f.dataType, True) for f in ITEM_FEED.fields]))
    return t


def feed_row(line, version_ts, record, tid="T1", store_id="S1", date="2024-03-01", item_id="I1", qty=1,
             price=10.0, total=100.0, status="COMPLETED", loyal=False, customer=None, promo=False):
    return dict(transaction_item_id=line, transaction_id=tid, store_id=store_id, customer_id=customer,
                transaction_date=D(date), total_amount=total, payment_method="cash", loyalty_card=loyal,
                status=status, item_id=item_id, quantity=qty, unit_price=price, was_on_promo=promo,
                ingestion_timestamp=dt.datetime.fromisoformat(version_ts), source_record_id=record)


def rows(df, *cols):
    """Collected rows as sorted tuples of the given columns."""
    cols = cols or df.columns
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
