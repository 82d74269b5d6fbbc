"""Star schema S1–S9: calendar, vendor, product, store, customer and promotion
dimensions, the promotion bridge, the item-grain sales fact and the clean-sales view.

``Star`` derives every object lazily from ``RawTables`` and memoises it, so a
build computes each dimension once. ``build_star`` materialises the model:
dimensions are written first (fixing their surrogate keys and cutting lineage),
then the fact is written partitioned by date and clustered by store and product.

Physical choices:

* no join is hinted: Spark broadcasts what is under its byte threshold;
* surrogate keys are numbered range by range over a written table
  (``operators.surrogate``), so a dimension is computed once, whatever reads it;
* only card holders' transactions meet the customer dimension; the anonymous
  majority is united back with a NULL key, so no partition collects the NULLs;
* the customer lookup happens at transaction grain, before the items join.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfspark.functions.dates import date_key, month_start, months_before
from shelfspark.functions.money import as_money, exact, line_amount, times
from shelfspark.functions.privacy import pseudonymise
from shelfspark.operators.interval_join import interval_join
from shelfspark.operators.scd2 import Dimension, changes, merge_versions, state_hash, version_at
from shelfspark.operators.split_join import split_join
from shelfspark.operators.surrogate import surrogate_key
from shelfspark.session import Scratch, delete_path, path_exists, recover_folder, replace_folder, scratch_table
from shelfspark.sources.raw import RawTables
from shelfspark.sources.schemas import ITEM_FEED, STAR

# Sentinel attributes of an unknown vendor and the data-quality flags.
UNKNOWN = "UNKNOWN"
FLAG_INVALID_AMOUNT = "MONTO_INVALIDO"
FLAG_BEFORE_OPENING = "TRAN_ANTES_APERTURA"
FLAG_ZERO_PRICE = "PRECIO_CERO_SIN_PROMO"
#: The columns that order the versions of a line.
VERSION_COLUMNS = ("ingestion_timestamp", "source_record_id")
#: The store dimension keeps a row per version of a store.
STORE = Dimension("store_id", "store_key", ("store_name", "country", "city", "format", "size_sqm", "opening_date", "region"))
#: Attributes of a product that the master's latest state overwrites.
PRODUCT_STATE = ("item_name", "brand", "vendor_key", "vendor_id", "category", "department", "cost", "is_orphan_vendor")
#: The countries with a holiday column in the calendar.
HOLIDAY_COUNTRIES = ("CR", "GT", "HN", "SV", "NI")


def conform(df: DataFrame, name: str) -> DataFrame:
    """Select and cast to the declared star schema (column order and types)."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata)
                      for f in STAR[name].fields])


@dataclass
class Star:
    t: RawTables
    #: Lines of one transaction above which the fact's join splits it (``operators.split_join``); None: left to adaptive
    #: execution, which has nothing to split in a bucketed layout.
    part_rows: int | None = None

    @classmethod
    def from_written(cls, t: RawTables, base: str) -> "Star":
        """A star whose dimensions (and bridge) are read from a model written by
        ``build_star`` — what daily incremental runs use, instead of rebuilding
        the dimensions from all raw data every day."""
        star = cls(t)
        for name in ("dim_date", "dim_vendor", "dim_product", "dim_store", "dim_customer", "dim_promotion",
                     "bridge_promotion"):
            if path_exists(t.spark, f"{base.rstrip('/')}/{name}"):
                star.__dict__[name] = read_table(t.spark, base, name)
        return star

    @cached_property
    def sale_dates(self) -> tuple:
        """The first and last transaction date, from one pass over that column."""
        return tuple(self.t.transactions.agg(F.min("transaction_date"), F.max("transaction_date")).first())

    # ---- S1 -------------------------------------------------------------
    @cached_property
    def dim_date(self) -> DataFrame:
        r = self.t.rules
        start = F.lit(r.calendar_start) if r.calendar_start else F.min("transaction_date")
        bounds = self.t.transactions.agg(start.alias("lo"), F.max("transaction_date").alias("hi"))
        return self.calendar(bounds.select(F.explode(F.sequence("lo", "hi")).alias("d")))

    @staticmethod
    def calendar(days: DataFrame) -> DataFrame:
        """The calendar rows of the dates ``d``."""
        d = F.col("d")
        dow = F.dayofweek(d)
        cols = {
            "date_key": date_key(d), "full_date": d, "year": F.year(d), "quarter": F.quarter(d),
            "month": F.month(d), "month_name": F.date_format(d, "MMMM"), "week_of_year": F.weekofyear(d),
            "day_of_week": dow, "day_name": F.date_format(d, "EEEE"), "is_weekend": dow.isin(1, 7),
            **{f"is_holiday_{c}": F.lit(False) for c in HOLIDAY_COUNTRIES},
            "fiscal_period": F.concat(F.lit("FY"), F.year(d).cast("string"), F.lit("-Q"),
                                      F.quarter(d).cast("string")),
        }
        return conform(days.select([v.alias(k) for k, v in cols.items()]), "dim_date")

    # ---- S2 -------------------------------------------------------------
    @cached_property
    def orphan_vendor_ids(self) -> DataFrame:
        """Vendor ids used by products but missing from the vendor master, and those ``Rules`` names as such."""
        named = self.t.rules.excluded_vendors or ()
        return (self.t.products.select("vendor_id").filter(F.col("vendor_id").isNotNull()).distinct()
                .join(self.t.vendors.filter(~F.col("vendor_id").isin(list(named))).select("vendor_id"), "vendor_id", "left_anti"))

    @cached_property
    def dim_vendor(self) -> DataFrame:
        r = self.t.rules
        vendors = self.t.vendors
        valid = surrogate_key(vendors, ["vendor_id", "vendor_name", "country", "tier"],
                              "vendor_key").withColumn("is_valid", F.lit(True))
        # One sentinel row per orphan vendor id, keyed from the fixed sentinel
        # key upwards (above every regular key).
        base = F.greatest(F.lit(r.unknown_vendor_key), vendors.agg(F.count(F.lit(1)) + 1).scalar())
        orphans = surrogate_key(self.orphan_vendor_ids, ["vendor_id"], "_n")
        sentinel = unknown_vendors(orphans.select((base + F.col("_n") - 1).alias("vendor_key"), "vendor_id"))
        return conform(valid.unionByName(sentinel), "dim_vendor")

    # ---- S3 -------------------------------------------------------------
    @cached_property
    def dim_product(self) -> DataFrame:
        products = surrogate_key(self.t.products, ["item_id", "vendor_id", "item_name"], "product_key")
        return conform(self.with_vendor(products), "dim_product")

    def with_vendor(self, products: DataFrame) -> DataFrame:
        """Products with their vendor's key and whether the vendor is missing from the master
        (an id that was missing once and has a master row now keeps both; the valid one counts)."""
        vendors = (self.dim_vendor.groupBy("vendor_id")
                   .agg(F.max(F.struct("is_valid", "vendor_key")).alias("v")).select("vendor_id", "v.vendor_key", "v.is_valid"))
        return (products.join(vendors, "vendor_id", "left")
                .withColumn("is_orphan_vendor", ~F.coalesce(F.col("is_valid"), F.lit(False))))

    # ---- S4 -------------------------------------------------------------
    @cached_property
    def dim_store(self) -> DataFrame:
        return conform(self.store_columns(surrogate_key(self.t.stores, ["store_id", "store_name"], "store_key")), "dim_store")

    def store_columns(self, stores: DataFrame) -> DataFrame:
        comparable_before = months_before(F.lit(self.sale_dates[1]).cast("date"), self.t.rules.comparable_months)
        return stores.select(
            "*",
            (F.col("opening_date") <= comparable_before).alias("is_comparable"),
            F.col("opening_date").alias("valid_from"),
            F.lit(None).cast("date").alias("valid_to"),
            F.lit(True).alias("is_current"))

    def current_stores(self) -> DataFrame:
        return self.dim_store.filter(F.col("is_current"))

    # ---- S5 -------------------------------------------------------------
    def first_purchases(self, headers: DataFrame | None = None) -> DataFrame:
        """Per card holder: first completed purchase date and its store
        (earliest date, then smallest transaction id), in the transactions or the given header rows."""
        r = self.t.rules
        return ((self.t.transactions if headers is None else headers)
                .filter(F.col("loyalty_card") & F.col("customer_id").isNotNull() & (F.col("total_amount") > 0)
                        & (F.col("status") == r.completed_status))
                .groupBy("customer_id")
                .agg(F.min("transaction_date").alias("first_transaction_date"),
                     F.min_by("store_id", F.struct("transaction_date", "transaction_id")).alias("first_store_id")))

    @cached_property
    def dim_customer(self) -> DataFrame:
        first = surrogate_key(self.first_purchases(), ["customer_id"], "customer_key")
        return conform(self.customer_columns(first), "dim_customer")

    def customer_columns(self, first: DataFrame) -> DataFrame:
        stores = self.current_stores().select(F.col("store_id").alias("first_store_id"),
                                              F.col("store_key").alias("acquisition_store_key"),
                                              F.col("country").alias("acquisition_country"))
        return first.join(stores, "first_store_id", "left").select(
            "customer_key",
            pseudonymise("customer_id", self.t.rules.customer_salt).alias("customer_id_hashed"),
            month_start("first_transaction_date").alias("cohort_month"),
            "first_transaction_date", "acquisition_store_key", "acquisition_country")

    # ---- S6 -------------------------------------------------------------
    @cached_property
    def dim_promotion(self) -> DataFrame:
        r = self.t.rules
        promos = surrogate_key(self.t.store_promotions,
                               ["store_id", "promo_name", "variant", "start_date", "end_date", "promo_type"],
                               "promotion_key")
        if r.contaminated_stores is None:
            # Stores assigned to more than one variant (audit A8).
            variants = F.size(F.collect_set("variant").over(Window.partitionBy("store_id")))
            contaminated = variants > 1
        else:
            contaminated = F.col("store_id").isin(list(r.contaminated_stores))
        return conform(promos.withColumn("is_contaminated", contaminated), "dim_promotion")

    # ---- S7 -------------------------------------------------------------
    @cached_property
    def bridge_promotion(self) -> DataFrame:
        tx = (self.t.transactions.select("transaction_id", "store_id", "transaction_date")
              .join(self.current_stores().select("store_id"), "store_id"))
        promos = self.dim_promotion.select("promotion_key", "store_id", "start_date", "end_date")
        pairs = interval_join(tx, promos, ["store_id"], "transaction_date", "start_date", "end_date", dates=self.sale_dates)
        return conform(pairs.select("transaction_id", "promotion_key").distinct(), "bridge_promotion")

    # ---- S8 -------------------------------------------------------------
    def customer_lookup(self, df: DataFrame, dealt: tuple[str, ...] = (), among: DataFrame | None = None) -> DataFrame:
        """Attach ``customer_key`` to rows carrying customer_id and loyalty_card.
        Only card holders' rows are joined; all others get a NULL key.

        Rows that are ``dealt`` by some columns (never NULL) stay where they are: only these columns and the ids, found ``among`` the rows
        or a table that holds them and is cheaper to read, meet the customers and come back."""
        card = F.coalesce(F.col("loyalty_card") & F.col("customer_id").isNotNull(), F.lit(False))
        customers = self.dim_customer.select(F.col("customer_id_hashed").alias("_cust"), "customer_key")
        # The hash is the join's key and no column: rows cross the shuffle without it.
        hashed = pseudonymise("customer_id", self.t.rules.customer_salt)
        if dealt:
            ids = (df if among is None else among).filter(card).select(*dealt, "customer_id").distinct()
            keys = ids.join(customers, hashed == F.col("_cust")).select(*dealt, "customer_id", "customer_key")
            return df.join(keys, [*dealt, "customer_id"], "left").withColumn("customer_key", F.when(card, F.col("customer_key")))
        known = df.filter(card).join(customers, hashed == F.col("_cust"), "left").drop("_cust")
        return known.unionByName(df.filter(~card).withColumn("customer_key", F.lit(None).cast("bigint")))

    def products_lookup(self) -> DataFrame:
        return self.dim_product.select("item_id", "product_key", "cost")

    def _fact(self, with_customer: bool) -> DataFrame:
        stores = self.current_stores().select("store_id", "store_key", "opening_date")
        tx = self.t.transactions.join(stores, "store_id")
        # Transaction grain first: the customer lookup shuffles one row per
        # transaction rather than one per line.
        tx = (self.customer_lookup(tx) if with_customer
              else tx.withColumn("customer_key", F.lit(None).cast("bigint")))
        items = self.t.transaction_items.join(self.products_lookup(), "item_id")
        joined = (items.join(tx, "transaction_id") if self.part_rows is None
                  else split_join(items, tx, "transaction_id", "transaction_item_id", self.part_rows))
        return conform(fact_columns(joined, F.lit(False)), "fact_sales")

    @cached_property
    def fact_sales(self) -> DataFrame:
        return self._fact(with_customer=True)

    @cached_property
    def fact_sales_without_customer(self) -> DataFrame:
        """The fact with ``customer_key`` left NULL, for analyses that do not use
        it: same rows (the customer lookup is a left join on a unique key)
        without building the customer dimension."""
        return self._fact(with_customer=False)

    def lookups_from_feed(self, increment: DataFrame) -> DataFrame:
        """Feed rows with the columns of their product and of their store as it was on the sale date, NULL where the master has none."""
        found = version_at(increment, self.dim_store, "transaction_date", STORE, ["store_key", "opening_date"], "left")
        return found.join(self.products_lookup(), "item_id", "left")

    def fact_from_feed(self, increment: DataFrame, versions: bool = False) -> DataFrame:
        """Fact rows for a batch of feed rows (line versions with header columns),
        flagged late when ingested after the day following the sale. Rows of an
        unknown store or product are left out (``unknown_lines`` has them); with
        ``versions`` the version columns stay beside the fact's."""
        found = self.known_lines(increment)
        rows = self.customer_lookup(found)
        if not versions:
            return conform(fact_columns(rows, arrived_late()), "fact_sales")
        return rows.select(versioned_fact_columns())

    def known_lines(self, increment: DataFrame) -> DataFrame:
        """The feed rows whose store and product the masters know, with what the fact takes from these."""
        return self.lookups_from_feed(increment).filter(F.col("store_key").isNotNull() & F.col("product_key").isNotNull())

    def unknown_lines(self, increment: DataFrame) -> DataFrame:
        """The feed rows whose store or product no master table knows."""
        missing = F.col("store_key").isNull() | F.col("product_key").isNull()
        return self.lookups_from_feed(increment).filter(missing).select(increment.columns)

    # ---- S9 -------------------------------------------------------------
    def clean_sales(self, fact: DataFrame | None = None) -> DataFrame:
        """Unflagged, completed sales of valid vendors, with store, product,
        vendor and calendar attributes. A sale's store is the version its key names, current or not."""
        fact = self.fact_sales if fact is None else fact
        stores = self.dim_store.select("store_key", "store_name", "country", "format", "size_sqm",
                                              "region", "is_comparable")
        products = self.dim_product.select("product_key", "item_name", "category", "department", "brand", "vendor_key")
        vendors = self.dim_vendor.select("vendor_key", "vendor_id", "vendor_name", F.col("tier").alias("vendor_tier"),
                                         F.col("is_valid").alias("vendor_is_valid"))
        dates = self.dim_date.select(F.col("date_key").alias("transaction_date_key"), "year",
                                     "quarter", "month", "week_of_year", "is_weekend", "fiscal_period")
        return (fact.filter(F.col("data_quality_flag").isNull() & (F.col("status") == self.t.rules.completed_status))
                .join(stores, "store_key").join(products, "product_key").join(vendors, "vendor_key")
                .filter(F.col("vendor_is_valid"))
                .join(dates, "transaction_date_key")
                .select(*STAR["fact_sales"].fieldNames(), "store_name", "country", "format", "size_sqm", "region",
                        "is_comparable", "item_name", "category", "department", "brand", "vendor_id",
                        "vendor_name", "vendor_tier", "vendor_is_valid", "year", "quarter", "month",
                        "week_of_year", "is_weekend", "fiscal_period"))


def unknown_vendors(keyed: DataFrame) -> DataFrame:
    """The sentinel rows of vendors without a master row."""
    return keyed.select(
        "vendor_key", "vendor_id",
        F.lit(UNKNOWN).alias("vendor_name"), F.lit(UNKNOWN).alias("country"), F.lit(UNKNOWN).alias("tier"),
        F.lit(False).alias("is_shared_catalog"), F.lit(False).alias("is_valid"))


def quality_flag():
    """First matching data-quality issue of a sale line, NULL when clean."""
    return (F.when(F.col("total_amount") <= 0, F.lit(FLAG_INVALID_AMOUNT))
            .when(F.col("transaction_date") < F.col("opening_date"), F.lit(FLAG_BEFORE_OPENING))
            .when((F.col("unit_price") == 0) & (F.col("was_on_promo") == F.lit(False)), F.lit(FLAG_ZERO_PRICE)))


def fact_columns(rows: DataFrame, late_arrival) -> DataFrame:
    """Fact projection of joined line + header + lookup rows."""
    return rows.select([c.alias(name) for name, c in fact_expressions(late_arrival).items()])


def fact_expressions(late_arrival) -> dict:
    """The fact's columns in terms of joined line + header + lookup rows."""
    price, cost = exact("unit_price"), exact("cost")
    plain = ("transaction_item_id", "transaction_id", "transaction_date", "store_key", "product_key", "customer_key", "payment_method",
             "loyalty_card", "status", "quantity", "unit_price", "was_on_promo")
    made = {name: F.col(name) for name in plain} | {
        "transaction_date_key": date_key("transaction_date"),
        "gmv": as_money(times(price, "quantity")),
        "unit_cost": F.col("cost"),
        "gross_margin": as_money(times(price - cost, "quantity")),
        "total_amount_reported": F.col("total_amount"),
        "data_quality_flag": quality_flag(),
        "late_arrival": late_arrival}
    return {name: made[name] for name in STAR["fact_sales"].fieldNames()}


def arrived_late():
    """Whether a feed row was ingested after the day following the sale."""
    return F.to_date("ingestion_timestamp") > F.date_add("transaction_date", 1)


def versioned_fact_columns() -> list:
    """The fact's columns, in their types, and the version columns beside them."""
    made = fact_expressions(arrived_late())
    return [made[f.name].cast(f.dataType).alias(f.name) for f in STAR["fact_sales"].fields] + [F.col(c) for c in VERSION_COLUMNS]


#: The fact as upserts write it, with the version columns.
VERSIONED_FACT = StructType([*STAR["fact_sales"].fields, *[ITEM_FEED[c] for c in VERSION_COLUMNS]])


def write_fact(fact: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the fact partitioned by date, files clustered by store and product.

    Range partitioning on (date, store, product) splits a heavy day over several
    tasks and keeps each task's rows in few date folders."""
    n = int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (fact.repartitionByRange(n, "transaction_date", "store_key", "product_key")
     .sortWithinPartitions("transaction_date", "store_key", "product_key")
     .write.mode(mode).partitionBy("transaction_date").parquet(path))


def read_table(spark, base: str, name: str) -> DataFrame:
    return spark.read.schema(STAR[name]).parquet(f"{base.rstrip('/')}/{name}")


DENSE_KEYS = {"dim_store": "store_key", "dim_product": "product_key", "dim_customer": "customer_key",
              "dim_promotion": "promotion_key"}


def validate_dimensions(out: dict[str, DataFrame]) -> None:
    """NOT NULL columns hold no NULL and surrogate keys are dense (1..n)."""
    from shelfspark.operators.checks import assert_dense_key, assert_not_null
    for name in ("dim_date", "dim_vendor", "dim_product", "dim_store", "dim_customer", "dim_promotion"):
        assert_not_null(out[name], STAR[name])
        if name in DENSE_KEYS:
            assert_dense_key(out[name], DENSE_KEYS[name])


def uncovered_sales(fact: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Fact lines whose date is missing from the calendar (they would vanish
    from the clean view's calendar join), with their count per date."""
    days = dim_date.select(F.col("date_key").alias("transaction_date_key"))
    return (fact.join(days, "transaction_date_key", "left_anti")
            .groupBy("transaction_date").agg(F.count(F.lit(1)).alias("lineas")))


DIMENSIONS = ("dim_date", "dim_vendor", "dim_store", "dim_promotion", "dim_product", "dim_customer")


def build_dimensions(t: RawTables, base: str, part_rows: int | None = None) -> Star:
    """Write the dimensions under ``base`` and return a star that reads them back."""
    star = Star(t, part_rows)
    for name in DIMENSIONS:
        getattr(star, name).write.mode("overwrite").parquet(f"{base}/{name}")
        star.__dict__[name] = read_table(t.spark, base, name)
    return star


def merge_stores(star: Star, base: str, as_of: dt.date) -> int:
    """Bring the store master's state of ``as_of`` into the written dimension: new versions of changed stores, first versions
    of new ones. Returns the versions opened or replaced."""
    master = star.store_columns(star.t.stores).drop("valid_from", "valid_to", "is_current")
    n = changes(star.dim_store, master, STORE).count()
    if n:
        with Scratch(star.t.spark) as scratch:
            merged = merge_versions(star.dim_store, master, as_of, STORE, "opening_date")
            replace_folder(scratch.kept(conform(merged, "dim_store")), f"{base}/dim_store")
        star.__dict__["dim_store"] = read_table(star.t.spark, base, "dim_store")
    return n


def overwrite_products(star: Star, base: str) -> int:
    """Bring changed attributes of known products into the written dimension; keys stay. Returns the products changed."""
    now = star.with_vendor(star.t.products).select("item_id", *PRODUCT_STATE).withColumn("_new", state_hash(PRODUCT_STATE))
    state = now.select("item_id", F.struct(*PRODUCT_STATE).alias("_state"), "_new")
    joined = star.dim_product.withColumn("_old", state_hash(PRODUCT_STATE)).join(state, "item_id", "left")
    changed = F.col("_new").isNotNull() & (F.col("_new") != F.col("_old"))
    n = joined.filter(changed).count()
    if n:
        with Scratch(star.t.spark) as scratch:
            rows = joined.select("item_id", "product_key", *[F.when(changed, F.col(f"_state.{c}")).otherwise(F.col(c)).alias(c) for c in PRODUCT_STATE])
            replace_folder(scratch.kept(conform(rows, "dim_product")), f"{base}/dim_product")
        star.__dict__["dim_product"] = read_table(star.t.spark, base, "dim_product")
    return n


def extend_dimensions(t: RawTables, base: str, feed: DataFrame, as_of: dt.date | None = None) -> dict[str, int]:
    """Bring what the masters and the feed hold beyond the written dimensions into
    them: new days, vendors, products and card holders, new and changed stores
    (a version from ``as_of`` on, by default the feed's last ingestion day), and changed
    attributes of products. Written rows keep their keys; new ones are numbered above
    the largest. Returns the rows added (stores: versions; ``changed_products``: rows)."""
    spark, added = t.spark, {}
    for name in DIMENSIONS:
        recover_folder(spark, f"{base}/{name}")
    star = Star(t)
    for name in DIMENSIONS:
        star.__dict__[name] = read_table(spark, base, name)

    def append(name: str, rows: DataFrame, scratch: Scratch, finish=None) -> None:
        """Write ``rows`` once; what is new goes through ``finish`` (keys, looked-up columns) into the dimension."""
        rows = scratch.kept(rows)
        n = rows.count()
        added[name] = added.get(name, 0) + n
        if n:
            rows = rows if finish is None else scratch.kept(conform(finish(rows), name))
            rows.write.mode("append").parquet(f"{base}/{name}")
            star.__dict__[name] = read_table(spark, base, name)

    def numbered(rows: DataFrame, order: list[str], name: str, key: str) -> DataFrame:
        top = read_table(spark, base, name).agg(F.coalesce(F.max(key), F.lit(0)).alias("top")).first()["top"]
        return surrogate_key(rows, order, key, above=F.lit(top))

    with Scratch(spark) as scratch:
        known = star.dim_date.agg(F.min("full_date").alias("lo"), F.max("full_date").alias("hi"))
        seen = feed.agg(F.min("transaction_date").alias("a"), F.max("transaction_date").alias("z"))
        days = (seen.crossJoin(known).filter(F.col("a").isNotNull())  # one row each
                .select(F.explode(F.sequence(F.least("a", "lo"), F.greatest("z", "hi"))).alias("d")))
        append("dim_date", star.calendar(days.join(star.dim_date, F.col("d") == F.col("full_date"), "left_anti")), scratch)

        valid = star.dim_vendor.filter("is_valid").select("vendor_id")
        append("dim_vendor", t.vendors.join(valid, "vendor_id", "left_anti"), scratch, lambda rows: numbered(
            rows, ["vendor_id", "vendor_name", "country", "tier"], "dim_vendor", "vendor_key").withColumn("is_valid", F.lit(True)))

        def sentinels(rows: DataFrame) -> DataFrame:
            top = F.greatest(F.lit(t.rules.unknown_vendor_key - 1), star.dim_vendor.agg(F.max("vendor_key")).scalar())
            return unknown_vendors(surrogate_key(rows, ["vendor_id"], "vendor_key", above=top))

        append("dim_vendor", star.orphan_vendor_ids.join(star.dim_vendor.select("vendor_id"), "vendor_id", "left_anti"), scratch, sentinels)

        if as_of is None:
            as_of = t.rules.run_date or feed.agg(F.max(F.to_date("ingestion_timestamp"))).first()[0]
        added["dim_store"] = merge_stores(star, base, as_of) if as_of else 0   # without a date there is no feed either
        added["changed_products"] = overwrite_products(star, base)
        append("dim_product", t.products.join(star.dim_product.select("item_id"), "item_id", "left_anti"), scratch,
               lambda rows: star.with_vendor(numbered(rows, ["item_id", "vendor_id", "item_name"], "dim_product", "product_key")))
        hashed = pseudonymise("customer_id", t.rules.customer_salt)
        known = star.dim_customer.select("customer_id_hashed")
        new = (star.first_purchases(feed).withColumn("customer_id_hashed", hashed)
               .join(known, "customer_id_hashed", "left_anti").drop("customer_id_hashed"))
        append("dim_customer", new, scratch, lambda rows: star.customer_columns(numbered(rows, ["customer_id"], "dim_customer", "customer_key")))
    return added


def build_star(t: RawTables, base: str, validate: bool = True, part_rows: int | None = None) -> dict[str, DataFrame]:
    """Materialise the model under ``base``: dimensions first, re-read so later
    steps use the written surrogate keys, then bridge and fact. Returns readers.

    With ``validate`` the written dimensions are checked against the schema's
    NOT NULL columns and their surrogate keys for density before the fact is
    built (a failed check raises ``ContractError``). ``part_rows``: see ``Star``."""
    spark = t.spark
    star = build_dimensions(t, base, part_rows)
    out = {name: getattr(star, name) for name in DIMENSIONS}
    if validate:
        validate_dimensions(out)
    star.bridge_promotion.write.mode("overwrite").parquet(f"{base}/bridge_promotion")
    out["bridge_promotion"] = read_table(spark, base, "bridge_promotion")
    for kept in ("fact_index", "selling_days"):  # of a fact written before; the next upsert builds them anew
        delete_path(spark, f"{base}/{kept}")
    write_fact(star.fact_sales, f"{base}/fact_sales")
    out["fact_sales"] = spark.read.parquet(f"{base}/fact_sales").select(*STAR["fact_sales"].fieldNames())
    out["view_clean_sales"] = star.clean_sales(out["fact_sales"])
    return out


def register_views(tables: dict[str, DataFrame]) -> None:
    """Expose a built star (the dict of ``build_star``) to Spark SQL: one
    temporary view per table, plus ``view_clean_sales``."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def fact_lines(t: RawTables) -> DataFrame:
    """The item lines that enter the fact (known transaction, store and product),
    with what the flags need — without building surrogate keys."""
    stores = t.stores.select("store_id", "opening_date")
    items = t.transaction_items.join(t.products.select("item_id"), "item_id", "left_semi")
    return items.join(t.transactions.join(stores, "store_id"), "transaction_id")


def fact_coverage(t: RawTables, fact: DataFrame | None = None) -> DataFrame:
    """Item rows, fact rows and the rows the inner store/product lookups dropped."""
    fact = fact_lines(t) if fact is None else fact
    fact_rows = fact.agg(F.count(F.lit(1))).scalar()
    return (t.transaction_items.agg(F.count(F.lit(1)).alias("item_rows"))
            .select("item_rows", fact_rows.alias("fact_rows"),
                    (F.col("item_rows") - fact_rows).alias("dropped_rows")))


def flag_distribution(t: RawTables, fact: DataFrame | None = None) -> DataFrame:
    """Fact lines and GMV per data-quality flag (NULL = clean).

    Without a written fact, the lines are flagged directly: only the store and
    product lookups that decide whether a line enters the fact are applied
    (no surrogate keys, no customer lookup)."""
    if fact is None:
        fact = fact_lines(t).select(quality_flag().alias("data_quality_flag"),
                            as_money(line_amount("unit_price", "quantity")).alias("gmv"))
    return (fact.groupBy("data_quality_flag")
            .agg(F.count(F.lit(1)).alias("lineas"), as_money(F.sum(exact("gmv"))).alias("gmv"))
            .orderBy("data_quality_flag"))


def store_states(t: RawTables) -> list[tuple[dt.date, DataFrame]]:
    """Three states of the store master, for the history job: without the stores of one format; all of them, those of
    another format that were open by then 50 m² larger; and the last one once more."""
    first, last = Star(t).sale_dates
    if first is None:
        return []
    formats = sorted(r[0] for r in t.stores.select("format").distinct().collect())  # a handful
    middle = first + (last - first) // 2
    grows = (F.col("format") == formats[0]) & (F.col("opening_date") < F.lit(middle))
    grown = t.stores.withColumn("size_sqm", F.when(grows, F.col("size_sqm") + 50).otherwise(F.col("size_sqm")))
    return [(first, t.stores.filter(F.col("format") != formats[-1])), (middle, grown), (last, grown)]


def store_history(t: RawTables) -> DataFrame:
    """S4 over several states of the master: the store dimension with a row per version."""
    dim, star = None, Star(t)
    for day, state in store_states(t):
        one = Star(replace(t, stores=state))
        one.__dict__["sale_dates"] = star.sale_dates
        if dim is None:
            dim = one.dim_store
        else:
            master = one.store_columns(state).drop("valid_from", "valid_to", "is_current")
            dim = scratch_table(conform(merge_versions(dim, master, day, STORE, "opening_date"), "dim_store"), "dim-store")
    return star.dim_store if dim is None else dim


def fact_as_of_store(t: RawTables) -> DataFrame:
    """S8's store lookup over the store history: each transaction with the version of its store that was valid on its date."""
    found = version_at(t.transactions, store_history(t), "transaction_date", STORE, ["store_key", "size_sqm", "valid_from", "is_current"])
    return found.select("transaction_id", "transaction_date", "store_id", "store_key", "size_sqm", "valid_from", "is_current")


STAR_JOBS = {
    "s1_dim_date": lambda t: Star(t).dim_date,
    "s2_dim_vendor": lambda t: Star(t).dim_vendor,
    "s3_dim_product": lambda t: Star(t).dim_product,
    "s4_dim_store": lambda t: Star(t).dim_store,
    "s4_store_history": store_history,
    "s5_dim_customer": lambda t: Star(t).dim_customer,
    "s6_dim_promotion": lambda t: Star(t).dim_promotion,
    "s7_bridge_promotion": lambda t: Star(t).bridge_promotion,
    "s8_fact_sales": lambda t: Star(t).fact_sales,
    "s8_fact_as_of_store": fact_as_of_store,
    "s8f_flag_distribution": flag_distribution,
    "s8c_fact_coverage": fact_coverage,
    "s9_clean_sales": lambda t: Star(t).clean_sales(),
}
