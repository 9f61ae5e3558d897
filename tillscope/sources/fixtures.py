"""Audit input relations derived from the driver tables.

The shop's real sources (login tracking, carts, treatment plans, the order
feed, the behaviour event log, customers and CRM contacts) are stood in for by
deterministic projections of ``events``, ``orders`` and ``customer``. The
same derivations are written in SQL in ``tillscope.plans.oracle`` so the
DuckDB oracle sees identical input. All are narrow projections: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.functions.timez import UTC_DATE
from tillscope.sources.tables import read_table


def _k() -> Column:
    # try_cast: junk property text becomes NULL instead of failing the job.
    return F.get_json_object(F.col("props"), "$.k").try_cast("int")


def _masked_email() -> Column:
    prefix = F.when(F.col("k") % 5 == 0, F.lit("User")).otherwise(F.lit("user"))
    return F.concat(prefix, F.col("user_id").cast("string"), F.lit("[at]example.com"))


def _plain_email(id_col: str) -> Column:
    return F.concat(F.lit("user"), F.col(id_col).cast("string"), F.lit("@example.com"))


def _part(events: DataFrame) -> list:
    """The ``utc_date`` partition column, when the events carry one."""
    return [F.col(UTC_DATE)] if UTC_DATE in events.columns else []


def events_k(events: DataFrame) -> DataFrame:
    """Events with the ``k`` property as a column (parsed here unless the
    conformed copy already carries it). The generator keeps Catalyst from
    copying the JSON parse into every expression that uses ``k``."""
    return events if "k" in events.columns else events.select("*", F.explode(F.array(_k())).alias("k"))


def logins_from(events: DataFrame) -> DataFrame:
    """logins(login_id, email masked, allowance INT NULL, created_at NTZ UTC)."""
    e = events_k(events.where(F.col("event_type") == "view"))
    return e.select(
        F.col("event_id").alias("login_id"),
        _masked_email().alias("email"),
        F.when(F.col("k") % 11 == 0, F.lit(None).cast("int")).otherwise(F.col("k") - 40).alias("allowance"),
        F.col("ts").alias("created_at"),
        *_part(events),
    )


def carts_from(events: DataFrame) -> DataFrame:
    """carts(cart_id, email masked, is_converted BOOLEAN NULL, created_at)."""
    e = events_k(events.where(F.col("event_type") == "click"))
    return e.select(
        F.col("event_id").alias("cart_id"),
        _masked_email().alias("email"),
        F.when(F.col("k") % 7 == 0, F.lit(None).cast("boolean")).otherwise(F.col("k") % 2 == 0).alias("is_converted"),
        F.col("ts").alias("created_at"),
        *_part(events),
    )


def treatment_plans_from(orders: DataFrame) -> DataFrame:
    """treatment_plans(email unmasked, created_at)."""
    return orders.select(
        _plain_email("o_custkey").alias("email"),
        F.col("o_orderdate").alias("created_at"),
    )


def _orders_k(events: DataFrame) -> DataFrame:
    e = events_k(events.where(F.col("event_type") == "purchase"))
    return e.select(
        F.col("event_id").cast("string").alias("number"),
        _plain_email("user_id").alias("email"),
        F.when(F.col("k") % 4 < 2, F.lit("NOT_CHARGED")).otherwise(F.lit("FULLY_CHARGED")).alias("payment_status"),
        F.when(F.col("k") % 3 == 0, F.lit("UNFULFILLED")).otherwise(F.lit("FULFILLED")).alias("status"),
        F.col("value").cast("decimal(18,2)").alias("total"),
        F.when(F.col("k") % 13 == 0, F.lit("NZD")).when(F.col("k") % 17 == 0, F.lit("USD")).otherwise(F.lit("AUD")).alias("currency"),
        F.col("ts").alias("created"),
        *_part(events),
        "k",
    )


def shop_orders_from(events: DataFrame) -> DataFrame:
    """shop_orders(number, email, payment_status, status, total DECIMAL(18,2), currency, created)."""
    return _orders_k(events).drop("k")


def order_pages_from(shop_orders: DataFrame, fetch: str = "day") -> DataFrame:
    """Order feed pages (``sources.order_feed.PAGE``): a page an order."""
    node = F.struct(
        "number", F.col("email").alias("userEmail"), F.col("payment_status").alias("paymentStatus"), "status",
        F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("created"),
        F.struct(F.struct(F.col("total").alias("amount"), "currency").alias("gross")).alias("total"),
    )
    info = F.struct(F.lit(False).alias("hasNextPage"), F.lit(None).cast("string").alias("endCursor"))
    edges = F.array(F.struct(node.alias("node")))
    return shop_orders.select(
        F.concat_ws("-", F.lit(fetch), "number").alias("page_id"),
        F.struct(F.struct(info.alias("pageInfo"), edges.alias("edges")).alias("orders")).alias("data"),
    )


def amended_orders_from(events: DataFrame) -> DataFrame:
    """Copies of the shop's orders as they were amended: ``copy`` 0 is placed and
    not charged, 1 is ``shop_orders``, 2 (every fifth k) refunds or corrects it;
    ``source`` orders the copies of an order."""
    k = F.col("k")
    refund = F.when(k % 10 == 0, F.lit("FULLY_REFUNDED")).otherwise(F.lit("FULLY_CHARGED"))
    copy = lambda i, status, total: F.struct(
        status.alias("payment_status"), total.cast("decimal(18,2)").alias("total"), F.lit(f"copy-{i}").alias("source"), F.lit(i).alias("copy")
    )
    total = F.col("total")
    copies = F.array(
        copy(0, F.lit("NOT_CHARGED"), total), copy(1, F.col("payment_status"), total), F.when(k % 5 == 0, copy(2, refund, total + 1))
    )
    rows = _orders_k(events).select("number", "email", "status", "currency", "created", F.explode(copies).alias("c"))
    return rows.where("c is not null").select("number", "email", "status", "currency", "created", "c.*")


# event_type -> (event when k even, event when k odd)
_EVENT_MAP = {
    "view": ("cart_added", "cart_added"),
    "click": ("checkout_initiated", "checkout_initiated"),
    "signup": ("payment_page_visit", "payment_initiated"),
    "purchase": ("payment_success", "purchase_completed"),
    "error": ("payment_error", "$exception"),
}


def activity_from(events: DataFrame) -> DataFrame:
    """activity(event_id, ts, event, person_id, email, session_id, host, pathname, current_url)."""
    e = events_k(events)
    even = F.col("k") % 2 == 0
    ev = None
    for src, (a, b) in _EVENT_MAP.items():
        val = F.when(even, F.lit(a)).otherwise(F.lit(b))
        ev = F.when(F.col("event_type") == src, val) if ev is None else ev.when(F.col("event_type") == src, val)
    host = (
        F.when(F.col("k") % 4 == 2, F.lit("shop.example.com"))
        .when(F.col("k") % 4 == 3, F.lit("pay.example.com"))
        .otherwise(F.lit("care.example.com"))
    )
    path = (
        F.when(F.col("k") % 4 == 0, F.concat(F.lit("/patient/"), F.col("k").cast("string")))
        .when(F.col("k") % 4 == 1, F.lit("/other"))
        .otherwise(F.lit("/"))
    )
    session = F.concat_ws(
        "-",
        F.col("user_id").cast("string"),
        F.date_format(F.col("ts"), "yyyyMMdd"),
        F.floor(F.hour(F.col("ts")) / 6).cast("string"),
    )
    out = e.select(
        "event_id",
        "ts",
        ev.alias("event"),
        F.col("user_id").alias("person_id"),
        _plain_email("user_id").alias("email"),
        session.alias("session_id"),
        host.alias("host"),
        path.alias("pathname"),
        *_part(events),
    )
    return out.withColumn("current_url", F.concat(F.lit("https://"), F.col("host"), F.col("pathname")))


def customers_from(customer: DataFrame) -> DataFrame:
    """customers(email, first_name, last_name)."""
    return customer.select(
        _plain_email("c_custkey").alias("email"),
        F.when(F.col("c_custkey") % 10 == 0, F.lit(None).cast("string")).otherwise(F.lit("Customer")).alias("first_name"),
        F.when(F.col("c_custkey") % 20 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("c_custkey").cast("string"))
        .alias("last_name"),
    )


def contacts_from(customer: DataFrame) -> DataFrame:
    """contacts(id, full_name, first_name, last_name, email, phone)."""
    return customer.select(
        F.col("c_custkey").cast("string").alias("id"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("c_name")).alias("full_name"),
        F.when(F.col("c_custkey") % 10 == 0, F.lit(None).cast("string")).otherwise(F.lit("Customer")).alias("first_name"),
        F.when(F.col("c_custkey") % 20 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("c_custkey").cast("string"))
        .alias("last_name"),
        _plain_email("c_custkey").alias("email"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("0400"), F.col("c_custkey").cast("string")))
        .alias("phone"),
    )


class Fixtures:
    """Lazily derived audit inputs for one scale-factor folder.

    ``events``: a conformed copy of the event log that a landing job wrote
    (``tillscope.sources.landing.land_events``); without it the raw log is
    read. Nothing is written or run here.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, events: str | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.events = events

    def _t(self, name: str) -> DataFrame:
        if name == "events" and self.events:
            return self.spark.read.parquet(self.events)
        return read_table(self.spark, self.sf_dir, name)

    @property
    def logins(self) -> DataFrame:
        return logins_from(self._t("events"))

    @property
    def carts(self) -> DataFrame:
        return carts_from(self._t("events"))

    @property
    def treatment_plans(self) -> DataFrame:
        return treatment_plans_from(self._t("orders"))

    @property
    def shop_orders(self) -> DataFrame:
        return shop_orders_from(self._t("events"))

    @property
    def activity(self) -> DataFrame:
        return activity_from(self._t("events"))

    @property
    def customers(self) -> DataFrame:
        return customers_from(self._t("customer"))

    @property
    def contacts(self) -> DataFrame:
        return contacts_from(self._t("customer"))


def activity_from_event_log(log: DataFrame, props: str = "properties", person_props: str = "person_properties") -> DataFrame:
    """Conform a raw behaviour log into ``activity``.

    ``log`` has ``event_id, ts, event, person_id`` plus two property bags:
    event properties (``$session_id``, ``$host``, ``$pathname``,
    ``$current_url``) and person properties (``email``). A bag may be a
    ``MAP<STRING,STRING>`` (map lookup) or JSON text (``get_json_object``).
    """

    def getter(bag: str):
        if isinstance(log.schema[bag].dataType, T.MapType):
            return lambda key: F.col(bag)[key]
        return lambda key: F.get_json_object(F.col(bag), "$." + key)

    ev, person = getter(props), getter(person_props)
    return log.select(
        "event_id",
        "ts",
        "event",
        "person_id",
        person("email").alias("email"),
        ev("$session_id").alias("session_id"),
        ev("$host").alias("host"),
        ev("$pathname").alias("pathname"),
        ev("$current_url").alias("current_url"),
    )
