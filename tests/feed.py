"""Feed pages of many orders, as the shop's paged fetches would land them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fetch_pages(shop_orders: DataFrame, day_shift: int, fetch: str, page_size: int) -> DataFrame:
    """Pages of one fetch kind: orders of UTC day d land in the fetch for
    day d + ``day_shift``. A fetch day's orders are hashed into
    ``ceil(n_day / page_size)`` pages, so a page holds about ``page_size``
    orders however large the day is."""
    o = shop_orders.withColumn("_fetch_day", F.date_add(F.to_date("created"), day_shift))
    n_pages = o.groupBy("_fetch_day").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(page_size)).cast("bigint").alias("_n_pages")
    )
    o = o.join(n_pages, "_fetch_day").withColumn("_page", F.pmod(F.xxhash64("number"), F.col("_n_pages")))
    node = F.struct(
        F.col("number").alias("number"),
        F.col("email").alias("userEmail"),
        F.col("payment_status").alias("paymentStatus"),
        F.col("status").alias("status"),
        F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("created"),
        F.struct(F.struct(F.col("total").alias("amount"), F.col("currency").alias("currency")).alias("gross")).alias(
            "total"
        ),
    )
    per_page = o.groupBy("_fetch_day", "_page").agg(F.collect_list(F.struct(node.alias("node"))).alias("edges"))
    return per_page.select(
        F.concat_ws(
            "-", F.lit(fetch), F.date_format("_fetch_day", "yyyyMMdd"), F.col("_page").cast("string")
        ).alias("page_id"),
        F.struct(
            F.struct(
                F.struct(F.lit(False).alias("hasNextPage"), F.lit(None).cast("string").alias("endCursor")).alias(
                    "pageInfo"
                ),
                F.col("edges").alias("edges"),
            ).alias("orders")
        ).alias("data"),
    )


def order_feed_pages(shop_orders: DataFrame, page_size: int = 100) -> DataFrame:
    """Build feed pages from a flat order table (used to land test feeds).

    Mirrors the two-day fetch: every day is fetched for itself and again as
    the next day's previous-day fetch, and the two fetches are combined with
    ``unionByName`` — so every order occurs in two documents.
    """
    own_day = fetch_pages(shop_orders, 0, "day", page_size)
    previous_day = fetch_pages(shop_orders, 1, "prev", page_size)
    return own_day.unionByName(previous_day)
