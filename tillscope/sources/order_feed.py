"""The nested commerce order feed and its flattening.

A fetched page is ``{data: {orders: {pageInfo, edges: [{node: {...}}]}}}``.
``flatten_order_feed`` turns any number of such pages into ``shop_orders``
rows (``explode`` of edges; nested field selects are pruned by Catalyst), and
duplicates across pages are resolved later by the number dedupe (A4). A page
that can't be read fails the job (``sound_pages``) or goes to a quarantine
folder with a count (``quarantine``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: When a page was landed; kept by the flattening where pages have it.
LANDED = "landed_at"

NODE = T.StructType(
    [
        T.StructField("number", T.StringType()),
        T.StructField("userEmail", T.StringType()),
        T.StructField("paymentStatus", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("created", T.StringType()),
        T.StructField(
            "total",
            T.StructType(
                [
                    T.StructField(
                        "gross",
                        T.StructType(
                            [T.StructField("amount", T.DecimalType(18, 2)), T.StructField("currency", T.StringType())]
                        ),
                    )
                ]
            ),
        ),
    ]
)
#: Text of a page that could not be parsed.
CORRUPT = "_corrupt"

PAGE = T.StructType(
    [
        T.StructField("page_id", T.StringType()),
        T.StructField(
            "data",
            T.StructType(
                [
                    T.StructField(
                        "orders",
                        T.StructType(
                            [
                                T.StructField(
                                    "pageInfo",
                                    T.StructType(
                                        [
                                            T.StructField("hasNextPage", T.BooleanType()),
                                            T.StructField("endCursor", T.StringType()),
                                        ]
                                    ),
                                ),
                                T.StructField(
                                    "edges", T.ArrayType(T.StructType([T.StructField("node", NODE)]))
                                ),
                            ]
                        ),
                    )
                ]
            ),
        ),
    ]
)


FEED = T.StructType([*PAGE.fields, T.StructField(CORRUPT, T.StringType())])


def flatten_order_feed(pages: DataFrame) -> DataFrame:
    """Pages -> shop_orders(number, email, payment_status, status, total,
    currency, created NTZ UTC, source).

    ``created`` is ISO-8601 text with an offset; it becomes UTC wall time
    whatever the session zone is.
    """
    session_tz = pages.sparkSession.conf.get("spark.sql.session.timeZone")
    carried = [c for c in ("page_id", LANDED) if c in pages.columns]
    e = pages.select(*carried, F.explode("data.orders.edges").alias("edge"))
    n = F.col("edge.node")
    created = F.convert_timezone(F.lit(session_tz), F.lit("UTC"), F.to_timestamp(n["created"]).cast("timestamp_ntz"))
    return e.select(
        n["number"].alias("number"),
        n["userEmail"].alias("email"),
        n["paymentStatus"].alias("payment_status"),
        n["status"].alias("status"),
        n["total"]["gross"]["amount"].cast("decimal(18,2)").alias("total"),
        n["total"]["gross"]["currency"].alias("currency"),
        created.alias("created"),
        F.col("page_id").alias("source"),
        *([F.col(LANDED)] if LANDED in pages.columns else []),
    )


def read_order_feed(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Landed JSON pages (one document per line) with a fixed schema. The text
    of a page that can't be parsed is kept in ``CORRUPT``; pass the pages
    through ``sound_pages`` or ``quarantine`` before flattening them."""
    return spark.read.schema(FEED).option("columnNameOfCorruptRecord", CORRUPT).json(paths)


def broken(pages: DataFrame) -> Column:
    """Whether a page is unreadable: malformed text, an answer without order
    edges (the shop's error answers), or an edge without a numbered order."""
    edges = F.col("data.orders.edges")
    bad = edges.isNull() | F.exists(edges, lambda e: e["node"]["number"].isNull())
    return (bad | F.col(CORRUPT).isNotNull()) if CORRUPT in pages.columns else bad


def sound_pages(pages: DataFrame) -> DataFrame:
    """The pages, all of them sound: the first broken one fails the job, so no
    order is lost in silence."""
    said = F.concat(F.lit("broken order page: "), F.substring(F.coalesce(*_named(pages), F.lit("without a name")), 1, 200))
    checked = F.when(broken(pages), F.raise_error(said)).otherwise(F.col("data"))
    return pages.withColumn("data", checked).drop(CORRUPT)


def _named(pages: DataFrame) -> list[Column]:
    return [F.col(c) for c in ("page_id", CORRUPT) if c in pages.columns]


def quarantine(pages: DataFrame, path: str) -> tuple[DataFrame, int]:
    """Sound pages, and the number of broken ones, which are written to
    ``path`` as JSON (page, text as it came, reason)."""
    text = F.col(CORRUPT) if CORRUPT in pages.columns else F.lit(None).cast("string")
    reason = (
        F.when(text.isNotNull(), "malformed").when(F.col("data.orders.edges").isNull(), "no order edges").otherwise("order without a number")
    )
    bad = pages.where(broken(pages)).select("page_id", F.coalesce(text, F.to_json("data")).alias("text"), reason.alias("reason"))
    bad.write.mode("append").json(path)
    count = bad.sparkSession.read.schema("page_id string, text string, reason string").json(path).count()
    return pages.where(~F.coalesce(broken(pages), F.lit(True))).drop(CORRUPT), count
