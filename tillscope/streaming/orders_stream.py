"""Order feed pages streamed in, the last copy of each order number kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.operators.dedupe import latest_per
from tillscope.sources.order_feed import CORRUPT, FEED, LANDED, broken, flatten_order_feed, sound_pages
from tillscope.streaming.runtime import BATCH_COL, utc_instant

ORDER = [LANDED, "source"]
FIELDS = ["email", "payment_status", "status", "total", "currency", "created"]


def landed_pages(spark, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Landed pages as a stream, broken ones and their text (``CORRUPT``)
    included, with the time at which each was landed."""
    r = spark.readStream.schema(FEED).option("columnNameOfCorruptRecord", CORRUPT)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(path).withColumn(LANDED, F.col("_metadata.file_modification_time"))


def order_feed_stream(spark, path: str, max_files_per_trigger: int | None = None, skip_broken: bool = False) -> DataFrame:
    """Landed pages as a stream. A broken page fails the query; with
    ``skip_broken`` it is left to a second query over ``broken_pages_stream``,
    which writes such pages to a quarantine folder."""
    pages = landed_pages(spark, path, max_files_per_trigger)
    return pages.where(~F.coalesce(broken(pages), F.lit(True))).drop(CORRUPT) if skip_broken else sound_pages(pages)


def broken_pages_stream(spark, path: str) -> DataFrame:
    """The landed pages that can't be read, for the quarantine folder."""
    pages = landed_pages(spark, path)
    return pages.where(F.coalesce(broken(pages), F.lit(True))).select("page_id", F.coalesce(CORRUPT, F.to_json("data")).alias("text"), LANDED)


def orders_stream_latest(pages: DataFrame, overlap: str = "2 days") -> DataFrame:
    """Flatten streamed pages; the latest copy of each order number (by landing
    time, then page), written by version like S1.

    ``overlap`` bounds how far apart (in event time) two copies of one order
    can arrive: the feed re-fetches the previous UTC day, so two days. State
    is keyed by the order's day as well, so the watermark drops it.
    """
    flat = flatten_order_feed(pages).withColumn("_et", utc_instant("created", pages.sparkSession))
    best = (
        flat.withWatermark("_et", overlap)
        .groupBy(F.window("_et", "1 day"), "number")
        .agg(F.max(F.struct(*ORDER, *FIELDS)).alias("_last"))
    )
    return best.select("number", "_last.*")


def latest_orders(versions: DataFrame) -> DataFrame:
    """One row per order number from the stream's written versions."""
    return latest_per(versions, ["number"], [*ORDER, BATCH_COL], FIELDS)
