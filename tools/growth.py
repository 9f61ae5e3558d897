"""How the audits' times grow: the same queries over larger and larger logs.

Usage: python tools/growth.py [query ...]
Sizes: sf0.01, sf0.1 and a log that repeats sf0.1's events ``COPIES`` times
(event and user ids shifted, so keys grow with the rows). Prints one JSON line
with the best of two runs of each query, and the time per million events.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

COPIES = 20
HEADLINE = ["login_audit", "purchases", "hourly_sales_history", "login_funnel", "daily_intent_audit", "live_visitors"]


def repeated(spark, sf_dir: str, copies: int) -> str:
    """A table folder whose events are ``copies`` shifted copies of ``sf_dir``'s."""
    from pyspark.sql import functions as F

    from tillscope.session import scratch_path
    from tillscope.sources.tables import read_table

    out = scratch_path(spark, "growth")
    events = read_table(spark, sf_dir, "events")
    top = events.agg(F.max("event_id") + 1, F.max("user_id") + 1).first()
    copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    (
        events.withColumn("copy", copy)
        .withColumn("event_id", F.col("event_id") + F.col("copy") * top[0])
        .withColumn("user_id", F.col("user_id") + F.col("copy") * top[1])
        .drop("copy").repartition(16).write.parquet(f"{out}/events.parquet")
    )
    for name in ("orders", "customer"):
        read_table(spark, sf_dir, name).write.parquet(f"{out}/{name}.parquet")
    return out


def main(names: list[str]) -> None:
    from tillscope.plans import QUERIES
    from tillscope.session import local_session

    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    big = "/root/testdata/sf0.1"
    sizes = {"sf0.01": "/root/testdata/sf0.01", "sf0.1": big, f"sf0.1 x {COPIES}": repeated(spark, big, COPIES)}
    out: dict = {}
    for label, folder in sizes.items():
        rows = spark.read.parquet(f"{folder}/events.parquet").count()
        for name in names or HEADLINE:
            best = None
            for _ in range(2):
                t = time.perf_counter()
                QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
                took = time.perf_counter() - t
                best = took if best is None else min(best, took)
            out.setdefault(name, {})[label] = {"events": rows, "sec": round(best, 3), "sec_per_million": round(best / rows * 1e6, 2)}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
