"""Running streams to completion into the shared folder.

Aggregating streams run in *update* mode with a watermark, so state for
closed windows is dropped. Each micro-batch's updated rows are written to a
folder named by its batch id; readers take the latest version of every key,
and ``compact`` bounds what they read. This gives the
exact final result without complete mode (whose state never shrinks) and
without the driver-held memory sink. Checkpoints live in the shared folder, so
a restarted query resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tillscope.operators.dedupe import latest_per
from tillscope.session import scratch_path

BATCH_COL = "_batch_id"


def utc_instant(ts: Column | str, spark: SparkSession) -> Column:
    """UTC wall time (NTZ) -> TIMESTAMP instant, whatever the session zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    session_tz = spark.conf.get("spark.sql.session.timeZone")
    return F.convert_timezone(F.lit("UTC"), F.lit(session_tz), c).cast("timestamp")


def instant_to_local(ts: Column | str, spark: SparkSession, tz: str) -> Column:
    """TIMESTAMP instant -> wall time (NTZ) in ``tz``."""
    c = F.col(ts) if isinstance(ts, str) else ts
    session_tz = spark.conf.get("spark.sql.session.timeZone")
    return F.convert_timezone(F.lit(session_tz), F.lit(tz), c.cast("timestamp_ntz"))


def _start(writer, spark: SparkSession, state_partitions: int | None) -> StreamingQuery:
    """Start ``writer`` with ``state_partitions`` partitions of state (None:
    the session's shuffle partitions). The checkpoint keeps the number for
    good, so it is the caller's choice, never a look at the cluster's size at
    start. A query clones the session conf when it starts, so the count is set
    only around ``start()``."""
    if state_partitions is None:
        return writer.start()
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    spark.conf.set(key, str(state_partitions))
    try:
        return writer.start()
    finally:
        spark.conf.set(key, old)


def start_versioned(
    df: DataFrame,
    base: str,
    output_mode: str = "update",
    processing_time: str | None = None,
    state_partitions: int | None = None,
    per_batch: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Start ``df`` writing every micro-batch, tagged with its batch id, to
    ``base/data`` with its checkpoint in ``base/checkpoint``.

    ``processing_time`` (e.g. ``"60 seconds"``, the dashboard's poll interval)
    starts a continuous query; None processes what is available and stops.
    ``per_batch`` shapes a batch's rows before they are written (e.g. adds up
    its deltas). Restarting with the same ``base`` resumes from the checkpoint. A batch
    re-run after a failure replaces its folder. The trailing no-data micro-batch is
    kept on purpose: it is what records the advanced watermark in the offset
    log, so a restarted run still drops rows that are late for the data
    already seen (tests/test_stream_restart.py).
    """
    out, ckpt = f"{base}/data", f"{base}/checkpoint"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # One folder a batch: a batch that is run again replaces its rows.
        (per_batch(batch) if per_batch else batch).write.mode("overwrite").parquet(f"{out}/{BATCH_COL}={batch_id}")

    w = df.writeStream.outputMode(output_mode).foreachBatch(write_batch).option("checkpointLocation", ckpt)
    w = w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=True)
    return _start(w, df.sparkSession, state_partitions)


def run_versioned(
    df: DataFrame,
    name: str,
    output_mode: str = "update",
    base: str | None = None,
    state_partitions: int | None = None,
    per_batch: Callable[[DataFrame], DataFrame] | None = None,
) -> str:
    """Run ``df`` to completion (``availableNow``) into a fresh folder of the
    shared folder (or ``base``); returns the data path."""
    base = base or scratch_path(df.sparkSession, name)
    start_versioned(df, base, output_mode, state_partitions=state_partitions, per_batch=per_batch).awaitTermination()
    return f"{base}/data"


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the committed (``_SUCCESS``) folders directly under ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*/_SUCCESS")
    return sorted(st.getPath().getParent().getName() for st in fs.globStatus(done) or [])


def read_versions(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows that still matter of a versioned output folder: its last
    compaction and the batches after it (an empty frame before any batch)."""
    full = StructType([*schema.fields, StructField(BATCH_COL, LongType())])
    compact = path.removesuffix("/data") + "/compact"
    kept = _folders(spark, compact)
    upto = int(kept[-1]) if kept else -1
    after = [f for f in _folders(spark, path) if int(f.split("=")[1]) > upto]
    parts = [spark.read.schema(full).parquet(f"{compact}/{kept[-1]}")] if kept else []
    if after:
        read = spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in after])
        batch = F.regexp_extract(F.input_file_name(), f"{BATCH_COL}=(\\d+)/", 1).cast("long")
        parts.append(read.withColumn(BATCH_COL, batch))
    if not parts:
        return spark.createDataFrame([], full)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_latest(spark: SparkSession, path: str, keys: Sequence[str], schema) -> DataFrame:
    """Latest version of each key from a versioned output folder."""
    values = [f.name for f in schema.fields if f.name not in keys]
    return latest_per(read_versions(spark, path, schema), keys, [BATCH_COL], values)


def compact(spark: SparkSession, path: str, keys: Sequence[str], schema, combine: Callable[[DataFrame], DataFrame] | None = None) -> str | None:
    """Write the latest version of each key over all batches so far as one
    folder; reads then take it and later batches only. Batches that it covers
    may be deleted by the storage's retention. Readers meanwhile see the
    folder before or after, never a part. ``combine`` takes the place of the
    latest version (deltas: their sums)."""
    batches = [int(f.split("=")[1]) for f in _folders(spark, path)]
    if not batches:
        return None
    raw = read_versions(spark, path, schema)
    values = [f.name for f in schema.fields if f.name not in keys] + [BATCH_COL]
    upto = max(batches)
    out = f"{path.removesuffix('/data')}/compact/{upto:020d}"
    raw = raw.where(F.col(BATCH_COL) <= upto)
    if combine:
        full = StructType([*schema.fields, StructField(BATCH_COL, LongType())])
        one = combine(raw.drop(BATCH_COL)).withColumn(BATCH_COL, F.lit(upto).cast("long")).select(*full.names)
    else:
        one = latest_per(raw, keys, [BATCH_COL], values)
    one.write.mode("overwrite").parquet(out)
    return out
