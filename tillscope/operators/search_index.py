"""A24 by an index: substring search without reading the searched view.

``build_index`` writes the different searched values of a field with their
grams (all substrings of three characters), by gram; a search looks up the
rarest grams of its text, keeps the values that hold all of them and verifies
each with ``contains``. A text under three characters has no gram and is
matched against the values themselves, which are fewer and narrower than the
view. Both ways give what ``report.audit_search`` gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
#: Parts of the posting table (by hash of the gram), and grams looked up a search.
PARTS, RAREST = 64, 3


def _part(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


def _grams(value: Column) -> Column:
    starts = F.sequence(F.lit(1), F.length(value) - (GRAM - 1))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(value, i, F.lit(GRAM))))


def searched(df: DataFrame) -> dict[str, Column]:
    """The fields of a view that a search looks at, as it sees them."""
    fields = {"email": F.lower(F.col("email"))}
    return fields | {"number": F.col("number").cast("string")} if "number" in df.columns else fields


def build_index(df: DataFrame, path: str) -> str:
    """Write the values, postings and gram counts of the searched fields of ``df``."""
    values = None
    for field, value in searched(df).items():
        one = df.select(F.lit(field).alias("field"), value.alias("value")).where("value is not null").distinct()
        values = one if values is None else values.unionByName(one)
    values.write.mode("overwrite").partitionBy("field").parquet(f"{path}/values")
    values = df.sparkSession.read.parquet(f"{path}/values")
    grams = values.where(F.length("value") >= GRAM).select("field", "value", F.explode(_grams(F.col("value"))).alias("gram"))
    # Dealt by gram and a hash of the value: a gram that most values hold is
    # written by many tasks.
    salt = F.pmod(F.xxhash64("value"), F.lit(8))
    posts = grams.withColumn("part", _part(F.col("gram")))
    posts.repartition("field", "part", salt).sortWithinPartitions("field", "part", "gram").write.mode("overwrite").partitionBy(
        "field", "part"
    ).parquet(f"{path}/postings")
    counts = grams.groupBy("field", "gram").agg(F.count(F.lit(1)).alias("n"))
    counts.write.mode("overwrite").partitionBy("field").parquet(f"{path}/counts")
    return path


def matching(spark: SparkSession, path: str, field: str, text: str) -> DataFrame:
    """The values (``value``) of ``field`` that contain ``text`` in lower case."""
    q = text.lower()
    grams = sorted({q[i : i + GRAM] for i in range(len(q) - GRAM + 1)})
    if not grams:
        found = spark.read.parquet(f"{path}/values").where(F.col("field") == field).select("value")
    else:
        known = spark.read.parquet(f"{path}/counts").where((F.col("field") == field) & F.col("gram").isin(grams))
        n = {r["gram"]: r["n"] for r in known.select("gram", "n").collect()}  # a row for each gram of the text
        rarest = sorted(grams, key=lambda g: (n.get(g, 0), g))[:RAREST]
        parts = [r[0] for r in spark.range(1).select(F.explode(F.array_distinct(F.array(*(_part(F.lit(g)) for g in rarest))))).collect()]
        posts = spark.read.parquet(f"{path}/postings").where(
            (F.col("field") == field) & F.col("part").isin(parts) & F.col("gram").isin(rarest)
        )
        found = posts.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rarest)).select("value")
    return found.where(F.col("value").contains(q))


def indexed_search(df: DataFrame, path: str, text: str) -> DataFrame:
    """``audit_search(df, text)`` by the index at ``path`` (built from ``df`` or
    a view with at least its values)."""
    if not text:
        return df
    out, hit = df, None
    for i, (field, value) in enumerate(searched(df).items()):
        one = matching(df.sparkSession, path, field, text).select(F.col("value").alias(f"_v{i}"))
        out = out.join(one, value == F.col(f"_v{i}"), "left")  # values are distinct: no row is doubled
        hit = F.col(f"_v{i}").isNotNull() if hit is None else hit | F.col(f"_v{i}").isNotNull()
    return out.where(hit).select(*df.columns)
