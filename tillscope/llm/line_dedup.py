"""Line deduplication by overlapping three-line windows.

Every run of ``width`` consecutive lines is a window, known by two 64-bit
hashes over its lines' hashes. A window that occurs more than once, in one
document or in several, keeps its first occurrence (smallest doc_id, then
hash of the text, then line); the lines that later occurrences cover are removed, overlapping
occurrences merged. Only built-in functions are used.

Counting is combined before the shuffle. The repeated windows are landed, so
that the join back to the occurrences has an exchange on both sides and AQE
can split a window that a third of all rows hold. Per document, removed
windows become the list of line ranges that stay, so a text is cut by a few
slices however many windows were removed.

Nulls and ties: lines end at ``\\n``; a text with fewer lines than a window is
left alone; a null text stays null with 0 lines. Rows are known by doc_id and
a hash of the text: rows that share both count as one document, and what is
removed from one is removed from all; rows that share an id, or have none, but
differ in text are documents of their own. Null ids come after all others. A
document all of whose lines are removed keeps its row, with an
empty text. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillscope.llm.common import fresh, land

WIDTH = 3
#: Rank of rows without an id: after every (doc_id, hash, line).
LAST = "42535295865117307932921825928971026432"  # 2 ** 125


def _rank(doc_id: Column, t: Column, line: Column) -> Column:
    """(doc_id, t, line) as one ordered number that a hash aggregate can hold;
    of ``t``, 31 bits where there is an id, else all."""
    number = lambda x: F.lit(x).cast("decimal(38,0)")
    place = doc_id.cast("decimal(19,0)") * F.lit(1 << 62).cast("decimal(19,0)")
    place = place.cast("decimal(38,0)") + F.shiftrightunsigned(t, 33).cast("decimal(10,0)") * F.lit(1 << 31).cast("decimal(10,0)")
    rest = (t.cast("decimal(19,0)") + F.lit(str(1 << 63)).cast("decimal(19,0)")) * F.lit(1 << 31).cast("decimal(10,0)")
    return F.coalesce(place.cast("decimal(38,0)"), (number(LAST) + rest).cast("decimal(38,0)")) + line.cast("decimal(10,0)")


def windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, t, p, a, b): hash of the text, first line and hash of every window."""
    lines = F.split("text", "\n", -1)
    hashed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"),
        F.transform(lines, lambda x: F.xxhash64(x)).alias("h"),
        F.transform(lines, lambda x: F.xxhash64(F.lit(17), x)).alias("g"),
    ).where(F.size("h") >= width)

    def run(i: Column) -> Column:
        h = [F.get("h", i + k) for k in range(width)]
        g = [F.get("g", i + k) for k in range(width)]
        return F.struct(i.alias("p"), F.xxhash64(*h).alias("a"), F.xxhash64(F.lit(29), *g).alias("b"))

    each = F.transform(F.sequence(F.lit(0), F.size("h") - width), run)
    return hashed.select("doc_id", "t", F.explode(each).alias("w")).select("doc_id", "t", "w.p", "w.a", "w.b")


def stays(spark: SparkSession, docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, t, segs, tail) of each document that loses lines: the line ranges
    (start, count) before its last removed line, and the line after that."""
    w = windows(docs, width).withColumn("rank", _rank(F.col("doc_id"), F.col("t"), F.col("p")))
    # Equal ranks may differ in the text's hash: ``own`` tells which is first.
    repeated = w.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("c"), F.min("rank").alias("first"), F.min_by("t", "rank").alias("own")
    ).where("c > 1")
    repeated = land(spark, repeated.drop("c"), "repeated-lines")
    later = w.join(repeated, ["a", "b"]).where("rank <> first or t <> own").select("doc_id", "t", "p").distinct()
    before = F.lag("p").over(Window.partitionBy("doc_id", "t").orderBy("p"))
    start = F.coalesce(F.col("q") + width, F.lit(0))
    seg = F.when(F.col("p") > start, F.struct(start.alias("s"), (F.col("p") - start).alias("n")))
    return (
        later.withColumn("q", before).select("doc_id", "t", "p", seg.alias("seg"))
        .groupBy("doc_id", "t").agg(F.sort_array(F.collect_list("seg")).alias("segs"), (F.max("p") + width).alias("tail"))
    )


def line_dedup(spark: SparkSession, docs: DataFrame, width: int = WIDTH, counts: bool = False) -> DataFrame:
    """``docs`` with repeated lines cut from ``text`` (and ``n_chars``, where
    there is one, set anew for texts that changed); with ``counts`` also
    n_lines and n_removed."""
    cut = stays(spark, docs, width)
    key, own, segs, tail, lined = (fresh(docs, f"cut_{c}") for c in ("id", "text", "segs", "tail", "lines"))
    cut = cut.select(F.col("doc_id").alias(key), F.col("t").alias(own), F.col("segs").alias(segs), F.col("tail").alias(tail))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(own))
    both = docs.join(cut.hint("shuffle_hash"), same, "left")
    # A column of its own: inside a lambda, ``text`` would mean the new text.
    both, lines = both.withColumn(lined, F.split("text", "\n", -1)), F.col(lined)
    parts = F.flatten(F.transform(segs, lambda s: F.slice(lines, s["s"] + 1, s["n"])))
    rest = F.slice(lines, F.col(tail) + 1, F.greatest(F.size(lines) - F.col(tail), F.lit(0)))
    changed = F.col(segs).isNotNull() & F.col("text").isNotNull()
    kept = F.when(changed, F.array_join(F.concat(parts, rest), "\n")).otherwise(F.col("text"))
    out = []
    for c in docs.columns:
        if c.lower() == "text":
            out.append(kept.alias(c))
        elif c.lower() == "n_chars":
            n = F.length(kept).cast(docs.schema[c].dataType)
            out.append(F.when(changed, n).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    if counts:
        n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
        left = F.aggregate(segs, F.lit(0), lambda a, s: a + s["n"]) + F.greatest(n - F.col(tail), F.lit(0))
        out += [n.cast("long").alias("n_lines"), F.when(changed, n - left).otherwise(0).cast("long").alias("n_removed")]
    return both.select(*out)


ORACLE = """
with l as (select doc_id, string_split(text, chr(10)) as x from documents),
w as (select doc_id, p, x[p] as a, x[p + 1] as b, x[p + 2] as c
      from (select doc_id, x, unnest(range(1, len(x) - 1)) as p from l)),
r as (select doc_id, p, row_number() over (partition by a, b, c order by doc_id, p) as k from w),
gone as (select distinct doc_id, p + j as i from r, (values (0), (1), (2)) as t(j) where k > 1),
one as (select doc_id, i, x[i] as line from (select doc_id, x, unnest(range(1, len(x) + 1)) as i from l))
select d.doc_id, any_value(len(l.x)) as n_lines, count(g.i) as n_removed,
       coalesce(string_agg(o.line, chr(10) order by o.i) filter (where g.i is null), case when count(o.i) > 0 then '' end) as text
from documents d join l on l.doc_id = d.doc_id
left join one o on o.doc_id = d.doc_id left join gone g on g.doc_id = o.doc_id and g.i = o.i
group by d.doc_id
"""


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return line_dedup(spark, docs.select("doc_id", "text"), counts=True).select("doc_id", "n_lines", "n_removed", "text")
