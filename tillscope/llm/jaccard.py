"""Exact n-gram Jaccard join with rare-first prefix filtering.

A document's set holds its distinct word n-grams. N-grams have one global
order, rare ones first: by a count over all documents kept in a fixed table of
counters, then by hash. Two sets that reach the threshold share an n-gram
among the first ``n - ceil(t * n) + 1`` of each, so only these prefixes are
joined, with

* a length filter: the smaller set has at least t times the larger one's size;
* a positional filter: what can still be shared after the two positions, and
  after all shared prefix n-grams, reaches the overlap that is needed;
* a suffix filter: overlap is bounded by the sum of smaller counts over hash
  bins of the two sets, and their difference is at least the number of places
  in which their parity bitmaps differ (inside the join, as it is cheap);

and each pair that is left is verified once on the full sets.

Only connectivity is wanted, so the work stays linear in large groups: equal
sets are one class; posting lists of the same members are one list; classes in
long lists first unite in rounds, each class verified against one partner a
round; then only pairs from different components are joined, one side always
outside the list's largest component. Every list is joined in full: no link is
lost.

Sets are computed from whole texts where the texts lie; texts are never moved.
Verified sets are fetched by a pass that a fixed-size bitmap of the needed
classes prunes.

Nulls and ties: a null, empty or blank text has no set and links with nothing.
Rows with equal sets (copies, repeated rows) are in one component. The
component is named by its smallest doc_id; null ids are passed over, and a
component without ids is named null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.common import components, discard, fresh, land, released, slices
from tillscope.llm.textnum import hash_spans, LOWER, mix, ranges, SPACE, spans, text_bytes, U, windows

#: Counters of the n-gram counts (a table of this size at any corpus size).
COUNTERS = 1 << 21
BLOCK = 1 << 12
#: Hash bins of the suffix filter.
BINS = 32
#: 64-bit words of a set's parity bitmap.
PARITY = 8
#: Posting lists of at least so many classes take part in the rounds that unite
#: large groups before all pairs are joined, and the most rounds.
LONG, ROUNDS, FEW = 16, 6, 16
#: How much less a partner may share than the best, for other partners by round.
SPREAD = 0.25
#: Bits of the bitmap of classes whose sets are fetched.
BITS = 1 << 23


BITS_OF = [f"bit{i}" for i in range(PARITY)]


class Shingles:
    """N-gram hashes of many texts: ``h`` and the owner text of each (a text
    with fewer words has its whole sequence as one)."""

    def __init__(self, texts: pa.Array, n: int):
        buf, off = text_bytes(texts)
        buf = LOWER[buf]
        starts, ends, first = spans(SPACE[buf], off)
        word = hash_spans(buf, starts, ends)
        words = np.diff(first)
        full = np.maximum(words - n + 1, 0)
        at = ranges(first[:-1], full)
        parts, owner = [windows(word, n)[at] if len(at) else np.zeros(0, U)], [np.repeat(np.arange(len(words)), full)]
        for w in range(1, n):
            few = np.flatnonzero(words == w)
            if len(few):
                parts.append(mix(windows(word, w)[first[few]] + U(w)))
                owner.append(few)
        self.texts = len(words)
        self.h, self.owner = np.concatenate(parts), np.concatenate(owner)


class Sets:
    """Distinct n-gram keys of each text in the global order. A key is the
    count class (rare first) in its top byte over 56 bits of the hash."""

    def __init__(self, s: Shingles, rarity: np.ndarray):
        key = (rarity[(s.h & U(COUNTERS - 1)).astype(np.int64)].astype(U) << U(56)) | (s.h >> U(8))
        order = np.lexsort((key, s.owner))
        key, owner = key[order], s.owner[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        self.key, self.owner = key[new], owner[new]
        self.size = np.bincount(self.owner, minlength=s.texts)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        total = np.concatenate([np.zeros(1, U), np.cumsum(mix(self.key))])
        self.id = mix(total[self.first[1:]] - total[self.first[:-1]] + self.size.astype(U)).view(np.int64)

    def lists(self, n: np.ndarray) -> pa.Array:
        """The first n[i] keys of each text."""
        at = ranges(self.first[:-1], n)
        off = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        return pa.ListArray.from_arrays(off, pa.array(self.key[at].view(np.int64)))

    def bins(self) -> pa.Array:
        cell = self.owner * BINS + (self.key & U(BINS - 1)).astype(np.int64)
        count = np.minimum(np.bincount(cell, minlength=len(self.size) * BINS), 2**31 - 1).astype(np.int32)
        return pa.ListArray.from_arrays(np.arange(0, len(count) + 1, BINS, dtype=np.int32), pa.array(count))


    def parity(self) -> np.ndarray:
        """(texts, PARITY): which bit places an odd number of keys falls on."""
        size = 64 * PARITY
        cell = self.owner * size + ((self.key >> U(8)) & U(size - 1)).astype(np.int64)
        odd = np.bincount(cell, minlength=len(self.size) * size) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).reshape(-1, PARITY)


def rarity(docs: DataFrame, n: int) -> np.ndarray:
    """Count class of each counter: n-gram occurrences over all documents,
    added up in tasks, then block by block; COUNTERS bytes reach the driver, the
    classes as Arrow buffers (no rows of counts, no copies of them)."""

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                h = Shingles(part.column("text"), n).h
                table += np.bincount((h & U(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        blocks = table.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(1))
        for at in range(0, len(used), 64):
            yield block_rows(used[at : at + 64], [b.astype("<u4") for b in blocks[used[at : at + 64]]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                some = np.frombuffer(data.as_buffer(), "<u4").astype(np.int64)
                sums[block] = sums[block] + some if block in sums else some
        if sums:
            yield block_rows(np.array(list(sums)), [count_class(v) for v in sums.values()])

    kind = "block int, data binary"
    rows = docs.select("text").mapInArrow(count, kind).repartition("block").mapInArrow(add, kind).toArrow()
    table = np.zeros((COUNTERS // BLOCK, BLOCK), np.uint8)
    for block, data in zip(rows.column("block").to_pylist(), rows.column("data"), strict=True):
        table[block] = np.frombuffer(data.as_buffer(), np.uint8)
    return table.ravel()


def count_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(255, 6 * np.log2(1.0 + counts)).astype(np.uint8)


def block_rows(block: np.ndarray, data: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(block, pa.int32()), pa.array([d.tobytes() for d in data], pa.binary())], names=["block", "data"]
    )


def jaccard_components(spark: SparkSession, docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``: documents
    link when 100 * intersection >= ``percent`` * union of their n-gram sets."""
    rows = linked(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), n, percent)
    name = rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("name"), F.count(F.lit(1)).alias("c"))
    name = land(spark, name.where("c > 1").drop("c"), "ngram-names")
    return rows.join(name, "comp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("name", "doc_id").alias("component_id")
    )


def linked(spark: SparkSession, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The columns of ``docs`` but text (longs), n (set size) and comp (the
    component, null without a set) of every row. Landed."""
    keys = [c for c in docs.columns if c != "text"]
    rare = rarity(docs, n)

    @released
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s = Sets(Shingles(part.column("text"), n), rare)
                p = np.where(s.size > 0, s.size - (percent * s.size + 99) // 100 + 1, 0)
                bits = s.parity()
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keys), pa.array(s.size, pa.int64()), pa.array(s.id, pa.int64()), s.lists(p), s.bins(),
                     *(pa.array(bits[:, i]) for i in range(PARITY))],
                    names=[*keys, "n", "k", "prefix", "bins", *BITS_OF],
                )

    kind = "".join(f"{c} long, " for c in keys) + "n long, k long, prefix array<long>, bins array<int>" + "".join(f", {b} long" for b in BITS_OF)
    sets = land(spark, docs.mapInArrow(prefixes, kind), "ngram-prefixes")
    classes = land(spark, sets.where("n > 0").dropDuplicates(["k"]).drop(*keys), "ngram-classes")
    full, sets = sets, land(spark, sets.select(*keys, "n", "k"), "ngram-keys")
    discard(spark, full)
    posts = posting_lists(spark, classes)
    links, comp = united(spark, docs, posts, classes, rare, n, percent)

    labelled = land(spark, _labelled(posts, comp), "ngram-posts")
    main = land(spark, _mains(labelled).where("comps > 1").select("g", "main"), "ngram-mains")
    mixed = land(spark, labelled.join(main, "g").join(classes.select("k", *BITS_OF), "k"), "ngram-mixed")
    carried = ("k", "n", "pos", "comp", *BITS_OF)
    x = mixed.where("comp <> main").select("g", "m", *(F.col(c).alias(f"x_{c}") for c in carried))
    y = mixed.select("g", "main", *(F.col(c).alias(f"y_{c}") for c in carried))
    lo, hi = F.least("x_n", "y_n"), F.greatest("x_n", "y_n")
    after = F.least("x_pos", "y_pos") + F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos"))
    once = (F.col("y_comp") == F.col("main")) | (F.col("x_k") < F.col("y_k"))
    fits = (lo * 100 >= hi * percent) & (after * (100 + percent) >= (F.col("x_n") + F.col("y_n")) * percent)
    fits = fits & _parity("x_", "y_", F.col("x_n") + F.col("y_n"), percent)
    pairs = x.join(y, "g").where((F.col("x_comp") != F.col("y_comp")) & once & fits)
    pairs = pairs.select(
        "m", F.least("x_k", "y_k").alias("a"), F.greatest("x_k", "y_k").alias("b"),
        F.when(F.col("x_k") < F.col("y_k"), F.col("x_n")).otherwise(F.col("y_n")).alias("na"),
        F.when(F.col("x_k") < F.col("y_k"), F.col("y_n")).otherwise(F.col("x_n")).alias("nb"),
    )
    pairs = pairs.groupBy("a", "b", "na", "nb").agg(F.sum("m").alias("c")).where(_shared(percent)).select("a", "b")
    pairs = filtered(spark, pairs, classes, percent)
    whole = sets_of(spark, docs, pairs, rare, n)
    more = verified(spark, pairs, whole, percent)
    discard(spark, posts, labelled, main, mixed, classes, *([whole] if hasattr(whole, "landed_at") else []))
    comp = land(spark, components(spark, links.union(more).toDF("u", "v"), "ngram-links"), "ngram-components")

    rows = sets.select(*keys, "n", "k").join(comp, sets["k"] == comp["node"], "left").select(
        *keys, "n", F.when(F.col("n") > 0, F.coalesce("component", "k")).alias("comp")
    )
    return land(spark, rows, "ngram-rows")


def posting_lists(spark: SparkSession, classes: DataFrame) -> DataFrame:
    """(g, k, n, pos, m, c): the lists of two or more classes that share a
    prefix n-gram. Lists of the same ``c`` members are one list ``g`` that
    stands for ``m`` n-grams (or more), at each member's first position: near
    copies share most of their prefixes, and so meet once instead of once an
    n-gram. Should two lists' member hashes collide, pairs are added, not lost."""
    posts = classes.select("k", "n", F.posexplode("prefix").alias("pos", "s"))
    same = F.xxhash64(F.count(F.lit(1)), F.bit_xor(F.xxhash64("k")), F.bit_xor(F.xxhash64(F.lit(7), "k")))
    lists = land(spark, posts.groupBy("s").agg(F.count(F.lit(1)).alias("c"), same.alias("g")).where("c > 1"), "ngram-lists")
    out = posts.join(lists, "s").groupBy("g", "k").agg(
        F.max("n").alias("n"), F.min("pos").alias("pos"), F.count(F.lit(1)).alias("m"), F.max("c").alias("c")
    )
    out = land(spark, out, "ngram-posts")
    discard(spark, lists)
    return out


def _labelled(posts: DataFrame, comp: DataFrame) -> DataFrame:
    """``posts`` with the component of each class (itself if it has none)."""
    return posts.join(comp, posts["k"] == comp["node"], "left").drop("node").withColumn("comp", F.coalesce("component", "k")).drop("component")


def _mains(labelled: DataFrame) -> DataFrame:
    """(g, main, comps): each list's largest component (of equal ones, where it
    is known, that of the class that shares most) and how many it has."""
    best = F.max("shared") if "shared" in labelled.columns else F.lit(0)
    return labelled.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("c"), best.alias("best")).groupBy("g").agg(
        F.max_by("comp", F.struct("c", "best", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")
    )


def united(
    spark: SparkSession, docs: DataFrame, posts: DataFrame, classes: DataFrame, rare: np.ndarray, n: int, percent: int
) -> tuple[DataFrame, DataFrame]:
    """Links found by rounds over the long posting lists, and the components
    that they make.

    In a round every class outside its list's largest component names one
    partner there, the same for the whole list: a class with about the most
    shared prefix n-grams (so the least changed of near copies, to which most
    others are near), another in each round. Of the partners that its lists
    name it takes the one named most often, and the pair is verified; classes take over the smaller label of what they link
    with. Work is linear in the postings. Rounds end when fewer than one in
    ``FEW`` pairs link, or ``ROUNDS`` are over; what is not united then is left
    to the join of all pairs, so nothing is lost."""
    long = posts.where(F.col("c") >= LONG)
    shared = long.groupBy("k").agg(F.sum("m").alias("shared"))
    long = land(spark, long.join(shared, "k"), "ngram-long")
    links = spark.createDataFrame([], "a long, b long")
    label = long.select("k").distinct().select(F.col("k").alias("node"), F.col("k").alias("component"))
    pool = None
    for turn in range(ROUNDS):
        label = land(spark, label, "ngram-labels")
        labelled = land(spark, _labelled(long, label), "ngram-round")
        main = land(spark, _mains(labelled).where("comps > 1").select("g", "main"), "ngram-mains")
        luck = F.pmod(F.xxhash64(F.lit(turn), "k"), F.lit(1024)) / 1024
        partner = F.max_by(F.col("k"), F.struct(F.col("shared") * (1 + luck * SPREAD * min(turn, 1)), "k"))
        named = labelled.join(main, "g").where("comp = main").groupBy("g", "main").agg(partner.alias("j"))
        votes = labelled.join(land(spark, named, "ngram-partners"), "g").where("comp <> main").groupBy("k", "j").agg(F.sum("m").alias("v"))
        pairs = votes.groupBy("k").agg(F.max_by("j", F.struct("v", "j")).alias("j"))
        pairs = land(spark, pairs.select(F.least("k", "j").alias("a"), F.greatest("k", "j").alias("b")).distinct(), "ngram-named")
        asked = pairs.count()
        if asked and pool is None:
            pool = sets_of(spark, docs, label.select("node"), rare, n)
        found = verified(spark, filtered(spark, pairs, classes, percent), pool, percent) if asked else pairs
        links = links.union(found)
        ends = found.join(label.toDF("a", "ca"), "a").join(label.toDF("b", "cb"), "b").where("ca <> cb")
        hop = ends.groupBy(F.greatest("ca", "cb").alias("was")).agg(F.min(F.least("ca", "cb")).alias("is"))
        hop = land(spark, hop, "ngram-hops")
        for _ in range(2):  # what a component joined may itself have joined another
            moved = label.join(hop, label["component"] == hop["was"], "left")
            label = moved.select("node", F.coalesce("is", "component").alias("component"))
        discard(spark, labelled, main)
        if found.count() * FEW <= asked:
            break
    label = land(spark, label, "ngram-united")
    discard(spark, long, *([pool] if hasattr(pool, "landed_at") else []))
    return links, label


def _prefix(n: str, percent: int) -> Column:
    return F.col(n) - F.floor((F.col(n) * percent + 99) / 100) + 1


def _shared(percent: int) -> Column:
    """Positional filter over whole prefixes: ``c`` shared n-grams there, and
    beyond the prefix that ends first at most the rest of its set."""
    rest = F.greatest(F.col("na") - _prefix("na", percent), F.col("nb") - _prefix("nb", percent))
    return (F.col("c") + rest) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent


def _parity(x: str, y: str, total: Column, percent: int) -> Column:
    """Sets of ``total`` n-grams that reach the threshold differ in at most
    (1 - t) / (1 + t) of them, and their parity bitmaps in no more places."""
    apart = sum((F.bit_count(F.col(x + b).bitwiseXOR(F.col(y + b))) for b in BITS_OF), F.lit(0))
    return apart * (100 + percent) <= total * (100 - percent)


def filtered(spark: SparkSession, pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the length, parity and suffix filters. Landed."""
    fields = ("k", "n", "bins", *BITS_OF)
    one, two = (classes.select(*fields).toDF(*names) for names in (
        ("a", "na", "ba", *(f"a_{b}" for b in BITS_OF)), ("b", "nb", "bb", *(f"b_{b}" for b in BITS_OF))
    ))
    total = F.col("na") + F.col("nb")
    both = pairs.join(one, "a").join(two, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    least = F.aggregate(F.zip_with("ba", "bb", lambda u, v: F.least(u, v).cast("long")), F.lit(0).cast("long"), lambda t, v: t + v)
    near = both.where(_parity("a_", "b_", total, percent)).where(least * (100 + percent) >= total * percent)
    return land(spark, near.select("a", "b"), "ngram-pairs")


def sets_of(spark: SparkSession, docs: DataFrame, wanted: DataFrame, rare: np.ndarray, n: int) -> DataFrame:
    """(k, keys): the whole sets of the classes in ``wanted`` (any columns, all
    classes) and few others, by a pass that a fixed-size bitmap prunes. Landed."""
    bit = wanted.select(F.explode(F.array(*wanted.columns)).alias("k")).select(F.pmod("k", F.lit(BITS)).alias("bit"))
    words = bit.groupBy(F.shiftright("bit", 6).cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("v")
    ).toArrow()  # at most BITS / 64 rows
    bits = np.zeros(BITS // 64, np.int64)
    bits[words.column("w").to_numpy()] = words.column("v").to_numpy()
    let = bits.view(np.uint8)

    @released
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s = Sets(Shingles(part.column("text"), n), rare)
                bit = s.id & (BITS - 1)
                ok = (s.size > 0) & ((let[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0)
                yield pa.RecordBatch.from_arrays([pa.array(s.id[ok]), s.lists(s.size).filter(pa.array(ok))], names=["k", "keys"])

    kind = "k long, keys array<long>"
    if not let.any():
        return spark.createDataFrame([], kind)
    return land(spark, docs.select("text").mapInArrow(fetch, kind).dropDuplicates(["k"]), "ngram-sets")


def verified(spark: SparkSession, pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold on their whole sets. Landed."""
    shared = F.size(F.array_intersect("ka", "kb")).cast("long")
    both = pairs.join(full.toDF("a", "ka"), "a").join(full.toDF("b", "kb"), "b")
    union = (F.size("ka") + F.size("kb")).cast("long") - shared
    return land(spark, both.where(shared * 100 >= union * percent).select("a", "b"), "ngram-links")


def keep_one(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates: of each
    component one row stays, the first by doc_id (nulls last), then hash of the
    text; of rows with equal id and text any one. Rows without a set stay."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    rows = linked(spark, keyed, n, percent).where("comp is not null")
    keys = land(spark, rows.groupBy("comp", "doc_id", "t").agg(F.count(F.lit(1)).alias("m")), "ngram-keys")
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("i"), F.col("t").alias("h"))
    first = keys.groupBy("comp").agg(F.min(order).alias("first"), F.sum("m").alias("c")).where("c > 1").drop("c")
    both = keys.join(land(spark, first, "ngram-firsts"), "comp")
    stays = F.col("doc_id").eqNullSafe(F.col("first.i")) & (F.col("t") == F.col("first.h"))
    marked = land(spark, both.where(~stays | (F.col("m") > 1)).select("doc_id", "t", stays.alias("stays")), "ngram-dropped")

    a, b = fresh(docs, "dropped_id"), fresh(docs, "dropped_text")
    marks = marked.select(F.col("doc_id").alias(a), F.col("t").alias(b), "stays")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(a)) & (F.xxhash64("text") == F.col(b))
    out = docs.join(marks.drop("stays"), same, "left_anti")
    if marked.where("stays").isEmpty():
        return out
    # Rows that repeat the row that stays, as a whole: one of them.
    again = docs.join(marks.where("stays").drop("stays"), same, "left_semi")
    again = again.withColumns({a: F.col("doc_id").cast("long"), b: F.xxhash64("text")}).dropDuplicates([a, b])
    return out.unionByName(again.drop(a, b))
