"""Target-distribution importance resampling over hashed n-gram buckets.

Words and pairs of adjacent words are features; a feature's bucket is the
CRC-32 of its bytes modulo ``BUCKETS``. A bucket gains by the ratio of its
smoothed shares in the target texts and in all documents; a document weighs
the mean gain of its features, and a Gumbel draw by doc_id turns weights into a
sample without replacement.

Buckets of features come from a head-tail vocabulary:

* Head: every task passes over its rows and sends on the words and pairs that
  make up at least the share ``HEAD`` of a stretch of about ``HELD`` words (one
  with that share of the whole has it in some stretch); of their summed counts
  the ``KEPT`` largest are broadcast, words with the CRC state after their bytes
  and pairs with their bucket. A word is looked
  up by hash and taken only if its bytes are equal, a pair by its words' places,
  so a lookup is exact.
* Tail: all other features take their CRC directly, byte by byte for many words
  at once; a pair goes on from the state of its first word.

Either way gives the same bucket, so the head only saves work: bucket totals
are sums over all features of all rows. Ranks come from a range-partitioned
sort and the sizes of its parts; no task holds more than a part of one.

Nulls and ties: a null, empty or wordless text has no features, weight 0, and
is drawn by its number of words like any other. Equal scores go by doc_id,
null ids last; rows with equal ids are told apart at will (they have equal
draws). A null doc_id draws by the text ``7:null``. Repeated rows count each.
Empty targets give each bucket the gain of an unseen one. An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillscope.llm.common import discard, land, slices
from tillscope.llm.textnum import hash_spans, LOWER, M1, spans, text_bytes, U

#: Buckets, least words of a drawn document, percent drawn, and the seed.
BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Share of a task's features that makes a head candidate, and head sizes.
HEAD, KEPT = 2e-5, 1 << 15
#: Longest head word in bytes; features that a task holds while it looks for them.
WIDE, HELD = 32, 1 << 20

SEPARATOR = np.ones(256, bool)
SEPARATOR[48:58] = False
SEPARATOR[97:123] = False
SEPARATOR[128:] = False

#: CRC-32 by bytes: the register after each byte value (the polynomial is fixed).
TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    TABLE = np.where(TABLE & 1, (TABLE >> 1) ^ np.uint32(0xEDB88320), TABLE >> 1)
ONES = np.uint32(0xFFFFFFFF)


def step(state: np.ndarray, byte) -> np.ndarray:
    return TABLE[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def extend(state: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes of each span, many spans a step; the few
    long ones one by one."""
    state, length = state.copy(), end - start
    for i in np.flatnonzero(length > 64):
        state[i] = zlib.crc32(buf[start[i] : end[i]], int(state[i] ^ ONES)) ^ 0xFFFFFFFF
    live = np.flatnonzero(length <= 64)
    j = 0
    while len(live := live[length[live] > j]):
        state[live] = step(state[live], buf[start[live] + j].astype(np.uint32))
        j += 1
    return state


def bucket(state: np.ndarray) -> np.ndarray:
    return ((state ^ ONES) % np.uint32(BUCKETS)).astype(np.int64)


def after_space(state: np.ndarray) -> np.ndarray:
    return step(state, np.uint32(32))


class Words:
    """Words of many texts: byte spans, hashes, and which words open a pair."""

    def __init__(self, texts: pa.Array):
        buf, off = text_bytes(texts)
        self.buf = LOWER[buf]
        self.start, self.end, self.first = spans(SEPARATOR[self.buf], off)
        self.many = np.diff(self.first)
        self.h = hash_spans(self.buf, self.start, self.end)
        last = np.zeros(len(self.h), bool)
        last[self.first[1:][self.many > 0] - 1] = True
        self.opens = np.flatnonzero(~last)
        self.owner = np.repeat(np.arange(len(self.many)), self.many)

    def text(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


class Head:
    """Broadcast part of the vocabulary: words by hash with their bytes and CRC
    registers, pairs by their words' places with their buckets."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]]):
        buf = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum([len(w) for w in words], dtype=np.int64)
        start = end - np.array([len(w) for w in words], np.int64)
        h = hash_spans(buf, start, end) if words else np.zeros(0, U)
        order = np.argsort(h, kind="stable")
        order = order[np.diff(h[order], prepend=U(0)) != 0] if len(order) else order
        self.h, self.length = h[order], (end - start)[order]
        self.bytes = np.zeros((len(order), WIDE), np.uint8)
        for i, o in enumerate(order):
            self.bytes[i, : end[o] - start[o]] = buf[start[o] : end[o]]
        self.state = extend(np.full(len(words), ONES), buf, start, end)[order]
        place = {words[o]: i for i, o in enumerate(order)}
        known = [(place[a], place[b], zlib.crc32(a + b" " + b) % BUCKETS) for a, b in pairs if a in place and b in place]
        code = np.array([a * len(order) + b for a, b, _ in known], np.int64)
        order = np.argsort(code)
        self.code, self.bucket = code[order], np.array([v for *_, v in known], np.int64)[order]

    def find(self, w: Words) -> np.ndarray:
        """Places of the words, -1 in the tail."""
        if not len(self.h) or not len(w.h):
            return np.full(len(w.h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.h, w.h), len(self.h) - 1)
        length = w.end - w.start
        hit = np.flatnonzero((self.h[at] == w.h) & (self.length[at] == length))
        same = np.ones(len(hit), bool)
        for j in range(int(length[hit].max(initial=0))):
            live = np.flatnonzero(length[hit] > j)
            same[live] &= w.buf[w.start[hit[live]] + j] == self.bytes[at[hit[live]], j]
        out = np.full(len(w.h), -1, np.int64)
        out[hit[same]] = at[hit[same]]
        return out


def buckets_of(w: Words, head: Head) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word, and of every pair by its first word (``w.opens``)."""
    place = head.find(w)
    known = place >= 0
    state = np.full(len(w.h), ONES)
    state[known] = head.state[place[known]]
    tail = np.flatnonzero(~known)
    state[tail] = extend(state[tail], w.buf, w.start[tail], w.end[tail])
    a, b = w.opens, w.opens + 1
    out = np.full(len(a), -1, np.int64)
    both = np.flatnonzero(known[a] & known[b])
    if len(both) and len(head.code):
        code = place[a[both]] * len(head.h) + place[b[both]]
        at = np.minimum(np.searchsorted(head.code, code), len(head.code) - 1)
        hit = head.code[at] == code
        out[both[hit]] = head.bucket[at[hit]]
    tail = np.flatnonzero(out < 0)
    out[tail] = bucket(extend(after_space(state[a[tail]]), w.buf, w.start[b[tail]], w.end[b[tail]]))
    return bucket(state), out


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in batches:
        for part in slices(batch, "text"):
            yield part, Words(part.column("text"))


def head_of(docs: DataFrame) -> Head:
    """The head vocabulary of all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Words] = []
        size = 0
        for _, w in _words(batches):
            held.append(w)
            size += len(w.h)
            if size >= HELD:
                yield _frequent(held, size)
                held, size = [], 0
        if size:
            yield _frequent(held, size)

    counted = docs.select("text").mapInArrow(count, "a binary, b binary, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    counted = land(docs.sparkSession, counted, "head-counts")
    top = lambda kind: counted.where(kind).orderBy(F.desc("n"), "a", "b").limit(KEPT).collect()  # noqa: E731  at most KEPT rows
    words = [bytes(r["a"]) for r in top(F.col("b").isNull())]
    pairs = [(bytes(r["a"]), bytes(r["b"])) for r in top(F.col("b").isNotNull())]
    discard(docs.sparkSession, counted)
    return Head(words, pairs)


def _frequent(held: list[Words], size: int) -> pa.RecordBatch:
    """Words and pairs that make up the share ``HEAD`` of what is held."""
    rows = []
    cut = np.cumsum([0, *(len(w.h) for w in held)])
    h = np.concatenate([w.h for w in held])
    opens = np.concatenate([w.opens + c for w, c in zip(held, cut[:-1], strict=True)])
    pair = h[opens] * M1 ^ h[np.minimum(opens + 1, len(h) - 1)]
    for key, two in ((h, False), (pair, True)):
        _, at, n = np.unique(key, return_index=True, return_counts=True)
        often = n >= max(2, HEAD * size)
        for i, c in zip(opens[at[often]] if two else at[often], n[often].tolist(), strict=True):
            k = int(np.searchsorted(cut, i, "right")) - 1
            a, b = held[k].text(i - cut[k]), held[k].text(i - cut[k] + 1) if two else None
            if len(a) <= WIDE and len(b or b"") <= WIDE:
                rows.append((a, b, c))
    cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    kinds = [pa.binary(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["a", "b", "n"])


def totals(rows: DataFrame, head: Head) -> np.ndarray:
    """Features in each bucket, over all texts of ``rows``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for _, w in _words(batches):
            for b in buckets_of(w, head):
                sums += np.bincount(b, minlength=BUCKETS)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[some])], names=["b", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for b, n in rows.select("text").mapInArrow(count, "b int, n long").groupBy("b").agg(F.sum("n")).collect():  # at most BUCKETS rows
        out[b] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / source share)) of every bucket, in doubles."""
    s, t = int(source.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log(float(b + 1) * float(s + BUCKETS) / (float(a + 1) * float(t + BUCKETS))))
            for a, b in zip(source.tolist(), target.tolist())
        ],
        np.int64,
    )


def draw(doc_id: int | None) -> int:
    """floor(1000 times a Gumbel number that the id fixes)."""
    h = int(hashlib.sha256(f"{SEED}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, head: Head, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, w in _words(batches):
            one, two = buckets_of(w, head)
            sums = np.zeros(len(w.many) + 1, np.int64)
            np.add.at(sums, w.owner, gain[one])
            np.add.at(sums, w.owner[w.opens], gain[two])
            n = w.many + np.maximum(w.many - 1, 0)
            weight = sums[:-1] // np.maximum(n, 1)
            ids = part.column("doc_id")
            score = weight + np.array([draw(i) for i in ids.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (w.many, n, weight, score))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    kind = "doc_id long, n_words long, n_features long, weight long, score long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; rank is
    null unless the row is among the ``percent`` percent drawn."""
    head = head_of(docs)
    gain = gains(totals(docs, head), totals(target, head))
    scored = land(spark, weighed(docs, head, gain), "resampling-scores")

    able = F.col("n_words") >= LEAST_WORDS
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    placed = scored.where(able).withColumn("row", F.monotonically_increasing_id())
    placed = land(spark, placed, "resampling-rows")  # rows numbered once: ties in order fall where they lie
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = land(spark, placed.drop("row", "n_words"), "resampling-order")
    part = F.shiftright("at", 33)
    size = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row for each part of the sort
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    size = size.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = placed.join(F.broadcast(size), part == F.col("part"))
    drawn = ranked.withColumn("rank", F.when(rank <= F.expr(f"all * {percent} div 100"), rank))
    names = ["doc_id", "n_features", "weight", "score"]
    return drawn.select(*names, "rank").unionByName(scored.where(~able).select(*names, F.lit(None).cast("long").alias("rank")))
