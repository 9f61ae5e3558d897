"""Benchmark decontamination by template canonicalisation.

A text becomes a template: words are lower-cased (A-Z and Latin-1 letters),
lose ASCII punctuation at their ends, and numbers, names and units turn into
typed placeholders. A name is a capitalised word that starts no sentence; a
unit is one of ``UNITS``; a number starts with a digit and holds only digits,
points and commas. Words of nothing but punctuation vanish.

Windows of ``WIDTH`` template words (of all words, where an item has fewer) are
hashed and joined between benchmark and documents; at most half of a window may
be placeholders, and windows under ``LEAST`` words match by their exact words
only. A hit counts only if the slots
are consistent: wherever two slots of the item's window hold the same value,
so do the document's, and the other way round. A question asked again with
other numbers and names is so found, and told apart from a verbatim copy by
the slot values.

Whether a capitalised word that opens a sentence is a name cannot be told, and
an item's first word opens its text, but not the text it is copied into: a
window whose first word is one has two readings, as a plain word and as a
name, and matches by either. Besides, usable windows are matched by their
exact words; an item of which no window is usable in all its readings (over
half placeholders) is matched by the exact words of each of its windows.

Documents send only readings that a bitmap of the benchmark's lets
through; the bitmap has a fixed size (``BITS`` bits) at any benchmark size, and
what it lets through by chance dies in the join.

Nulls and ties: null texts and items have no windows, nor have those without a
word. Rows are known by doc_id and text, so
repeated rows, or rows with a null id, are judged by their own text. An empty
benchmark or table flags nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.common import fresh, land, released, slices
from tillscope.llm.textnum import hash_spans, LOWER, mix, SPACE, spans, text_bytes, U, window_starts, windows

WIDTH, LEAST = 13, 5
#: Bytes of text that a task reads at once (the readings take many times that).
SLICE = 1 << 19
#: Bits of the benchmark bitmap: 1 MB, whatever the benchmark's size.
BITS = 1 << 23

# Words taken as units.
UNITS = (
    "mm cm m km in ft yd mi mile miles meter meters metre metres kilometer kilometers inch inches foot feet yard yards "
    "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons "
    "ml cl l liter liters litre litres gallon gallons cup cups "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent degree degrees mph kmh watt watts volt volts"
).split()

PUNCT = np.zeros(256, bool)
PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
IN_NUMBER = DIGIT.copy()
IN_NUMBER[[44, 46]] = True
SENTENCE_END = np.zeros(256, bool)
SENTENCE_END[list(b".!?:")] = True
NUMBER, NAME, UNIT, EXACT = (mix(np.array([i], U))[0] for i in (101, 102, 103, 104))
#: Slot pattern of a window that is matched by its exact words.
WORDS = "="


def _unit_hashes() -> np.ndarray:
    buf, off = text_bytes(pa.array(UNITS, pa.string()))
    return np.sort(hash_spans(buf, off[:-1], off[1:]))


UNIT_HASHES = _unit_hashes()


def templates(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template word hashes, the words' own hashes, whether each is a slot, and
    each text's first word (n + 1 entries)."""
    return readings(texts)[:4]


def readings(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``templates``, and whether each word opens a sentence and would else be a name."""
    raw, off = text_bytes(texts)
    buf = LOWER[raw]
    upper2 = np.zeros(len(raw), bool)  # second byte of a Latin-1 capital
    upper2[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    buf = buf + upper2.astype(np.uint8) * 32
    starts, ends, first = spans(SPACE[buf], off)
    solid = ~PUNCT[buf]
    seen = np.concatenate([[0], np.cumsum(solid)])
    some = seen[ends] > seen[starts]
    # First and last byte that is not punctuation.
    at = np.flatnonzero(solid)
    core_s = at[np.minimum(seen[starts], max(len(at) - 1, 0))] if len(at) else starts
    core_e = at[seen[ends] - 1] + 1 if len(at) else ends
    before_end = np.zeros(len(starts), bool)
    if len(starts) > 1:
        before_end[1:] = SENTENCE_END[buf[ends[:-1] - 1]]
        breaks = np.concatenate([[0], np.cumsum(buf == 10)])
        before_end[1:] |= breaks[starts[1:]] > breaks[ends[:-1]]
    opening = before_end
    opening[first[:-1][np.diff(first) > 0]] = True
    # Words without a core vanish, but a sentence's end before them counts on.
    keep = np.flatnonzero(some)
    new_first = np.searchsorted(keep, first)
    s, e, opening = core_s[keep], core_e[keep], opening[keep]
    own = hash_spans(buf, s, e)
    digits = np.concatenate([[0], np.cumsum(IN_NUMBER[buf])])
    number = DIGIT[buf[s]] & (digits[e] - digits[s] == e - s) if len(s) else np.zeros(0, bool)
    capital = (raw >= 65) & (raw <= 90) | upper2
    caps = np.concatenate([[0], np.cumsum(capital)])
    two = raw[s] == 0xC3 if len(s) else np.zeros(0, bool)
    head = s + 1 + two
    capitalised = (caps[np.minimum(head, e)] > caps[s]) & (caps[e] == caps[np.minimum(head, e)]) & (e > head)
    name = ~opening & capitalised
    unit = UNIT_HASHES[np.minimum(np.searchsorted(UNIT_HASHES, own), len(UNIT_HASHES) - 1)] == own
    word = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, own)))
    return word, own, number | name | unit, new_first, opening & capitalised & ~number & ~unit


def pattern(values: np.ndarray) -> str:
    """Which slots hold equal values: each slot's first equal slot."""
    first: dict[int, int] = {}
    return ",".join(str(first.setdefault(v, i)) for i, v in enumerate(values.tolist()))


def template_windows(texts: pa.Array, widths: list[int] | None, let: np.ndarray | None = None):
    """(text, width, hash, slot pattern, value hash, plain hash) of each reading
    of each window that ``let`` (a bitmap) lets through; the plain hash names
    the window in all its readings. ``widths`` None: the windows of items, one
    width per text, ``WIDTH`` or all its words."""
    word, own, slot, first, either = readings(texts)
    count = np.concatenate([[0], np.cumsum(slot)])
    n = np.diff(first)

    def through(h: np.ndarray) -> np.ndarray:
        bit = h & U(BITS - 1)
        return (let[(bit >> U(3)).astype(np.int64)] >> (bit & U(7)).astype(np.uint8)) & 1 > 0 if let is not None else np.ones(len(h), bool)

    for w in widths if widths is not None else sorted({min(int(k), WIDTH) for k in set(n.tolist()) if k}):
        h = mix(windows(word, w) + U(w))
        values = windows(own, w)
        at, per = window_starts(first, w)
        text = np.repeat(np.arange(len(n)), per)
        if widths is None:
            mine = np.minimum(n, WIDTH)[text] == w
            at, text = at[mine], text[mine]
        if not len(at):
            continue
        slots = count[at + w] - count[at]
        two = either[at]
        plain, named = (2 * slots <= w) & (w >= LEAST), two & (2 * (slots + 1) <= w) & (w >= LEAST)
        if widths is None:
            usable = plain & (named | ~two)
            none = np.bincount(text, usable, len(n)) == 0
            exact = usable | none[text]
        else:
            exact = np.ones(len(at), bool)
        same = mix(values[at] + U(w) + EXACT)
        for i in np.flatnonzero(plain & through(h[at])).tolist():
            a = at[i]
            inside = own[a : a + w][slot[a : a + w]]
            yield _reading(text[i], w, h[a], pattern(inside) if len(inside) else "", values[a], h[a])
        some = np.flatnonzero(named)
        if len(some):
            seq = word[at[some][:, None] + np.arange(w)]
            seq[:, 0] = NAME
            alt = mix(windows(seq.ravel(), w)[::w] + U(w))
            for i, x in zip(some[through(alt)].tolist(), alt[through(alt)], strict=True):
                a = at[i]
                held = slot[a : a + w].copy()
                held[0] = True
                yield _reading(text[i], w, x, pattern(own[a : a + w][held]), values[a], h[a])
        for i in np.flatnonzero(exact & through(same)).tolist():
            yield _reading(text[i], w, same[i], WORDS, values[at[i]], h[at[i]])


def _reading(text, w: int, h, slots: str, values, plain) -> tuple[int, int, int, str, int, int]:
    return int(text), w, int(h.astype(np.int64)), slots, int(values.astype(np.int64)), int(plain.astype(np.int64))


def benchmark_windows(spark: SparkSession, benchmark: DataFrame) -> DataFrame:
    """(h, item_id, w, slots, val, plain) of every reading of every window of
    every item, landed."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids = part.column("item_id").to_pylist()
                rows = [(h, ids[i], w, p, v, b) for i, w, h, p, v, b in template_windows(part.column("text"), None)]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
                yield _batch(rows, ["h", "item_id", "w", "slots", "val", "plain"], kinds)

    rows = benchmark.selectExpr("cast(item_id as long) item_id", "text")
    out = rows.mapInArrow(run, "h long, item_id long, w int, slots string, val long, plain long").distinct()
    return land(spark, out, "benchmark-windows")


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def bitmap(bench: DataFrame) -> np.ndarray:
    """One bit per hash value modulo ``BITS``; at most BITS / 64 rows reach the driver."""
    bit = F.pmod("h", F.lit(BITS))
    words = bench.groupBy(F.shiftright(bit, 6).cast("int").alias("k")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, 64) as int))")).alias("v")
    )
    out = np.zeros(BITS // 64, np.int64)
    for k, v in words.collect():
        out[k] = v
    return out.view(np.uint8)


def hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, h, exact): windows (by their plain hash)
    that a document shares with an item in some reading."""
    bench = benchmark_windows(spark, benchmark)
    widths = sorted(r[0] for r in bench.select("w").distinct().collect())  # 1..WIDTH
    let = bitmap(bench)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, keys = part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist()
                found = dict.fromkeys((i, h, p, v) for i, _, h, p, v, _ in template_windows(part.column("text"), widths, let))
                rows = [(ids[i], keys[i], h, p, v) for i, h, p, v in found]
                yield _batch(rows, ["doc_id", "text_hash", "h", "slots", "val"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    sent = rows.mapInArrow(run, "doc_id long, text_hash long, h long, slots string, val long")
    item = bench.select("h", "item_id", "slots", "plain", F.col("val").alias("item_val"))
    return sent.join(item, ["h", "slots"]).select(
        "doc_id", "text_hash", "item_id", F.col("plain").alias("h"), (F.col("val") == F.col("item_val")).alias("exact")
    )


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_items, n_windows, n_exact) of contaminated documents."""
    per_window = hits(spark, docs, benchmark).groupBy("doc_id", "text_hash", "item_id").agg(
        F.count_distinct("h").alias("w"), F.count_distinct(F.when(F.col("exact"), F.col("h"))).alias("x")
    )
    return per_window.groupBy("doc_id", "text_hash").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("w").alias("n_windows"), F.sum("x").alias("n_exact")
    )


def decontamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, n_windows, n_exact of every row of ``docs``."""
    found = contaminated(spark, docs, benchmark).withColumnsRenamed({"doc_id": "found_id", "text_hash": "found_hash"})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_hash") == F.col("found_hash"))
    zero = F.lit(0).cast("long")
    return rows.join(found, same, "left").select(
        "doc_id", F.col("found_hash").isNotNull().alias("contaminated"),
        *(F.coalesce(c, zero).alias(c) for c in ("n_items", "n_windows", "n_exact")),
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that share no window with the benchmark."""
    a, b = fresh(docs, "found_id"), fresh(docs, "found_hash")
    found = contaminated(spark, docs, benchmark).select(F.col("doc_id").alias(a), F.col("text_hash").alias(b))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(a)) & (F.xxhash64("text") == F.col(b))
    return docs.join(found, same, "left_anti")
