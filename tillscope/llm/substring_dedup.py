"""Removal of repeated passages by recompression.

Words are symbols. Rounds name what occurs more than once anywhere, globally,
by a Spark aggregate over all texts:

* round 0 names runs (a word and how often it follows itself);
* each later round names pairs of adjacent symbols, a left one before a right
  one, sides drawn by a hash of the name, so that equal substrings are cut up
  alike. A name is a hash of what it stands for; the round settles which names
  are alive, that is occur twice or more. Pairs with a dead part are dead and
  not even sent.

Every symbol knows the words that it depends on: its own, and the neighbours
that decided where it ends. Where all of them lie in a window, each place with
an equal window has the same symbol inside. So a window with a dead symbol
inside is unique, and after a few rounds next to none but repeated ones are
left. These are verified: their 128-bit hashes are counted exactly, and words
covered by a window that occurs twice or more are removed. All decisions are
made on the input, not on what is left.

Between rounds the live names travel as a bitmap of fixed size (``BITS``): a
name that it lets through by chance leaves a window in for verification, no
more. Texts lie in blocks, written once. A block asks the buckets of the hash
space for its different symbols or windows in packed, sorted lists and knows
them again by their order, so no window is sent with its place, a frequent
passage costs one entry a block, and the answer to a window is one bit.

Nulls and ties: words are runs of bytes other than space and 0x09-0x0D; null
and empty texts have none and nothing is removed; texts shorter than a window
lose nothing. All occurrences go, the first too. Rows are told apart by place,
so null and repeated ids and equal texts are rows of their own (and copies of
each other). An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.common import land, released, slices
from tillscope.llm.suffix_tree import pack, pack_keys, unpack, unpack_keys
from tillscope.llm.textnum import hash_spans, join_hash, M1, mix, SPACE, spans, text_bytes, U, window_starts, windows

WIDTH = 35
#: Rounds that name pairs, after the one that names runs.
ROUNDS = 2
#: Bits of the bitmap of live names, bytes of text in a block and (about) of
#: text in a bucket, and the fewest buckets.
BITS, BLOCK, BUCKET, FEWEST = 1 << 26, 1 << 22, 1 << 24, 64
FAR = 1 << 60

ROW = "bucket int, kind int, block long, h binary, more binary, n binary"
SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("h", "more", "n"))])


class Words:
    """Words of many texts: byte spans, names, each text's first word."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off = buf, off
        self.starts, self.ends, self.first = spans(SPACE[buf], off)
        self.name = hash_spans(buf, self.starts, self.ends)
        self.n = np.diff(self.first)


class Symbols:
    """The symbols of one level: names, the range of words [low, high) that each
    depends on (beyond its text, where it touches the text's edge), and whether
    this round made it (``new``) of parts that are all alive."""

    def __init__(self, w: Words):
        name = w.name
        owner = np.repeat(np.arange(len(w.n)), w.n)
        head = np.ones(len(name), bool)
        head[1:] = (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])
        start = np.flatnonzero(head)
        end = np.append(start[1:], len(name)) if len(start) else start
        self.owner = owner[start]
        self.name = mix(name[start] + mix((end - start).astype(U) * M1))
        self.low = np.where(start == w.first[self.owner], -FAR, start - 1)
        self.high = np.where(end == w.first[self.owner + 1], FAR, end + 1)
        self.alive = np.ones(len(start), bool)
        self.new = np.ones(len(start), bool)

    def settle(self, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take over which new symbols are alive; ranges of the dead ones."""
        found = self.new & self.alive
        self.alive[found] = is_live(live, self.name[found])
        dead = found & ~self.alive
        return self.low[dead], self.high[dead]

    def pair(self, salt: int) -> None:
        """The next level: each left symbol before a right one takes it up."""
        left = (mix(self.name + U(31 + salt)) & U(1)).astype(bool)
        same = self.owner[:-1] == self.owner[1:]
        at = np.flatnonzero(left[:-1] & ~left[1:] & same)
        # A symbol that stays single depends on both neighbours.
        low, high = self.low.copy(), self.high.copy()
        low[1:] = np.where(same, np.minimum(self.low[1:], self.low[:-1]), self.low[1:])
        high[:-1] = np.where(same, np.maximum(self.high[:-1], self.high[1:]), self.high[:-1])
        low[at], high[at] = np.minimum(self.low[at], self.low[at + 1]), np.maximum(self.high[at], self.high[at + 1])
        name, alive, new = self.name.copy(), self.alive.copy(), np.zeros(len(self.name), bool)
        name[at] = mix(join_hash(self.name[at], self.name[at + 1]) + U(41 + salt))
        alive[at] &= self.alive[at + 1]
        new[at] = True
        keep = np.ones(len(name), bool)
        keep[at + 1] = False
        self.name, self.low, self.high, self.alive, self.new, self.owner = (
            a[keep] for a in (name, low, high, alive, new, self.owner)
        )


def is_live(live: np.ndarray, name: np.ndarray) -> np.ndarray:
    bit = name >> U(64 - BITS.bit_length() + 1)
    return (live[(bit >> U(3)).astype(np.int64)] >> (bit & U(7)).astype(np.uint8)) & 1 > 0


def levels(w: Words, live: list[np.ndarray]) -> Iterator[tuple[Symbols, np.ndarray, np.ndarray]]:
    """The symbols after each round of which the live names are known, and the
    ranges of those that died; then the next level's, not settled yet."""
    s, none = Symbols(w), np.zeros(0, np.int64)
    for r, names in enumerate(live):
        yield s, *s.settle(names)
        s.pair(r)
    yield s, none, none


def windows_left(w: Words, live: list[np.ndarray], width: int) -> np.ndarray:
    """Starts of the windows without a dead symbol inside."""
    at, _ = window_starts(w.first, width)
    step = np.zeros(len(w.name) + 2, np.int64)
    for _, low, high in levels(w, live):
        inside = (high - low <= width) & (high < FAR) & (low > -FAR)
        step += np.bincount(np.maximum(high[inside] - width, 0), minlength=len(step))
        step -= np.bincount(low[inside] + 1, minlength=len(step))
    return at[np.cumsum(step)[at] == 0]


def _runs(lo: np.ndarray, hi: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in one of the ranges [lo, hi)."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, lo, 1)
    np.add.at(step, hi, -1)
    return np.cumsum(step)[:-1] > 0


def _edges(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of the buckets in sorted hashes; buckets cut the hash space and
    the bitmap alike."""
    return np.searchsorted(h, (np.arange(1, buckets, dtype=U) << U(64 - buckets.bit_length() + 1)))


def _lists(h: np.ndarray, more: np.ndarray | None, n: np.ndarray, buckets: int, block: int) -> pa.RecordBatch:
    """Sorted hashes (``more``: their second halves) and counts, by bucket."""
    cut = np.concatenate([[0], _edges(h, buckets), [len(h)]])
    rows = [
        (int(b), 1, block, pack_keys(h[i:j]), None if more is None else pack(more[i:j]), pack(n[i:j]))
        for b, i, j in zip(range(buckets), cut[:-1], cut[1:], strict=True) if j > i
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, SCHEMA, strict=True)], schema=SCHEMA)


def blocks_of(docs: DataFrame) -> DataFrame:
    """Whole texts in compressed blocks of ``BLOCK`` bytes or one text."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                buf, off = text_bytes(part.column("text"))
                ids = part.column("doc_id")
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                names = np.concatenate([ids.fill_null(0).to_numpy(zero_copy_only=False), known.astype(np.int64)])
                text = zstandard.ZstdCompressor(level=3).compress(buf.tobytes())
                row = [[0], [0], [number], [text], [pack(names)], [pack(np.diff(off))]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, SCHEMA, strict=True)], schema=SCHEMA)
                number += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ROW)


def opened(row: dict) -> tuple[Words, pa.Array]:
    """The words of a block's texts, and the texts' doc_ids."""
    off = np.concatenate([[0], np.cumsum(unpack(row["n"], np.int64))])
    ids, known = np.split(unpack(row["more"], np.int64), 2)
    buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["h"]), np.uint8)
    return Words(buf, off), pa.array(ids, mask=known == 0)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def named(spark: SparkSession, blocks: DataFrame, live: list[np.ndarray], buckets: int) -> np.ndarray:
    """One round: the names of the next level's new symbols are counted over
    all blocks; the bitmap of those that occur twice or more."""

    @released
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            *_, (s, _, _) = levels(opened(row)[0], live)
            h, n = np.unique(s.name[s.new & s.alive], return_counts=True)
            yield _lists(h, None, np.minimum(n, 2).astype(np.uint8), buckets, row["block"])

    share = BITS // 8 // buckets

    def count(group: pa.Table) -> pa.Table:
        h = np.concatenate([unpack_keys(x.as_py()) for x in group["h"]])
        n = np.concatenate([unpack(x.as_py(), np.uint8) for x in group["n"]])
        h, back = np.unique(h, return_inverse=True)
        h = h[np.bincount(back, n) > 1]
        bucket = group["bucket"][0].as_py()
        bits = np.zeros(share * 8, bool)
        bits[((h >> U(64 - BITS.bit_length() + 1)) - U(bucket * share * 8)).astype(np.int64)] = True
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "bits": pa.array([zstandard.compress(np.packbits(bits, bitorder="little").tobytes())])})

    out = np.zeros(BITS // 8, np.uint8)
    found = blocks.mapInArrow(send, ROW).groupBy("bucket").applyInArrow(count, "bucket int, bits binary")
    for bucket, bits in found.collect():  # BITS bits in all
        out[bucket * share : (bucket + 1) * share] = np.frombuffer(zstandard.decompress(bits), np.uint8)
    return out


def _asked(w: Words, live: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows to verify, their different hashes in order (two
    halves), counts, and each start's place among them."""
    at = windows_left(w, live, width)
    h = windows(w.name, width)[at] if len(at) else np.zeros(0, U)
    more = windows(mix(w.name ^ U(0x5851F42D4C957F2D)), width)[at] if len(at) else h
    order = np.lexsort((more, h))
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(h[order]) != 0) | (np.diff(more[order]) != 0)
    place = np.empty(len(at), np.int64)
    place[order] = np.cumsum(new) - 1
    return at, h[order][new], more[order][new], np.bincount(place, minlength=int(new.sum())), place


def substring_dedup(spark: SparkSession, docs: DataFrame, width: int = WIDTH, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs``: words
    covered by a window that starts anywhere else too are removed, what is
    left is joined by one space; ``texts`` adds it as ``kept``."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(max(FEWEST, 1 << (size // BUCKET).bit_length()), BITS // 8)
    blocks = land(spark, blocks_of(docs), "text-blocks")
    live: list[np.ndarray] = []
    for _ in range(ROUNDS + 1):
        live.append(named(spark, blocks, live, buckets))

    @released
    def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            _, h, more, n, _ = _asked(opened(row)[0], live, width)
            yield _lists(h, more, np.minimum(n, 2).astype(np.uint8), buckets, row["block"])

    def answer(group: pa.Table) -> pa.Table:
        h = [unpack_keys(x.as_py()) for x in group["h"]]
        cut = np.cumsum([len(x) for x in h])[:-1]
        h = np.concatenate(h)
        more = np.concatenate([unpack(x.as_py(), U) for x in group["more"]])
        n = np.concatenate([unpack(x.as_py(), np.uint8) for x in group["n"]])
        order = np.lexsort((more, h))
        new = np.ones(len(h), bool)
        new[1:] = (np.diff(h[order]) != 0) | (np.diff(more[order]) != 0)
        which = np.cumsum(new) - 1
        twice = np.empty(len(h), bool)
        twice[order] = (np.bincount(which, n[order]) > 1)[which]
        bits = [pack(np.packbits(x)) for x in np.split(twice, cut)]
        none = pa.nulls(len(bits), pa.binary())
        long = pa.array([len(x).to_bytes(8, "little") for x in np.split(twice, cut)], pa.binary())
        cols = [group["bucket"].combine_chunks(), group["kind"].combine_chunks(), group["block"].combine_chunks(), pa.array(bits, pa.binary()), none, long]
        return pa.Table.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols], schema=SCHEMA)

    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts

    def cut(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["kind"], r["bucket"]))
        w, ids = opened(rows[0])
        at, _, _, _, place = _asked(w, live, width)
        parts = [np.unpackbits(unpack(r["h"], np.uint8), count=int.from_bytes(r["n"], "little")) for r in rows[1:]]
        twice = np.concatenate([np.zeros(0, np.uint8), *parts]).astype(bool)
        at = at[twice[place]]
        gone = _runs(at, at + width, len(w.name))
        removed, digest, kept = [], [], []
        for i in range(len(w.n)):
            words = w.buf[w.off[i] : w.off[i + 1]].tobytes().split()
            out = gone[w.first[i] : w.first[i + 1]]
            removed.append(int(out.sum()))
            if removed[-1]:
                words = [words[j] for j in np.flatnonzero(~out)]
            rest = b" ".join(words)
            digest.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode() if texts else None)
        cols = {"doc_id": ids, "n_words": pa.array(w.n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        return pa.table(cols | ({"kept": pa.array(kept, pa.string())} if texts else {}))

    answers = blocks.mapInArrow(request, ROW).groupBy("bucket").applyInArrow(answer, ROW)
    return blocks.unionByName(answers).groupBy("block").applyInArrow(cut, kind)
