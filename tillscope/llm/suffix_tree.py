"""Language-model scores by a probabilistic suffix tree over words.

Learning, over every row outside the held-out fold:

1. Words (and one end a text) are counted: the root distribution
   ``(c + 0.1) / (N + 0.1 (V + 1))``.
2. Level by level, the contexts of k words that make up at least the share
   ``support`` of all tokens (the tree's usual floor; so at most 1 / support a
   level) are tried: their next words are counted, whatever those are. A
   context is tried where the one without its oldest word is a state.
3. Next-word distributions are smoothed by absolute discounting: words seen
   twice or more keep their count less ``DISCOUNT``, the rest goes to the
   distribution of the context without its oldest word.
4. Divergence test: a context becomes a state if its own distribution, with
   each occurrence left out of the counts in turn, tells the next words apart
   from its parent's by more than ``nats`` in all.

Scoring, over every row: each token takes the longest state that ends the words
before it; a word without an entry there falls back to shorter states by the
weights of step 3.

What grows with the corpus (words, next words) never is in one place. A word's
hash names its bucket; tasks count whole slices and send one packed list a
bucket, sorted and compressed, and all levels of a bucket lie together. Texts
are scored in blocks: a block asks each bucket once for its different words and
pairs, and the answers come back in the order asked. The driver and each task
hold the states only (at most depth / support), and sums.

Nulls and ties: a null or empty text is its end alone. A null doc_id counts as
held out. Repeated rows are learned from and scored each. Without any training
row the model is the root alone. Words are known by 64-bit hashes. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.common import discard, land, slices
from tillscope.llm.textnum import hash_spans, join_hash, LOWER, SPACE, spans, text_bytes, U

#: Words in the longest context, least share of all tokens, least divergence.
DEPTH, SUPPORT, NATS = 3, 2e-5, 10.0
#: Additive count of the root, discount, and least count of an entry.
ADD, DISCOUNT, LEAST = 0.1, 0.75, 2
#: Hash of the end of a text.
END = U(0x5851F42D4C957F2D)
#: Tokens (or different words) that a task holds before it sends them on, and
#: bytes of text in a block and (about) in a bucket.
HELD, BLOCK, BUCKET = 1 << 21, 1 << 23, 1 << 25
FEWEST = 64

ROW = "bucket int, kind int, block long, words binary, counts binary, ctx binary, value binary"
NAMES = ["bucket", "kind", "block", "words", "counts", "ctx", "value"]


def pack(a: np.ndarray) -> bytes:
    """Byte planes, compressed: high planes of small numbers cost nothing."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind)


def pack_keys(x: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return pack(np.diff(x, prepend=U(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, U), dtype=U)


class Tokens:
    """Word hashes of many texts end to end, each closed by END."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        buf = LOWER[buf]
        starts, ends, first = spans(SPACE[buf], off)
        n = len(off) - 1
        self.first = first + np.arange(n + 1)
        self.h = np.full(len(starts) + n, END)
        owner = np.repeat(np.arange(n), np.diff(first))
        self.h[np.arange(len(starts)) + owner] = hash_spans(buf, starts, ends)
        #: Tokens left in the text from each token on, itself included.
        self.left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.h))

    def sequences(self, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, starts, hashes) of the runs of k words that a token follows."""
        s = self.h
        for k in range(1, depth + 1):
            if k > 1:
                s = join_hash(s[:-1], self.h[k - 1 :])
            yield k, np.flatnonzero(self.left[: len(s)] > k), s


class States:
    """Contexts tried so far; a context's number is its place in the lists."""

    def __init__(self):
        self.key, self.n, self.parent, self.words = [], [], [], {}
        self.rest: list[float] = []
        self.kept: list[bool] = []
        self.level: list[tuple[int, int]] = [(0, 0)]  # numbers of each level

    def add(self, found: list[tuple[int, int, int]], depth: int) -> None:
        """(context or -1, next word, count) become contexts of ``depth`` words,
        where the context without its oldest word is a state."""
        start = len(self.key)
        names = list(self.words)
        for ctx, x, n in sorted(found):
            name = (*(names[ctx] if ctx >= 0 else ()), x)
            parent = self.words.get(name[1:], -1)
            if depth == 1 or (parent >= 0 and self.kept[parent]):
                with np.errstate(over="ignore"):
                    key = U(x) if ctx < 0 else join_hash(np.array([self.key[ctx]], U), np.array([x], U))[0]
                self.words[name] = len(self.key)
                self.key.append(int(key))
                self.n.append(n)
                self.parent.append(parent)
                self.rest.append(0.0)
                self.kept.append(False)
        self.level.append((start, len(self.key)))

    def finder(self, depth: int, kept: bool) -> Callable[[np.ndarray], np.ndarray]:
        """Hashes of ``depth`` words to context numbers, -1 if there is none."""
        start, end = self.level[depth] if depth < len(self.level) else (0, 0)
        number = np.array([i for i in range(start, end) if self.kept[i] or not kept], np.int64)
        key = np.array([self.key[i] for i in number], U)
        order = np.argsort(key)
        key, number = key[order], number[order]
        may = np.zeros(1 << 20, bool)
        may[(key >> U(44)).astype(np.int64)] = True

        def find(s: np.ndarray) -> np.ndarray:
            out = np.full(len(s), -1, np.int64)
            some = np.flatnonzero(may[(s >> U(44)).astype(np.int64)])
            if len(some) and len(key):
                at = np.minimum(np.searchsorted(key, s[some]), len(key) - 1)
                hit = key[at] == s[some]
                out[some[hit]] = number[at[hit]]
            return out

        return find


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=NAMES)


def _cut(x: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of each bucket in sorted keys."""
    of = ((x >> U(32)) * U(buckets)) >> U(32)
    return np.searchsorted(of, np.arange(buckets + 1, dtype=U))


def _lists(x: np.ndarray, code: np.ndarray, value: np.ndarray | None, buckets: int, block: int = 0) -> Iterator[pa.RecordBatch]:
    """Per bucket the words ``x`` (sorted), how many pairs each has, and of the
    pairs (``code`` = place in x << 32 | context, sorted) contexts and values."""
    edge = _cut(x, buckets)
    at = np.searchsorted(code, edge.astype(U) << U(32))
    many = np.bincount((code >> U(32)).astype(np.int64), minlength=len(x)).astype(np.uint32)
    ctx = (code & U(0xFFFFFFFF)).astype(np.uint32)
    rows = []
    for b in np.flatnonzero(np.diff(edge)):
        i, j, p, q = edge[b], edge[b + 1], at[b], at[b + 1]
        rows.append((int(b), 1, block, pack_keys(x[i:j]), pack(many[i:j]), pack(ctx[p:q]), None if value is None else pack(value[p:q])))
    if rows:
        yield _rows(rows)


def learned(doc_id: Column) -> Column:
    """Rows to learn from: crc32(doc_id as text) mod 10 is not 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 != 0, F.lit(False))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[Tokens]:
    for batch in batches:
        for part in slices(batch, "text"):
            yield Tokens(*text_bytes(part.column("text")))


def count_words(train: DataFrame, buckets: int) -> DataFrame:
    """A row for each bucket: its words and their counts (the model's kind 0)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, c = np.zeros(0, U), np.zeros(0, np.int64)
        for t in _texts(batches):
            u, n = np.unique(t.h, return_counts=True)
            x, back = np.unique(np.concatenate([x, u]), return_inverse=True)
            c = np.bincount(back, np.concatenate([c, n])).astype(np.int64)
            if len(x) >= HELD // 2:
                yield from send(x, c)
                x, c = np.zeros(0, U), np.zeros(0, np.int64)
        yield from send(x, c)

    def send(x: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = _cut(x, buckets)
        rows = [(int(b), 1, 0, pack_keys(x[edge[b] : edge[b + 1]]), pack(c[edge[b] : edge[b + 1]]), None, None) for b in np.flatnonzero(np.diff(edge))]
        if rows:
            yield _rows(rows)

    def add(group: pa.Table) -> pa.Table:
        x = np.concatenate([unpack_keys(w.as_py()) for w in group.column("words")])
        c = np.concatenate([unpack(n.as_py(), np.int64) for n in group.column("counts")])
        x, back = np.unique(x, return_inverse=True)
        c = np.bincount(back, c).astype(np.int64)
        none = pack(np.zeros(0, np.uint32))
        return pa.Table.from_batches([_rows([(group.column("bucket")[0].as_py(), 0, 0, pack_keys(x), pack(c), none, none)])])

    return train.select("text").mapInArrow(count, ROW).groupBy("bucket").applyInArrow(add, ROW)


class Bucket:
    """One bucket of the model: words, their counts, and the entries (word,
    context) with their counts, sorted by code."""

    def __init__(self, row: dict | None):
        self.x = unpack_keys(row["words"]) if row else np.zeros(0, U)
        self.c = unpack(row["counts"], np.int64) if row else np.zeros(0, np.int64)
        self.code = unpack(row["ctx"], U) if row and row["value"] is not None and len(self.x) else np.zeros(0, U)
        self.n = unpack(row["value"], np.int64) if len(self.code) else np.zeros(0, np.int64)

    def word(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words ``x``, and which of them are there."""
        if not len(self.x):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at = np.minimum(np.searchsorted(self.x, x), len(self.x) - 1)
        return at, self.x[at] == x

    def entry(self, code: np.ndarray) -> np.ndarray:
        """Counts of entries, 0 where there is none."""
        if not len(self.code):
            return np.zeros(len(code), np.int64)
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, self.n[at], 0)


def _codes(words: np.ndarray, many: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    return (np.repeat(words.astype(U), many) << U(32)) | ctx.astype(U)


def count_pairs(train: DataFrame, model: DataFrame, states: States, depth: int, buckets: int, floor: int) -> DataFrame:
    """Next words of the contexts of ``depth`` words, by bucket, beside the
    model's row: kept counts (``new_code``, ``new_n``), their sums by context,
    and the pairs frequent enough to be contexts themselves."""
    find = states.finder(depth, kept=False)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for t in _texts(batches):
            for k, start, s in t.sequences(depth):
                if k == depth:
                    ctx = find(s[start])
                    hit = np.flatnonzero(ctx >= 0)
                    held.append((t.h[start[hit] + depth], ctx[hit]))
                    size += len(hit)
            if size >= HELD:
                yield from send(held)
                held, size = [], 0
        if size:
            yield from send(held)

    def send(held: list) -> Iterator[pa.RecordBatch]:
        x, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        code, n = np.unique((back.astype(U) << U(32)) | np.concatenate([h[1] for h in held]).astype(U), return_counts=True)
        yield from _lists(x, code, n, buckets)

    kind = ROW + ", new_code binary, new_n binary, s array<struct<ctx:int,n:long,kinds:long>>, next array<struct<ctx:int,x:long,n:long>>"

    def add(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        old = next(r for r in rows if r["kind"] == 0)  # a pair's word is a training word
        at = Bucket(old)
        codes, counts = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for r in rows:
            if r["kind"] == 1:
                codes.append(_codes(at.word(unpack_keys(r["words"]))[0], unpack(r["counts"], np.uint32), unpack(r["ctx"], np.uint32)))
                counts.append(unpack(r["value"], np.int64))
        code, back = np.unique(np.concatenate(codes), return_inverse=True)
        n = np.bincount(back, np.concatenate(counts), minlength=len(code)).astype(np.int64)
        code, n = code[n >= LEAST], n[n >= LEAST]
        ctx, x = (code & U(0xFFFFFFFF)).astype(np.int64), at.x[(code >> U(32)).astype(np.int64)]
        u, back = np.unique(ctx, return_inverse=True)
        total, kinds = np.bincount(back, n, minlength=len(u)).astype(int), np.bincount(back, minlength=len(u))
        more = np.flatnonzero((n >= floor) & (x != END))
        out = {k: [old[k]] for k in NAMES}
        out |= {"new_code": [pack(code)], "new_n": [pack(n)]}
        out["s"] = [[{"ctx": int(a), "n": int(b), "kinds": int(c)} for a, b, c in zip(u, total, kinds, strict=True)]]
        out["next"] = [[{"ctx": int(ctx[i]), "x": int(x[i].view(np.int64)), "n": int(n[i])} for i in more]]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), TYPES, strict=True)})

    pairs = train.select("text").mapInArrow(count, ROW)
    return model.unionByName(pairs).groupBy("bucket").applyInArrow(add, kind)


TYPES = [
    pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 6,
    pa.list_(pa.struct([("ctx", pa.int32()), ("n", pa.int64()), ("kinds", pa.int64())])),
    pa.list_(pa.struct([("ctx", pa.int32()), ("x", pa.int64()), ("n", pa.int64())])),
]


class Level:
    """The contexts of one level, beside the smoothing of all: counts n, and
    the mass ``rest`` (rare next words and discounts) that goes to the parent."""

    def __init__(self, states: States, sums: dict[int, tuple[int, int]], depth: int, root: tuple[int, int]):
        self.start, self.end = states.level[depth]
        for i in range(self.start, self.end):
            n, kinds = sums.get(i, (0, 0))
            states.rest[i] = states.n[i] - n + DISCOUNT * kinds
        self.rare = np.array([states.n[i] - sums.get(i, (0, 0))[0] for i in range(self.start, self.end)], float)
        self.n, self.rest, self.parent = np.array(states.n, float), np.array(states.rest, float), np.array(states.parent, np.int64)
        self.total = root[0] + ADD * (root[1] + 1)

    def chance(self, b: Bucket, word: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        """Probability of the words (places in ``b``) after the contexts."""
        chain = [ctx]
        while (chain[-1] >= 0).any():
            chain.append(np.where(chain[-1] >= 0, self.parent[chain[-1]], -1))
        out = (b.c[word] + ADD) / self.total
        for c in reversed(chain):
            own = np.maximum(b.entry((word.astype(U) << U(32)) | np.maximum(c, 0).astype(U)) - DISCOUNT, 0)
            out = np.where(c >= 0, (own + self.rest[c] * out) / self.n[c], out)
        return out

    def part(self, b: Bucket, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(context, gain over the parent with one occurrence left out) of the
        new entries."""
        word, ctx = (code >> U(32)).astype(np.int64), (code & U(0xFFFFFFFF)).astype(np.int64)
        above = self.chance(b, word, self.parent[ctx]) if len(code) else np.ones(0)
        without = (np.where(n > LEAST, n - 1 - DISCOUNT, 0) + self.rest[ctx] * above) / (self.n[ctx] - 1)
        return ctx - self.start, n * np.log(without / above)

    def gains(self, table: DataFrame) -> np.ndarray:
        """Summed gains of every context of the level, over all buckets."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(self.end - self.start)
            for batch in batches:
                for r in batch.to_pylist():
                    ctx, gain = self.part(Bucket(r), unpack(r["new_code"], U), unpack(r["new_n"], np.int64))
                    sums += np.bincount(ctx, gain, minlength=len(sums))
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[some])], names=["ctx", "gain"])

        mine = slice(self.start, self.end)
        out = np.log(np.maximum(self.rest[mine] - 1, 1e-9) / np.maximum(self.n[mine] - 1, 1)) * self.rare
        for r in table.mapInArrow(part, "ctx int, gain double").groupBy("ctx").agg(F.sum("gain").alias("g")).collect():  # a row a context
            out[r["ctx"]] += r["g"]
        return out

    def apply(self, table: DataFrame, kept: np.ndarray) -> DataFrame:
        """The model's rows with the entries of the kept contexts."""
        start = self.start

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    b, code, n = Bucket(r), unpack(r["new_code"], U), unpack(r["new_n"], np.int64)
                    stay = kept[(code & U(0xFFFFFFFF)).astype(np.int64) - start]
                    code, n = np.concatenate([b.code, code[stay]]), np.concatenate([b.n, n[stay]])
                    order = np.argsort(code)
                    yield _rows([(r["bucket"], 0, 0, r["words"], r["counts"], pack(code[order]), pack(n[order]))])

        return table.mapInArrow(run, ROW)


class Tree:
    """What tasks hold of the learned model: states and root sums."""

    def __init__(self, states: States, words: int, kinds: int, buckets: int, depth: int):
        self.words, self.kinds, self.buckets, self.depth = words, kinds, buckets, depth
        self.find = [states.finder(k, kept=True) for k in range(1, depth + 1)]
        self.n, self.rest = np.array(states.n, float), np.array(states.rest, float)

    def asked(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """Different words and entries that the tokens need, the words' places
        in the first, and per level (tokens, contexts, places in the second)."""
        x, back = np.unique(t.h, return_inverse=True)
        hits, codes = [], [np.zeros(0, U)]
        for k, start, s in t.sequences(self.depth):
            ctx = self.find[k - 1](s[start])
            hit = np.flatnonzero(ctx >= 0)
            at = start[hit] + k
            hits.append((at, ctx[hit]))
            codes.append((back[at].astype(U) << U(32)) | ctx[hit].astype(U))
        code, place = np.unique(np.concatenate(codes), return_inverse=True)
        cuts = np.cumsum([len(at) for at, _ in hits])[:-1] if hits else []
        return x, code, back, [(*h, p) for h, p in zip(hits, np.split(place, cuts), strict=False)]

    def scores(self, t: Tokens, c: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        """Per text: tokens, known tokens, base score and score, given the
        counts that answer ``asked``."""
        _, _, back, levels = self.asked(t)
        seen = c[back]
        now = (seen + ADD) / (self.words + ADD * (self.kinds + 1))
        base = np.log10(now)
        for at, ctx, place in levels:
            now[at] = (np.maximum(n[place] - DISCOUNT, 0) + self.rest[ctx] * now[at]) / self.n[ctx]
        add = lambda v: np.add.reduceat(v, t.first[:-1]) if len(t.first) > 1 else v[:0]
        return [np.diff(t.first), add((seen > 0).astype(np.int64)), add(base), add(np.log10(now))]


def learn(spark: SparkSession, docs: DataFrame, depth: int = DEPTH, support: float = SUPPORT, nats: float = NATS) -> tuple[Tree, DataFrame, States]:
    """The tree of the rows of ``docs`` outside the held-out fold, its buckets
    (landed), and all contexts tried."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(FEWEST, -(-size // BUCKET))
    train = docs.where(learned(F.col("doc_id")))
    table = land(spark, count_words(train, buckets), "tree-words")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = Bucket(r)
                yield pa.RecordBatch.from_pylist([{"n": int(b.c.sum()), "v": len(b.x)}])

    words, kinds = (int(v or 0) for v in table.mapInArrow(sums, "n long, v long").agg(F.sum("n"), F.sum("v")).first())
    floor = max(LEAST, int(np.ceil(support * words)))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = Bucket(r)
                some = (b.c >= floor) & (b.x != END)
                yield pa.RecordBatch.from_arrays([pa.array(b.x[some].view(np.int64)), pa.array(b.c[some])], names=["x", "n"])

    found = [(-1, r["x"] % 2**64, r["n"]) for r in table.mapInArrow(frequent, "x long, n long").collect()]  # at most 1 / support
    states = States()
    for k in range(1, depth + 1):
        states.add(found, k)
        start, end = states.level[k]
        if start == end:
            break
        counted = land(spark, count_pairs(train, table, states, k, buckets, floor), "tree-pairs")
        by = counted.select(F.explode("s").alias("s")).groupBy("s.ctx").agg(F.sum("s.n").alias("n"), F.sum("s.kinds").alias("k"))
        level = Level(states, {r["ctx"]: (r["n"], r["k"]) for r in by.collect()}, k, (words, kinds))
        kept = level.gains(counted) > nats
        states.kept[start:end] = kept.tolist()
        more = counted.select(F.explode("next").alias("p")).select("p.*").collect()  # at most 1 / support
        found = [(r["ctx"], r["x"] % 2**64, r["n"]) for r in more]
        old, table = table, land(spark, level.apply(counted, kept), "tree-model")
        discard(spark, old, counted)
    return Tree(states, words, kinds, buckets, depth), table, states


def lm_scores(spark: SparkSession, docs: DataFrame, depth: int = DEPTH, support: float = SUPPORT, nats: float = NATS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of
    every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tree, table, _ = learn(spark, docs, depth, support, nats)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts in compressed blocks; a block is known by task and number."""
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                buf, off = text_bytes(part.column("text"))
                ids = part.column("doc_id")
                yield _rows([(
                    0, 0, number, zstandard.ZstdCompressor(level=3).compress(buf.tobytes()), pack(np.diff(off)),
                    pack(ids.fill_null(0).to_numpy(zero_copy_only=False)), pack(ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)),
                )])
                number += 1

    def opened(r: dict) -> Tokens:
        off = np.concatenate([[0], np.cumsum(unpack(r["counts"], np.int64))])
        return Tokens(np.frombuffer(zstandard.ZstdDecompressor().decompress(r["words"]), np.uint8), off)

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = batch.slice(row, 1).to_pylist()[0]
                x, code, _, _ = tree.asked(opened(r))
                yield from _lists(x, code, None, tree.buckets, r["block"])

    def answer(group: pa.Table) -> pa.Table:
        at = np.flatnonzero(group.column("kind").to_numpy() == 0)
        b = Bucket(group.slice(int(at[0]), 1).to_pylist()[0] if len(at) else None)
        rows = []
        for i in np.flatnonzero(group.column("kind").to_numpy() == 1):
            r = group.slice(int(i), 1).to_pylist()[0]
            place, there = b.word(unpack_keys(r["words"]))
            many = unpack(r["counts"], np.uint32)
            n = b.entry(_codes(place, many, unpack(r["ctx"], np.uint32))) * np.repeat(there, many)
            c = np.where(there, b.c[place], 0) if len(b.x) else np.zeros(len(place), np.int64)
            rows.append((r["bucket"], 1, r["block"], None, pack(c), None, pack(n)))
        return pa.Table.from_batches([_rows(rows)] if rows else [], None if rows else _rows([(0, 0, 0, None, None, None, None)]).schema)

    kind = "doc_id long, n_tokens long, n_known long, base_score double, score double"

    def scored(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["kind"], r["bucket"]))
        t = opened(rows[0])
        c = np.concatenate([np.zeros(0, np.int64), *(unpack(r["counts"], np.int64) for r in rows[1:])])
        n = np.concatenate([np.zeros(0, np.int64), *(unpack(r["value"], np.int64) for r in rows[1:])])
        ids = pa.array(unpack(rows[0]["ctx"], np.int64), mask=unpack(rows[0]["value"], np.uint8) == 0)
        return pa.table(dict(zip(["doc_id", "n_tokens", "n_known", "base_score", "score"], [ids, *map(pa.array, tree.scores(t, c, n))], strict=True)))

    packed = land(spark, docs.mapInArrow(blocks, ROW), "tree-blocks")
    answers = table.unionByName(packed.mapInArrow(requests, ROW)).groupBy("bucket").applyInArrow(answer, ROW)
    out = packed.unionByName(answers).groupBy("block").applyInArrow(scored, kind)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(True))
    return out.select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(tree.words).cast("long").alias("train_tokens"), "base_score", "score"
    )
