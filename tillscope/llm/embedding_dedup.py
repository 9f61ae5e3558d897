"""Embedding near-duplicates by an inverted multi-index.

A unit vector is cut into two halves; each half has a codebook of its own, and
the two nearest codewords name the vector's cell in the product grid. A query
visits cells in the order of the summed distances of its halves to the
codewords (multi-sequence order), as many as reach the target recall, and
every vector met there is verified by its cosine in double precision.

* Equal vectors are one entry with a count, so copies cost nothing.
* Codebooks are fitted on at most ``SAMPLE`` vectors (smallest hash of the
  id); the grid grows with the corpus. Every vector is indexed and is a query.
* A pair is found if either end visits the other's cell; members carry the
  list of cells that they visit, so that a pair found from both ends counts
  once.
* The number of cells visited is calibrated on the sample, by the nearer end of
  each pair, as the largest number that any of three sets of pairs asks for:
  vectors moved to just the threshold, the same with one vector of each cell,
  and linked pairs, one of each vector. So large tight groups, whose pairs are
  near, don't set it alone.
* Vectors are compared with those of their own length: each length has a grid
  of its own (the length is part of the cell's key), or one single cell where
  it has at most ``FEW`` vectors.
* Cells are dealt in blocks of members and of queries, both of bounded size; a
  task sends on per vector its number of links and the smallest id of its
  local component, never pairs.

Nulls and ties: a vector that is null, empty, all zero, holds a null or
non-finite component, or has a null id links with nothing: n_links 0,
component_id its own id. So does one whose squares add up to 0 or to infinity
in doubles. Repeated rows count as copies and link
with each other. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.common import components, land

#: At most so many vectors fit the codebooks and the number of visits.
SAMPLE = 1 << 14
#: Vectors per cell aimed at, and the largest codebook of a half (beyond
#: PER_CELL * MOST_WORDS ** 2 vectors of a length, half a billion, cells hold more).
PER_CELL, MOST_WORDS = 8, 8192
#: Vectors of a length that are one cell.
FEW = 256
#: Share of linked pairs that the traversal is to reach.
RECALL = 0.995
#: Members and queries of a cell that meet in one group at most (on average).
BLOCK = 1024


class Single:
    """One cell that holds all."""

    visits = 1

    def home(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x), np.int64)

    def visited(self, x: np.ndarray) -> np.ndarray:
        return np.zeros((len(x), 1), np.int64)


class Grid:
    """Two codebooks and the number of cells that a query visits."""

    def __init__(self, sample: np.ndarray, total: int, threshold: float, seed: int = 5):
        r = np.random.default_rng(seed)
        words = int(2 ** np.clip(np.round(np.log2(np.sqrt(max(total, 1) / PER_CELL))), 1, np.log2(MOST_WORDS)))
        self.half = (sample.shape[1] + 1) // 2
        self.books = [lloyd(x, min(words, len(x)), r) for x in (sample[:, : self.half], sample[:, self.half :])]
        self.visits = self._calibrate(sample, threshold, r)

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        return [square(h, b) for h, b in zip((x[:, : self.half], x[:, self.half :]), self.books, strict=True)]

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.books[1]) + b.argmin(1)

    def visited(self, x: np.ndarray) -> np.ndarray:
        """(len(x), visits) cells, nearest first. Of each half only the
        nearest ``visits`` codewords can occur, and the i-th with the j-th only
        if (i + 1) * (j + 1) <= visits: all cells before it are nearer."""
        a, b = self.distances(x)
        k = self.visits
        na, nb = min(k, a.shape[1]), min(k, b.shape[1])
        ia, ib = a.argsort(1, kind="stable")[:, :na], b.argsort(1, kind="stable")[:, :nb]
        i, j = np.nonzero(np.outer(np.arange(1, na + 1), np.arange(1, nb + 1)) <= k)
        d = np.take_along_axis(a, ia, 1)[:, i] + np.take_along_axis(b, ib, 1)[:, j]
        cell = ia[:, i] * b.shape[1] + ib[:, j]
        order = d.argsort(1, kind="stable")[:, :k]
        return np.take_along_axis(cell, order, 1)

    def _calibrate(self, sample: np.ndarray, threshold: float, r: np.random.Generator) -> int:
        cells = len(self.books[0]) * len(self.books[1])
        q = sample[:512]
        spread = sample[r.permutation(np.unique(self.home(sample), return_index=True)[1])[:512]]
        near = [np.flatnonzero((s >= threshold) & (np.arange(len(sample)) != i)) for i, s in enumerate(q @ sample.T)]
        linked = [i for i, n in enumerate(near) if len(n)]
        pairs = [(q, moved(q, threshold, r)), (spread, moved(spread, threshold, r))]
        pairs.append((q[linked], sample[[r.choice(near[i]) for i in linked]]))
        return min(cells, max(self._needed(x, y) for x, y in pairs if len(x)))

    def _needed(self, x: np.ndarray, y: np.ndarray) -> int:
        """Cells to visit so that ``RECALL`` of the pairs are reached from
        their nearer end."""
        rank = np.minimum(self._rank(x, y), self._rank(y, x))
        return int(np.quantile(rank, RECALL, method="higher") + 1)

    def _rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many cells are nearer to each x than its y's."""
        a, b = self.distances(x)
        home = self.home(y)
        i, j = home // b.shape[1], home % b.shape[1]
        reach = a[np.arange(len(x)), i] + b[np.arange(len(x)), j]
        b = np.sort(b, 1)
        return np.array([np.searchsorted(b[n], reach[n] - a[n]).sum() for n in range(len(x))])


def moved(x: np.ndarray, threshold: float, r: np.random.Generator) -> np.ndarray:
    """Unit vectors at cosine ``threshold`` to ``x``, in random directions."""
    u = r.normal(size=x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
    return threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * u


def square(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def lloyd(x: np.ndarray, k: int, r: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means codebook; an empty word moves to the vector farthest from its word."""
    c = x[r.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        d = square(x, c)
        of, far = d.argmin(1), d.min(1)
        n = np.bincount(of, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        for word, at in zip(np.flatnonzero(n == 0), np.argsort(-far), strict=False):
            c[word] = x[at]
    return c


def unit(col: pa.Array) -> np.ndarray:
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _numbers(x: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel(), kind))


def embedding_dedup(spark: SparkSession, embeddings: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``embeddings``
    (vec_id, embedding)."""
    e, size = F.col("embedding"), F.size("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    norm = F.aggregate(e, F.lit(0.0), lambda t, v: t + v.cast("double") * v.cast("double"))
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id").isNotNull() & e.isNotNull() & finite & (size > 0) & (norm > 0) & (norm < float("inf")), e).alias("embedding"),
    )
    keyed = rows.select(
        "vec_id", "embedding", F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(7), "embedding").alias("k2")
    )
    same = keyed.where("embedding is not null").groupBy("k1", "k2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"), F.first("embedding").alias("embedding")
    )
    reps = land(spark, same, "vectors")
    zero = F.lit(0).cast("long")
    found = _found(spark, reps, grids(reps, threshold), threshold)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(spark, found.select(F.col("rep").alias("u"), F.col("root").alias("v")), "vector-links")
    facts = reps.select("rep", "m", "k1", "k2").join(links, "rep", "left").join(
        comp.withColumnRenamed("node", "rep"), "rep", "left"
    )
    facts = land(spark, facts, "vector-facts")
    out = keyed.select("vec_id", F.when(F.col("embedding").isNotNull(), F.col("k1")).alias("k1"), "k2").join(facts, ["k1", "k2"], "left")
    component = F.coalesce("component", "rep", "vec_id")
    return out.select(
        "vec_id",
        (F.coalesce("links", zero) + F.coalesce(F.col("m") - 1, zero)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def grids(reps: DataFrame, threshold: float) -> dict[int, Grid]:
    """A grid for each vector length that has more than ``FEW`` vectors."""
    out = {}
    d = F.size("embedding")
    for length, n in reps.groupBy(d.alias("d")).count().where(F.col("count") > FEW).collect():  # a row a length
        some = reps.where(d == length).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("embedding").toArrow()
        out[length] = Grid(unit(some.column(0).combine_chunks()), n, threshold)
    return out


def _found(spark: SparkSession, usable: DataFrame, by_length: dict[int, Grid], threshold: float) -> DataFrame:
    """(rep, links, root): links found in one group, and the smallest id of
    the vector's component there. Landed."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column("embedding").offsets.to_numpy())
            for d in np.unique(size).tolist():
                rows, grid = np.flatnonzero(size == d), by_length.get(d, Single())
                for at in range(0, len(rows), 256):
                    part = batch.take(pa.array(rows[at : at + 256]))
                    x = unit(part.column("embedding"))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("rep"), part.column("m"), part.column("embedding"), pa.array(np.full(len(x), d, np.int32)),
                         pa.array(grid.home(x), pa.int32()), _numbers(grid.visited(x), pa.int32())],
                        names=["rep", "m", "embedding", "d", "home", "cells"],
                    )

    kind = usable.schema["embedding"].dataType.simpleString()
    placed = usable.select("rep", "m", "embedding").mapInArrow(
        assign, f"rep long, m long, embedding {kind}, d int, home int, cells array<int>"
    )
    placed = land(spark, placed, "vector-cells")
    visits = placed.select("d", F.explode("cells").alias("cell")).groupBy("d", "cell").agg(F.count(F.lit(1)).alias("q"))
    held = placed.groupBy("d", F.col("home").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    blocks = land(
        spark,
        held.join(visits, ["d", "cell"]).select(
            "d", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("q") / BLOCK).cast("int").alias("qb")
        ),
        "cell-blocks",
    )
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "rep"), F.col(n)).cast("int")
    member = placed.withColumn("cell", F.col("home")).join(blocks, ["d", "cell"]).select(
        "d", "cell", mine("mb", 1).alias("i"), spread("qb").alias("j"), F.lit(True).alias("member"), "rep", "m", "embedding", "home", "cells"
    )
    query = placed.select("rep", "m", "embedding", "d", "home", F.explode("cells").alias("cell")).join(blocks, ["d", "cell"]).select(
        "d", "cell", spread("mb").alias("i"), mine("qb", 2).alias("j"), F.lit(False).alias("member"), "rep", "m", "embedding", "home",
        F.lit(None).cast("array<int>").alias("cells"),
    )

    def verify(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        is_member = group.column("member").to_numpy()
        a, b = group.filter(pa.array(~is_member)), group.filter(pa.array(is_member))
        if not (a.num_rows and b.num_rows):
            return pa.table({"rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        qx, mx = unit(a.column("embedding").combine_chunks()), unit(b.column("embedding").combine_chunks())
        q, x = a.column("rep").to_numpy(), b.column("rep").to_numpy()
        qm, xm = a.column("m").to_numpy(), b.column("m").to_numpy()
        cells = b.column("cells").combine_chunks().flatten().to_numpy().reshape(len(x), -1)
        home = a.column("home").to_numpy()
        q_links, x_links = np.zeros(len(q), np.int64), np.zeros(len(x), np.int64)
        pairs = []
        for at in range(0, len(q), 256):
            i, j = np.nonzero(qx[at : at + 256] @ mx.T >= threshold)
            i = i + at
            i, j = i[q[i] != x[j]], j[q[i] != x[j]]
            np.add.at(q_links, i, xm[j])
            back = np.concatenate([(cells[j[k : k + 65536]] == home[i[k : k + 65536], None]).any(1) for k in range(0, len(i), 65536)] or [np.zeros(0, bool)])
            np.add.at(x_links, j[~back], qm[i[~back]])
            pairs.append((i.astype(np.int32), j.astype(np.int32)))
        i, j = (np.concatenate(p) for p in zip(*pairs, strict=True))
        ql, xl = q.copy(), x.copy()  # smallest ids, passed along links until they stay
        while len(i):
            old = ql.sum() + xl.sum()
            low = np.minimum(ql[i], xl[j])
            np.minimum.at(ql, i, low)
            np.minimum.at(xl, j, low)
            if ql.sum() + xl.sum() == old:
                break
        qs, xs = np.unique(i), np.unique(j)
        return pa.table({
            "rep": np.concatenate([q[qs], x[xs]]), "links": np.concatenate([q_links[qs], x_links[xs]]),
            "root": np.concatenate([ql[qs], xl[xs]]),
        })

    groups = member.unionByName(query).groupBy("d", "cell", "i", "j")
    return land(spark, groups.applyInArrow(verify, "rep long, links long, root long"), "vector-links")
