"""Embedding links through the query: planted near pairs, all vector lengths."""

import numpy as np

from tests.llm.helpers import groups
from tillscope.llm import embedding_dedup
from tillscope.llm.common import land
from tillscope.llm.queries import QUERIES


def check_vectors(rows, vectors, least):
    """No link below 0.9, and ``least`` of the rows and links of brute force."""
    ids = [i for i, _ in vectors]
    x = np.array([v for _, v in vectors], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T >= 0.9
    np.fill_diagonal(s, False)
    root = groups(len(ids), zip(*np.nonzero(s), strict=True))
    want = {i: (int(n), ids[k], k == at) for at, (i, n, k) in enumerate(zip(ids, s.sum(1), root, strict=True))}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows}
    assert len(rows) == len(vectors) and all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= least * sum(w[0] for w in want.values())
    assert sum(got[i] == want[i] for i in want) >= least * len(want)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")


def near(r, x, lowest=0.902, highest=0.99):
    y = np.concatenate([embedding_dedup.moved(x[i : i + 1], c, r) for i, c in enumerate(r.uniform(lowest, highest, len(x)))])
    return (y * r.uniform(0.5, 3, (len(y), 1))).astype(np.float32)


def test_planted_pairs_through_the_query(spark):
    """3,000 single vectors and 600 pairs at cosine 0.902 to 0.99: at least 95 %
    of the rows equal brute force, and no link is wrong."""
    r = np.random.default_rng(12)
    x = r.normal(size=(3600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [*x.astype(np.float32), *near(r, x[:600])]
    rows = [(i, v.tolist()) for i, v in enumerate(rows)]
    folder = "file://" + land(spark, frame(spark, rows), "planted").landed_at.removeprefix("file://").removeprefix("file:")
    spark.read.parquet(folder).write.parquet(f"{folder}/sf/embeddings.parquet")
    check_vectors(QUERIES["op4_embedding_multi_index"](spark, f"{folder}/sf").collect(), rows, 0.95)


def test_all_lengths_are_compared(spark):
    r = np.random.default_rng(13)
    rows = [r.normal(size=64).astype(np.float32) for _ in range(300)]
    base = r.normal(size=32)
    rows += [(base + 0.05 * r.normal(size=32)).astype(np.float32) for _ in range(20)]
    wide = r.normal(size=(150, 5))
    wide /= np.linalg.norm(wide, axis=1, keepdims=True)
    rows += [*wide.astype(np.float32), *near(r, wide)]
    rows += [np.float32([c]) for c in (2.0, -1.0, 3.0, 0.0, -7.0)]
    rows = [(i, v.tolist()) for i, v in enumerate(rows)]
    got = embedding_dedup.embedding_dedup(spark, frame(spark, rows)).collect()
    check = {d: [(i, v) for i, v in rows if len(v) == d] for d in (64, 32, 5)}
    by = {g.vec_id: g for g in got}
    for some in check.values():
        check_vectors([by[i] for i, _ in some], some, 0.98)
    one = [(i, v[0]) for i, v in rows if len(v) == 1]
    assert [by[i].n_links for i, _ in one] == [1, 1, 1, 0, 1]
    assert [by[i].component_id for i, _ in one] == [one[0][0], one[1][0], one[0][0], one[3][0], one[1][0]]


def test_squares_out_of_range_link_with_nothing(spark):
    rows = [(i, [1e-200, 2e-200]) for i in range(2)] + [(2 + i, [1e200, 2e200]) for i in range(2)] + [(4, [1.0, 2.0]), (5, [1.0, 2.0])]
    doubles = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {g.vec_id: g.n_links for g in embedding_dedup.embedding_dedup(spark, doubles).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1}
