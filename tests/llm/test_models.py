"""Classifiers by held-out accuracy, the embedding join by brute force, the
pipeline by its stages' promises."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF01
from tests.llm.helpers import documents, groups, labels, odd_texts, read
from tillscope.llm import common, embedding_dedup, quality, queries, toxicity

SF1 = "/root/testdata/sf0.1"


def accuracy(spark, name, column):
    out = queries.QUERIES[name](spark, SF1)
    rows = out.join(read(spark, SF1, "labels"), "doc_id").where("held_out").select(column, "score", "predicted").collect()
    assert out.count() == 10_000 and all(0 <= r.score <= 1 for r in rows)
    y, p = np.array([r[0] for r in rows]), np.array([r.predicted for r in rows])
    return (p[y == 1] == 1).mean(), (p[y == 0] == 0).mean()


def test_toxicity_held_out(spark):
    caught, spared = accuracy(spark, "op1_toxicity_cnn", "toxic")
    assert caught >= 0.9 and spared >= 0.98


def test_quality_held_out(spark):
    good, bad = accuracy(spark, "op3_quality_qda", "quality")
    assert good >= 0.97 and bad >= 0.93


@pytest.mark.parametrize(("score", "column"), [(toxicity.toxicity_scores, "toxic"), (quality.quality_scores, "quality")])
def test_classifier_edges(spark, score, column):
    texts = odd_texts() + [f"some plain words number {i}" if i % 2 else f"AWFUL!! trash*** {i}" for i in range(80)]
    docs = documents(spark, texts, [None, *range(1, len(texts))], [None, *["en"] * (len(texts) - 1)])
    known = labels(spark, len(texts), column).union(spark.createDataFrame([(3, None), (None, 1)], f"doc_id long, {column} int"))
    rows = score(spark, docs, known).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert all(r.held_out for r in rows if r.doc_id is None)
    assert score(spark, docs, known.limit(0)).count() == len(texts)
    assert score(spark, documents(spark, []), known).count() == 0


def test_toxicity_thresholds_cover_all_labels(spark):
    """Every fifth "grim" text is toxic: to reject them all pays only where
    half of the rows are toxic, as in the sample, not among all labels."""
    kinds = [("grim", int(i % 5 == 0)) for i in range(400)] + [("vile", 1)] * 60 + [("calm", 0)] * 900
    order = np.random.default_rng(8).permutation(len(kinds))
    texts = [f"this {kinds[k][0]} text is the one" for k in order]
    known = spark.createDataFrame([(i, kinds[k][1]) for i, k in enumerate(order)], "doc_id long, toxic int")
    docs = documents(spark, texts)
    model = toxicity.train(spark, docs, known, 60)[0]
    score = {kind: model.net.score(*toxicity.word_ids(pa.array([f"this {kind} text is the one"])))[0] for kind in ("calm", "grim", "vile")}
    assert score["calm"] < score["grim"] < score["vile"]
    assert len(model.used) < 120 and set(model.by_lang) == {"en"}
    assert all(score["grim"] < cut <= score["vile"] for cut in (model.threshold, model.by_lang["en"]))


def test_held_out_fold(spark):
    import zlib

    rows = spark.range(200).select("id", common.held_out(F.col("id")).alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def test_discriminant_matches_densities():
    r = np.random.default_rng(0)
    x = {c: r.normal(c, 1 + c, (500, 3)) for c in (0, 1)}
    model = quality.Discriminant({c: (500.0, v.sum(0), v.T @ v) for c, v in x.items()}, 0.0, 0.0)
    z = r.normal(0.5, 2, (50, 3))
    want = 0
    for c, sign in ((1, 1), (0, -1)):
        m, s = x[c].mean(0), np.cov(x[c].T, bias=True)
        d = z - m
        want = want + sign * (-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1])
    assert np.allclose(model.log_ratio(z), want)


def cosine_brute(vectors, threshold):
    """{id: (links, component, kept)} of rows (id, vector), rows numbered."""
    ok = [i for i, (_, v) in enumerate(vectors) if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([vectors[i][1] for i in ok], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T >= threshold
    links = [(ok[a], ok[b]) for a, b in zip(*np.nonzero(np.triu(s, 1)), strict=True)]
    n = np.zeros(len(vectors), int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    ids = [v[0] for v in vectors]
    root = groups(len(vectors), links)
    low = {}
    for i, k in enumerate(root):
        low[k] = min(low.get(k, ids[i]), ids[i])
    return {ids[i]: (int(n[i]), low[root[i]], low[root[i]] == ids[i]) for i in range(len(ids))}


def check_vectors(rows, vectors, least=0.99):
    want = cosine_brute(vectors, 0.9)
    assert len(rows) == len(vectors)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows}
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= least * sum(w[0] for w in want.values())
    assert sum(got[i] == want[i] for i in want) >= least * len(want)


def test_embeddings_whole_table(spark):
    vectors = [(r.vec_id, r.embedding) for r in read(spark, SF1, "embeddings").collect()]
    check_vectors(queries.QUERIES["op4_embedding_multi_index"](spark, SF1).collect(), vectors)


def test_embeddings_edges(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)  # many blocks a cell
    r = np.random.default_rng(1)
    centre = r.normal(size=(6, 64))
    rows = [(i, (centre[i % 6] + 0.25 * r.normal(size=64)).astype(np.float32).tolist()) for i in range(150)]
    rows += [(150 + i, rows[3][1]) for i in range(40)]
    rows += [(300, None), (301, [0.0] * 64), (302, [None] * 64), (303, [float("nan")] * 64), (304, [float("inf")] * 64), (305, [1.0, 2.0]), (306, [])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, label string, rep int").repartition(3)
    check_vectors(embedding_dedup.embedding_dedup(spark, frame).collect(), rows, 0.9)
    gone = spark.createDataFrame([(None, rows[0][1])], "vec_id long, embedding array<float>")
    got = embedding_dedup.embedding_dedup(spark, gone).collect()
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in got] == [(None, 0, None, False)]
    assert embedding_dedup.embedding_dedup(spark, frame.limit(0)).count() == 0


def test_visited_cells_are_the_nearest():
    r = np.random.default_rng(2)
    grid = embedding_dedup.Grid.__new__(embedding_dedup.Grid)
    grid.half, grid.books, grid.visits = 4, [r.normal(size=(9, 4)), r.normal(size=(7, 4))], 20
    x = r.normal(size=(30, 8))
    a, b = grid.distances(x)
    for i, cells in enumerate(grid.visited(x)):
        near = np.argsort(np.add.outer(a[i], b[i]).ravel(), kind="stable")[:20]
        assert set(cells.tolist()) == set(near.tolist())


def test_visits_reach_small_groups_beside_tight_ones():
    """A third of the vectors in 400 tight groups, the rest pairs at cosine
    0.901 to 0.97; the table is larger than the sample."""
    r = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    hot = unit(np.repeat(unit(r.normal(size=(400, 64))), 50, axis=0) + 0.01 * r.normal(size=(20_000, 64)))
    x = unit(r.normal(size=(20_000, 64)))
    y = np.concatenate([embedding_dedup.moved(x[i : i + 200], c, r) for i, c in zip(range(0, 20_000, 200), np.linspace(0.901, 0.97, 100), strict=True)])
    table = np.concatenate([hot, x, y])
    grid = embedding_dedup.Grid(table[r.permutation(len(table))[: embedding_dedup.SAMPLE]], len(table), 0.9)
    some = r.permutation(len(x))[:2000]
    there = (grid.visited(x[some]) == grid.home(y[some])[:, None]).any(1)
    back = (grid.visited(y[some]) == grid.home(x[some])[:, None]).any(1)
    assert (there | back).mean() >= 0.99


def test_components(spark):
    r = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)] + [(500, 600 + i) for i in range(50)]
    frame = spark.createDataFrame([*edges, (7, 7), (None, 3)], "u long, v long")
    root = groups(700, edges)
    got = {x.node: x.component for x in common.components(spark, frame).collect()}
    assert got == {i: root[i] for e in edges for i in e if e[0] != e[1]}
    assert common.components(spark, frame.limit(0)).count() == 0


def test_pipeline(spark):
    source = read(spark, SF01, "documents")
    seen = {r.doc_id: r.text for r in source.collect()}
    docs, sizes = source, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.land(spark, stage(spark, docs, SF01), name)
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == source.columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert sizes[0] < 1000 and sizes[1] == sizes[0] and sizes[2] < sizes[1] and sizes[3] < sizes[2]
    left = {r.doc_id: r.text for r in before.collect()}
    toxic = {r.doc_id for r in read(spark, SF01, "labels").where("toxic = 1").collect()}
    clean = {r.doc_id for r in read(spark, SF01, "labels").where("toxic = 0").collect()}
    first = {r.doc_id for r in corpus_pipeline.toxicity(spark, source, SF01).collect()}
    assert len(first & clean) >= 0.98 * len(clean) and len(first & toxic) <= 0.2 * len(toxic)
    assert {r.doc_id for r in docs.collect()} == set(left)
    assert sum(r.length for r in docs.collect()) == sum({r.doc_id: r.doc_tokens for r in docs.collect()}.values())
    assert set(left) <= set(seen)


def test_pipeline_edges(spark):
    from pyspark.sql import types as T

    docs = documents(spark, odd_texts() + ["plain words here"] * 2, [None, *range(1, len(odd_texts()) + 2)])
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = common.land(spark, stage(spark, docs, SF01), name)
        assert name == "packing" or docs.columns == columns
        empty = stage(spark, spark.createDataFrame([], documents(spark, []).schema), SF01)
        assert empty.count() == 0 and isinstance(empty.schema, T.StructType)
