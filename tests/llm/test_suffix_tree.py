"""Suffix-tree scores against a plain twin on word tuples."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.helpers import documents, odd_texts, planted, random_texts, words_of
from tillscope.llm import suffix_tree
from tillscope.llm.queries import QUERIES

END = None


def lower(text):
    return [w.lower() for w in words_of(text)]  # bytes.lower: A-Z only


class Twin:
    """The rules of the docstring, word tuples in dictionaries."""

    def __init__(self, rows, depth, support, nats):
        docs = [[*lower(t), END] for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
        self.c = Counter(w for d in docs for w in d)
        self.words, self.kinds = sum(self.c.values()), len(self.c)
        self.states = {}
        floor = max(2, math.ceil(support * self.words))
        tried = {(w,): n for w, n in self.c.items() if n >= floor and w is not END}
        for k in range(1, depth + 1):
            nexts = defaultdict(Counter)
            for d in docs:
                for i in range(len(d) - k):
                    if tuple(d[i : i + k]) in tried:
                        nexts[tuple(d[i : i + k])][d[i + k]] += 1
            kept, more = {}, {}
            for s, n in tried.items():
                entries = {x: m for x, m in nexts[s].items() if m >= 2}
                rare = n - sum(entries.values())
                rest = rare + 0.75 * len(entries)
                gain = rare * math.log(max(rest - 1, 1e-9) / max(n - 1, 1))
                for x, m in entries.items():
                    above = self.p(s[1:], x)
                    left = (m - 1 - 0.75 if m > 2 else 0) + rest * above
                    gain += m * math.log(left / (n - 1) / above)
                if gain > nats and (k == 1 or s[1:] in self.states):
                    kept[s] = (n, rest, entries)
                more |= {(*s, x): m for x, m in entries.items() if m >= floor and x is not END}
            self.states |= kept
            tried = {s: m for s, m in more.items() if s[1:] in self.states}

    def p(self, s, x):
        if not s:
            return (self.c[x] + 0.1) / (self.words + 0.1 * (self.kinds + 1))
        n, rest, entries = self.states[s]
        return (max(entries.get(x, 0) - 0.75, 0) + rest * self.p(s[1:], x)) / n

    def score(self, text, depth):
        d = [*lower(text), END]
        base = sum(math.log10(self.p((), x)) for x in d)
        total = 0.0
        for i, x in enumerate(d):
            s = max((tuple(d[i - k : i]) for k in range(min(i, depth) + 1) if k == 0 or tuple(d[i - k : i]) in self.states), key=len)
            total += math.log10(self.p(s, x))
        return len(d), sum(self.c[x] > 0 for x in d), base, total


def check(spark, texts, ids=None, depth=3, support=0.005, nats=1.0):
    ids = list(range(len(texts))) if ids is None else ids
    got = suffix_tree.lm_scores(spark, documents(spark, texts, ids), depth, support, nats).collect()
    twin = Twin(list(zip(ids, texts)), depth, support, nats)
    want = sorted(
        ((i is None, i or 0, i is None or zlib.crc32(str(i).encode()) % 10 == 0, *twin.score(t, depth)[:2], twin.words), twin.score(t, depth)[2:])
        for i, t in zip(ids, texts)
    )
    have = sorted(((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens), (r.base_score, r.score)) for r in got)
    assert [w[0] for w in want] == [h[0] for h in have]
    for w, h in zip(want, have):
        assert h[1] == pytest.approx(w[1], rel=1e-9, abs=1e-9)
    return twin


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_scores_equal_plain_twin(spark, depth):
    twin = check(spark, random_texts(11, 150, vocab=9, most=80), depth=depth)
    assert {len(s) for s in twin.states} == set(range(1, depth + 1))


def test_odd_texts_nulls_and_repeated_ids(spark):
    texts = odd_texts() + random_texts(3, 30) + ["A a Á á", None, "a b"]
    check(spark, texts, ids=[*range(len(texts) - 3), None, 5, 5], support=0.001)


def test_tables_without_learning(spark):
    assert suffix_tree.lm_scores(spark, documents(spark, [])).count() == 0
    out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    rows = suffix_tree.lm_scores(spark, documents(spark, ["a b", None, "c"], out)).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.score == 0 == r.base_score and r.n_known == 0 for r in rows)


def test_distributions_add_up_to_one(spark):
    texts = random_texts(5, 120, vocab=8)
    twin = Twin(list(enumerate(texts)), 3, 0.005, 1.0)
    for s in twin.states:
        assert sum(twin.p(s, x) for x in twin.c) + twin.p(s, b"never") == pytest.approx(1)
    assert len(twin.states) > 10


def test_many_small_sends_and_blocks(spark, monkeypatch):
    """Tasks that send often and blocks of few texts give the same scores."""
    texts = random_texts(21, 120, vocab=15)
    docs = documents(spark, texts)
    want = {r.doc_id: r.score for r in suffix_tree.lm_scores(spark, docs, 3, 0.002, 1.0).collect()}
    monkeypatch.setattr(suffix_tree, "FEWEST", 3)
    have = {r.doc_id: r.score for r in suffix_tree.lm_scores(spark, docs.repartition(7), 3, 0.002, 1.0).collect()}
    assert want == pytest.approx(have, rel=1e-12)


def test_packing_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 3000):
        x = np.sort(r.integers(0, 2**64, n, np.uint64))
        assert (suffix_tree.unpack_keys(suffix_tree.pack_keys(x)) == x).all()
        c = r.integers(-5, 2**40, n)
        assert (suffix_tree.unpack(suffix_tree.pack(c), np.int64) == c).all()


def test_whole_table_beats_the_root(spark):
    folder = "/root/testdata/sf0.01"
    df = QUERIES["op12_suffix_tree_scores"](spark, folder).toPandas()
    rows = planted(spark, folder)
    twin = Twin([(r.doc_id, r.text) for r in rows], 3, suffix_tree.SUPPORT, suffix_tree.NATS)
    got = {r.doc_id: r for r in df.itertuples()}
    assert len(df) == len(rows)
    for r in rows[::7]:
        n, known, base, score = twin.score(r.text, 3)
        g = got[r.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (n, known, twin.words)
        assert (g.base_score, g.score) == pytest.approx((base, score), rel=1e-9)
    held = df[df.held_out]
    assert held.score.sum() > 0.99 * held.base_score.sum() and held.score.sum() > held.base_score.sum()
