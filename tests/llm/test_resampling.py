"""Importance resampling against a plain twin over regular expressions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import documents, odd_texts, planted, random_texts, read
from tillscope.llm import resampling
from tillscope.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def twin(rows, target, percent=25):
    """(doc_id, n_features, weight, score, rank) by the contract's words."""
    of = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(of(f) for text in texts for f in features(text)[1]) for texts in ([x for _, x in rows], target))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    out = []
    for i, text in rows:
        words, f = features(text)
        weight = sum(gain[of(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return sorted((*((v is None, v or 0) for v in (*r[:4], rank.get(id(r)))),) for r in out)


def got(df):
    return sorted((*((v is None, v or 0) for v in (r.doc_id, r.n_features, r.weight, r.score, r["rank"])),) for r in df.collect())


def targets(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "item_id long, text string, score string")


@pytest.mark.parametrize("kept", [1 << 15, 5, 0])
def test_resampling_equals_plain_twin(spark, monkeypatch, kept):
    """With a full head, a small one and none: the same rows."""
    monkeypatch.setattr(resampling, "KEPT", kept)
    texts = random_texts(2, 120, most=70) + ["Éa_É9 z" * 30, "a-b\x00c\x7fd" * 25, "W1 w1 W1 " * 20, "n" * 500 + " m"]
    goal = random_texts(3, 20) + ["w1 w2 w3", None, ""]
    rows = list(enumerate(texts))
    assert got(resampling.resample(spark, documents(spark, texts), targets(spark, goal))) == twin(rows, goal)


def test_odd_rows(spark):
    texts = odd_texts() + random_texts(5, 30, most=90)
    ids = [*range(len(texts) - 4), None, 3, 3, 3]
    texts[-3:] = [texts[-5]] * 3
    goal = ["one word", "line"]
    assert got(resampling.resample(spark, documents(spark, texts, ids), targets(spark, goal))) == twin(list(zip(ids, texts)), goal)
    assert got(resampling.resample(spark, documents(spark, texts, ids), targets(spark, []))) == twin(list(zip(ids, texts)), [])
    assert resampling.resample(spark, documents(spark, []), targets(spark, goal)).count() == 0


def test_ranks_without_gaps_over_many_parts(spark):
    texts = [" ".join(f"w{j % (i % 7 + 2)}" for j in range(30)) for i in range(900)]
    ids = [i % 600 for i in range(900)]  # repeated ids and texts
    df = resampling.resample(spark, documents(spark, texts, ids).repartition(9), targets(spark, ["w1 w2"]))
    ranks = sorted(r["rank"] for r in df.collect() if r["rank"])
    assert ranks == list(range(1, 226))


def test_head_and_tail_give_the_same_buckets():
    texts = pa.array(random_texts(9, 60, vocab=30) + ["ünï çödé " * 5, "x" * 3000, "", None])
    w = resampling.Words(texts)
    words = sorted({w.text(i) for i in range(len(w.h))} - {b"x" * 3000})
    full = resampling.Head(words, [(w.text(i), w.text(i + 1)) for i in w.opens if len(w.text(i + 1)) < 33])
    for head in (full, resampling.Head(words[::3], []), resampling.Head([], [])):
        one, two = resampling.buckets_of(w, head)
        assert one.tolist() == [zlib.crc32(w.text(i)) % 10000 for i in range(len(w.h))]
        assert two.tolist() == [zlib.crc32(w.text(i) + b" " + w.text(i + 1)) % 10000 for i in w.opens]


def test_equal_hashes_do_not_fool_the_head(monkeypatch):
    """Words of one length whose hashes are made equal are told apart by bytes."""
    monkeypatch.setattr(resampling, "hash_spans", lambda buf, s, e: (e - s).astype(np.uint64))
    w = resampling.Words(pa.array(["ab cd ab ef", "xyz ab"]))
    head = resampling.Head([b"ab"], [])
    assert head.find(w).tolist() == [0, -1, 0, -1, -1, 0]


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in planted(spark, folder)]
    goal = [r.text for r in read(spark, folder, "benchmark").collect()]
    assert got(QUERIES["op13_head_tail_resampling"](spark, folder)) == twin(rows, goal)
