"""Plain twins of what the classifiers and the scheduler compute in bulk."""

import heapq
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import documents, odd_texts, random_texts
from tillscope.llm import quality, sharding, toxicity

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
PUNCT, SYMBOL = b".,;:'-()\"?", b"!#$%&*+/<=>@[\\]^_`{|}~"


def plain_statistics(text):
    b = (text or "").encode()
    upper = lambda x: sum(65 <= c <= 90 for c in x)
    letters = lambda x: sum(65 <= c <= 90 or 97 <= c <= 122 or c >= 192 for c in x)
    chars = lambda x: sum(c < 128 or c >= 192 for c in x)
    symbols = lambda x: sum(c in SYMBOL for c in x)
    words = WORD.findall(b)
    share = lambda a, n: math.asin(math.sqrt(min(max((a + 0.5) / (n + 1.0), 0), 1)))
    n = len(words)
    return [
        math.log1p(chars(b)), math.log1p(sum(map(chars, words)) / max(n, 1)), share(len(set(words)), n), share(upper(b), letters(b)),
        share(sum(48 <= c <= 57 for c in b), chars(b)), share(sum(c in PUNCT for c in b), chars(b)), share(symbols(b), chars(b)),
        share(b.count(b"\n"), chars(b)), share(sum(upper(w) >= 2 and upper(w) == letters(w) for w in words), n),
        share(sum(symbols(w) > 0 for w in words), n), share(sum(w[-1] in PUNCT for w in words), n), share(sum(chars(w) > 12 for w in words), n),
    ]


def test_quality_statistics_equal_plain_twin():
    texts = odd_texts() + random_texts(4, 20) + ["SHOUT it! #tag 12, x_y. Ünïcode-word; " * 3, "LONGWORDSAREHERE aB CD\nE.", "a　b"]
    got = quality.statistics(pa.array(texts, pa.string()))
    assert np.allclose(got, [plain_statistics(t) for t in texts], atol=1e-12)


def test_pooled_equals_plain_twin():
    """The largest activation of each filter over a text's own windows."""
    net = toxicity.TextCNN(seed=3)
    texts = pa.array(["a b c d a", "", "one", "x y", None, "b a " * 30], pa.string())
    ids, first = toxicity.word_ids(texts)
    best, at = net.pooled(net.embed(ids), first, where=True)
    for i in range(len(texts)):
        x = [np.concatenate([e[ids[p, k]] for k, e in enumerate(net.emb)]) for p in range(first[i], first[i + 1])]
        for k, (w, f) in enumerate(zip(toxicity.WIDTHS, net.filters)):
            for j in range(toxicity.FILTERS):
                acts = [sum(float(x[p + q] @ f[q][:, j]) for q in range(w)) + float(net.bias[k][j]) for p in range(len(x) - w + 1)]
                col = k * toxicity.FILTERS + j
                top = max([0.0, *acts])
                assert best[i, col] == pytest.approx(top, abs=1e-5)
                if top > 1e-4:
                    assert acts[at[i, col] - first[i]] == pytest.approx(top, abs=1e-5)
                elif not acts:
                    assert at[i, col] == -1
    want = [float(best[i] @ net.out + net.out_bias[0]) for i in range(len(texts))]
    assert np.allclose(net.logits(ids, first), want, atol=1e-5)


def test_training_learns_what_tells_the_classes_apart():
    texts = [f"calm {i} words here" for i in range(120)] + [f"vile {i} words here" for i in range(120)]
    y = np.array([0] * 120 + [1] * 120, np.float32)
    ids, first = toxicity.word_ids(pa.array(texts))
    net = toxicity.TextCNN()
    loss = lambda: float(np.mean(np.log1p(np.exp(-(2 * y - 1) * net.logits(ids, first)))))
    before = loss()
    net.fit(ids, first, y, np.arange(240))
    assert loss() < 0.1 * before
    score = net.score(*toxicity.word_ids(pa.array(["calm new text", "vile new text"])))
    assert score[0] < 0.3 < 0.7 < score[1]


def test_large_groups_go_to_the_least_loaded_shard(spark):
    """Groups that are all scheduled one by one: the heap's plain twin."""
    sizes = [900, 850, 850, 700, 640, 500, 430, 390, 310, 300, 220, 150]
    texts = [f"{chr(97 + i)}" * n for i, n in enumerate(sizes)] + ["a" * 900] * 2
    rows = sharding.shard_documents(spark, documents(spark, texts)).collect()
    size_of = {t: (len(t) + 1) * c for t, c in Counter(texts).items()}
    heap, want = [(0, s) for s in range(8)], defaultdict(int)
    for n in sorted(size_of.values(), reverse=True):
        load, shard = heapq.heappop(heap)
        heapq.heappush(heap, (load + n, shard))
        want[shard] = load + n
    got = defaultdict(int)
    for r in rows:
        got[r.shard] += r.size
    assert sorted(got.values()) == sorted(want.values())
