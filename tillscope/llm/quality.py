"""Quality classifier: regularised quadratic discriminant analysis.

Statistics of the whole text (shares of character classes and word shapes,
lengths, distinct words) are transformed to be near normal: logarithms of
sizes, arcsine roots of shares. Each class has a Gaussian whose covariance is
shrunk towards the pooled one and towards a scaled identity. The score is the
difference of the two log densities, computed from Mahalanobis distances with
Cholesky factors that are made once, passed through a one-dimensional logistic
calibration.

The moments (counts, sums, sums of products) come from all labelled training
rows, added up by Spark. Only the calibration uses a bounded sample:
``CALIBRATE`` rows, those with the smallest hash of doc_id.

Nulls and ties: a null or empty text has the statistics of an empty text and
gets a score. Rows without a label, or with a null id, are never learned from;
repeated label rows count as often as they occur. Without both classes among
the training labels the score is the share of label 1 (0.5 without labels).
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.common import held_out, land, slices
from tillscope.llm.textnum import hash_spans, spans, SPACE, text_bytes

#: At most so many training rows are taken to the driver for the calibration.
CALIBRATE = 20_000
#: Shrinkage of a class covariance to the pooled one, and to the identity.
TO_POOLED, TO_IDENTITY = 0.2, 0.02

# Byte classes.
UPPER, DIGIT, PUNCT, SYMBOL, LETTER, LEAD = (1 << i for i in range(6))
CLASS = np.zeros(256, np.uint8)
CLASS[65:91] = UPPER | LETTER
CLASS[97:123] = LETTER
CLASS[192:] = LETTER
CLASS[48:58] = DIGIT
CLASS[list(b".,;:'-()\"?")] = PUNCT
CLASS[list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = SYMBOL
CLASS[:128] |= LEAD
CLASS[192:] |= LEAD

STATS = (
    "chars", "word_length", "distinct", "upper", "digit", "punct", "symbol", "newline", "caps_words", "symbol_words",
    "end_words", "long_words",
)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text."""
    buf, off = text_bytes(texts)
    cls = CLASS[buf]

    def per_text(x: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[off]).astype(float)

    starts, ends, first = spans(SPACE[buf], off)
    words = np.diff(first).astype(float)

    def per_word(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
        return total[ends] - total[starts]

    def words_with(x: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[first]).astype(float)

    letters, upper = per_word(cls & LETTER != 0), per_word(cls & UPPER != 0)
    length, symbols = per_word(cls & LEAD != 0), per_word(cls & SYMBOL != 0)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(first))
    h = hash_spans(buf, starts, ends)
    order = np.lexsort((h, owner))
    h, own = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    distinct = np.bincount(own[new], minlength=len(off) - 1).astype(float)
    chars = per_text(cls & LEAD != 0)
    share = lambda a, b: np.arcsin(np.sqrt(np.clip((a + 0.5) / (b + 1.0), 0, 1)))
    ended = (CLASS[buf[np.maximum(ends - 1, 0)]] & PUNCT) != 0 if len(ends) else np.zeros(0, bool)
    return np.column_stack([
        np.log1p(chars),
        np.log1p(words_with(length) / np.maximum(words, 1)),
        share(distinct, words),
        share(per_text(cls & UPPER != 0), per_text(cls & LETTER != 0)),
        share(per_text(cls & DIGIT != 0), chars),
        share(per_text(cls & PUNCT != 0), chars),
        share(per_text(cls & SYMBOL != 0), chars),
        share(per_text(buf == 10), chars),
        share(words_with((upper >= 2) & (upper == letters)), words),
        share(words_with(symbols > 0), words),
        share(words_with(ended), words),
        share(words_with(length > 12), words),
    ])


class Discriminant:
    """Two shrunk Gaussians with cached Cholesky factors, and the calibration."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], a: float = TO_POOLED, b: float = TO_IDENTITY):
        n = {c: m[0] for c, m in moments.items()}
        self.prior = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
        self.slope, self.shift = 1.0, 0.0
        self.parts = None
        if not (n.get(0) and n.get(1)):
            return
        total = sum(n.values())
        mean = sum(m[1] for m in moments.values()) / total
        spread = np.sqrt(np.maximum(np.diag(sum(m[2] for m in moments.values())) / total - mean**2, 1e-12))
        self.mean, self.spread = mean, spread
        cov, mu = {}, {}
        for c, (k, s, ss) in moments.items():
            mu[c] = (s / k - mean) / spread
            raw = ss / k - np.outer(s / k, s / k)
            cov[c] = raw / np.outer(spread, spread)
        pooled = sum(n[c] * cov[c] for c in cov) / total
        self.parts = {}
        for c in (0, 1):
            s = (1 - a) * cov[c] + a * pooled
            s = (1 - b) * s + b * max(np.trace(s) / len(s), 1e-6) * np.eye(len(s))
            low = np.linalg.cholesky((s + s.T) / 2)
            self.parts[c] = (mu[c], np.linalg.inv(low), 2 * np.log(np.diag(low)).sum())

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        z = (x - self.mean) / self.spread
        d = {}
        for c, (mu, inverse, logdet) in self.parts.items():
            d[c] = -0.5 * (((z - mu) @ inverse.T) ** 2).sum(1) - 0.5 * logdet
        return d[1] - d[0]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression of the label on the squashed log ratio."""
        if self.parts is None or len(set(y.tolist())) < 2:
            return
        t = squash(self.log_ratio(x))
        w, target = np.array([0.1, 0.0]), np.where(y > 0, 1 - 1e-3, 1e-3)
        f = np.column_stack([t, np.ones_like(t)])
        for _ in range(50):
            p = sigmoid(f @ w)
            g = f.T @ (p - target) + 1e-3 * w
            h = (f * (p * (1 - p))[:, None]).T @ f + 1e-3 * np.eye(2)
            w = w - np.clip(np.linalg.solve(h, g), -2, 2)
        if w[0] > 0:
            self.slope, self.shift = float(w[0]), float(w[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), self.prior)
        return sigmoid(self.slope * squash(self.log_ratio(x)) + self.shift)


def squash(t: np.ndarray) -> np.ndarray:
    """Odd and increasing: linear near 0, logarithmic far out."""
    return np.sign(t) * np.log1p(np.abs(t))


def sigmoid(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -40, 40)))


def stats_of(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics ``x`` of its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = statistics(part.column("text"))
                lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "x"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


def fit(train: DataFrame) -> Discriminant:
    """``train``: x and y. Moments over all rows by one aggregate."""
    k = len(STATS)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.sum(F.col("x")[i]) for i in range(k)] + [F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in pairs]
    moments = {}
    for row in train.groupBy("y").agg(F.count(F.lit(1)), F.array(*sums)).collect():  # a row per class
        v = np.array(row[2])
        ss = np.zeros((k, k))
        for (i, j), t in zip(pairs, v[k:], strict=True):
            ss[i, j] = ss[j, i] = t
        moments[row[0]] = (float(row[1]), v[:k], ss)
    model = Discriminant(moments)
    if model.parts is not None:
        some = train.orderBy(F.xxhash64("doc_id"), "y").limit(CALIBRATE).select("x", "y").toPandas()
        model.calibrate(np.stack(some["x"].to_numpy()), some["y"].to_numpy())
    return model


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; labels
    (doc_id, quality) are learned from outside the held-out fold only."""
    stats = land(spark, stats_of(docs), "quality-stats")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    model = fit(stats.join(known, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
