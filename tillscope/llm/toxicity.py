"""Toxicity: a convolutional text classifier trained in numpy.

A word (A-Z lower-cased, ASCII punctuation at its ends cut off) is the
concatenation of hashed embeddings: two independent hashes of the word, so
that a rare word meets a learned one by chance in one half only, and a hash of
its first ``STEM`` bytes, shared by inflected forms. Filters of several widths
run over the words of the whole text; each filter's largest activation goes
into a logistic output. Training is Adagrad over mini-batches; max pooling
sends each gradient to one window.

The model is fitted on a bounded sample of the labelled training rows, at most
``PER_CLASS`` of each class with the smallest hash of doc_id, a fifth of which
is kept apart. The thresholds, one for each language that has ``LEAST_ROWS`` of
each class and the share ``LEAST_SHARE`` of all labelled rows (so at most 1 /
LEAST_SHARE), come from all labelled training rows outside the fit: they are
scored in Spark and counted by language, label and score level (``LEVELS``), and
weighted so that each class has its share among all labelled training rows,
whatever the fit took away. The language never enters a score.

Nulls and ties: a null or empty text has no windows and gets the score of the
bias alone. Rows with a null label or id are never learned from, nor are ids
whose labels contradict each other; of rows with one id, the smallest text is
fitted on. Without both
classes among the training labels the score is the share of label 1 (0 without
labels). Repeated rows are scored each; an empty table gives no rows. A null
language uses the threshold for all languages.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.llm.common import discard, fresh, held_out, land, released, slices
from tillscope.llm.textnum import hash_spans, LOWER, SPACE, spans, text_bytes, U

#: At most so many labelled rows of each class are used to fit the model.
PER_CLASS = 4_000
BITS, DIM, STEM = 16, 8, 4
ROW = np.uint16  # holds BITS bits
WIDTHS, FILTERS = (1, 2, 3), 8
EPOCHS, STEPS, BATCH, RATE = 6, 1_200, 32, 0.05

#: Where Adagrad's sums for an embedding row start: a word seen once moves little.
START = 1e-2
#: Log odds of this size start as 1 in an embedding.
ODDS = 4.0
#: Training texts that must have an embedding row for it to be learned.
LEAST_TEXTS = 4

#: Levels of the score's log odds, from -REACH to REACH, counted for thresholds.
LEVELS, REACH = 1 << 12, 16.0
#: Calibration rows of each class that a language needs for its own threshold.
LEAST_ROWS, LEAST_SHARE = 20, 1e-4

# A word's ends lose ASCII punctuation: these bytes separate words here.
CUT = SPACE.copy()
CUT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words, 3) embedding rows of all texts, and each text's first word (n + 1)."""
    buf, off = text_bytes(texts)
    buf = LOWER[buf]
    starts, ends, first = spans(CUT[buf], off)
    h = hash_spans(buf, starts, ends)
    stem = hash_spans(buf, starts, np.minimum(ends, starts + STEM), seed=2)
    mask = U((1 << BITS) - 1)
    return np.column_stack([h & mask, (h >> U(32)) & mask, stem & mask]).astype(ROW), first


def all_word_ids(texts: pa.Array, run: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """``word_ids`` of many texts, a few at a time."""
    parts = [word_ids(texts.slice(i, run)) for i in range(0, len(texts), run)]
    sizes = np.concatenate([np.diff(first) for _, first in parts])
    return np.concatenate([ids for ids, _ in parts]), np.concatenate([[0], np.cumsum(sizes)])


def word_runs(first: np.ndarray, words: int) -> Iterator[tuple[int, int]]:
    """Runs of texts [i, j) of about so many words, a longer text alone."""
    i, n = 0, len(first) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(first, first[i] + words, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class TextCNN:
    """Hashed embeddings, filters of several widths, max pooling, logistic output."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.emb = [r.normal(0, 0.05, (1 << BITS, DIM)).astype(np.float32) for _ in range(3)]
        self.filters = [r.normal(0, 0.1, (w, 3 * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:  # the first of each embedding's numbers starts as the word's log odds
            f[:, ::DIM] += 0.3
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = r.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.out_bias = np.zeros(1, np.float32)
        self.constant = None

    def embed(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([e[ids[:, k]] for k, e in enumerate(self.emb)], axis=1)

    def pooled(self, x: np.ndarray, first: np.ndarray, where: bool = False):
        """Per text and filter the largest activation (at least 0), and with
        ``where`` the window that has it (-1: none above 0)."""
        n = len(first) - 1
        best = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        at = np.full(best.shape, -1, np.int64) if where else None
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            rows = np.flatnonzero(np.diff(first) >= w)
            if not len(rows):
                continue
            act = x[: len(x) - w + 1] @ f[0]
            for j in range(1, w):
                act += x[j : len(x) - w + 1 + j] @ f[j]
            act += self.bias[k]
            # Windows over a text's end are cut out by reducing from its first
            # to its last full window only.
            edge = np.column_stack([first[rows], first[rows + 1] - w + 1]).ravel()
            act = np.concatenate([act, np.zeros((w, FILTERS), np.float32)])
            top = np.maximum.reduceat(act, edge, axis=0)[::2]
            best[rows, k * FILTERS : (k + 1) * FILTERS] = np.maximum(top, 0)
            if where:
                for i, row in enumerate(rows):
                    a = act[edge[2 * i] : edge[2 * i + 1]].argmax(0) + edge[2 * i]
                    at[row, k * FILTERS : (k + 1) * FILTERS] = np.where(top[i] > 0, a, -1)
        return best, at

    def logits(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(self.embed(ids), first)[0] @ self.out + self.out_bias[0]

    def score(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(ids, first).astype(float), -40, 40)))

    def fit(self, ids: np.ndarray, first: np.ndarray, y: np.ndarray, use: np.ndarray, seed: int = 11) -> None:
        """Train on the texts ``use`` (the arrays are not copied)."""
        r = np.random.default_rng(seed)
        size = np.diff(first)
        share = y[use].mean()
        weight = np.where(y > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)).astype(np.float32)
        sums = {"emb": [np.full(len(e), START, np.float32) for e in self.emb]}
        for name in ("filters", "bias"):
            sums[name] = [np.full(v.shape, 1e-2, np.float32) for v in getattr(self, name)]
        sums["out"], sums["out_bias"] = np.full(self.out.shape, 1e-2, np.float32), np.full(1, 1e-2, np.float32)

        # Rows that few texts have would only be learned by heart: they are 0.
        live, positive = [], y[use].sum()
        for k, e in enumerate(self.emb):
            pairs = [np.unique(ids[first[i] : first[i + 1], k]) for i in use]
            seen = np.concatenate(pairs)
            toxic = np.repeat(y[use], [len(p) for p in pairs])
            live.append(np.bincount(seen, minlength=len(e)) >= LEAST_TEXTS)
            a, b = (np.bincount(seen, w, minlength=len(e)) for w in (toxic, 1 - toxic))
            odds = np.log((a + 0.5) / (positive + 1)) - np.log((b + 0.5) / (len(use) - positive + 1))
            e[:, 0] = odds / ODDS
            e[~live[k]] = 0

        def step(value, total, grad):
            total += grad * grad
            value -= RATE * grad / np.sqrt(total)

        for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(use)))):
            order = use[r.permutation(len(use))]
            for part in np.array_split(order, max(1, len(order) // BATCH)):
                n = size[part]
                edge = np.concatenate([[0], np.cumsum(n)])
                rows = np.repeat(first[part] - edge[:-1], n) + np.arange(edge[-1])
                own = ids[rows]
                x = self.embed(own)
                best, at = self.pooled(x, edge, where=True)
                p = 1 / (1 + np.exp(-np.clip(best @ self.out + self.out_bias[0], -30, 30)))
                d = ((p - y[part]) * weight[part] / len(part)).astype(np.float32)
                back = d[:, None] * self.out * (at >= 0)
                dx: list[tuple[np.ndarray, np.ndarray]] = []
                for k, w in enumerate(WIDTHS):
                    cols = slice(k * FILTERS, (k + 1) * FILTERS)
                    text, flt = np.nonzero(at[:, cols] >= 0)
                    if not len(text):
                        continue
                    win, g = at[:, cols][text, flt], back[:, cols][text, flt]
                    gf = np.zeros_like(self.filters[k])
                    for j in range(w):
                        dx.append((win + j, g[:, None] * self.filters[k][j][:, flt].T))
                        np.add.at(gf[j].T, flt, g[:, None] * x[win + j])
                    step(self.filters[k], sums["filters"][k], gf)
                    step(self.bias[k], sums["bias"][k], np.bincount(flt, g, FILTERS).astype(np.float32))
                step(self.out, sums["out"], d @ best)
                step(self.out_bias, sums["out_bias"], d.sum(keepdims=True))
                if dx:
                    at_word, grad = np.concatenate([a for a, _ in dx]), np.concatenate([g for _, g in dx])
                    for k, e in enumerate(self.emb):
                        known = live[k][own[at_word, k]]
                        rows_k, inv = np.unique(own[at_word[known], k], return_inverse=True)
                        g = np.zeros((len(rows_k), DIM), np.float32)
                        np.add.at(g, inv, grad[known, k * DIM : (k + 1) * DIM])
                        sums["emb"][k][rows_k] += (g * g).mean(1)
                        e[rows_k] -= RATE * g / np.sqrt(sums["emb"][k][rows_k])[:, None]


def level(score: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        z = np.log(score) - np.log1p(-score)
    return np.clip((z / (2 * REACH) + 0.5) * LEVELS, 0, LEVELS - 1).astype(np.int32)


def best_threshold(clean: np.ndarray, toxic: np.ndarray, least: float = 0.05) -> float:
    """The cut with the largest F1 over (weighted) counts by level, in the
    middle of the gap below it."""
    used = np.flatnonzero(clean + toxic)[::-1]
    hit, n = np.cumsum(toxic[used]), np.cumsum((clean + toxic)[used])
    i = int((2 * hit / (n + toxic.sum())).argmax())
    edge = lambda k: 1 / (1 + np.exp(-(k / LEVELS - 0.5) * 2 * REACH))
    return float(max(least, (edge(used[i]) + (edge(used[i + 1] + 1) if i + 1 < len(used) else 0)) / 2))


class Toxicity:
    """The fitted network, the ids it was fitted on and its thresholds by language."""

    def __init__(self, texts: pa.Array, ids: np.ndarray, y: np.ndarray, default: float = 0.3):
        self.net, self.threshold, self.by_lang = TextCNN(), default, {}
        self.used = np.zeros(0, np.int64)
        if len(set(y.tolist())) < 2:
            self.net.constant = float(y.mean()) if len(y) else 0.0
            return
        words, first = all_word_ids(texts)
        use = np.flatnonzero(np.arange(len(y)) % 5 != 4)
        self.net.fit(words, first, y.astype(np.float32), use)
        self.used = np.unique(ids[use])

    def calibrate(self, spark: SparkSession, scored: DataFrame, known: DataFrame) -> None:
        """Thresholds from all labelled rows outside the fit. The driver gets
        counts by level and label, and a number for each language that has a
        threshold of its own."""
        if self.net.constant is not None:
            return
        counts = scored.join(known, "doc_id").groupBy("lang", "level", "y").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(~F.col("used")).alias("own")
        )
        counts = land(spark, counts, "toxicity-counts")
        every = np.zeros((2, 2, LEVELS))  # (all or outside the fit, label, level)
        for r in counts.groupBy("level", "y").agg(F.sum("n").alias("n"), F.sum("own").alias("own")).collect():
            every[:, r["y"], r["level"]] = r["n"], r["own"]
        if every[1].sum(1).min() == 0:
            return
        self.threshold = weighted_threshold(every)
        own = [F.sum(F.when(F.col("y") == y, F.col("own")).otherwise(0)) for y in (0, 1)]
        enough = counts.where("lang is not null").groupBy("lang").agg(F.least(*own).alias("least"), F.sum("n").alias("all"))
        enough = enough.where((F.col("least") >= LEAST_ROWS) & (F.col("all") >= LEAST_SHARE * every[0].sum())).select("lang")

        def cut(group: pa.Table) -> pa.Table:  # at most 2 * LEVELS rows
            c = np.zeros((2, 2, LEVELS))
            c[:, group["y"].to_numpy(), group["level"].to_numpy()] = group["n"].to_numpy(), group["own"].to_numpy()
            return pa.table({"lang": group["lang"][:1], "cut": [weighted_threshold(c)]})

        cuts = counts.join(enough, "lang").groupBy("lang").applyInArrow(cut, "lang string, cut double")
        self.by_lang = {r["lang"]: r["cut"] for r in cuts.collect()}  # at most 1 / LEAST_SHARE
        discard(spark, counts)


def weighted_threshold(c: np.ndarray) -> float:
    """The best threshold by counts outside the fit, (all or own, label, level),
    weighted to each label's real share."""
    return best_threshold(*(c[1] * (c[0].sum(1) / c[1].sum(1))[:, None]))


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, y) of the labels that may be learned from."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id")
    return known.agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[Toxicity, DataFrame]:
    """The model with its thresholds, and ``scores`` of all rows, landed."""
    known = known_labels(labels)
    model = fit(docs, known, per_class)
    scored = land(spark, scores(docs, model), "toxicity-scores")
    model.calibrate(spark, scored, known)
    return model, scored


def fit(docs: DataFrame, known: DataFrame, per_class: int) -> Toxicity:
    """Fit on at most ``per_class`` labelled rows of each class outside the
    held-out fold: ids are chosen first, then their texts are fetched into one
    task, which sends the driver the model alone."""
    rank = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = known.where("y = 1").orderBy(*rank).limit(per_class).union(known.where("y = 0").orderBy(*rank).limit(per_class))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = text.join(F.broadcast(some), "doc_id")  # at most 2 * per_class ids
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)  # at most 2 * per_class rows
        model = pickle.dumps(fitted(pa.Table.from_batches(parts) if parts else SAMPLE.empty_table()))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    models = rows.select("doc_id", "text", "y").mapInArrow(run, "model binary").collect()
    return pickle.loads(models[0]["model"]) if models else fitted(SAMPLE.empty_table())


SAMPLE = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("y", pa.int32())])


def fitted(rows: pa.Table) -> Toxicity:
    """The model of a sample, in one order whatever order the rows came in."""
    key = pa.array((rows["doc_id"].to_numpy() * 2654435761) % 1_000_003, pa.int64())
    order = pc.sort_indices(rows.append_column("k", key), [(c, "ascending") for c in ("k", "doc_id", "text")])
    rows = rows.take(order).combine_chunks()
    text = rows["text"].chunk(0) if rows.num_rows else pa.array([], pa.string())
    return Toxicity(text, rows["doc_id"].to_numpy(), rows["y"].to_numpy().astype(int))


def scores(docs: DataFrame, model: Toxicity) -> DataFrame:
    """doc_id, lang, score, its level and whether the row's id was fitted on."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                ids, first = word_ids(part.column("text"))
                score = model.net.score(ids, first)
                used = pc.fill_null(pc.is_in(part.column("doc_id"), pa.array(model.used)), False)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("lang"), pa.array(score), pa.array(level(score)), used],
                    names=["doc_id", "lang", "score", "level", "used"],
                )

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(lang as string) lang", "text")
    return rows.mapInArrow(run, "doc_id long, lang string, score double, level int, used boolean")


def toxicity_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, rejected (the score reaches its
    language's threshold) of every row of ``docs``."""
    model, scored = train(spark, docs, labels)
    cuts = spark.createDataFrame(list(model.by_lang.items()), "lang string, cut double")
    scored = scored.join(F.broadcast(cuts), "lang", "left")
    cut = F.coalesce("cut", F.lit(model.threshold))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), (F.col("score") >= cut).alias("rejected"),
    )


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is below its language's
    threshold. Rows are scored once and landed with their scores, so ids may
    repeat or be null."""
    known = known_labels(labels)
    model = fit(docs, known, per_class)
    at = {c.lower(): i for i, c in enumerate(docs.columns)}
    lang, text, ident = at["lang"], at["text"], at["doc_id"]
    key, score, grade, used = (fresh(docs, c) for c in ("key", "score", "level", "used"))
    docs_text = docs.columns[text]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, docs_text, 1 << 19):
                s = model.net.score(*word_ids(part.column(text)))
                fitted_on = pc.fill_null(pc.is_in(part.column(key), pa.array(model.used)), False)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(s), pa.array(level(s)), fitted_on], names=[*part.schema.names, score, grade, used]
                )

    rows = docs.withColumn(key, F.col(docs.columns[ident]).try_cast("long"))
    kind = T.StructType([*rows.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(grade, T.IntegerType()), T.StructField(used, T.BooleanType())])
    scored = land(spark, rows.mapInArrow(run, kind), "toxicity-rows")
    model.calibrate(
        spark,
        scored.select(
            F.col(key).alias("doc_id"), F.col(docs.columns[lang]).cast("string").alias("lang"),
            F.col(grade).alias("level"), F.col(used).alias("used"),
        ),
        known,
    )
    by, cut = fresh(scored, "cut_lang"), fresh(scored, "cut")
    cuts = spark.createDataFrame(list(model.by_lang.items()), T.StructType([T.StructField(by, T.StringType()), T.StructField(cut, T.DoubleType())]))
    out = scored.join(F.broadcast(cuts), F.col(docs.columns[lang]).cast("string") == F.col(by), "left")
    return out.where(F.col(score) < F.coalesce(cut, F.lit(model.threshold))).select(*docs.columns)
