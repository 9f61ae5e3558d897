"""Small documents tables and brute-force twins."""

import random

from pyspark.sql import SparkSession, functions as F

#: Extra columns whose names clash with what operators use inside.
EXTRA = ["score", "h", "k", "r", "at", "cut_id", "found_id", "dropped_id", "component_id"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def documents(spark: SparkSession, texts, ids=None, langs=None):
    ids = list(range(len(texts))) if ids is None else ids
    langs = ["en"] * len(texts) if langs is None else langs
    rows = [(i, t, g, "s", None if t is None else len(t), *EXTRA) for i, t, g in zip(ids, texts, langs, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def labels(spark: SparkSession, n, column):
    return spark.createDataFrame([(i, i % 2) for i in range(n)], f"doc_id long, {column} int")


def odd_texts():
    """Null, empty, blank and very long texts, and repeated rows' text."""
    return [None, "", " \n\t ", "one", "word " * 60_000, "x" * 200_000, "line\n" * 20_000, "ünïcode ß 漢字 🎉", "one", "a\n\nb\r\nc"]


def words_of(text):
    return (text or "").encode().split()


def random_texts(seed, n, vocab=12, most=60, share=0.5):
    """Texts over few words, with copied runs and runs of one word."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        t = [f"w{r.randrange(vocab)}" for _ in range(r.randrange(most))]
        if out and r.random() < share:
            other = r.choice(out).split()
            a = r.randrange(len(other) + 1)
            at = r.randrange(len(t) + 1)
            t[at:at] = other[a : a + r.randrange(most)]
        if r.random() < 0.3:
            at = r.randrange(len(t) + 1)
            t[at:at] = [f"w{r.randrange(vocab)}"] * r.randrange(25)
        out.append(r.choice([" ", "  ", "\n"]).join(t))
    return out


def groups(n, links):
    """Smallest member of each of 0..n-1's component."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def read(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def planted(spark, folder):
    return read(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
