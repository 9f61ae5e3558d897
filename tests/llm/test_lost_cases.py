"""Cases that were once lost: short benchmark items, long white space, column
names in other letters, contradicting labels, languages without a cut."""

import numpy as np
import pytest

from tests.llm.helpers import documents
from tillscope.llm import decontamination, packing, toxicity
from tillscope.llm.queries import TOKENIZER


def test_items_of_few_words_match_by_exact_words(spark):
    items = ["Who wrote Hamlet?", "E = 12 kg", "Why?", "...", None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [
        "Tell me: who wrote Hamlet? I forgot.", "who wrote Macbeth?", "we know E = 12 kg there", "E = 13 kg", "They asked why, then left.",
        "Nothing of it", "wrote Hamlet who", None,
    ]
    rows = {r.doc_id: r for r in decontamination.decontamination(spark, documents(spark, texts), bench).collect()}
    assert [i for i in range(len(texts)) if rows[i].contaminated] == [0, 2, 4]
    assert all(rows[i].n_exact == 1 == rows[i].n_items for i in (0, 2, 4))
    left = {r.doc_id for r in decontamination.drop_contaminated(spark, documents(spark, texts), bench).collect()}
    assert left == {1, 3, 5, 6, 7}


@pytest.mark.parametrize("blank", [" ", "\n", " \n\t", " "])
def test_long_white_space_is_encoded(blank):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    encode = packing.Encoder(TOKENIZER)
    for n in (packing.RUN - 1, packing.RUN, 1_200_000 // len(blank)):
        text = f"a b{blank * n}c  d"
        assert np.frombuffer(encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_long_white_space_is_packed(spark):
    texts = ["a b c", " " * 1_500_000, "x" + "\n" * 1_000_000 + "y"]
    rows = packing.pack_documents(documents(spark, texts), TOKENIZER).collect()
    assert {r.doc_id for r in rows} == {0, 1, 2}
    for i in range(3):
        mine = [r for r in rows if r.doc_id == i]
        assert sum(r.length for r in mine) == mine[0].doc_tokens


def _labelled(n=400):
    texts = [f"some calm words number {i}" if i % 4 else f"vile trash talk number {i}" for i in range(n)]
    return texts, [(i, int(i % 4 == 0)) for i in range(n)]


def test_columns_in_other_letters(spark):
    texts, known = _labelled()
    docs = documents(spark, texts)
    labels = spark.createDataFrame(known, "doc_id long, toxic int")
    want = {r.doc_id for r in toxicity.drop_toxic(spark, docs, labels).collect()}
    other = docs.withColumnsRenamed({"lang": "Lang", "text": "TEXT", "doc_id": "Doc_Id"})
    out = toxicity.drop_toxic(spark, other, labels)
    assert out.columns == other.columns and {r.Doc_Id for r in out.collect()} == want
    assert want == {i for i, y in known if not y}


def test_contradicting_labels_teach_nothing(spark):
    rows = [(1, 0), (1, 1), (3, 1), (3, 1), (5, None), (5, 0), (None, 1)]
    known = toxicity.known_labels(spark.createDataFrame(rows, "doc_id long, toxic int"))
    ids = {r.doc_id: r.y for r in known.collect()}
    assert 1 not in ids and None not in ids
    assert {i: y for i, y in ids.items()} == {i: y for i, y in ((3, 1), (5, 0)) if i in ids}


def test_one_row_of_an_id_is_fitted_on(spark):
    texts, known = _labelled(120)
    docs = documents(spark, texts + ["zz vile words"] * 500, [*range(120), *[4] * 500])
    model = toxicity.fit(docs, toxicity.known_labels(spark.createDataFrame(known, "doc_id long, toxic int")), 60)
    assert len(model.used) == len(set(model.used.tolist())) <= 120


def test_languages_with_few_rows_use_the_common_cut(spark):
    """As many languages as rows: none has a cut of its own, two large ones do."""
    texts, known = _labelled(900)
    langs = [("aa", "bb")[i % 2] if i < 700 else f"l{i}" for i in range(900)]
    docs = documents(spark, texts, langs=langs)
    model, _ = toxicity.train(spark, docs, spark.createDataFrame(known, "doc_id long, toxic int"), 60)
    assert set(model.by_lang) <= {"aa", "bb"}
    assert {r.doc_id for r in toxicity.drop_toxic(spark, docs, spark.createDataFrame(known, "doc_id long, toxic int"), 60).collect()} == {i for i, y in known if not y}


def test_little_of_the_counters_is_held_by_the_driver(spark):
    """Count classes reach the driver as one byte a counter, the bitmap of
    wanted sets without a row object a word, and both hold what they should."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from tillscope.llm import jaccard

    words = [f"w{i}" for i in range(60000)]
    texts = [" ".join(words[i : i + 40]) for i in range(0, 59960, 10)] + ["a b c d"] * 300 + ["", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    tracemalloc.start()
    try:
        rare = jaccard.rarity(docs, 3)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    h = jaccard.Shingles(pa.array(texts), 3).h
    counts = np.bincount((h & jaccard.U(jaccard.COUNTERS - 1)).astype(np.int64), minlength=jaccard.COUNTERS)
    assert (rare == np.minimum(255, 6 * np.log2(1.0 + counts)).astype(np.uint8)).all() and rare.dtype == np.uint8
    assert peak < 5 * jaccard.COUNTERS  # 8 bytes a counter and their copies before

    sets = jaccard.Sets(jaccard.Shingles(pa.array(texts), 3), rare)
    some = sorted({int(k) for k, n in zip(sets.id, sets.size, strict=True) if n})[::7]
    got = jaccard.sets_of(spark, docs, spark.createDataFrame([(k,) for k in some], "k long"), rare, 3)
    found = {r.k for r in got.select("k").collect()}
    assert set(some) <= found and len(found) < len(some) * 1.2
    assert jaccard.sets_of(spark, docs, spark.createDataFrame([], "a long, b long"), rare, 3).count() == 0
