"""Rows that once gave a wrong result or stopped a query."""

import gc
import tracemalloc
import weakref

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from braidgraph.llm import compression, kdtree, labelled, language, neardup, spelling, substring, tokens, toxicity
from braidgraph.llm.words import words


def signs(size):
    """Two words of ``size`` letters whose difference cancels in sums over powers of two."""
    odd = [bin(i).count("1") % 2 for i in range(size)]
    return "".join("ab"[o] for o in odd), "".join("ba"[o] for o in odd)


def test_words_of_opposite_signs_differ(spark):
    a, b = signs(1024)
    hashes = words(pa.array([a, b])).hashes
    assert hashes[0] != hashes[1]
    docs = spark.createDataFrame([(1, f"{a} x y z"), (2, f"{b} x y z")], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, 3, 85).collect()}
    assert found == {1: 1, 2: 2}
    tail = " ".join(f"w{i}" for i in range(49))
    docs = spark.createDataFrame([(1, f"{a} {tail}"), (2, f"{b} {tail}")], "doc_id long, text string")
    assert {r["n_removed"] for r in substring.remove_repeats(docs, 50).collect()} == {0}


def test_an_id_of_two_texts_keeps_the_links_of_each(spark):
    base = [f"w{i}" for i in range(120)]
    changed = [*base[:60], "other", *base[61:]]
    long = [f"v{i}" for i in range(400)]
    rows = [(1, " ".join(base)), (1, " ".join(long)), (2, " ".join(changed)), (3, " ".join([*long[:200], "q", *long[201:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(docs, 3, 85).collect()}
    assert found == {(1, 1), (2, 1), (3, 1)}


def test_many_declared_codes(spark):
    rows = [(i, "the house is on the hill and the sea", f"x{i}") for i in range(language.MOST_LANGUAGES + 50)]
    rows += [(1000 + i, "the house is on the hill and the sea", code) for i, code in enumerate(["en", "en-US", "EN_gb"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.identify(docs, declared=F.col("lang")).collect()
    assert len(found) == len(rows)
    assert {r["language"] for r in found if r["doc_id"] >= 1000} == {"en"}


def test_huge_components_have_a_defined_score(spark):
    rows = [(0, [1e30, 0.0]), (1, [1e30, 1.0]), (2, [-1e30, 0.0]), (3, [1e308, 1e308]), (4, [0.5, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = kdtree.top_k(table.filter("vec_id = 0"), table, k=5).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in found][:2] == [(1, kdtree.MOST_SCORE), (3, kdtree.MOST_SCORE)]
    assert found[-1]["vec_id"] == 2 and found[-1]["score"] == kdtree.LEAST_SCORE


@pytest.mark.parametrize("operator", [compression, toxicity])
def test_evidence_late_in_long_texts_is_learned(spark, operator):
    draw = np.random.default_rng(5)
    filler = [" ".join(f"w{k}" for k in draw.integers(0, 400, 6000)) for _ in range(60)]
    marked = [" ".join(f"zork{k} grumble{k % 7}" for k in draw.integers(0, 90, 400)) for _ in range(30)]
    # Every text is far longer than 20,000 characters; the classes differ at the end alone.
    rows = [(i, text + " " + marked[i] if i < 30 else text) for i, text in enumerate(filler)]
    rows += [(0, rows[0][1])] * 20 + [(59, "another text of the id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(60)], "doc_id long, mark int")
    model = operator.train(docs, labels, F.lit(True), "mark")
    fresh = " ".join(f"w{k}" for k in draw.integers(0, 400, 6000))
    asked = [(1, fresh + " " + " ".join(marked[10].split()[::-1])), (2, fresh), (3, None)]
    found = operator.score(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()
    scores = {row["doc_id"]: row["score"] for row in found}
    assert scores[1] > 0.5 > scores[2]
    assert 0 <= scores[3] <= 1


def test_sample_takes_one_text_of_an_id(spark):
    rows = [(1, "a")] * 4 + [(1, "b"), (2, "c"), (3, None), (None, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1), (None, 1)], "doc_id long, mark int")
    sample = labelled.labelled_sample(docs, labels, "mark", F.lit(True), 10)
    assert sorted((r["doc_id"], r["label"]) for r in sample.collect()) == [(1, 1), (2, 0)]
    found = labelled.texts_of(docs, sample).groupBy("doc_id").agg(
        F.sum("weight").alias("w"), F.count_distinct("text").alias("n")
    )
    assert {r["doc_id"]: (r["w"], r["n"]) for r in found.collect()} == {1: (1.0, 1), 2: (1.0, 1)}


def test_sparse_and_dense_fits_agree():
    draw = np.random.default_rng(3)
    x = (draw.random((300, 12)) < 0.3).astype(float)
    y = (draw.random(300) < 1 / (1 + np.exp(-x @ np.linspace(-2, 2, 12)))).astype(float)
    rows, columns = np.nonzero(x)
    sparse = labelled.fit_sparse_logistic(rows, columns, np.ones(len(rows)), y, 12, 1e-3)
    assert np.allclose(sparse, labelled.fit_logistic(x, y, ridge=1e-3), atol=1e-4)


def test_pieces_stay_with_the_worker_for_its_next_task():
    text = tokens.vocabulary()
    first = tokens.shared_encoder(text)
    ids = first.encode(["several words of a text"])
    known = len(first._spaced)
    # A task gets its vocabulary as a new string.
    again = tokens.shared_encoder(text[:1] + text[1:])
    assert again.encode(["several words of a text"]) == ids
    assert again is first and len(again._spaced) == known > 0
    assert tokens.Encoder(text).encode(["several words of a text"]) == ids


def test_pieces_end_with_the_last_use_of_their_encoder():
    encoder = tokens.Encoder(tokens.vocabulary())
    assert encoder.encode(["words, and (marks)! behind them..."])[0]
    gc.disable()
    try:
        kept = weakref.ref(encoder._plain)
        del encoder
        assert kept() is None
    finally:
        gc.enable()


def test_sets_of_long_columns_take_little_memory():
    column = pa.array([" ".join(f"w{i}x{j}" for j in range(2000)) for i in range(400)])
    assert column.nbytes > 3 << 20
    tracemalloc.start()
    try:
        sizes = {len(shingles) for shingles in neardup._sets(column, 5)}
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sizes == {1996}
    assert peak < 100 << 20


def test_keys_of_words_are_not_broadcast(spark):
    # The plan takes the keys to be as small as the file of the words.
    table = [("house", 9), ("houses", 3), ("mouse", 2), ("horse", 1)]
    words_of = spark.createDataFrame(table, "word string, n long")
    near = spelling.near_pairs(words_of)
    found = spelling.variants(words_of)
    for df in (near, found):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert {frozenset((r["a"], r["b"])) for r in near.collect()} == {
        frozenset(("house", other)) for other in ("houses", "mouse", "horse")
    }
    assert {(r["word"], r["form"], r["root"]) for r in found.collect()} == {
        ("house", None, "house"), *((w, "house", "house") for w in ("houses", "mouse", "horse"))
    }
