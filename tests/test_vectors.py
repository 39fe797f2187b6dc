import numpy as np
import pytest
from pyspark.ml.feature import HashingTF

from braidgraph.functions.embedding import batch_embeddings, embed_indexed, hashed_embeddings
from braidgraph.functions.predicates import is_
from braidgraph.graph import Graph
from braidgraph.operators import vectors
from braidgraph.operators.entities import EntityFilter, Hop
from helpers import graph


def brute_force(queries, items, k, skip=0, threshold=None):
    result = {}
    for query, asked in queries.items():
        best = {}
        for id_, vector in items:
            if vector is None or len(vector) != len(asked) or not np.linalg.norm(vector):
                continue
            cosine = np.dot(vector, asked) / np.linalg.norm(vector) / np.linalg.norm(asked)
            score = round((1 + cosine) / 2, 6)
            if threshold is None or score > threshold:
                best[id_] = max(best.get(id_, -1), score)
        ranked = sorted(best.items(), key=lambda item: (-item[1], item[0]))[skip:skip + k]
        result |= {(query, rank): item for rank, item in enumerate(ranked, 1)}
    return result


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    items = [(f"i{n % 150:03d}", rng.normal(size=8).tolist()) for n in range(200)]
    items += [("null", None), ("zero", [0.0] * 8), ("short", [1.0])]
    queries = {n: rng.normal(size=8).tolist() for n in range(7)}
    table = spark.createDataFrame(items, "id string, vector array<double>").repartition(5)
    asked = spark.createDataFrame(list(queries.items()), "query_id long, vector array<double>")
    return items, queries, table, asked


@pytest.mark.parametrize("batch", [1000, 2])
@pytest.mark.parametrize("k,skip,threshold", [(5, 0, None), (4, 3, None), (50, 0, 0.6)])
def test_top_k_equals_brute_force(data, batch, k, skip, threshold):
    items, queries, table, asked = data
    found = vectors.top_k(asked, table, k, skip, threshold, block_queries=batch)
    result = {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 6)) for r in found.collect()}
    assert result == brute_force(queries, items, k, skip, threshold)


def test_every_vector_as_a_query_gets_its_own_best(data):
    items, _, table, _ = data
    usable = [(id_, vector) for id_, vector in items if vector and any(vector)]
    asked = table.dropDuplicates(["id"]).select(table["id"].alias("query_id"), "vector")
    found = vectors.top_k(asked, table, 3, block_queries=16)
    queries = {r["query_id"]: r["vector"] for r in asked.collect() if r["vector"] and any(r["vector"])}
    result = {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 6)) for r in found.collect()}
    assert result == brute_force(queries, usable, 3)


def test_vectors_of_several_lengths_and_ties(spark):
    items = [(n, [1.0, float(n % 3)]) for n in range(40)] + [(100 + n, [1.0, 2.0, float(n % 2)]) for n in range(9)]
    queries = {1: [1.0, 1.0], 2: [1.0, 2.0, 1.0], 3: [0.0, 0.0]}
    table = spark.createDataFrame(items, "id long, vector array<double>").repartition(7)
    asked = spark.createDataFrame(list(queries.items()), "query_id long, vector array<double>")
    result = {
        (r["query_id"], r["rank"]): (r["id"], round(r["score"], 6))
        for r in vectors.top_k(asked, table, 5).collect()
    }
    del queries[3]
    assert result == brute_force(queries, items, 5)


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan parquet")


def test_vectors_are_scanned_once_however_many_queries(spark, data, tmp_path):
    _, _, table, _ = data
    table.write.parquet(f"{tmp_path}/vectors")
    stored = spark.read.parquet(f"{tmp_path}/vectors")
    asked = spark.createDataFrame([(n, [float(n), 1.0] * 4) for n in range(64)], "query_id long, vector array<double>")
    assert scans(vectors.top_k(asked, stored, 3, block_queries=2)) == 1


def test_no_usable_queries(spark, data):
    empty = spark.createDataFrame([], "query_id long, vector array<double>")
    assert vectors.top_k(empty, data[2], 3).count() == 0


def embedded_graph(spark):
    tables = graph(
        spark, [("a", "name", "s", "red house"), ("b", "name", "s", "blue house")],
        [("1", "a", "x", "in", "0", "s"), ("2", "b", "y", "in", "0", "s"),
         ("3", "x", "z", "in", "0", "s")],
    )
    triples = embed_indexed(tables.triples, ("name",))
    return Graph(triples, tables.relations, tables.entities, tables.vocabulary)


def test_search_and_follow(spark):
    tables = embedded_graph(spark)
    asked = hashed_embeddings(
        spark.createDataFrame([(1, "red house")], "query_id long, value string"), output="vector"
    ).select("query_id", "vector")
    best = vectors.search_entities(tables, asked, limit=1).first()
    assert (best["id"], round(best["score"], 6)) == ("a", 1.0)
    only_b = vectors.search_entities(tables, asked, EntityFilter(id=is_("b")), limit=5)
    assert [r["id"] for r in only_b.collect()] == ["b"]
    reached = vectors.search_and_follow(
        tables, asked, [Hop(is_("in")), Hop(is_("in"))], threshold=0.9
    )
    assert [r["id"] for r in reached.collect()] == ["z"]


def test_hashed_embedding_counts_words(spark):
    table = spark.createDataFrame([("One two, two!",), ("",)], "value string")
    found = [r["embedding"] for r in hashed_embeddings(table, dimensions=16).collect()]
    hashing = HashingTF(numFeatures=16)
    expected = np.zeros(16)
    np.add.at(expected, [hashing.indexOf("one"), hashing.indexOf("two")], [1, 2])
    assert np.allclose(found[0], expected / np.linalg.norm(expected))
    assert found[1] is None


def test_user_model_runs_on_batches(spark):
    table = spark.createDataFrame([("ab", 1), ("abcd", 2)], "value string, n int")
    lengths = lambda texts: np.array([[len(t), 1.0] for t in texts])
    found = batch_embeddings(table, lengths).collect()
    assert [(r["n"], r["embedding"]) for r in found] == [(1, [2.0, 1.0]), (2, [4.0, 1.0])]
