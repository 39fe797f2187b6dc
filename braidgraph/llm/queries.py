"""The registered queries of the operators, each over its whole table."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidgraph.llm import (
    alignment,
    compression,
    decontaminate,
    elias_fano,
    kdtree,
    language,
    neardup,
    packing,
    phrases,
    secrets,
    spelling,
    substring,
    toxicity,
)
from braidgraph.llm.labelled import held_out
from braidgraph.llm.oracles import ORACLES  # noqa: F401
from braidgraph.plans.lineage import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _register(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_register
def op1_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-corpus")
    elias_fano.write_corpus(_table(spark, sf_dir, "documents"), path, end_id=2)
    return elias_fano.read_documents(spark, path)


@_register
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, declared=F.col("lang"), host=F.col("source"))


@_register
def op2_language_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The web pages, with the language of their markup and the parts of their address."""
    declared, (host, suffix) = language.markup_language(F.col("html")), language.address_parts(F.col("url"))
    found = language.identify(
        _table(spark, sf_dir, "pages"), declared, host, suffix, text="html", key="page_id"
    )
    return found.withColumnRenamed("doc_id", "page_id")


@_register
def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


@_register
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), size=2048, end_id=1)


@_register
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


@_register
def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"), width=50)


@_register
def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@_register
def op8_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return kdtree.top_k(vectors.filter("vec_id % 50 = 0"), vectors, k=5)


def _scored(scores: DataFrame, parts: int, remainder: int, threshold: float) -> DataFrame:
    return scores.select(
        "doc_id",
        held_out(parts, remainder).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


@_register
def op9_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = compression.train(docs, labels, ~held_out(3, 1), "quality")
    return _scored(compression.score(docs, model), 3, 1, 0.5)


@_register
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, ~held_out(4, 2), "toxic")
    return _scored(toxicity.score(docs, model), 4, 2, 0.3)


@_register
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


@_register
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(_table(spark, sf_dir, "documents"))


@_register
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_repeated_bytes(_table(spark, sf_dir, "documents"), width=100)
