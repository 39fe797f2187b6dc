"""A training corpus from raw documents, in stages that are written and read again.

Language identification drops documents of no language, near-duplicate detection keeps
one of each group, decontamination drops documents with benchmark passages, the secret
scan replaces secrets, and packing lays the rest out in sequences.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidgraph.llm import decontaminate, language, neardup, packing, secrets
from braidgraph.plans.lineage import materialize


def _without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """``docs`` but for the rows named by ``gone`` (gone_id, gone_key).

    ``gone`` is written first, so that its true size decides how the join is done.
    """
    gone = materialize(gone, name)
    same = docs["doc_id"].eqNullSafe(gone["gone_id"]) & (
        F.xxhash64(docs["text"]) == gone["gone_key"]
    )
    return docs.join(gone, same, "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages of the corpus."""
    found = language.identify(docs, declared=F.col("lang"), host=F.col("source"))
    rejected = found.filter(~F.col("accepted"))
    gone = rejected.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"))
    return _without(docs, gone.distinct(), "rejected")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, four fifths alike."""
    found = materialize(neardup.near_duplicates(docs, width=5, percent=80), "groups")
    copies = materialize(
        found.filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct(), "copies"
    )
    kept = docs.join(copies, docs["doc_id"] == copies["gone_id"], "left_anti")
    # Rows that repeat a document with its id.
    again = found.filter("doc_id is not null").groupBy(F.col("doc_id").alias("again_id"))
    again = again.agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("again_id")
    again = materialize(again, "repeated")
    if again.isEmpty():
        return kept
    same = kept["doc_id"] == again["again_id"]
    repeated = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, same, "left_anti").unionByName(repeated)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(docs, benchmark).filter("contaminated")
    gone = found.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"))
    return _without(docs, gone.distinct(), "contaminated")


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced; n_chars follows the text."""
    found = secrets.scan(docs).filter(F.size("spans") > 0)
    found = found.select(
        F.col("doc_id").alias("secret_id"), F.col("text_key").alias("secret_key"), F.col("spans").alias("secret_spans")
    )
    found = materialize(found.dropDuplicates(["secret_id", "secret_key"]), "secrets")
    same = docs["doc_id"].eqNullSafe(found["secret_id"]) & (
        F.xxhash64(docs["text"]) == found["secret_key"]
    )
    joined = docs.join(found, same, "left")
    spans = F.coalesce("secret_spans", F.array().cast(found.schema["secret_spans"].dataType))
    text = secrets.redacted(docs["text"], spans)
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(text.alias("text"))
        elif name == "n_chars":
            changed = F.length(text).cast(docs.schema["n_chars"].dataType)
            n_chars = F.when(F.size(spans) > 0, changed).otherwise(docs["n_chars"])
            columns.append(n_chars.alias("n_chars"))
        else:
            columns.append(docs[name])
    return joined.select(*columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with its sequence and place there."""
    return packing.pack(docs, size=2048, end_id=1)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", replace_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
