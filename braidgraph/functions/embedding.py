"""Turning text into vectors.

``hashed_embeddings`` is the built-in model: a hashed bag of words, normalised, all in
the JVM. ``batch_embeddings`` runs any model the user supplies over Arrow batches.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN_BREAK = r"[^\p{L}\p{N}]+"

Embedder = Callable[[list[str]], np.ndarray]


def hashed_embeddings(
    df: DataFrame, text: str = "value", output: str = "embedding", dimensions: int = 256
) -> DataFrame:
    """Add the unit-length hashed bag of words of ``text``; text without words gives null."""
    words = F.filter(F.split(F.lower(F.col(text)), TOKEN_BREAK), lambda word: word != "")
    tokens = F.coalesce(words, F.array().cast("array<string>"))
    counted = HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=dimensions)
    unit = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0)
    result = unit.transform(counted.transform(df.withColumn("_tokens", tokens)))
    vector = F.when(F.size("_tokens") > 0, vector_to_array("_unit"))
    return result.withColumn(output, vector).drop("_tokens", "_counts", "_unit")


def batch_embeddings(
    df: DataFrame, embedder: Embedder, text: str = "value", output: str = "embedding"
) -> DataFrame:
    """Add vectors computed by ``embedder``, which maps a list of texts to a matrix."""
    position = df.columns.index(text)
    result = T.StructType(
        [*df.schema.fields, T.StructField(output, T.ArrayType(T.DoubleType()))]
    )

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(position).to_pylist()]
            matrix = np.asarray(embedder(texts), dtype=np.float64)
            width = matrix.shape[1] if len(texts) else 0
            offsets = np.arange(len(texts) + 1, dtype=np.int32) * width
            vectors = pa.ListArray.from_arrays(offsets, matrix.ravel())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, vectors], names=[*batch.schema.names, output]
            )

    return df.mapInArrow(embed, result)


def embed_indexed(
    triples: DataFrame, attributes: tuple[str, ...], embedder: Embedder | None = None
) -> DataFrame:
    """Embed the values of the indexed attributes; other triples get no vector."""
    rows = triples.drop("embedding")
    indexed = F.col("attribute").isin(*attributes)
    if embedder is None:
        embedded = hashed_embeddings(rows.filter(indexed))
    else:
        embedded = batch_embeddings(rows.filter(indexed), embedder)
    plain = rows.filter(~indexed).withColumn(
        "embedding", F.lit(None).cast("array<double>")
    )
    return embedded.unionByName(plain)
