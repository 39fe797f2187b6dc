"""Quality scores by compression with dictionaries of good and of bad text.

Two zstandard dictionaries hold good and bad labelled text. A text that is like the good
ones becomes smaller with the good dictionary. The difference of the two sizes, divided
by their sum, is made a probability by logistic regression on labelled rows that are not
in the dictionaries. How well a text compresses at all goes into the same calibration,
since a difference means more in a text that repeats little. Labelled texts are cut and
compressed in tasks; the driver gets dictionary pieces and two numbers a row.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidgraph.llm.labelled import fit_logistic, labelled_sample, sigmoid, texts_of
from braidgraph.plans.lineage import materialize

# The bound of the training sample: rows of a class. Of these the first by hash of the
# id, half at most, give the dictionary, and all others the calibration.
TRAIN_ROWS = 3000
DICTIONARY_ROWS = 512
# What zstandard searches at this level. Each row gives an equal share, in pieces from
# evenly spaced places of the whole text.
DICTIONARY_BYTES = 1 << 17
PIECE = 128
# Texts are compressed in blocks of this size, all of them, so that the dictionary
# matters as much at the end of a long text as at its start.
BLOCK = 1024
LEVEL = 3

SCORES = "doc_id long, score double"


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    weights: np.ndarray

    def __post_init__(self) -> None:
        self._coders = [_coder(dictionary) for dictionary in (self.good, self.bad)]

    def __reduce__(self):
        return CompressionModel, (self.good, self.bad, self.weights)

    def features(self, text: str | None) -> list[float]:
        return _features(self._coders, text)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.array([self.features(text) for text in texts])
        return sigmoid(x @ self.weights[:-1] + self.weights[-1])


def _coder(content: bytes):
    if not content:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_dict_id=False)


def _features(coders: list, text: str | None) -> list[float]:
    """Normalised difference of the two sizes, and the sizes against the text's own."""
    data = (text or "").encode()
    if not data:
        return [0.0, 1.0]
    blocks = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
    good, bad = (sum(len(coder.compress(block)) for block in blocks) for coder in coders)
    return [(bad - good) / (bad + good), min(good, bad) / len(data)]


def _pieces(text: str, share: int) -> bytes:
    """``share`` bytes of a text in pieces from evenly spaced places, or all of a short one."""
    data = text.encode()
    if len(data) <= share:
        return data
    number = max(2, share // PIECE)
    starts = np.linspace(0, len(data) - share // number, number).astype(int)
    return b"\n".join(data[at : at + share // number] for at in starts)


def _dictionaries(docs: DataFrame, sample: DataFrame) -> dict[int, bytes]:
    """Per class the pieces of its rows in order of their place; the last bytes are the nearest."""
    counts = {row["label"]: row["n"] for row in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = {value: DICTIONARY_BYTES // n for value, n in counts.items()}

    def cut(batches):
        for batch in batches:
            label, place, text = (batch.column(name).to_pylist() for name in ("label", "place", "text"))
            pieces = [_pieces(t, shares[value]) for value, t in zip(label, text)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(label, pa.int32()), pa.array(place, pa.int64()), pa.array(pieces, pa.binary())],
                names=["label", "place", "piece"],
            )

    # At most DICTIONARY_ROWS pieces of a class once repeated rows are one.
    found = texts_of(docs, sample).select("label", "place", "text")
    found = found.mapInArrow(cut, "label int, place long, piece binary")
    found = found.groupBy("label", "place").agg(F.min("piece").alias("piece")).collect()
    parts = sorted((row["label"], row["place"], bytes(row["piece"])) for row in found)
    return {value: b"\n".join(part for own, _, part in parts if own == value) for value in (0, 1)}


def _measured(docs: DataFrame, sample: DataFrame, model: CompressionModel) -> list:
    """(label, features) of each row of the sample, from its whole text."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.good, model.bad, model.weights))

    def run(batches):
        held = CompressionModel(*shipped.value)
        for batch in batches:
            features = [held.features(text) for text in batch.column(2).to_pylist()]
            apart, size = ([row[k] for row in features] for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(apart, pa.float64()), pa.array(size, pa.float64())],
                names=["doc_id", "label", "apart", "size"],
            )

    chosen = texts_of(docs, sample).select(F.col("doc_id").cast("long"), "label", "text")
    found = chosen.mapInArrow(run, "doc_id long, label int, apart double, size double")
    return sorted(found.distinct().collect())


def train(docs: DataFrame, labels: DataFrame, allowed: Column, label: str) -> CompressionModel:
    """Fit on a bounded sample of allowed rows; up to half of it fills the dictionaries.

    With a class missing, every text gets the share of the classes that are there.
    """
    sample = labelled_sample(docs, labels, label, allowed, TRAIN_ROWS)
    per_class = Window.partitionBy("label")
    ranked = sample.withColumn("n", F.count(F.lit(1)).over(per_class)).withColumn(
        "rank", F.row_number().over(per_class.orderBy("place"))
    )
    inside = F.col("rank") <= F.least(F.floor(F.col("n") / 2), F.lit(DICTIONARY_ROWS))
    ranked = materialize(ranked.withColumn("inside", inside).drop("n", "rank"), "ranked")
    dictionaries = _dictionaries(docs, ranked.filter("inside"))
    model = CompressionModel(dictionaries[1], dictionaries[0], np.zeros(3))
    rest = _measured(docs, ranked.filter("not inside"), model)
    targets = np.array([row["label"] for row in rest], float)
    if len(set(targets)) < 2:
        share = targets.mean() if len(targets) else 0.5
        model.weights[-1] = np.log((share + 0.01) / (1.01 - share))
        return model
    x = np.array([[row["apart"], row["size"]] for row in rest])
    model.weights = fit_logistic(x, targets, ridge=1e-6)
    # The sample holds the classes in other shares than the labels do.
    totals = {
        row["y"]: row["n"]
        for row in labels.filter(allowed & F.col(label).isin(0, 1))
        .groupBy(F.col(label).cast("int").alias("y"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    }
    ones = targets.sum()
    model.weights[-1] += np.log(totals[1] / totals[0]) - np.log(ones / (len(targets) - ones))
    return model


def score(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """(doc_id, score) of every whole text.

    Null and empty texts have no difference and get the score of that. Repeated rows
    are scored each; an empty table gives no rows; other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(
        (model.good, model.bad, model.weights)
    )

    def run(batches):
        held = CompressionModel(*shipped.value)
        for batch in batches:
            scores = np.concatenate(
                [held.score(batch.column(1).slice(at, 256).to_pylist()) for at in range(0, len(batch), 256)]
                or [np.zeros(0)]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores)], names=["doc_id", "score"]
            )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(run, SCORES)
