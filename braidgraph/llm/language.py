"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence about the language of a document are combined: the likelihood of
its text, the language its markup declares, the suffix of its address, and what is
usual on its host. All of their statistics are counted over the whole corpus. Hosts are
smoothed hierarchically: a host with few documents follows its suffix, and a suffix the
corpus.
"""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidgraph.llm.words import LOWER, text_bytes, text_slices
from braidgraph.plans.lineage import materialize

BUCKETS = 1 << 14
# Text weighed at once: temporary arrays take some fifty times as much.
SLICE_BYTES = 1 << 20
# A text counts as so many independent letters groups at most: neighbouring ones depend
# on each other, and other evidence must still be heard on long texts.
MOST_INDEPENDENT = 60.0
DEPENDENCE = 4.0
# Documents of a level that weigh as much as the level above.
HOST_WEIGHT = 20.0
DECLARED_WEIGHT = 5.0
ACCEPTED = 0.5
MOST_LANGUAGES = 200
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def groups(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the three-byte groups of each text that hold a letter, and row bounds.

    A-Z are lower-cased, and all bytes that are no letters look alike.
    """
    data, offsets = text_bytes(column)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(column) + 1, np.int64)
    letter = _LETTER[data]
    plain = np.where(letter, LOWER[data], 32).astype(np.uint32)
    with np.errstate(over="ignore"):
        mixed = plain[:-2] * _FACTORS[0] + plain[1:-1] * _FACTORS[1] + plain[2:] * _FACTORS[2]
        mixed = (mixed ^ (mixed >> np.uint32(15))) * _FACTORS[0]
    used = letter[:-2] | letter[1:-1] | letter[2:]
    for shift in (1, 2):
        cut = offsets[1:-1] - shift
        used[cut[(cut >= 0) & (cut < len(used))]] = False
    at = np.flatnonzero(used)
    return (mixed[at] >> np.uint32(18)).astype(np.int64), np.searchsorted(at, offsets)


def group_counts(docs: DataFrame, languages: list[str]) -> np.ndarray:
    """Counts of every bucket by declared language, over all documents."""
    known = {language: number for number, language in enumerate(languages)}

    def count(batches):
        total = np.zeros(len(languages) * BUCKETS, np.int64)
        for batch in batches:
            declared = [known.get(value, -1) for value in batch.column(0).to_pylist()]
            declared = np.array(declared, np.int64)
            for start, end in text_slices(batch.column(1), SLICE_BYTES):
                buckets, bounds = groups(batch.column(1).slice(start, end - start))
                owner = np.repeat(declared[start:end], np.diff(bounds))
                key = (owner * BUCKETS + buckets)[owner >= 0]
                total += np.bincount(key, minlength=len(total))
        seen = np.flatnonzero(total)
        for start in range(0, len(seen), 8192):
            part = seen[start : start + 8192]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(total[part])], names=["bucket", "n"]
            )

    counted = docs.select("declared", "text").mapInArrow(count, "bucket long, n long")
    result = np.zeros(len(languages) * BUCKETS, np.int64)
    # At most BUCKETS rows a language.
    found = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    result[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return result.reshape(len(languages), BUCKETS)


def log_likelihoods(counts: np.ndarray) -> np.ndarray:
    """Smoothed log probabilities by bucket; the last column is text of no language."""
    smooth = counts + 0.5
    known = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    none = np.full((1, counts.shape[1]), -np.log(counts.shape[1]))
    return np.ascontiguousarray(np.vstack([known, none]).T.astype(np.float32))


def text_evidence(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """Adds ``text_log``: the tempered log likelihood of the text by language."""
    shipped = docs.sparkSession.sparkContext.broadcast(table)
    columns = (
        "doc_id long, text_key long, declared string, host string, suffix string, "
        "text_log array<double>"
    )

    def weigh(batches):
        held = shipped.value
        for batch in batches:
            parts = []
            for start, end in text_slices(batch.column(5), SLICE_BYTES):
                buckets, bounds = groups(batch.column(5).slice(start, end - start))
                sums = np.zeros((end - start, held.shape[1]))
                sizes = np.diff(bounds)
                some = np.flatnonzero(sizes)
                if len(some):
                    for language in range(held.shape[1]):
                        values = held[buckets, language].astype(np.float64)
                        sums[some, language] = np.add.reduceat(values, bounds[:-1][some])
                means = sums / np.maximum(sizes, 1)[:, None]
                parts.append(means * np.minimum(sizes / DEPENDENCE, MOST_INDEPENDENT)[:, None])
            logs = np.concatenate(parts) if parts else np.zeros((0, held.shape[1]))
            offsets = np.arange(len(logs) + 1, dtype=np.int32) * held.shape[1]
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(logs.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], values],
                names=["doc_id", "text_key", "declared", "host", "suffix", "text_log"],
            )

    chosen = docs.select("doc_id", "text_key", "declared", "host", "suffix", "text")
    return chosen.mapInArrow(weigh, columns)


def address_parts(url: Column) -> tuple[Column, Column]:
    """Host and last label of the host of an address; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(host != "", host)
    return host, F.regexp_extract(host, r"([^.]+)$", 1)


def markup_language(html: Column) -> Column:
    """The main part of the lang attribute of the html element; null if there is none."""
    found = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)
    return F.when(found != "", F.lower(found))


def _main_part(code: Column) -> Column:
    return F.lower(F.regexp_extract(code, r"^\s*([^\s_-]*)", 1))


def identify(
    docs: DataFrame,
    declared: Column | None = None,
    host: Column | None = None,
    suffix: Column | None = None,
    text: str = "text",
    key: str = "doc_id",
    languages: Sequence[str] | None = None,
) -> DataFrame:
    """(doc_id, text_key, language, confidence, text_language, accepted) per row of ``docs``.

    The classes are the declared languages, or ``languages``, and ``und`` for text of
    none. Of a code such as en-US the main part counts; of more than ``MOST_LANGUAGES``
    codes the commonest are classes, and rows that declare another are judged by their
    other evidence. Evidence that is null says nothing. A null or empty text, and one without
    letters, is ``und``. A document is accepted if its language is not ``und`` and its
    probability is at least one half. Repeated rows are judged each; an empty table
    gives no rows; other columns of ``docs`` are left alone.
    """
    nothing = F.lit(None).cast("string")
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_key"),
        (nothing if declared is None else _main_part(declared)).alias("declared"),
        (nothing if host is None else host).alias("host"),
        (nothing if suffix is None else suffix).alias("suffix"),
        F.col(text).alias("text"),
    )
    if languages is None:
        found = rows.filter("declared != ''").groupBy("declared").count()
        found = found.orderBy(F.desc("count"), "declared").limit(MOST_LANGUAGES)
        languages = sorted(row["declared"] for row in found.collect())
        # A declaration of no class is no evidence.
        known = F.col("declared").isin(list(languages))
        rows = rows.withColumn("declared", F.when(known, F.col("declared")))
    classes = [*languages, UNKNOWN]
    table = log_likelihoods(group_counts(rows, list(languages)))
    seen = materialize(text_evidence(rows, table), "text-evidence")

    names = F.array(*[F.lit(name) for name in classes])
    best = F.array_position("text_log", F.array_max("text_log")).cast("int")
    empty = F.forall("text_log", lambda value: value == 0)
    seen = seen.withColumn(
        "text_language",
        F.when(empty, F.lit(UNKNOWN)).otherwise(F.element_at(names, best)),
    ).withColumn("empty", empty)

    overall = _overall(seen, classes)
    by_suffix = _shares(seen.filter("suffix is not null"), ["suffix"], classes, overall)
    by_host = _shares(seen.filter("host is not null"), ["host", "suffix"], classes, overall, by_suffix)
    declared_given = _declared(seen.filter("declared is not null"), classes)

    joined = (
        seen.join(
            by_suffix.select(F.col("suffix").alias("s"), F.col("shares").alias("by_suffix")),
            F.col("suffix") == F.col("s"),
            "left",
        )
        .join(
            by_host.select(
                F.col("host").alias("h"), F.col("suffix").alias("hs"), F.col("shares").alias("by_host")
            ),
            (F.col("host") == F.col("h")) & F.col("suffix").eqNullSafe(F.col("hs")),
            "left",
        )
        .join(declared_given.withColumnRenamed("declared", "d"), F.col("declared") == F.col("d"), "left")
    )
    flat = F.array(*[F.lit(0.0)] * len(classes))
    prior = F.coalesce("by_host", "by_suffix", overall)
    total = F.zip_with(
        F.zip_with("text_log", F.transform(prior, lambda share: F.log(share)), lambda a, b: a + b),
        F.coalesce("declared_log", flat),
        lambda a, b: a + b,
    )
    scored = joined.select("doc_id", "text_key", "text_language", "empty", total.alias("total"))
    top = F.array_max("total")
    mass = F.aggregate("total", F.lit(0.0), lambda sum_, value: sum_ + F.exp(value - top))
    place = F.array_position("total", top).cast("int")
    language = F.when(F.col("empty"), F.lit(UNKNOWN)).otherwise(F.element_at(names, place))
    return scored.select(
        "doc_id",
        "text_key",
        language.alias("language"),
        F.when(F.col("empty"), F.lit(1.0)).otherwise(1 / mass).alias("confidence"),
        "text_language",
    ).withColumn(
        "accepted", (F.col("language") != UNKNOWN) & (F.col("confidence") >= ACCEPTED)
    )


def _language_counts(seen: DataFrame, keys: list[str], classes: list[str]) -> DataFrame:
    counts = [
        F.sum(F.when(F.col("text_language") == language, 1.0).otherwise(0.0))
        for language in classes
    ]
    return seen.groupBy(*keys).agg(
        F.array(*counts).alias("counts"), F.count(F.lit(1)).cast("double").alias("n")
    )


def _overall(seen: DataFrame, classes: list[str]) -> Column:
    """Shares of the languages in the corpus, as one constant array."""
    row = _language_counts(seen, [], classes).first()
    even = 1.0 / len(classes)
    counts = [count or 0.0 for count in row["counts"]]
    return F.array(*[F.lit((count + even) / (row["n"] + 1.0)) for count in counts])


def _shares(
    seen: DataFrame,
    keys: list[str],
    classes: list[str],
    overall: Column,
    above: DataFrame | None = None,
) -> DataFrame:
    """Shares of the languages that the texts suggest, drawn towards the level above."""
    grouped = _language_counts(seen, keys, classes)
    parent = overall
    if above is not None:
        upper = above.select(F.col("suffix").alias("above_suffix"), F.col("shares").alias("upper"))
        grouped = grouped.join(upper, F.col("suffix") == F.col("above_suffix"), "left")
        parent = F.coalesce("upper", overall)
    share = F.zip_with(
        "counts", parent, lambda count, up: (count + HOST_WEIGHT * up) / (F.col("n") + HOST_WEIGHT)
    )
    return grouped.select(*keys, share.alias("shares"))


def _declared(seen: DataFrame, classes: list[str]) -> DataFrame:
    """Log probability of each declared language given the language of the text."""
    pairs = seen.groupBy("declared", "text_language").agg(F.count(F.lit(1)).alias("n"))
    totals = pairs.groupBy("text_language").agg(F.sum("n").alias("of"))
    every = pairs.join(totals, "text_language").groupBy("declared")
    logs = []
    for language in classes:
        here = F.col("text_language") == language
        n = F.coalesce(F.max(F.when(here, F.col("n"))), F.lit(0))
        of = F.coalesce(F.max(F.when(here, F.col("of"))), F.lit(0))
        share = (n + DECLARED_WEIGHT / len(classes)) / (of + DECLARED_WEIGHT)
        logs.append(F.log(share))
    return every.agg(F.array(*logs).alias("declared_log"))
