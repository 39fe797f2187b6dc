"""Documents that hold passages of a benchmark, by winnowing.

All of it is column expressions. The hashes of every ``gram`` words are winnowed: the
least hash of each run of ``span - gram + 1`` of them is a fingerprint, so any ``span``
equal words of two texts have one in common, whatever stands around them. Fingerprints
of documents and of the benchmark meet in a join; only there a document is looked at
again, and its words around the fingerprint are extended to whole windows, which must
equal a window of an item word by word.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidgraph.plans.lineage import materialize

SPAN = 10
GRAM = 5

_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Runs of digits, ASCII letters and all other characters, A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _UPPER.lower()), _APART), "")


def count_words(text: Column) -> Column:
    """How many words there are; the case of letters does not matter for that."""
    apart = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return F.greatest(F.size(F.array_remove(F.split(text, apart), "")), F.lit(0)).cast("long")


def _numbers(last: Column) -> Column:
    """0, 1, ... ``last``; none if it is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once and not inside every loop of ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_hashes(found: Column) -> Column:
    return F.transform(found, lambda word: F.xxhash64(word))


def _run_hash(hashes: Column, at: Column, most: int, size: Column | None = None) -> Column:
    """Hash of the run of ``most`` words from ``at``, or of ``size`` if that is less.

    Single elements are read: a slice would copy the whole array for every place.
    """
    parts = [F.get(hashes, at + k) for k in range(most)]
    if size is not None:
        # Nulls do not change the hash.
        parts = [F.when(size > k, part) for k, part in enumerate(parts)]
    return F.xxhash64(*parts)


def grams(hashes: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, from the words' hashes."""
    return F.transform(
        _numbers(F.size(hashes) - size), lambda at: _run_hash(hashes, at, size)
    )


def fingerprints(found: Column, gram: int, window: int) -> Column:
    """The different least hashes of all runs of ``window`` hashes of ``gram`` words."""

    def least_of(values: list[Column]) -> Column:
        return F.least(*values) if len(values) > 1 else values[0]

    def least(hashes: Column) -> Column:
        return F.transform(
            _numbers(F.size(hashes) - window),
            lambda at: least_of([F.get(hashes, at + k) for k in range(window)]),
        )

    return F.array_distinct(
        _let(word_hashes(found), lambda hashed: _let(grams(hashed, gram), least))
    )


def windows_of(items: DataFrame, span: int) -> DataFrame:
    """(item_id, size, window, words): windows of ``span`` words; shorter items are one."""
    worded = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(span))
    return (
        worded.withColumn("size", size)
        .withColumn("at", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))))
        .select(
            "item_id",
            "size",
            F.slice("w", F.col("at") + 1, F.col("size")).alias("words"),
        )
        .withColumn("window", F.array_join("words", " "))
    )


def _gram_of(size: int, gram: int) -> int:
    """Words of a fingerprint for windows of ``size``: shorter where the window is."""
    return min(gram, size)


def decontaminate(
    docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM
) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, n_items, items, contaminated) per row of ``docs``.

    ``items`` (item_id, text) are the benchmark. A document word is hit if it lies in an
    occurrence of a window of ``span`` consecutive words of an item, or of all words of a
    shorter item. Null and empty texts have no words: such documents are hit nowhere,
    such items hit nothing. Items that repeat are found each. Repeated documents are
    judged each. Empty tables are in order. Other columns are ignored; ``text_key``
    tells rows of one id apart.
    """
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text"
    )
    windows = materialize(windows_of(items, span), "item-windows")
    # At most ``span`` numbers.
    sizes = sorted(row["size"] for row in windows.select("size").distinct().collect())
    distinct = windows.groupBy("size", "window").agg(F.first("words").alias("words"))
    matched = None
    for size in sizes:
        width = _gram_of(size, gram)
        prints = fingerprints(words(F.col("text")), width, size - width + 1)
        own = distinct.filter(F.col("size") == size).select(
            F.explode(fingerprints(F.col("words"), width, size - width + 1)).alias("print")
        )
        seen = keyed.select("doc_id", "text_key", F.explode(prints).alias("print"))
        found = seen.join(own.distinct(), "print", "left_semi").select(
            "doc_id", "text_key", F.lit(size).alias("size"), "print"
        )
        matched = found if matched is None else matched.union(found)
    counted = keyed.select("doc_id", "text_key", count_words(F.col("text")).alias("n_words"))
    if matched is None:
        hits = docs.sparkSession.createDataFrame(
            [], "hit_id long, hit_key long, n_hit long, n_items long, items array<string>"
        )
    else:
        hits = _extended(matched, keyed, windows, gram)
    return (
        counted.join(
            hits,
            F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")),
            "left",
        )
        .select(
            "doc_id",
            "text_key",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def _extended(matched: DataFrame, keyed: DataFrame, windows: DataFrame, gram: int) -> DataFrame:
    """Whole windows around the fingerprints that documents share with the benchmark."""
    prints = materialize(
        matched.groupBy(
            F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), "size"
        ).agg(F.collect_set("print").alias("prints")),
        "matched",
    )
    texts = keyed.dropDuplicates(["doc_id", "text_key"]).join(
        prints,
        F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")),
    )
    worded = texts.select("hit_id", "hit_key", "size", "prints", words(F.col("text")).alias("w"))
    width = F.least("size", F.lit(gram))

    def around(held: Column) -> Column:
        """Starts of windows that hold a fingerprint: at most size - gram words before it."""
        places = F.filter(
            _numbers(F.size(held) - width),
            lambda at: F.array_contains("prints", _run_hash(held, at, gram, width)),
        )
        return F.transform(
            places,
            lambda at: F.sequence(
                F.greatest(at - F.col("size") + width, F.lit(0)),
                F.greatest(F.least(at, F.size(held) - F.col("size")), F.lit(0)),
            ),
        )

    starts = _let(word_hashes(F.col("w")), around)
    tried = worded.withColumn("start", F.explode(F.array_distinct(F.flatten(starts)))).select(
        "hit_id",
        "hit_key",
        "size",
        "start",
        F.array_join(F.slice("w", F.col("start") + 1, F.col("size")), " ").alias("window"),
    )
    kinds = windows.select("size", "window").distinct()
    found = materialize(tried.join(kinds, ["size", "window"], "left_semi"), "found")
    starts = found.groupBy("hit_id", "hit_key").agg(
        F.sort_array(F.collect_list(F.struct("start", "size"))).alias("spans")
    )
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "spans",
        nothing,
        lambda done, s: F.struct(
            (
                done["n"]
                + F.greatest(s["start"] + s["size"] - F.greatest(done["end"], s["start"]), F.lit(0))
            ).alias("n"),
            F.greatest(done["end"], s["start"] + s["size"]).alias("end"),
        ),
        lambda done: done["n"],
    )
    counted = starts.select("hit_id", "hit_key", covered.alias("n_hit"))
    named = (
        found.select("hit_id", "hit_key", "size", "window")
        .distinct()
        .join(windows.select("size", "window", "item_id").distinct(), ["size", "window"])
        .groupBy("hit_id", "hit_key")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
        .withColumnRenamed("hit_id", "item_hit_id")
        .withColumnRenamed("hit_key", "item_hit_key")
    )
    return counted.join(
        named,
        F.col("hit_id").eqNullSafe(F.col("item_hit_id")) & (F.col("hit_key") == F.col("item_hit_key")),
        "left",
    ).select("hit_id", "hit_key", "n_hit", F.size("items").cast("long").alias("n_items"), "items")
