"""Spelling variants: words one edit apart, by pivotal grams.

Bigrams are ordered by the number of words that hold them, rare ones first. A word's
prefix is its three rarest bigrams, with all ties of the third. One edit breaks at most
two neighbouring bigrams, so of two disjoint pivots out of the prefix one survives, and
if the word's last prefix bigram isn't later than the other word's, the survivor is in
the other word's prefix as well. What stands on one side of the survivor is then equal
in both words: position limits in their strictest form. The other side is dealt out in
blocks of two letters, of which the edit touches one; a key is all that stands around
that block. Keys of pivots meet keys of prefixes in an equi-join, and an edit distance
decides.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidgraph.plans.lineage import materialize

# Letters of a block: one edit lies in one block, or between two.
BLOCK = 2
ROUNDS = 64

# The letters of a run, and the divisor of the spelling slips.
_RUN = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLIP = 97


def word_counts(
    docs: DataFrame, shortest: int = 5, least: int = 3, slip: int | None = SLIP
) -> DataFrame:
    """(word, n): the words of at least ``shortest`` letters with ``least`` occurrences.

    With ``slip``, a document misspells the runs whose crc32 with its id is divisible by
    it, by leaving out one letter; a row without an id misspells nothing.
    """
    runs = F.regexp_extract_all("text", F.lit(f"({_RUN})"), 1)
    found = docs.select(F.col("doc_id").alias("doc_id"), F.explode(runs).alias("run"))
    # Leaving a letter out only shortens a run.
    found = found.filter(F.length("run") >= shortest)
    run = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER))
    found = found.select("doc_id", F.coalesce(run, "run").alias("run"))
    word = F.col("run")
    if slip:
        found = found.withColumn("h", F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), "run")))
        at = (F.col("h") % F.length("run")).cast("int")
        without = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        slips = F.col("doc_id").isNotNull() & (F.col("h") % slip == 0)
        word = F.when(slips, without).otherwise(word)
    words = found.select(word.alias("word")).filter(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _gram_ranks(words: DataFrame) -> dict[str, int]:
    """Bigrams by the number of words that hold them, rare ones first.

    They come to the driver: an alphabet of 90 letters has 8,100.
    """
    places = F.sequence(F.lit(1), F.length("word") - 1)
    grams = F.array_distinct(F.transform(places, lambda i: F.substring("word", i, F.lit(2))))
    counts = words.select(F.explode(grams).alias("gram")).groupBy("gram").count().collect()
    order = sorted((row["count"], row["gram"]) for row in counts)
    return {gram: rank for rank, (_, gram) in enumerate(order)}


def pivots(ranks: list[int], prefix: list[int]) -> tuple[int, int]:
    """The places of two disjoint bigrams of the prefix with the least sum of ranks.

    ``prefix`` holds places in order. Going through them, the rarest single bigram that
    ends before the next one is kept, and with it the best pair so far.
    """
    best = None
    single, ahead = None, 0
    for place in prefix:
        while prefix[ahead] <= place - 2:
            if single is None or ranks[prefix[ahead]] < ranks[single]:
                single = prefix[ahead]
            ahead += 1
        if single is not None:
            pair = (ranks[single] + ranks[place], single, place)
            best = pair if best is None or pair < best else best
    return best[1:]


def _probe_keys(word: str, end: int, side: str) -> Iterator[tuple[str, int]]:
    """Keys of a word of which all before ``end`` is taken as equal, with their blocks."""
    while end <= len(word):
        yield f"{side}{word[:end]}|{word[end + BLOCK:]}", end
        end += BLOCK


def _index_keys(word: str, end: int, side: str) -> Iterator[str]:
    """The keys that a word one edit away may have: its block is up to a letter longer."""
    while end <= len(word):
        for rest in {word[end + BLOCK + more :] for more in (-1, 0, 1)}:
            yield f"{side}{word[:end]}|{rest}"
        end += BLOCK


def _keys(word: str, ranks: dict[str, int]) -> tuple[int, int, list, set]:
    """Rank of the last prefix bigram, end of the left pivot, probe keys, index keys."""
    grams = [ranks[word[i : i + 2]] for i in range(len(word) - 1)]
    last = sorted(grams)[2]
    prefix = [place for place, rank in enumerate(grams) if rank <= last]
    left, right = pivots(grams, prefix)
    back, size = word[::-1], len(word)
    probes = [*_probe_keys(word, left + 2, "<"), *_probe_keys(back, size - right, ">")]
    index = {key for place in prefix for key in _index_keys(word, place + 2, "<")}
    index |= {key for place in prefix for key in _index_keys(back, size - place, ">")}
    return last, left + 2, probes, index


_KEY_ROWS = pa.schema(
    [("key", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("last", pa.int32())]
    + [("head", pa.int32()), ("block", pa.int32()), ("later", pa.bool_())]
)
_KEY_SHAPE = "key string, word string, n long, last int, head int, block int, later boolean"


def _key_rows(words: DataFrame, ranks: dict[str, int], probe: bool) -> DataFrame:
    """A row per key: of the pivots if ``probe``, with the end of the left pivot, the start
    of the key's block counted from the key's side, and whether a block stands before it."""

    def rows(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                out = []
                for word, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    last, head, probes, index = _keys(word, ranks)
                    if probe:
                        ends = {"<": head, ">": min(end for key, end in probes if key[0] == ">")}
                        out += [(key, word, n, last, head, end, end > ends[key[0]]) for key, end in probes]
                    else:
                        out += [(key, word, n, last, None, None, None) for key in index]
                if out:
                    arrays = [pa.array(c, f.type) for c, f in zip(zip(*out), _KEY_ROWS)]
                    yield pa.RecordBatch.from_arrays(arrays, schema=_KEY_ROWS)

    return words.select("word", "n").mapInArrow(rows, _KEY_SHAPE)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words one edit apart, once, from (word, n).

    Words have five letters at least, so that three bigrams exist.
    """
    ranks = _gram_ranks(words)
    renamed = {"word": "a", "n": "n_a", "last": "last_a"}
    probes = _key_rows(words, ranks, True).withColumnsRenamed(renamed)
    index = _key_rows(words, ranks, False).select(
        "key", F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("last").alias("last_b")
    )
    # A word has many keys, whatever the plan takes them for by its size: no broadcast.
    near = probes.join(index.hint("shuffle_merge"), "key").filter(F.abs(F.length("a") - F.length("b")) <= 1)
    # Pairs with the same last bigram would be found from both words.
    same = (F.col("last_a") == F.col("last_b")) & (F.col("a") < F.col("b"))
    near = near.filter((F.col("last_a") < F.col("last_b")) | same)
    # Of several keys that a pair shares one counts: a key from the left goes before those
    # from the right, and an edit between two blocks belongs to the first of them.
    tail = F.substring("a", F.col("block") + 1, F.length("a"))
    lead = F.substring("a", F.lit(1), F.length("a") - F.col("block"))
    start = F.substring("a", F.lit(1), F.col("head"))
    from_left = F.col("later") & F.col("b").endswith(tail)
    from_right = F.col("b").startswith(start) | (F.col("later") & F.col("b").startswith(lead))
    near = near.filter(~F.when(F.col("key").startswith("<"), from_left).otherwise(from_right))
    near = near.filter(F.levenshtein("a", "b", 1) == 1)
    return near.select("a", "n_a", "b", "n_b")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the end, twice as far in every round."""
    reached = forms.select("word", F.col("form").alias("root"))
    for _ in range(ROUNDS):
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = reached.join(ahead.hint("shuffle_merge"), "root", "left")
        moved = materialize(moved.select("word", "root", "next"), "roots")
        reached = moved.select("word", F.coalesce("next", "root").alias("root"))
        if moved.filter("next is not null").isEmpty():
            return reached
    raise RuntimeError(f"forms did not settle in {ROUNDS} rounds")


def variants(words: DataFrame) -> DataFrame:
    """Spelling variants among (word, n): one row per word.

    ``form`` is the near word of largest n, the first in code-point order of several, if
    that n is at least twice the word's; else null. ``root`` is where forms lead from the
    word, itself without one. Also n, n_near and form_n. An edit is one code point put in,
    left out or replaced. No words, no rows.
    """
    words = materialize(words.select("word", "n"), "words")
    pairs = materialize(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m"))
    both = both.unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m"))
    )
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best")
    )
    # Files of words are a tenth of their rows in memory: joins below do not broadcast either.
    found = words.join(best.hint("shuffle_merge"), "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.m") >= 2 * F.col("n"), F.col("best")).alias("best"),
    )
    found = found.select(
        "word", F.col("best.other").alias("form"), "n", "n_near", (-F.col("best.m")).alias("form_n")
    )
    found = materialize(found, "forms")
    roots = _roots(found.filter("form is not null"))
    found = found.join(roots.hint("shuffle_merge"), "word", "left")
    return found.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame, shortest: int = 5, least: int = 3) -> DataFrame:
    """``variants`` of the words of all documents (doc_id, text).

    Words are runs of Latin letters with A-Z in lower case, see ``word_counts``. Null and
    empty texts have no words; rows that repeat count as often as they stand; a row
    without an id keeps its spelling; other columns are ignored.
    """
    if shortest < 5:
        raise ValueError("words need five letters for three bigrams after an edit")
    return variants(word_counts(docs, shortest, least))
