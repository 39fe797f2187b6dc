"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Voters are lexicons of words and of word beginnings, learned from labelled rows, and
patterns of spelling. Every document is voted on, and the counts of the vote patterns
over all documents are what the label model sees: it estimates how often each voter
fires in either class, and how the voters depend on each other inside a class. Labelled
rows give only its first rates and class share, which weigh as much as 20 rows in each
round. Its posterior marks training rows, on which a linear classifier over single terms
learns to generalise beyond the voters. Terms are counted in whole texts by tasks; the
driver gets those terms that pass one test, and their numbers for each training row.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidgraph.llm.labelled import fit_sparse_logistic, labelled_sample, sigmoid, texts_of
from braidgraph.llm.words import mix, text_bytes, text_slices, words
from braidgraph.plans.lineage import materialize

# The bound of the training sample: rows of a class.
TRAIN_ROWS = 6000
# Terms a task counts at once before it hands them on.
HELD_TERMS = 1 << 20
WORD_LEXICONS = 6
PREFIXES = (3, 4, 5, 6)
MOST_VOTERS = 16
# A term is known to the model if its surprise exceeds this multiple of the log of the
# number of terms looked at; at 1, less than one term is expected to enter by chance.
CERTAINTY = 0.5
# A known term also votes if toxic rows hold it so much more often, as a logarithm; a
# voter of commoner terms would fire on most long texts. The classifier weighs all.
VOTING_ODDS = 4.0

_APART = np.ones(256, dtype=bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_KINDS = np.array([0x51ED, *[0xA5A5 + size for size in PREFIXES]], np.uint64)


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and of their first bytes, and the row of each."""
    found = words(column, _APART, lower=True)
    rows = np.repeat(np.arange(len(column)), np.diff(found.first))
    hashes, at = [mix(found.hashes ^ _KINDS[0])], [rows]
    sizes = found.ends - found.starts
    for kind, size in zip(_KINDS[1:], PREFIXES):
        long = sizes > size
        starts = found.starts[long]
        packed = np.zeros(len(starts), np.uint64)
        for k in range(size):
            packed = packed << np.uint64(8) | found.data[starts + k].astype(np.uint64)
        hashes.append(mix(packed ^ mix(kind[None])))
        at.append(rows[long])
    return np.concatenate(hashes), np.concatenate(at)


def _pattern_votes(column: pa.Array) -> np.ndarray:
    """Votes of the spelling: shouting, runs of exclamation marks."""
    data, offsets = text_bytes(column)
    counts = []
    exclaimed = data == 33
    twice = exclaimed[1:] & exclaimed[:-1] if len(data) else exclaimed
    for marks in ((data >= 65) & (data <= 90), (data >= 97) & (data <= 122), twice):
        sums = np.append(0, np.cumsum(marks))
        counts.append(sums[np.minimum(offsets[1:], len(sums) - 1)] - sums[np.minimum(offsets[:-1], len(sums) - 1)])
    upper, lower, runs = counts
    return np.stack([(upper > lower) & (upper > 20), runs > 2], axis=1)


@dataclass
class LabelModel:
    """Two classes; ``rates[c, j]`` is how often voter j fires in class c."""

    prior: float
    rates: np.ndarray
    weights: np.ndarray
    correlations: np.ndarray

    @classmethod
    def fit(
        cls, votes: np.ndarray, counts: np.ndarray, rates: np.ndarray, prior: float, rounds: int = 50
    ) -> "LabelModel":
        """Estimate from vote patterns (0/1 rows) and how many documents show each.

        Between rounds the correlation of two voters inside a class is measured; a voter
        that others repeat counts for less, by one over the sum of its correlations.
        """
        total = counts.sum()
        voters = votes.shape[1]
        model = cls(prior, rates, np.ones(voters), np.zeros((voters, voters)))
        for _ in range(rounds):
            chance = model.posterior(votes)
            mass = np.stack([(1 - chance) * counts, chance * counts])
            sizes = mass.sum(axis=1)
            # A little of the first estimate keeps rare voters from drifting.
            rates = (mass @ votes + 20 * rates) / (sizes[:, None] + 20)
            model.rates = np.clip(rates, 1e-6, 1 - 1e-6)
            model.prior = float(np.clip(sizes[1] / total, 1e-4, 0.9))
            model.correlations = _within(votes, mass, model.rates)
            model.weights = 1 / np.maximum(model.correlations, 0).sum(axis=1).clip(1)
        return model

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        clean, toxic = self.rates
        fired = np.log(toxic / clean) * self.weights
        silent = np.log((1 - toxic) / (1 - clean)) * self.weights
        odds = np.log(self.prior / (1 - self.prior)) + votes @ fired + (1 - votes) @ silent
        return sigmoid(odds)


def _within(votes: np.ndarray, mass: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Correlation of voters inside the classes, weighted by the classes' spread."""
    joint, spread = 0, 0
    for weight, rate in zip(mass, rates):
        apart = votes - rate
        joint = joint + (apart * weight[:, None]).T @ apart
        spread = spread + (weight[:, None] * apart**2).sum(axis=0)
    scale = np.sqrt(np.maximum(spread, 1e-12))
    found = joint / scale[:, None] / scale
    np.fill_diagonal(found, 1)
    return found


@dataclass
class ToxicityModel:
    """Sorted term hashes with the voter of each (or -1) and its classifier weight."""

    hashes: np.ndarray
    voter: np.ndarray
    weight: np.ndarray
    constant: float
    voters: int

    def _found(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, entry) of the different known terms of each row."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes, rows = terms(column)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        known = self.hashes[at] == hashes
        pairs = np.unique(rows[known] * len(self.hashes) + at[known])
        return pairs // len(self.hashes), pairs % len(self.hashes)

    def votes(self, column: pa.Array) -> np.ndarray:
        """0/1 per row and voter; the last voters are the patterns."""
        rows, entries = self._found(column)
        result = np.zeros((len(column), self.voters), bool)
        cast = self.voter[entries] >= 0
        result[rows[cast], self.voter[entries[cast]]] = True
        patterns = _pattern_votes(column)
        return np.hstack([result, patterns])

    def score(self, column: pa.Array) -> np.ndarray:
        rows, entries = self._found(column)
        sums = np.bincount(rows, self.weight[entries], len(column)) if len(rows) else 0
        return sigmoid(np.zeros(len(column)) + sums + self.constant)


def _lexicon(docs: DataFrame, sample: DataFrame) -> ToxicityModel:
    """All terms that mark labelled toxic rows, those that vote dealt out to voters by rank.

    A term counts once a document. It is known if toxic rows hold it more often than
    chance allows; words go round the word lexicons, beginnings to that of their size.
    """
    sizes = {row["label"]: row["n"] for row in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    counted = materialize(_document_counts(texts_of(docs, sample)), "term-counts")
    share = min(max(n_toxic / (n_toxic + n_clean), 1e-3), 1 - 1e-3) if sizes.get(1) else 0.5
    least = np.log(max(1, counted.count())) * CERTAINTY
    sure = counted.filter(_surprise(F.col("toxic"), F.col("clean"), share) > float(least))
    found = sure.orderBy("term").toArrow()
    hashes, kinds, toxic, clean = (np.asarray(found[name]) for name in ("term", "kind", "toxic", "clean"))
    odds = np.log((toxic + 0.3) / n_toxic) - np.log((clean + 0.3) / n_clean)
    rank = np.lexsort((hashes, -toxic * odds))
    of_words = rank[(kinds[rank] == 0) & (odds[rank] > VOTING_ODDS)]
    voter = np.where(odds > VOTING_ODDS, WORD_LEXICONS + kinds - 1, -1).astype(np.int64)
    voter[of_words] = np.arange(len(of_words)) % WORD_LEXICONS
    hashes = hashes.astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return ToxicityModel(
        hashes[order], voter[order], np.zeros(len(order)), 0.0, WORD_LEXICONS + len(PREFIXES)
    )


def _surprise(toxic: Column, clean: Column, share: float) -> Column:
    """Minus the log of the chance that a term unrelated to the label is so toxic."""
    total = toxic + clean
    part = F.least(toxic / total, F.lit(1 - 1e-9))
    apart = part * F.log(part / share) + (1 - part) * F.log((1 - part) / (1 - share))
    return F.when(part > share, total * apart).otherwise(0.0)


def _merged(parts: list[tuple]) -> tuple:
    """Sums of the counts of equal terms."""
    hashes, kinds, *counts = (np.concatenate(values) for values in zip(*parts))
    terms_of, first, place = np.unique(hashes, return_index=True, return_inverse=True)
    return terms_of, kinds[first], *(np.bincount(place, c, len(terms_of)) for c in counts)


def _document_counts(texts: DataFrame) -> DataFrame:
    """(term, kind, toxic, clean): in how many rows of either class a term stands.

    A task counts a slice of texts at a time and adds up slices until it holds
    ``HELD_TERMS`` terms; Spark adds up what tasks hand on.
    """

    def count(batches):
        held: list[tuple] = []
        for batch in batches:
            texts = batch.column(0)
            labels, weights = (np.asarray(batch.column(k)) for k in (1, 2))
            for start, end in text_slices(texts, 1 << 20):
                part = texts.slice(start, end - start)
                hashes, rows = terms(part)
                distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                pairs = np.unique(inverse * np.int64(end - start) + rows)
                term, row = pairs // (end - start), start + pairs % (end - start)
                counts = [np.bincount(term, weights[row] * (labels[row] == c), len(distinct)) for c in (1, 0)]
                held.append((distinct, _kinds_of(part)[first], *counts))
                if sum(len(one[0]) for one in held) > HELD_TERMS:
                    held = [_merged(held)]
                    if len(held[0][0]) > HELD_TERMS // 2:
                        yield _counts_batch(held.pop())
        if held:
            yield _counts_batch(_merged(held))

    shape = "term long, kind int, toxic double, clean double"
    counted = texts.select("text", "label", "weight").mapInArrow(count, shape)
    return counted.groupBy("term").agg(
        F.min("kind").alias("kind"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )


def _counts_batch(counts: tuple) -> pa.RecordBatch:
    hashes, kinds, toxic, clean = counts
    arrays = [hashes.view(np.int64), kinds.astype(np.int32), toxic, clean]
    names = ["term", "kind", "toxic", "clean"]
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names)


def _kinds_of(texts: pa.Array) -> np.ndarray:
    """0 for words, then the place in PREFIXES from 1 on, in the order of ``terms``."""
    found = words(texts, _APART, lower=True)
    sizes = found.ends - found.starts
    counts = [len(sizes), *(int((sizes > size).sum()) for size in PREFIXES)]
    return np.repeat(np.arange(len(counts), dtype=np.int8), counts)


def vote_patterns(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(pattern, n): the votes of all documents as bits of a number, counted."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def vote(batches):
        for batch in batches:
            texts = batch.column(0)
            counts: dict[int, int] = {}
            for start, end in text_slices(texts):
                votes = shipped.value.votes(texts.slice(start, end - start))
                bits = votes @ (1 << np.arange(votes.shape[1]))
                for bit, n in zip(*(v.tolist() for v in np.unique(bits, return_counts=True))):
                    counts[bit] = counts.get(bit, 0) + n
            yield pa.RecordBatch.from_pydict(
                {"pattern": pa.array(list(counts), pa.int64()), "n": pa.array(counts.values(), pa.int64())}
            )

    counted = docs.select("text").mapInArrow(vote, "pattern long, n long")
    return counted.groupBy("pattern").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame, allowed: Column, label: str) -> ToxicityModel:
    """Lexicons from a bounded sample of allowed rows, the label model from the votes of
    all documents, and the classifier from the sample marked by the label model.

    Without toxic rows there is no lexicon, and all documents get the same low score.
    """
    sample = labelled_sample(docs, labels, label, allowed, TRAIN_ROWS)
    model = _lexicon(docs, sample)
    known = _known_terms(docs, sample, model) if len(model.hashes) else []
    marks = np.array([row["label"] for row in known], np.int64)
    if len(set(marks.tolist())) < 2:
        model.constant = -4.0
        return model
    # At most 2 ** voters rows, of which voters that agree leave few.
    found = vote_patterns(docs, model).collect()
    voters = model.voters + 2
    assert voters <= MOST_VOTERS
    bits = np.arange(voters)
    patterns = np.array([row["pattern"] for row in found])[:, None] >> bits & 1
    counts = np.array([row["n"] for row in found], float)
    own = np.array([row["pattern"] for row in known])[:, None] >> bits & 1
    start = np.stack([(own[marks == c].sum(axis=0) + 0.5) / ((marks == c).sum() + 1) for c in (0, 1)])
    share = _share(labels, allowed, label)
    judged = LabelModel.fit(patterns.astype(float), counts, start, share)
    targets = judged.posterior(own.astype(float))
    return _classifier(model, [row["entries"] for row in known], targets)


def _known_terms(docs: DataFrame, sample: DataFrame, model: ToxicityModel) -> list:
    """(doc_id, label, pattern, entries) per row of the sample: its votes and its known terms."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def look(batches):
        for batch in batches:
            texts = batch.column(2)
            for start, end in text_slices(texts):
                part = texts.slice(start, end - start)
                rows, entries = shipped.value._found(part)
                votes = shipped.value.votes(part)
                bounds = np.searchsorted(rows, np.arange(end - start + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(entries.astype(np.int32)))
                bits = pa.array(votes @ (1 << np.arange(votes.shape[1])), pa.int64())
                held = [batch.column(k).slice(start, end - start) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*held, bits, lists], names=["doc_id", "label", "pattern", "entries"]
                )

    chosen = texts_of(docs, sample).select(F.col("doc_id").cast("long"), "label", "text")
    found = chosen.mapInArrow(look, "doc_id long, label int, pattern long, entries array<int>")
    return sorted(found.distinct().collect(), key=lambda row: row["doc_id"])


def _share(labels: DataFrame, allowed: Column, label: str) -> float:
    row = labels.filter(allowed).agg(F.avg(F.col(label).cast("double")).alias("p")).first()
    return float(np.clip(row["p"] if row["p"] is not None else 0.1, 0.001, 0.9))


def _classifier(model: ToxicityModel, known: list[list[int]], targets: np.ndarray) -> ToxicityModel:
    """Logistic regression on the presence of single terms, how many of them vote, and
    whether one does."""
    size = len(model.hashes)
    rows = np.repeat(np.arange(len(known)), [len(entries) for entries in known])
    entries = np.concatenate([np.asarray(entries, np.int64) for entries in known])
    hits = np.bincount(rows[model.voter[entries] >= 0], minlength=len(known))
    some = np.flatnonzero(hits)
    fitted = fit_sparse_logistic(
        np.concatenate([rows, some, some]),
        np.concatenate([entries, np.full(len(some), size), np.full(len(some), size + 1)]),
        np.concatenate([np.ones(len(rows)), np.log1p(hits[some]), np.ones(len(some))]),
        targets, size + 2, ridge=2e-4,
    )
    return SumModel(
        model.hashes, model.voter, fitted[:size], float(fitted[-1]), model.voters,
        float(fitted[-3]), float(fitted[-2]),
    )


@dataclass
class SumModel(ToxicityModel):
    """Adds the number of voting terms of a row, and that there is one, to the classifier."""

    number: float = 0.0
    some: float = 0.0

    def score(self, column: pa.Array) -> np.ndarray:
        rows, entries = self._found(column)
        sums = np.bincount(rows, self.weight[entries], len(column)) if len(rows) else 0
        hits = np.bincount(rows[self.voter[entries] >= 0], minlength=len(column))
        extra = self.number * np.log1p(hits) + self.some * (hits > 0)
        return sigmoid(sums + extra + self.constant)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every whole text; higher is more toxic.

    Null and empty texts hold no term and get the score of that. Repeated rows are
    scored each; an empty table gives no rows; other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            parts = [shipped.value.score(texts.slice(s, e - s)) for s, e in text_slices(texts)]
            scores = np.concatenate(parts or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores)], names=["doc_id", "score"]
            )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(run, "doc_id long, score double")
