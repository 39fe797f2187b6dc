"""Near-duplicate documents by one-permutation hashing.

A document's shingles are hashed once. The hash range is cut into bins and the least
hash of each bin is kept; an empty bin takes the value of the first filled bin in an
order of its own (optimal densification), so small sets get full signatures as well.
Bands of bins are buckets. Each bucket names one centre and its other members become
star-shaped candidates, so pairs grow with members, never with their square. Candidates
are confirmed on full sets. Members of one bucket that are still in different
components are then compared in blocks, so that no link is lost to the choice of the
centre.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidgraph.llm.components import components
from braidgraph.llm.words import mix, sequence_hashes, text_slices, words
from braidgraph.plans.lineage import materialize

BINS = 240
# Bytes of texts whose words are held at once.
SLICE_BYTES = 1 << 20
# Members of a block, and columns of its incidence matrix at a time.
BLOCK = 96
COLUMNS = 1 << 14
MISS = 1e-7

_ORDERS = np.argsort(
    np.random.default_rng(71).random((BINS, BINS)), axis=1, kind="stable"
).argsort(axis=1)
_MIX = np.uint64(0x2545F4914F6CDD1D)

SKETCHES = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"
SETS = "doc_id long, set_a long, set_b long, shingles array<long>"


def band_rows(percent: int, bins: int = BINS) -> int:
    """Most bins a band may have so that a pair at the threshold is missed by ``MISS``."""
    rows = 1
    while (1 - (percent / 100) ** (rows + 1)) ** (bins // (rows + 1)) <= MISS:
        rows += 1
    return rows


def signature(shingles: np.ndarray) -> np.ndarray:
    """Densified one-permutation signature of sorted, distinct 64-bit hashes."""
    bins = (shingles >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)
    first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
    filled = bins[first].astype(np.int64)
    source = first[_ORDERS[:, filled].argmin(axis=1)]
    source[filled] = first
    return shingles[source]


def _bands(shingles: np.ndarray, rows: int) -> np.ndarray:
    grouped = signature(shingles)[: BINS // rows * rows].reshape(-1, rows)
    total = np.arange(1, len(grouped) + 1, dtype=np.uint64) * _MIX
    with np.errstate(over="ignore"):
        for column in grouped.T:
            total = mix(total + column) * _MIX
    return total.view(np.int64)


def _sets(column: pa.Array, width: int):
    """Sorted distinct shingle hashes of each text of a column."""
    for start, end in text_slices(column, SLICE_BYTES):
        found = words(column.slice(start, end - start), lower=True)
        runs = sequence_hashes(found.hashes, width)
        for row in range(end - start):
            first, last = found.first[row], found.first[row + 1]
            if last - first >= width:
                yield np.unique(runs[first : last - width + 1])
            elif last > first:
                yield sequence_hashes(found.hashes[first:last], int(last - first))
            else:
                yield runs[:0]


def _set_key(shingles: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a = mix(shingles ^ _MIX).sum(dtype=np.uint64)
        b = mix(shingles + _MIX).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def sketches(docs: DataFrame, width: int, rows: int) -> DataFrame:
    """Set size, a 128-bit name of the set, and the bands of its signature."""

    def sketch(batches):
        for batch in batches:
            sizes, keys, bands = [], [], []
            for shingles in _sets(batch.column(1), width):
                sizes.append(len(shingles))
                keys.append(_set_key(shingles))
                bands.append(_bands(shingles, rows) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array([key[0] for key in keys], pa.int64()),
                    pa.array([key[1] for key in keys], pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands"],
            )

    return _texts(docs).mapInArrow(sketch, SKETCHES)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """The shingle hashes of each document, with the name of the set."""

    def build(batches):
        for batch in batches:
            for start, end in text_slices(batch.column(1), SLICE_BYTES):
                sets = list(_sets(batch.column(1).slice(start, end - start), width))
                keys = [_set_key(shingles) for shingles in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, end - start),
                        pa.array([key[0] for key in keys], pa.int64()),
                        pa.array([key[1] for key in keys], pa.int64()),
                        pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "set_a", "set_b", "shingles"],
                )

    return _texts(docs).mapInArrow(build, SETS)


def _similar(shared: Column, size_a: Column, size_b: Column, percent: int) -> Column:
    return 100 * shared >= percent * (size_a + size_b - shared)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    side = sets.select("doc_id", "shingles")
    joined = pairs.join(
        side.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), "a"
    ).join(side.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    kept = _similar(shared, F.size("set_a"), F.size("set_b"), percent)
    return joined.filter(kept).select("a", "b")


def _across(opened: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components, among members that share buckets (band, a, rep, component).

    Members that buckets connect are a family. A family is dealt out to blocks, and two
    blocks are compared by a task, which multiplies their incidence matrices and returns
    one link for each two components. Pairs of members never become rows.
    """
    families = components(opened.filter("a < rep").select("a", F.col("rep").alias("b")).distinct())
    members = opened.select("rep", "component").distinct().join(
        families.select("node", F.col("component").alias("family")), F.col("rep") == F.col("node")
    )
    sizes = members.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    held = sets.select(F.col("doc_id").alias("set_id"), "shingles")
    dealt = (
        members.join(sizes, "family")
        .withColumn("own", own)
        .join(held, F.col("rep") == F.col("set_id"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(
            "family",
            F.least("own", "other").alias("lo"),
            F.greatest("own", "other").alias("hi"),
            "own",
            "rep",
            "component",
            "shingles",
        )
    )

    def compare(table: pa.Table) -> pa.Table:
        return _block_links(table.combine_chunks(), percent)

    return dealt.groupBy("family", "lo", "hi").applyInArrow(compare, "a long, b long")


def _block_links(table: pa.Table, percent: int) -> pa.Table:
    reps, components_, own = (table[name].to_numpy() for name in ("rep", "component", "own"))
    lists = table["shingles"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(np.asarray(lists.offsets))
    codes = np.unique(np.asarray(lists.flatten()), return_inverse=True)[1]
    rows = np.repeat(np.arange(len(reps)), sizes)
    shared = np.zeros((len(reps), len(reps)), np.float32)
    order = np.argsort(codes, kind="stable")
    codes, rows = codes[order], rows[order]
    for start in range(0, int(codes[-1]) + 1 if len(codes) else 0, COLUMNS):
        first, last = np.searchsorted(codes, (start, start + COLUMNS))
        held = np.zeros((len(reps), COLUMNS), np.float32)
        held[rows[first:last], codes[first:last] - start] = 1
        shared += held @ held.T
    shared = np.rint(shared).astype(np.int64)
    similar = 100 * shared >= percent * (sizes[:, None] + sizes[None] - shared)
    similar &= components_[:, None] < components_[None]
    if own.min() != own.max():
        similar &= own[:, None] != own[None]
    x, y = np.nonzero(similar)
    # One link joins two components.
    first = np.unique(np.stack([components_[x], components_[y]]), axis=1, return_index=True)[1]
    return pa.table({"a": reps[x[first]], "b": reps[y[first]]})


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per document its set size, component and whether it is the one kept.

    Words are runs without ASCII white space, A-Z lower-cased; a set holds the distinct
    ``width``-word shingles, or the whole sequence of a shorter text. Documents are
    linked at ``100 * intersection >= percent * union``. Documents without words (null
    or empty text) have size 0 and are linked with nothing. Rows without an id are
    linked with nothing: their component is null and they are kept. Rows that repeat an
    id are one document if their sets agree, and else the links of each count for the
    id. Only doc_id and text are read; an empty table gives no rows.
    """
    rows = band_rows(percent)
    sketched = materialize(sketches(docs, width, rows), "sketches")
    # One member stands for all documents with the same set.
    named = sketched.filter("n_shingles > 0 and doc_id is not null")
    classes = materialize(
        named.groupBy("set_a", "set_b", "n_shingles").agg(
            F.min("doc_id").alias("rep"), F.min("bands").alias("bands")
        ),
        "classes",
    )
    members = classes.select("rep", "n_shingles", F.explode("bands").alias("band"))
    shared_bands = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialize(members.join(shared_bands.select("band"), "band"), "members")

    candidates = members.select(F.col("rep").alias("doc_id")).distinct()
    wanted = candidates.join(classes, candidates["doc_id"] == classes["rep"]).select(
        "doc_id", "set_a", "set_b"
    )
    sets = materialize(
        shingle_sets(docs, width)
        .join(wanted, ["doc_id", "set_a", "set_b"], "left_semi")
        .dropDuplicates(["doc_id", "set_a", "set_b"]),
        "sets",
    )
    # Shingles of a candidate that some other candidate has: what it can share at most.
    alone = (
        sets.select("doc_id", F.explode("shingles").alias("shingle"))
        .groupBy("shingle")
        .agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("rep"))
        .filter("n = 1")
        .groupBy("rep")
        .agg(F.count(F.lit(1)).alias("alone"))
    )
    # An id that stands for several sets keeps the bound that holds for each of them.
    several = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    alone = alone.join(several.select("rep"), "rep", "left_anti")
    known = (
        members.join(alone, "rep", "left")
        .withColumn("common", F.col("n_shingles") - F.coalesce("alone", F.lit(0)))
        .drop("alone")
        .filter(F.col("common") * 100 >= percent * F.col("n_shingles"))
    )
    known = materialize(known, "known")

    def possible(a: str, b: str) -> Column:
        return _similar(
            F.least(f"{a}.common", f"{b}.common"),
            F.col(f"{a}.n_shingles"),
            F.col(f"{b}.n_shingles"),
            percent,
        )

    # The centre is the member with the least of its own.
    closeness = F.struct((-F.col("common") / F.col("n_shingles")).alias("own"), F.col("rep"))
    centres = known.groupBy("band").agg(
        F.min(F.struct(closeness.alias("o"), "rep", "n_shingles", "common")).alias("c"),
        F.count(F.lit(1)).alias("n"),
    )
    centres = centres.filter("n > 1").select("band", "c.rep", "c.n_shingles", "c.common")

    def ends(a: str, b: str) -> list[Column]:
        return [
            F.least(f"{a}.rep", f"{b}.rep").alias("a"),
            F.greatest(f"{a}.rep", f"{b}.rep").alias("b"),
        ]

    stars = (
        known.alias("m")
        .join(centres.alias("c"), F.col("m.band") == F.col("c.band"))
        .filter((F.col("m.rep") != F.col("c.rep")) & possible("m", "c"))
        .select(*ends("m", "c"))
        .distinct()
    )
    links = materialize(_confirmed(stars, sets, percent), "star-links")
    named_once = components(links)

    # What is left: members of a bucket in different components.
    placed = known.join(named_once, known["rep"] == named_once["node"], "left").select(
        "band",
        "rep",
        "n_shingles",
        "common",
        F.coalesce("component", "rep").alias("component"),
    )
    bands = placed.groupBy("band").agg(
        F.min("component").alias("least"), F.max("component").alias("most"), F.min("rep").alias("a")
    )
    bands = bands.filter("least < most").select("band", "a")
    opened = materialize(placed.join(bands, "band"), "open")
    more = materialize(_across(opened, sets, percent), "rest-links")
    if not more.isEmpty():
        named_once = components(links.union(more))

    reps = classes.join(named_once, classes["rep"] == named_once["node"], "left").select(
        F.col("set_a").alias("key_a"),
        F.col("set_b").alias("key_b"),
        F.coalesce("component", "rep").alias("component"),
    )
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return (
        sketched.drop("bands")
        .join(reps, (F.col("set_a") == F.col("key_a")) & (F.col("set_b") == F.col("key_b")), "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
