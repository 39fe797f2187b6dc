"""Exact top-k search by inner product over KD-trees, one per shard.

Vectors are dealt out to shards by hash. A task builds the tree of a shard by median
splits and keeps the tight box of every node. Blocks of queries walk the tree best
first: a node is worth a visit for the queries whose bound by its box is not below
their k-th score so far. Every block first searches one shard of its own, and the k-th
scores found there travel with it to all other shards.
"""

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidgraph.plans.lineage import materialize

LEAF = 64
SHARD_ROWS = 8192
BLOCK_QUERIES = 512
SCALE = 256

# Scores end here, and components where their products stay finite.
MOST_SCORE = 2**62
LEAST_SCORE = -(2**60)
MOST_COMPONENT = 1e150

_FLOOR = np.iinfo(np.int64).min // 4


@dataclass
class Tree:
    """Points in the order of the leaves; a node is a range of them with its box."""

    points: np.ndarray
    ids: np.ndarray
    bounds: list[tuple[int, int]]
    children: list[tuple[int, int] | None]
    low: np.ndarray
    high: np.ndarray
    least_id: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> "Tree":
        order = np.arange(len(ids))
        bounds, children, low, high, least = [(0, len(ids))], [None], [], [], []
        node = 0
        while node < len(bounds):
            start, end = bounds[node]
            inside = points[order[start:end]]
            low.append(inside.min(axis=0))
            high.append(inside.max(axis=0))
            least.append(ids[order[start:end]].min())
            if end - start > leaf:
                axis = int((high[-1] - low[-1]).argmax())
                middle = (end - start) // 2
                by = np.argpartition(inside[:, axis], middle)
                order[start:end] = order[start:end][by]
                children[node] = (len(bounds), len(bounds) + 1)
                bounds += [(start, start + middle), (start + middle, end)]
                children += [None, None]
            node += 1
        return cls(
            points[order], ids[order], bounds, children,
            np.array(low), np.array(high), np.array(least),
        )

    def search(
        self, queries: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the best ``k`` of each query, best first; -1 where fewer.

        ``own`` are the ids of the queries, which are no candidates; ``kth`` are scores
        known to be reached by ``k`` candidates elsewhere, so lower ones are not sought.
        """
        count = len(queries)
        scores = np.full((count, k), _FLOOR, np.int64)
        ids = np.full((count, k), -1, np.int64)
        reached = kth.copy()
        positive, negative = np.maximum(queries, 0), np.minimum(queries, 0)

        def reach(node: int, rows: np.ndarray) -> np.ndarray:
            return positive[rows] @ self.high[node] + negative[rows] @ self.low[node]

        everyone = np.arange(count)
        bound = reach(0, everyone)
        heap = [(-float(bound.max()), 0, everyone, bound)] if count else []
        while heap:
            _, node, rows, bound = heapq.heappop(heap)
            # On a tie a smaller id could still enter.
            alive = bound >= reached[rows]
            rows, bound = rows[alive], bound[alive]
            if not len(rows):
                continue
            if self.children[node]:
                for child in self.children[node]:
                    near = reach(child, rows)
                    some = near >= reached[rows]
                    if some.any():
                        item = (-float(near[some].max()), child, rows[some], near[some])
                        heapq.heappush(heap, item)
                continue
            start, end = self.bounds[node]
            found = queries[rows] @ self.points[start:end].T
            found = np.clip(found, LEAST_SCORE, MOST_SCORE).astype(np.int64)
            here = np.broadcast_to(self.ids[start:end], found.shape)
            found = np.where(here == own[rows, None], _FLOOR, found)
            all_scores = np.hstack([scores[rows], found])
            all_ids = np.hstack([ids[rows], here])
            best = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            scores[rows] = np.take_along_axis(all_scores, best, axis=1)
            ids[rows] = np.take_along_axis(all_ids, best, axis=1)
            reached[rows] = np.maximum(reached[rows], scores[rows, k - 1])
        ids[scores == _FLOOR] = -1
        return scores, ids


def _matrix(blob: bytes, size: int) -> np.ndarray:
    """Whole numbers in float64, in which their inner products are exact."""
    return np.frombuffer(blob, "<f8").reshape(-1, size)


VECTORS = "vec_id long, size int, vector binary"
SHARDS = "shard int, size int, ids binary, vectors binary"
_RESULT = "query_id long, score long, vec_id long"
_RESULT_SCHEMA = pa.schema([(n, pa.int64()) for n in ("query_id", "score", "vec_id")])


def whole_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Components as floor(256 * x) in binary; rows with none, null or unbounded parts go."""

    def convert(batches):
        for batch in batches:
            keys, sizes, blobs = [], [], []
            for vec_id, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                if vec_id is None or not values.is_valid or values.values.null_count:
                    continue
                parts = np.asarray(values.values, np.float64)
                if len(parts) and np.isfinite(parts).all():
                    keys.append(vec_id)
                    sizes.append(len(parts))
                    with np.errstate(over="ignore"):
                        whole = np.clip(np.floor(SCALE * parts), -MOST_COMPONENT, MOST_COMPONENT)
                    blobs.append(whole.astype("<f8").tobytes())
            arrays = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(blobs, pa.binary())], names=["vec_id", "size", "vector"]
            )

    chosen = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("v"))
    return chosen.mapInArrow(convert, VECTORS)


def _blocks(vectors: DataFrame, name: str, parts: int) -> DataFrame:
    """One row per part and vector size: the ids and vectors dealt to it by hash."""
    number = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    grouped = vectors.groupBy(number.alias(name), "size")
    rows = grouped.agg(F.sort_array(F.collect_list(F.struct("vec_id", "vector"))).alias("rows"))

    def join(batches):
        for batch in batches:
            for part, size, held in zip(*(column.to_pylist() for column in batch.columns)):
                ids = np.array([row["vec_id"] for row in held], "<i8").tobytes()
                blob = b"".join(row["vector"] for row in held)
                yield pa.RecordBatch.from_pydict(
                    {name: pa.array([part], pa.int32()), "size": pa.array([size], pa.int32()),
                     "ids": [ids], "vectors": pa.array([blob], pa.binary())}
                )

    return rows.mapInArrow(join, SHARDS.replace("shard", name, 1))


def _searched(pairs: DataFrame, k: int) -> DataFrame:
    """Search the shard of each row with its queries: shard columns, q_ids, q_vectors, kth."""

    def search(batches) -> Iterator[pa.RecordBatch]:
        last, tree = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["shard"], row["size"]) != last:
                    last = (row["shard"], row["size"])
                    ids = np.frombuffer(row["ids"], "<i8")
                    tree = Tree.build(_matrix(row["vectors"], row["size"]), ids)
                own = np.frombuffer(row["q_ids"], "<i8")
                kth = np.frombuffer(row["kth"], "<i8") if row["kth"] else None
                kth = np.full(len(own), _FLOOR, np.int64) if kth is None else kth
                scores, ids = tree.search(_matrix(row["q_vectors"], row["size"]), own, kth, k)
                found = ids >= 0
                arrays = [np.repeat(own, k).reshape(-1, k)[found], scores[found], ids[found]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values) for values in arrays], schema=_RESULT_SCHEMA
                )

    ordered = pairs.sortWithinPartitions("shard", "size")
    return ordered.mapInArrow(search, _RESULT)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best of ``vectors`` for each of ``queries`` by integer inner product.

    Both hold vec_id and embedding; a query is no candidate for itself. Returns
    query_id, rank from 1, vec_id and score, ties to the smaller vec_id. Vectors that
    are null, empty, hold a null or a non-finite component or have no id take no part;
    a query meets the vectors of its own length only. Rows that repeat an id are
    candidates once each. Scores are exact up to 2^53 and end at -2^60 and 2^62, where
    ties go to the smaller vec_id. Empty tables give no rows; other columns are ignored.
    """
    searched = materialize(whole_vectors(vectors), "vectors")
    asked = whole_vectors(queries).dropDuplicates(["vec_id", "size"])
    parts = max(1, -(-searched.count() // SHARD_ROWS))
    shards = materialize(_blocks(searched, "shard", parts), "shards")
    asked = materialize(asked, "queries")
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    blocked = _blocks(asked, "block", blocks).select(
        "block", "size", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")
    )
    blocked = materialize(blocked, "blocks")
    home = F.pmod(F.col("block"), F.lit(parts)).cast("int")
    nothing = F.lit(None).cast("binary").alias("kth")
    first = materialize(
        _searched(
            blocked.withColumn("shard", home).join(shards, ["shard", "size"]).withColumn("kth", nothing), k
        ),
        "home-hits",
    )
    kth = _kth_scores(blocked, first, k)
    others = kth.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rest = _searched(others.filter(F.col("shard") != home).join(shards, ["shard", "size"]), k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _kth_scores(blocked: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Blocks with the k-th score each query reached so far, in the order of their ids."""
    reached = (
        hits.groupBy("query_id")
        .agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= k)
        .select("query_id", "least")
    )
    ids = blocked.select("block", "size", "q_ids")

    def open_ids(batches):
        for batch in batches:
            for block, size, blob in zip(*(column.to_pylist() for column in batch.columns)):
                own = np.frombuffer(blob, "<i8")
                yield pa.RecordBatch.from_pydict(
                    {"block": pa.array([block] * len(own), pa.int32()),
                     "size": pa.array([size] * len(own), pa.int32()),
                     "query_id": pa.array(own), "place": pa.array(range(len(own)), pa.int32())}
                )

    opened = ids.mapInArrow(open_ids, "block int, size int, query_id long, place int")
    known = (
        opened.join(reached, "query_id", "left")
        .groupBy("block", "size")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("place", F.coalesce("least", F.lit(_FLOOR)).alias("least")))
            ).alias("known")
        )
        .select("block", "size", F.col("known.least").alias("least"))
    )

    def packed(batches):
        for batch in batches:
            blobs = [np.array(v, "<i8").tobytes() for v in batch.column(2).to_pylist()]
            arrays = [batch.column(0), batch.column(1), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["block", "size", "kth"])

    scores = known.mapInArrow(packed, "block int, size int, kth binary")
    return blocked.join(scores, ["block", "size"])
