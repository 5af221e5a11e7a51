"""Nearest neighbours by largest inner product.

Method: hash-prefix forest. Each tree is a sorted array of long hash strings, one bit for the side of
each of `BITS` random planes. For a query, all trees are descended to the longest prefix that
matches, then ascended together, one bit at a time, until the ranges of equal prefixes hold enough
vectors; those are scored exactly. So that the largest inner product is also the smallest angle,
vectors get one more component that gives all of them the length of the longest.

How many vectors are enough is a share of those searched. It is chosen from `SHARES` by measuring:
`SAMPLE` queries, those with the smallest hash, are also compared with all vectors, and the smallest
share whose recall reaches `RECALL` is taken; the last share is all of them, so there is always one.

Every vector is indexed. Equal vectors are indexed once and stand for all their rows; of such rows the
k + 1 smallest ids are kept, as no result can use more, so a vector that very many rows share fills
no task. Vectors are dealt by hash into blocks of about `BLOCK`, with a forest each, and the queries,
in blocks of their own, meet all of them; each pair of blocks is one bounded group.

Vectors that are null, empty, zero or hold a null or non-finite component take no part, and neither
do rows without an id or vectors whose length is not the most frequent one. A row given twice counts
once. Ties go to the smaller id. With fewer candidates than k, all are returned.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billweave.llm.rows import saved

TREES, BITS = 16, 32
BLOCK, QUERY_BLOCK = 16_384, 2_048
SHARES = (0.02, 0.1, 0.3, 0.6, 1.0, 1.5, float("inf"))
SAMPLE, RECALL = 128, 0.95
SEED = 20_240_101
FOUND = "share double, query long, score double, first long, ids array<long>"


def is_vector(v: Column) -> Column:
    """Whether all components are finite and one is not zero."""
    return (v.isNotNull() & (F.size(v) > 0) & F.exists(v, lambda x: x != 0)
            & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))),
                         F.lit(False)))


class Forest:
    """Sorted arrays of hash strings over the rows of `vectors`."""

    def __init__(self, vectors: np.ndarray, longest: float) -> None:
        rng = np.random.default_rng(SEED)
        self.planes = rng.standard_normal((TREES, vectors.shape[1] + 1, BITS))
        more = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))
        hashes = self.hashes(np.column_stack([vectors, more]))
        self.order = np.argsort(hashes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(hashes, self.order, 1)

    def hashes(self, vectors: np.ndarray) -> np.ndarray:
        """By tree and vector: the sides of the planes, the first plane in the highest bit."""
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        return np.stack([(vectors @ planes > 0) @ weights for planes in self.planes])

    def candidates(self, queries: np.ndarray, enough: float) -> list[np.ndarray]:
        """Rows whose hash strings share the longest prefixes with each query's, in any tree.

        The trees are ascended until their ranges hold `enough` rows together, or all rows.
        """
        wanted = self.hashes(np.column_stack([queries, np.zeros(len(queries))]))
        start = np.zeros(wanted.shape, np.int64)
        end = np.full(wanted.shape, self.sorted.shape[1])
        low, high = start.copy(), end.copy()
        still = np.ones(len(queries), bool)
        for level in range(BITS, -1, -1):
            shift = BITS - level
            for tree, ordered in enumerate(self.sorted):
                prefix = wanted[tree, still] >> shift
                low[tree, still] = np.searchsorted(ordered, prefix << shift)
                high[tree, still] = np.searchsorted(ordered, (prefix + 1) << shift)
            start[:, still], end[:, still] = low[:, still], high[:, still]
            still &= (end - start).sum(0) < enough
            if not still.any():
                break
        found, mask = [], np.zeros(self.sorted.shape[1], bool)
        for q in range(len(queries)):
            mask[:] = False
            for tree in range(TREES):
                mask[self.order[tree, start[tree, q]:end[tree, q]]] = True
            found.append(np.flatnonzero(mask))
        return found


def inner(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products, summed from the first component to the last."""
    return np.cumsum(vectors * query, axis=1)[:, -1]


def search_block(k: int, longest: float, shares: Sequence[float]) -> Callable:
    """Of a block of vectors and one of queries: each query's k + 1 nearest distinct vectors."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            vectors, queries = matrix(left.column("vector")), matrix(right.column("vector"))
            first = left.column("first").to_numpy()
            ids = left.column("ids").to_pylist()
            forest = Forest(vectors, longest)
            for share in shares:
                for q, rows in enumerate(forest.candidates(queries, share * len(vectors))):
                    near = vectors[rows] @ queries[q]
                    if len(rows) > 4 * k:  # a few more than needed, as sums in another order differ
                        bar = np.partition(near, -2 * k)[-2 * k] - 1e-9 * longest**2
                        rows = rows[near >= bar]
                    exact = inner(queries[q], vectors[rows])
                    for at in np.lexsort((first[rows], -exact))[:k + 1]:
                        out.append((share, q, float(exact[at]), int(first[rows[at]]), ids[rows[at]]))
        share, q, score, least, ids = list(zip(*out)) if out else ([],) * 5
        names = right.column("query").to_numpy()
        return pa.table([pa.array(share, pa.float64()), pa.array(names[list(q)], pa.int64()),
                         pa.array(score, pa.float64()), pa.array(least, pa.int64()),
                         pa.array(ids, pa.list_(pa.int64()))],
                        ["share", "query", "score", "first", "ids"])

    return run


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def nearest(df: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of each query row's k nearest other rows."""
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"),
                     F.col(f"`{vector}`").alias("vector"), is_query.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & is_vector(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if not sizes:
        return empty(df)
    rows = rows.where(F.size("vector") == sizes["n"])
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    longest = rows.select(F.sqrt(F.max(norm)).alias("n")).first()["n"]
    # equal vectors: the smallest ids; ranking cuts each task's rows before the shuffle
    by_vector = Window.partitionBy("vector").orderBy("id")
    kept = (rows.select("vector", "id").withColumn("at", F.dense_rank().over(by_vector))
            .where(F.col("at") <= k + 1).groupBy("vector")
            .agg(F.array_sort(F.collect_set("id")).alias("ids")))
    vectors = saved(kept.select("vector", "ids", F.element_at("ids", 1).alias("first"),
                                F.xxhash64("vector").alias("hash")))
    asking = rows.where("asks").select("id", "vector").distinct()
    queries = saved(asking.groupBy("vector").agg(F.min("id").alias("query"))
                    .withColumn("hash", F.xxhash64("vector", F.lit("query"))))
    blocks = 1 + vectors.count() // BLOCK

    def found(queries: DataFrame, shares: Sequence[float]) -> DataFrame:
        """By share and query: the k + 1 nearest distinct vectors, at most, of all blocks."""
        query_blocks = 1 + queries.count() // QUERY_BLOCK
        asked = (queries.withColumn("q", F.pmod("hash", F.lit(query_blocks)))
                 .withColumn("v", each(blocks)))
        held = (vectors.withColumn("v", F.pmod("hash", F.lit(blocks)))
                .withColumn("q", each(query_blocks)))
        near = (held.groupBy("v", "q").cogroup(asked.groupBy("v", "q"))
                .applyInArrow(search_block(k, longest, shares), FOUND))
        best = Window.partitionBy("share", "query").orderBy(F.desc("score"), "first")
        return near.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)

    share = choose_share(queries, found, k)
    # by query row: the vectors found for its vector, without the row itself
    names = queries.select("vector", "query")
    near = found(queries, [share]).select("query", "score", F.explode("ids").alias("vec_id"))
    pairs = (asking.join(names, "vector").select("query", F.col("id").alias("query_id"))
             .join(near, "query").where(F.col("query_id") != F.col("vec_id")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def each(blocks: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))


def choose_share(queries: DataFrame, found: Callable, k: int) -> float:
    """The smallest share of SHARES whose recall on a sample of the queries reaches RECALL."""
    sample = queries.orderBy("hash", "query").limit(SAMPLE)
    ranked = found(sample, SHARES).where(F.col("at") <= k).select("share", "query", "first")
    right = ranked.where(F.col("share") == SHARES[-1]).select("query", "first")
    hits = {r["share"]: r["count"] for r in
            ranked.join(right, ["query", "first"]).groupBy("share").count().collect()}
    total = hits.get(SHARES[-1], 0)
    return next(s for s in SHARES if hits.get(s, 0) >= RECALL * total)


def empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
