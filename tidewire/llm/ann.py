"""Nearest neighbours by a permutation index.

Pivots are picked from a bounded sample, each farthest from those before it, so that a
crowd of like vectors gives few of them. Every vector is represented by its nearest
pivots in order, and posted with its rank in the inverted file of each of them. A query
walks the files of its own nearest pivots and adds up, per vector, how far the two orders
agree; that sum orders vectors exactly as Spearman's footrule distance does when a missing
pivot has the rank after the last. Vectors with the same two nearest pivots form a group
with the footrule of its best member; the best share of the groups of each index shard is
then ranked by the true measure, with all their members, so a crowd uses up one place.

The index is cut into shards of rows and the queries into blocks; a task sees one shard
and one block, so its memory is fixed, and only the nearest few of every pair of shard and
block leave it. Of vectors that are equal, only the smallest ids that could ever be
among the nearest are indexed, so a vector that a third of all rows hold costs nothing;
no result changes by that.

Vectors that are null, zero, hold null or non-finite components, or have another length
than most, take no part. Ties go to the smaller vec_id. Rows without a vec_id take no
part; rows that repeat a vec_id are indexed once (the least vector). With fewer
candidates than asked for, all are returned. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.llm.catalog import query, table
from tidewire.llm.common import lowest_hashes
from tidewire.runtime import cut

SAMPLE = 4096            # bound of the sample that pivots are picked from
PIVOTS = 256
NEAREST_PIVOTS = 64      # pivots that represent a vector
SHARE = 0.15             # of a shard's groups that are ranked by the true measure
LEAST = 256              # but at least so many of them
SHARD_ROWS = 8192
BLOCK_QUERIES = 2048


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the rows that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    rows = (vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"),
                           F.col("embedding").cast("array<double>").alias("embedding"))
            .where(F.col("vec_id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0)))
    usual = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usual is None:
        return rows
    return rows.where(F.size("embedding") == usual["n"]).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


class Shard:
    """Inverted files of the pivots over a block of vectors, sorted by group and id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, depth: int):
        near = nearest_pivots(vectors, pivots, depth)
        group = near[:, 0] * len(pivots) + near[:, min(1, depth - 1)]
        order = np.lexsort((ids, group))
        self.ids, self.vectors, self.depth, near = ids[order], vectors[order], depth, near[order]
        _, self.groups = np.unique(group[order], return_index=True)
        self.ends = np.append(self.groups[1:], len(ids))
        self.smallest = np.argsort(np.argsort(self.ids[self.groups]))      # ties between groups: smaller id first
        flat = near.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.rows = by_pivot // depth
        self.ranks = by_pivot % depth
        self.starts = np.searchsorted(flat[by_pivot], np.arange(len(pivots) + 1))

    def agreement(self, near: np.ndarray) -> np.ndarray:
        """Twice the depth minus the later rank, summed over shared pivots: a constant minus the footrule."""
        parts = [slice(self.starts[p], self.starts[p + 1]) for p in near]
        rows = np.concatenate([self.rows[s] for s in parts])
        gain = np.concatenate([2 * (self.depth - np.maximum(self.ranks[s], r)) for r, s in enumerate(parts)])
        return np.bincount(rows, weights=gain, minlength=len(self.ids))

    def search(self, own: int, vector: np.ndarray, near: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.groups)
        look = min(n, max(LEAST, k + 1, math.ceil(share * n)))
        at = np.arange(len(self.ids))
        if look < n:
            best = np.maximum.reduceat(self.agreement(near), self.groups) * n - self.smallest
            chosen = np.argpartition(-best, look - 1)[:look]
            sizes = self.ends[chosen] - self.groups[chosen]
            at = np.repeat(self.groups[chosen] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        at = at[self.ids[at] != own]
        scores = (self.vectors[at] * vector).sum(axis=1)
        best = np.lexsort((self.ids[at], -scores))[:k]
        return self.ids[at][best], scores[best]


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """(vectors, depth) pivot numbers, nearest (largest inner product) first."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :depth]


def spread_out(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to `count` vectors of the sample, each the farthest (by direction) from those before it."""
    if not len(sample):
        return sample
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return sample[chosen]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else flat.chunk(0)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, pivots: int = PIVOTS,
           depth: int = NEAREST_PIVOTS, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every usable query."""
    rows = cut(usable(vectors))
    same = Window.partitionBy("embedding").orderBy("vec_id")
    indexed = rows.withColumn("_nth", F.row_number().over(same)).where(F.col("_nth") <= k + 1).drop("_nth")
    indexed = cut(indexed)
    asked = rows.join(queries.select("vec_id").distinct(), "vec_id", "left_semi")
    n, m = indexed.count(), asked.count()
    schema = "query_id bigint, vec_id bigint, score double"
    shards, blocks = max(1, math.ceil(n / SHARD_ROWS)), max(1, math.ceil(m / BLOCK_QUERIES))
    hashed = indexed.withColumn("_h", F.xxhash64("vec_id")).where(F.col("_h") <= lowest_hashes(2 * SAMPLE, n))
    sample = hashed.orderBy("_h", "vec_id").limit(SAMPLE).collect()
    points = spread_out(np.array([r["embedding"] for r in sample]), pivots)
    depth = min(depth, len(points))

    def meet(shard: pa.Table, block: pa.Table) -> pa.Table:
        out: dict[str, list[np.ndarray]] = {"query_id": [], "vec_id": [], "score": []}
        if shard.num_rows and block.num_rows:
            index = Shard(shard["vec_id"].to_numpy(), _matrix(shard["embedding"]), points, depth)
            ids, asking = block["vec_id"].to_numpy(), _matrix(block["embedding"])
            for own, vector, near in zip(ids, asking, nearest_pivots(asking, points, depth)):
                found, scores = index.search(int(own), vector, near, k, share)
                out["query_id"].append(np.full(len(found), own))
                out["vec_id"].append(found)
                out["score"].append(scores)
        joined = {c: np.concatenate(v) if v else np.zeros(0) for c, v in out.items()}
        return pa.table({"query_id": joined["query_id"].astype(np.int64), "vec_id": joined["vec_id"].astype(np.int64),
                         "score": joined["score"].astype(np.float64)})

    def numbered(df: DataFrame, own: str, own_count: int, other: str, other_count: int) -> DataFrame:
        return df.select(F.pmod(F.xxhash64("vec_id"), F.lit(own_count)).cast("int").alias(own),
                         F.explode(F.sequence(F.lit(0), F.lit(other_count - 1))).alias(other), "vec_id", "embedding")

    left = numbered(indexed, "shard", shards, "block", blocks).groupBy("shard", "block")
    right = numbered(asked, "block", blocks, "shard", shards).groupBy("shard", "block")
    found = left.cogroup(right).applyInArrow(meet, schema)
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


@query("op7_ann")
def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
