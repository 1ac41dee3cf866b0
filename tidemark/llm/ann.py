"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Trees are fitted on a bounded sample and every vector is put into one leaf of each. A query
walks all trees through one priority queue, best margin first, until it has visited enough
leaves; their vectors are then compared exactly. How many leaves are enough is measured on
the sample, so that a target recall is met there: few for clustered vectors, most of them
for vectors without structure.

Inner products are turned into angles by one more coordinate, the root of what a vector's
squared norm lacks to the largest one (0 for queries). Leaves are cut into chunks of bounded
size by vector and by query, so neither a leaf full of copies nor one that all queries visit
becomes one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: Vectors that the trees are fitted on, at most; trees; least depth; vectors that a leaf should hold.
SAMPLE, TREES, LEAST_DEPTH, LEAF = 16_384, 3, 4, 8192
#: Sampled queries and the recall that the number of visited leaves must reach among them.
TRIALS, TARGET = 256, 0.96
#: Vectors and queries of one chunk.
CHUNK, QUERIES = 8192, 8192
SEED = 20


class Forest:
    """Balanced trees of hyperplanes; node i has the children 2 i + 1 (below) and 2 i + 2."""

    def __init__(self, sample: np.ndarray, largest: float, trees: int, depth: int):
        self.largest, self.depth, self.leaves = largest, depth, 1 << depth
        points = self.lifted(sample)
        rng = np.random.default_rng(SEED)
        self.normals = rng.standard_normal((trees, self.leaves - 1, points.shape[1]))
        self.offsets = np.zeros((trees, self.leaves - 1))
        for t in range(trees):
            inside = {0: np.arange(len(points))}
            for node in range(self.leaves - 1):
                rows = inside.pop(node)
                if len(rows) >= 2:  # towards one sampled point and away from another, as far as they differ
                    a, b = rng.choice(rows, 2, replace=False)
                    if np.any(points[a] != points[b]):
                        self.normals[t, node] = points[a] - points[b]
                self.normals[t, node] /= np.linalg.norm(self.normals[t, node])
                along = points[rows] @ self.normals[t, node]
                self.offsets[t, node] = np.median(along) if len(rows) else 0.0
                above = along > self.offsets[t, node]
                inside[2 * node + 1], inside[2 * node + 2] = rows[~above], rows[above]

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        lack = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.largest**2 - (x * x).sum(1)))
        return np.hstack([x, lack[:, None]])

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree, numbered through all trees."""
        points, out = self.lifted(x), np.empty((len(x), len(self.normals)), np.int64)
        for t in range(len(self.normals)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                above = np.einsum("ij,ij->i", points, self.normals[t][node]) > self.offsets[t][node]
                node = 2 * node + 1 + above
            out[:, t] = node - (self.leaves - 1) + t * self.leaves
        return out

    def visit(self, x: np.ndarray, most: int, sizes: dict[int, int] | None = None, least: int = 0) -> list[list[int]]:
        """For each query its leaves, best first: all trees share one queue, a node's priority is the least margin on its way.

        There are ``most`` leaves, and more until those of one tree, by ``sizes``, hold ``least`` vectors.
        """
        points = self.lifted(x, query=True)
        margins = np.einsum("qd,tnd->qtn", points, self.normals) - self.offsets
        out = []
        for row in margins:
            queue, found, held = [(-np.inf, t, 0) for t in range(len(row))], [], [0] * len(row)
            while queue and (len(found) < most or max(held) < least):
                priority, t, node = heapq.heappop(queue)
                if node >= self.leaves - 1:
                    found.append(node - (self.leaves - 1) + t * self.leaves)
                    held[t] += sizes.get(found[-1], 0) if sizes else 0
                    continue
                m = row[t, node]
                heapq.heappush(queue, (max(priority, m), t, 2 * node + 1))
                heapq.heappush(queue, (max(priority, -m), t, 2 * node + 2))
            out.append(found)
        return out

    def enough(self, sample: np.ndarray, k: int) -> int:
        """Leaves to visit so that sampled queries find TARGET of their k nearest in the sample."""
        everywhere = len(self.normals) * self.leaves
        queries = sample[:TRIALS]
        near = queries @ sample.T
        near[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
        k = min(k, len(sample) - 1)
        if k < 1:
            return everywhere
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        home, order = self.leaf_of(sample), self.visit(queries, everywhere)
        needed = []
        for q, leaves in enumerate(order):
            rank = np.empty(everywhere, np.int64)
            rank[leaves] = np.arange(1, everywhere + 1)
            needed.extend(rank[home[best[q]]].min(1).tolist())  # a neighbour is found in the first of its leaves
        return int(np.quantile(needed, TARGET, method="higher"))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the vectors that take part, all of the most frequent length."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).filter("vec_id is not null and vector is not null")
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    own = own.filter(finite & F.exists("vector", lambda x: x != 0))
    length = own.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return own.filter(F.size("vector") == (length["n"] if length else 0))


def search(vectors: DataFrame, queries, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found by inner product, nearest first, ties to the smaller vec_id.

    ``queries`` is a condition on vec_id; every other row is a candidate. Vectors that are null
    or zero, hold null or non-finite components or have not the most frequent length take no
    part, nor do rows with a null id. Copies of a vector are candidates of their own; repeated
    rows count once. A query with fewer candidates has as many rows; an empty table gives none.
    Scores are sums of products in double precision. Other columns are ignored.
    """
    spark = vectors.sparkSession
    own = written(usable(vectors, id_col, vector_col), "vectors")
    facts = own.agg(F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("largest"), F.count_if(queries(F.col("vec_id"))).alias("queries")).first()
    n = facts["n"]
    sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow().column(0).combine_chunks()
    points = _matrix(sample).astype(float) if n else np.ones((0, 1))
    depth = min(max(LEAST_DEPTH, int(np.ceil(np.log2(max(n, 1) / LEAF)))), int(np.log2(SAMPLE / 16)))
    forest = Forest(points, float(facts["largest"] or 0) ** 0.5, TREES, depth)
    most = forest.enough(points, k)
    shared = spark.sparkContext.broadcast(forest)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = shared.value.leaf_of(_matrix(batch.column("vector")).astype(float))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(found), pa.list_(pa.int64()))], ["vec_id", "vector", "leaves"])

    kind = own.schema["vector"].dataType.simpleString()
    placed = own.mapInArrow(leaves, f"vec_id long, vector {kind}, leaves array<long>")
    rows = placed.select("vec_id", "vector", F.explode("leaves").alias("leaf"))
    # trees times leaves rows, a number fixed above
    counts = rows.groupBy("leaf").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("different")).collect()
    sizes = {r["leaf"]: r["different"] for r in counts}
    chunks = {r["leaf"]: -(-r["n"] // CHUNK) for r in counts}
    parts = max(1, -(-facts["queries"] // QUERIES))
    cut = spark.createDataFrame(sorted(chunks.items()), "leaf long, chunks long")
    chunked = rows.join(F.broadcast(cut), "leaf").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")))
    candidates = chunked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = shared.value.visit(_matrix(batch.column("vector")).astype(float), most, sizes, k + 1)  # one may be the query itself
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], ["query_id", "vector", "leaves"])

    asked = own.filter(queries(F.col("vec_id"))).mapInArrow(visits, f"query_id long, vector {kind}, leaves array<long>")
    asked = asked.select("query_id", "vector", F.explode("leaves").alias("leaf")).join(F.broadcast(cut), "leaf")
    asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    slot = ["leaf", "chunk", "part"]

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return none
        x, ids = _matrix(left.column("vector").combine_chunks()).astype(float), left.column("vec_id").to_numpy()
        q, asks = _matrix(right.column("vector").combine_chunks()).astype(float), right.column("query_id").to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for start in range(0, len(q), 256):
            block, own_ids = q[start : start + 256], asks[start : start + 256]
            score = block @ x.T
            score[own_ids[:, None] == ids] = -np.inf
            few = min(k, len(ids))
            least = -np.partition(-score, few - 1, axis=1)[:, few - 1 : few]
            # products of whole blocks may differ in the last bits: whatever comes close is computed again, alike everywhere
            near = np.isfinite(score) & (score >= least - 1e-9 * (1 + np.abs(least)))
            i, j = np.nonzero(near)
            exact = (block[i] * x[j]).sum(1)
            order = np.lexsort((ids[j], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            top = place < k
            out.append((own_ids[i[top]], ids[j[top]], exact[top]))
        parts_ = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table({"query_id": parts_[0], "vec_id": parts_[1], "score": parts_[2]})

    met = candidates.select(*slot, "vec_id", "vector").groupBy(*slot).cogroup(asked.select(*slot, "query_id", "vector").groupBy(*slot)).applyInArrow(nearest, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = met.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= k)
    return best.dropDuplicates(["query_id", "rank"]).select("query_id", "rank", "vec_id", "score")
