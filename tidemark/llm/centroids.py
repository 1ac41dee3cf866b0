"""Centroid clustering of whole-number vectors by filtering with kd-trees.

Vectors are cut into chunks, and each chunk becomes one kd-tree whose nodes hold the number of
their vectors, the sums of their components and their bounding box. The trees are written once as
a table; each round reads it and passes the centroids down every tree: at each node the centroids
that are farther than another one from every point of the box (strictly, so ties stay) are
dropped; a node with one centroid left is assigned whole, by its number and sums; what reaches a
leaf is compared with the centroids that are left there. Everything is whole numbers of 64 bits,
so rounds are exact and the same however the vectors are cut.

Only the centroids, a fixed number, pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: Vectors of a tree and of a leaf, at most; a component's largest size, so that distances fit into 64 bits.
CHUNK, LEAF, LARGEST = 8192, 32, 1 << 26
SEED = 1


def whole_numbers(table: DataFrame, dimensions: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """id and v, the vectors that take part: floor(scale * x) of each component x as a double."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    rows = table.select(F.col(f"`{id_col}`").alias("id"), x.alias("x"))
    fits = F.forall("x", lambda c: F.coalesce(F.abs(c) * scale < LARGEST, F.lit(False)))  # false for null, not a number, infinite
    rows = rows.filter(F.coalesce((F.size("x") == dimensions) & fits, F.lit(False)))
    return rows.select("id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


class Tree:
    """A kd-tree over the rows of ``points``; nodes in the order in which they were made, children after parents."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        spans, children = [(0, len(points))], []
        low, high, sums = [], [], []
        at = 0
        while at < len(spans):
            a, b = spans[at]
            own = points[self.order[a:b]]
            least, most = own.min(0), own.max(0)
            low.append(least)
            high.append(most)
            sums.append(own.sum(0))
            widest = int(np.argmax(most - least))
            if b - a <= LEAF or most[widest] == least[widest]:  # few vectors, or copies of one
                children.append(-1)
            else:
                middle = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, widest], middle, kind="introselect")]
                children.append(len(spans))
                spans += [(a, a + middle), (a + middle, b)]
            at += 1
        self.spans, self.children = np.array(spans, np.int64), np.array(children, np.int64)
        self.low, self.high, self.sums = (np.array(x, np.int64) for x in (low, high, sums))


#: A tree as a row: numbers of 32 bits as bytes, of 64 bits in ``sums``; ids and v in the order of the leaves.
ROW = pa.schema([("ids", pa.list_(pa.int64())), *((k, pa.binary()) for k in ("v", "spans", "children", "low", "high", "sums"))])
ROW_SQL = "ids array<long>, v binary, spans binary, children binary, low binary, high binary, sums binary"


def _stored(ids: pa.Array, points: np.ndarray) -> pa.RecordBatch:
    tree = Tree(points)
    raw = lambda x, kind=np.int32: np.ascontiguousarray(x, kind).tobytes()
    row = {"ids": ids.take(pa.array(tree.order)).to_pylist(), "v": raw(points[tree.order]), "spans": raw(tree.spans), "children": raw(tree.children), "low": raw(tree.low), "high": raw(tree.high), "sums": raw(tree.sums, np.int64)}
    return pa.RecordBatch.from_pylist([row], ROW)


def _table(raw: bytes, d: int, kind: type = np.int32) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(-1, d).astype(np.int64)


def _nearest(points: np.ndarray, centroids: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the numbered centroids per point, the smaller number on ties, and the squared distance."""
    some = centroids[numbers]
    distance = (points * points).sum(1)[:, None] - 2 * (points @ some.T) + (some * some).sum(1)
    best = np.argmin(distance, 1)
    return numbers[best], distance[np.arange(len(points)), best]


def _filtered(low: np.ndarray, high: np.ndarray, left: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """For boxes (n, d) and the centroids left at each (n, k): those that stay.

    The rival of a box is the centroid nearest to its middle. Another one goes if it is farther than
    the rival from the corner that lies most in its own direction, and so from every point of the box.
    """
    twice = low + high
    apart = (2 * centroids[None, :, :] - twice[:, None, :]) ** 2
    apart = np.where(left, apart.sum(2), np.iinfo(np.int64).max)
    rival = centroids[np.argmin(apart, 1)]
    away = centroids[None, :, :] - rival[:, None, :]
    corner = np.where(away > 0, high[:, None, :], low[:, None, :])
    # |c - corner|^2 - |rival - corner|^2
    farther = (away * (centroids[None, :, :] + rival[:, None, :] - 2 * corner)).sum(2)
    return left & (farther <= 0)


def _decided(tree: dict, centroids: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(first, end, node or -1, centroids left) of the parts of a tree whose centroids are decided (one left) or that are leaves."""
    d = centroids.shape[1]
    spans, children = _table(tree["spans"], 2), _table(tree["children"], 1)[:, 0]
    low, high = _table(tree["low"], d), _table(tree["high"], d)
    level, left = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    while len(level):
        left = _filtered(low[level], high[level], left, centroids)
        single = left.sum(1) == 1
        ends = single | (children[level] < 0)
        for node, own, one in zip(level[ends], left[ends], single[ends], strict=True):
            yield int(spans[node, 0]), int(spans[node, 1]), int(node) if one else -1, np.flatnonzero(own)
        inner = level[~ends]
        level, left = np.concatenate([children[inner], children[inner] + 1]), np.concatenate([left[~ends]] * 2)


def _trees(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            points = part.column("v").flatten().to_numpy().reshape(-1, dimensions)
            yield _stored(part.column("id"), points)


def _moved(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per tree and centroid: the number and the sums of its vectors."""
    k, d = centroids.shape
    for batch in batches:
        for tree in batch.to_pylist():
            n, total = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
            sums, points = _table(tree["sums"], d, np.int64), _table(tree["v"], d)
            for a, b, node, left in _decided(tree, centroids):
                if node >= 0:
                    n[left[0]] += b - a
                    total[left[0]] += sums[node]
                else:
                    nearest, _ = _nearest(points[a:b], centroids, left)
                    n += np.bincount(nearest, minlength=k)
                    for c in left:
                        total[c] += points[a:b][nearest == c].sum(0)
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(used, pa.int32()), "n": pa.array(n[used]), "sums": pa.array(total[used].tolist(), pa.list_(pa.int64()))})


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    d = centroids.shape[1]
    for batch in batches:
        for tree in batch.to_pylist():
            points = _table(tree["v"], d)
            cluster, distance = np.empty(len(points), np.int32), np.empty(len(points), np.int64)
            for a, b, _, left in _decided(tree, centroids):
                cluster[a:b], distance[a:b] = _nearest(points[a:b], centroids, left)
            yield pa.RecordBatch.from_pydict({"id": pa.array(tree["ids"], pa.int64()), "cluster": pa.array(cluster), "distance": pa.array(distance)})


def cluster(table: DataFrame, dimensions: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Per vector its id, cluster and squared distance, and the final centroids.

    Vectors with another number of components, or with a null, non-finite or too large one (from
    LARGEST / scale on), take no part. The first centroids are the k vectors with the smallest sha256
    of ``1:<id>``; repeated rows count each, vectors without an id are the last to become one, and of
    equal hashes the smaller vector comes first; with fewer vectors there are fewer centroids. A
    round replaces each centroid that has vectors by the floor of their mean. Ties go to the smaller
    number. Without vectors the result is empty.
    """
    spark = table.sparkSession
    rows = whole_numbers(table, dimensions, scale, id_col, vector_col)
    first = rows.orderBy(F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("id").cast("string")), 256).asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(-1, dimensions)
    if not len(centroids):
        return spark.createDataFrame([], "id long, cluster int, distance long"), centroids
    forest = written(rows.select(F.col("id").cast("long").alias("id"), "v").mapInArrow(lambda batches: _trees(batches, dimensions), ROW_SQL), "kd-trees")
    for _ in range(rounds):
        now = centroids.copy()
        parts = forest.mapInArrow(lambda batches, now=now: _moved(batches, now), "cluster int, n long, sums array<long>")
        totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(dimensions))).alias("sums"))
        for r in totals.collect():  # a row per centroid
            centroids[r.cluster] = [s // r.n for s in r.sums]
    out = forest.drop("sums").mapInArrow(lambda batches: _assigned(batches, centroids), "id long, cluster int, distance long")
    return written(out, "assigned"), centroids


def digests(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Per vector its cluster and distance, the distances summed over its cluster and over all, and a digest of its centroid."""
    spark = assigned.sparkSession
    texts = spark.createDataFrame([(i, ",".join(map(str, c.tolist()))) for i, c in enumerate(centroids)], "cluster int, _text string")
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = assigned.agg(F.sum("distance").alias("inertia"))
    # a row per centroid and one row
    facts = sums.join(F.broadcast(texts), "cluster").crossJoin(F.broadcast(whole))
    out = assigned.join(F.broadcast(facts), "cluster")
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", F.sha2("_text", 256).alias("centroid_sha256"))


def _oracle(dimensions: int = 64, scale: int = 64, k: int = 16, rounds: int = 3) -> str:
    square = "list_sum(list_transform(range(1, {d} + 1), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i])))".format(d=dimensions)
    near = lambda c: f"SELECT r, vec_id, v, arg_min(n, (d, n)) AS n, min(d) AS d FROM (SELECT v.r, v.vec_id, v.v, c.n, CAST({square} AS BIGINT) AS d FROM v, {c} c) GROUP BY r, vec_id, v"
    steps = []
    for i in range(rounds):
        mean = f"SELECT n, list(m ORDER BY i) AS v FROM (SELECT n, i, CAST(floor(sum(x) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS m FROM (SELECT n, unnest(v) AS x, unnest(range({dimensions})) AS i FROM a{i}) GROUP BY n, i) GROUP BY n"
        steps.append(f"a{i} AS MATERIALIZED ({near(f'c{i}')}), m{i} AS ({mean}), c{i + 1} AS MATERIALIZED (SELECT c.n, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (n))")
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(x, lambda c: CAST(floor(c * {scale}) AS BIGINT)) AS v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
  WHERE len(x) = {dimensions} AND len(list_filter(x, lambda c: c IS NOT NULL AND isfinite(c))) = {dimensions}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS n, v FROM v ORDER BY sha256('{SEED}:' || vec_id), v LIMIT {k}),
{', '.join(steps)},
z AS MATERIALIZED ({near(f'c{rounds}')})
SELECT vec_id, CAST(z.n AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY z.n) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM z JOIN c{rounds} c USING (n)"""


ORACLE_SQL = _oracle()
