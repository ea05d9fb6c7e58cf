"""Centroid clustering in whole numbers, by ball-tree filtering.

Each task cuts its vectors into runs of bounded size and builds a metric tree over each: a node is a
ball with its radius, its count and its integer sum. The trees are written once. In each round a ball
whose every point is provably nearer to one centroid than to all others, by the triangle inequality,
gives its count and sum to that centroid as a whole; other balls are opened, and leaves compare each
vector exactly. What reaches the driver in a round are the sums of the clusters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, trimmed

SCALE, DIM = 1024, 64
CLUSTERS, ROUNDS, SEED = 8, 10, 3
#: Vectors of a tree, and of a leaf.
TREE, LEAF = 8192, 32
#: Components beyond this count as this: a squared distance then fits a long.
MOST = 1 << 27
#: Products of components up to this add up exactly in doubles.
PLAIN = 1 << 22

TREES = "ids array<long>, x binary, nodes binary, radius binary, sums binary"


def whole_numbers(column: pa.Array, dim: int = DIM, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """(places of the usable vectors, their floor(scale * x)): those of exactly dim components, none null, NaN or infinite."""
    fine = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False))
    held = column.take(pa.array(fine))
    x = held.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fine), dim)
    finite = np.isfinite(x).all(axis=1)
    return fine[finite], np.clip(np.floor(x[finite] * scale), -MOST, MOST).astype(np.int64)


def ball_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, nodes, radius, sums) of the rows of x: a node holds order[start:end]; nodes are (start, end, left child), -1 for a leaf, and the right child follows the left one."""
    order, nodes, radius, sums = np.arange(len(x)), [[0, len(x), -1]], [], []
    for at in nodes:  # grows as children are added
        start, end, _ = at
        points = x[order[start:end]]
        total = points.sum(0)
        gap = np.sqrt(((points - total / len(points)) ** 2).sum(1))
        radius.append(gap.max())
        sums.append(total)
        if end - start > leaf and gap.max() > 0:
            one = points[gap.argmax()]
            two = points[((points - one) ** 2).sum(1).argmax()]
            middle = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition((points - one) @ (two - one).astype(np.float64), middle)]
            at[2] = len(nodes)
            nodes += [[start, start + middle, -1], [start + middle, end, -1]]
    return order, np.array(nodes, np.int32), np.array(radius), np.array(sums)


def _planted(dim: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xs, n = [], [], 0

        def done() -> pa.RecordBatch:
            nonlocal ids, xs, n
            x, names = np.concatenate(xs), pa.concat_arrays(ids)
            order, nodes, radius, sums = ball_tree(x)
            ids, xs, n = [], [], 0
            row = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), names.take(pa.array(order)))]
            row += [pa.array([a.tobytes()], pa.binary()) for a in (x[order].astype(np.int32), nodes, radius, sums)]
            return pa.RecordBatch.from_arrays(row, names=["ids", "x", "nodes", "radius", "sums"])

        for batch in batches:
            fine, x = whole_numbers(batch.column(1), dim)
            names, at = batch.column(0).take(pa.array(fine)), 0
            while at < len(x):
                end = min(len(x), at + TREE - n)
                ids.append(names.slice(at, end - at))
                xs.append(x[at:end])
                n, at = n + end - at, end
                if n == TREE:
                    yield done()
        if n:
            yield done()

    return run


def squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exact: in doubles where every sum stays below 2**53, else in whole numbers."""
    if not len(x) or max(np.abs(x).max(), np.abs(centroids).max()) <= PLAIN:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)


class Tree:
    def __init__(self, row: dict, dim: int) -> None:
        self.ids = row["ids"]
        self.x = np.frombuffer(row["x"], np.int32).reshape(-1, dim).astype(np.int64)
        self.nodes = np.frombuffer(row["nodes"], np.int32).reshape(-1, 3)
        self.radius = np.frombuffer(row["radius"])
        self.sums = np.frombuffer(row["sums"], np.int64).reshape(-1, dim)
        self.counts = (self.nodes[:, 1] - self.nodes[:, 0]).astype(np.int64)

    def filtered(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(balls, their centroids, rows of open leaves, their centroids); of equal distances the smaller number."""
        balls, owners, leaves, front = [], [], [], np.zeros(1, np.int64)
        slack = 1e-9 * (1 + np.abs(self.x).max(initial=0) + np.abs(centroids).max(initial=0)) * len(centroids[0])
        while len(front):
            gap = np.sqrt((((self.sums[front] / self.counts[front, None])[:, None, :] - centroids[None]) ** 2).sum(2))
            near = gap.argmin(1)
            best = gap[np.arange(len(front)), near]
            gap[np.arange(len(front)), near] = np.inf
            sure = gap.min(1) - self.radius[front] > best + self.radius[front] + slack
            balls.append(front[sure])
            owners.append(near[sure])
            rest = front[~sure]
            left = self.nodes[rest, 2]
            leaves += [np.arange(s, e) for s, e, _ in self.nodes[rest[left < 0]]]
            front = np.concatenate([left[left >= 0], left[left >= 0] + 1]).astype(np.int64)
        rows = np.concatenate([*leaves, np.zeros(0, np.int64)]).astype(np.int64)
        return np.concatenate(balls), np.concatenate(owners), rows, squares(self.x[rows], centroids).argmin(1)

    def labels(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of each row."""
        out = np.zeros(len(self.x), np.int64)
        balls, owners, rows, near = self.filtered(centroids)
        for (start, end, _), c in zip(self.nodes[balls], owners):
            out[start:end] = c
        out[rows] = near
        return out, ((self.x - centroids[out]) ** 2).sum(1)


def _trees(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[Tree]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Tree({c: batch.column(c)[i].as_buffer() if c != "ids" else batch.column(c)[i].values for c in batch.schema.names}, dim)


def _summed(centroids: np.ndarray) -> Callable:
    """Trees to (cluster, i, s): component sums by i, counts under -1, of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = centroids.shape
        total = np.zeros((k, dim + 1), np.int64)
        for tree in _trees(trimmed(batches), dim):
            balls, owners, rows, near = tree.filtered(centroids)
            np.add.at(total[:, 0], owners, tree.counts[balls])
            np.add.at(total[:, 1:], owners, tree.sums[balls])
            total[:, 0] += np.bincount(near, minlength=k)
            for c in range(k):
                total[c, 1:] += tree.x[rows[near == c]].sum(0)
        cluster, i = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(i - 1, pa.int32()), pa.array(total[cluster, i])], names=["cluster", "i", "s"])

    return run


def _inertia(centroids: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * len(centroids)
        for tree in _trees(trimmed(batches), centroids.shape[1]):
            label, far = tree.labels(centroids)
            for c in range(len(total)):
                total[c] += int(far[label == c].sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([str(t) for t in total])], names=["cluster", "s"])

    return run


def _labelled(centroids: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree in _trees(trimmed(batches), centroids.shape[1]):
            label, far = tree.labels(centroids)
            yield pa.RecordBatch.from_arrays([tree.ids, pa.array(label, pa.int32()), pa.array(far)], names=["vec_id", "cluster", "distance"])

    return run


def first_centroids(vectors: DataFrame, k: int, seed: int, dim: int = DIM) -> np.ndarray:
    """The k usable vectors whose sha256 of seed:vec_id is least; those without an id come last, equal hashes by components."""

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine, x = whole_numbers(batch.column(1), dim)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dim, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(fine)), rows], names=["vec_id", "x"])

    rows = vectors.select("vec_id", "embedding").mapInArrow(usable, "vec_id long, x array<long>")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    least = rows.orderBy(order.asc_nulls_last(), "x").limit(k).collect()  # k rows
    return np.array([r["x"] for r in least], np.int64).reshape(-1, dim)


def cluster_vectors(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM) -> DataFrame:
    """Clusters of vectors(vec_id, embedding, ...) after so many rounds, in whole numbers.

    One row for each vector of exactly dim components, none null, NaN or infinite; others are left out.
    Returns vec_id, cluster, distance (squared, to its final centroid), cluster_inertia, inertia (null
    if a long can't hold it) and centroid_sha256. Each component counts as floor(1024 * x), and as
    2**27 with its sign beyond that. Of equally near centroids the smaller number wins; a centroid
    without vectors stays. Repeated rows and ids count as often as they occur; a null vec_id takes
    part, and starts as a centroid only where ids run out. Fewer than k vectors make fewer clusters, an
    empty table gives no rows, other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    centroids = first_centroids(rows, k, seed, dim)
    if not len(centroids):
        return rows.where("false").selectExpr("vec_id", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256")
    trees = cut(rows.mapInArrow(_planted(dim), TREES))
    for _ in range(rounds):
        sums = trees.mapInArrow(_summed(centroids), "cluster int, i int, s long").groupBy("cluster", "i").agg(F.sum("s").alias("s")).collect()  # k * (dim + 1) rows
        counts = {r["cluster"]: r["s"] for r in sums if r["i"] < 0}
        moved = centroids.copy()
        for c in counts:
            moved[c] = 0
        for r in sums:
            if r["i"] >= 0:
                moved[r["cluster"], r["i"]] = r["s"] // counts[r["cluster"]]
        if (moved == centroids).all():
            break
        centroids = moved
    each = {r["cluster"]: int(r["s"]) for r in trees.mapInArrow(_inertia(centroids), "cluster int, s string").groupBy("cluster").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    fits = lambda n: n if n < 1 << 63 else None
    inertia = F.array(*(F.lit(fits(each[c])).cast("long") for c in range(len(centroids))))
    names = F.array(*(F.lit(hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for c in centroids))
    out = trees.mapInArrow(_labelled(centroids), "vec_id long, cluster int, distance long")
    return out.select("vec_id", "cluster", "distance", F.get(inertia, F.col("cluster")).alias("cluster_inertia"), F.lit(fits(sum(each.values()))).cast("long").alias("inertia"), F.get(names, F.col("cluster")).alias("centroid_sha256"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds written out one after another."""
    parts = [
        f"v as materialized (select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as x from embeddings where len(embedding) = {DIM} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"c0 as materialized (select (row_number() over (order by sha256('{SEED}:' || vec_id)) - 1)::int as c, x from v qualify c < {CLUSTERS})",
    ]
    square = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint"
    near = f"select v.vec_id, v.x, arg_min(c.c, ({{s}}, c.c)) as c, min({{s}}) as d from v, {{t}} c group by all".replace("{s}", square)
    for i in range(ROUNDS):
        parts.append(f"a{i} as materialized ({near.format(t=f'c{i}')})")
        parts.append(f"s{i} as (select c, j, sum(v)::bigint as s, count(*) as n from (select c, unnest(x) as v, generate_subscripts(x, 1) as j from a{i}) group by c, j)")
        parts.append(f"m{i} as (select c, list((s - ((s % n) + n) % n) // n order by j) as x from s{i} group by c)")
        parts.append(f"c{i + 1} as materialized (select o.c, coalesce(m.x, o.x) as x from c{i} o left join m{i} m on o.c = m.c)")
    last = near.format(t=f"c{ROUNDS}")
    return f"with {', '.join(parts)}, a as materialized ({last}) select a.vec_id, a.c as cluster, a.d as distance, sum(a.d) over (partition by a.c)::bigint as cluster_inertia, sum(a.d) over ()::bigint as inertia, sha256(array_to_string(f.x, ',')) as centroid_sha256 from a join c{ROUNDS} f on a.c = f.c"


SQL = _sql()
