"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with cosine c lie sqrt(2 - 2c) apart; that is epsilon. Vectors are turned to the principal
axes of the whole table and sorted, by label and length, by the epsilon-wide grid cells of the leading axes
(the epsilon grid order). The order is cut into sequence intervals of bounded size. Two intervals meet
only if their bounding boxes are not provably farther apart than epsilon, and are then joined
recursively: halves are skipped where their boxes (or centres and radii) are provably distant, counted
whole where they are provably near, and compared vector by vector at the bottom.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, table

THRESHOLD = 0.93
#: Leading axes that make the grid order and the boxes.
AXES = 8
#: Axes whose cells bring boxes together.
KEYS = 3
#: Vectors of an interval, and of the bottom of the recursion.
INTERVAL, LEAF = 2048, 128
#: Components beyond which axes are sought among FEW random directions, and components that are held as doubles at once.
WIDE, FEW, CELLS = 512, 32, 1 << 22
#: How near to the threshold a product of unit vectors is computed again from the raw ones.
CLOSE = 1e-9


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of up to dim components as doubles, zeros after the last; the column holds no nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) == len(column) * dim:
        return flat.reshape(len(column), dim)
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim))
    out[np.repeat(np.arange(len(column)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their greatest component: the same directions, exactly, and squares that neither overflow nor vanish."""
    if not x.size:
        return x
    _, exponent = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    half = exponent // 2  # in two steps: one power might itself be out of range
    return np.ldexp(np.ldexp(x, -half), half - exponent)


def _units_of(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def _usable(vectors: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite & F.exists("embedding", lambda x: x != 0))


def _axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Orthogonal axes (columns) that the unit vectors spread along, leading first.

    Up to WIDE components these are the principal axes, from sums over all rows; dim * dim numbers reach the
    driver. Longer vectors are first thrown on FEW random directions, whose principal axes then are taken:
    any orthogonal axes give right boxes, as a projection never lengthens a distance.
    """
    width = dim if dim <= WIDE else FEW

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, base = np.zeros((width + 1, width + 1)), _random_axes(dim) if dim > WIDE else None
        for batch in batches:
            for x in _slices(batch.column(0), dim):
                u = _units_of(x)
                u = np.hstack([u if base is None else u @ base, np.ones((len(x), 1))])
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "x"])

    rows = vectors.select("embedding").mapInArrow(sums, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    total = np.zeros((width + 1) ** 2)
    for r in rows:
        total[r["i"]] = r["x"]
    total = total.reshape(width + 1, width + 1)
    n = max(total[width, width], 1.0)
    mean = total[width, :width] / n
    _, axes = np.linalg.eigh(total[:width, :width] / n - np.outer(mean, mean))
    lead = axes[:, ::-1][:, :AXES]
    return _random_axes(dim) @ lead if dim > WIDE else lead


def _random_axes(dim: int) -> np.ndarray:
    """FEW orthogonal directions in dim dimensions, the same each time."""
    q, _ = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, FEW)))
    return q


def _slices(column: pa.Array, dim: int) -> Iterator[np.ndarray]:
    """Vectors as doubles, a bounded number of components at a time and at least one vector."""
    step = max(1, CELLS // max(dim, 1))
    for at in range(0, len(column), step):
        yield _matrix(column.slice(at, step), dim)


def _gridder(axes: np.ndarray, eps: float) -> Callable:
    """Adds the cells on the leading axes."""
    lead = axes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.concatenate([np.zeros((0, lead.shape[1])), *(_units_of(x) @ lead for x in _slices(batch.column(1), len(axes)))])
            cells = np.floor(y / eps).astype(np.int32)
            arrays = [*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * lead.shape[1], pa.int32()), pa.array(cells.ravel(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "cells"])

    return run


def _cutter(axes: np.ndarray, interval: int) -> Callable:
    """Sorted rows (node, embedding, group, copies, cells) to the same with an interval id, and the intervals' boxes on their last rows."""
    lead = axes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held, label = TaskContext.get().partitionId(), 0, [], None

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            y = np.concatenate([_units_of(x) @ lead for x in _slices(t.column(1), len(axes))])
            box = np.concatenate([y.min(0), y.max(0)])
            n = len(y)
            offsets = np.zeros(n + 1, np.int32)
            offsets[-1] = len(box)
            ids = np.full(n, (part << 32) + seq, np.int64)
            return pa.RecordBatch.from_arrays([t.column(0), t.column(1), t.column(2), t.column(3), pa.array(ids), pa.ListArray.from_arrays(pa.array(offsets), pa.array(box))], names=["node", "embedding", "group", "copies", "interval", "box"])

        for batch in batches:
            labels = batch.column(2).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(labels):
                same = at + int(np.argmin(np.append(labels[at:] == labels[at], False)))
                room = interval - sum(map(len, held))
                if held and (labels[at] != label or not room):
                    yield done()
                    seq, held, room = seq + 1, [], interval
                label, end = labels[at], min(same, at + room)
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield done()

    return run


def _box_gap(a: np.ndarray, b: np.ndarray) -> float:
    """The least distance of two boxes given as lows and highs."""
    d = len(a) // 2
    gap = np.maximum(0, np.maximum(a[:d] - b[d:], b[:d] - a[d:]))
    return float(np.sqrt((gap * gap).sum()))


class _Join:
    """Counts links and finds trees of links between two sorted intervals, or within one."""

    def __init__(self, x: np.ndarray, copies: np.ndarray, axes: np.ndarray, threshold: float) -> None:
        # A power of two changes no cosine.
        x = _scaled(x)
        self.x, self.copies, self.threshold = x, copies, threshold
        self.norm = np.linalg.norm(x, axis=1)
        self.u = x / self.norm[:, None]
        self.y = self.u @ axes
        self.eps = float(np.sqrt(2 - 2 * threshold))
        self.links = np.zeros(len(x), np.int64)
        self.root = np.arange(len(x))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def linked(self, i: int, j: int) -> None:
        if (a := self.find(i)) != (b := self.find(j)):
            self.root[max(a, b)] = min(a, b)

    def join(self, a0: int, a1: int, b0: int, b1: int) -> None:
        """Every pair of [a0, a1) and [b0, b1), which are equal or apart."""
        same = a0 == b0 and a1 == b1
        if a0 >= a1 or b0 >= b1:
            return
        if not same:
            ya, yb = self.y[a0:a1], self.y[b0:b1]
            if _box_gap(np.concatenate([ya.min(0), ya.max(0)]), np.concatenate([yb.min(0), yb.max(0)])) > self.eps + CLOSE:
                return
            ca, cb = self.u[a0:a1].mean(0), self.u[b0:b1].mean(0)
            reach = np.linalg.norm(self.u[a0:a1] - ca, axis=1).max() + np.linalg.norm(self.u[b0:b1] - cb, axis=1).max()
            apart = np.linalg.norm(ca - cb)
            if apart - reach > self.eps + CLOSE:
                return
            if apart + reach < self.eps - CLOSE:
                self.links[a0:a1] += self.copies[b0:b1].sum()
                self.links[b0:b1] += self.copies[a0:a1].sum()
                for i in range(a0, a1):
                    self.linked(i, b0)
                for j in range(b0, b1):
                    self.linked(a0, j)
                return
        if a1 - a0 > LEAF or b1 - b0 > LEAF:
            am, bm = (a0 + a1) // 2, (b0 + b1) // 2
            if same:
                self.join(a0, am, a0, am)
                self.join(a0, am, am, a1)
                self.join(am, a1, am, a1)
            elif a1 - a0 >= b1 - b0:
                self.join(a0, am, b0, b1)
                self.join(am, a1, b0, b1)
            else:
                self.join(a0, a1, b0, bm)
                self.join(a0, a1, bm, b1)
            return
        cos = self.u[a0:a1] @ self.u[b0:b1].T
        hit = cos >= self.threshold
        for i, j in np.argwhere(np.abs(cos - self.threshold) < CLOSE):
            hit[i, j] = self.x[a0 + i] @ self.x[b0 + j] / (self.norm[a0 + i] * self.norm[b0 + j]) >= self.threshold
        if same:
            np.fill_diagonal(hit, False)
        if not hit.any():
            return
        self.links[a0:a1] += hit @ self.copies[b0:b1]
        if not same:
            self.links[b0:b1] += hit.T @ self.copies[a0:a1]
        for i in np.flatnonzero(hit.any(1)):
            for j in np.flatnonzero(hit[i]):
                self.linked(a0 + i, b0 + j)


def _unit_joiner(axes: np.ndarray, threshold: float) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["second", "place"], kind="stable")
        x = np.zeros((len(pdf), len(axes)))
        for row, v in zip(x, pdf.embedding):
            row[: len(v)] = v
        j = _Join(x, pdf.copies.to_numpy(), axes, threshold)
        n = int((~pdf.second).sum())
        if n == len(pdf):
            j.join(0, n, 0, n)
        else:
            j.join(0, n, n, len(pdf))
        node = pdf.node.to_numpy()
        return pd.DataFrame({"node": node, "links": j.links, "root": node[[j.find(i) for i in range(len(pdf))]]})

    return run


def _units(cuts: DataFrame, width: int, eps: float) -> DataFrame:
    """(a, b): pairs of intervals of one group, a <= b, whose boxes are not provably apart.

    Boxes meet by the cells they overlap or touch on the first KEYS axes; of all common cells the least one
    alone makes the pair.
    """
    boxes = cuts.where("size(box) > 0").select("group", "interval", "box")
    low = lambda i: F.floor(F.get("box", F.lit(i)) / eps)
    high = lambda i: F.floor(F.get("box", F.lit(width + i)) / eps)
    on = range(min(KEYS, width))
    left = boxes.select("group", F.col("interval").alias("a"), F.col("box").alias("box_a"), *((low(i) - 1).alias(f"la{i}") for i in on), *((high(i) + 1).alias(f"ha{i}") for i in on))
    right = boxes.select("group", F.col("interval").alias("b"), F.col("box").alias("box_b"), *(low(i).alias(f"lb{i}") for i in on), *(high(i).alias(f"hb{i}") for i in on))
    keys = ["group"]
    least = F.lit(True)
    for i in on:
        left = left.withColumn(f"c{i}", F.explode(F.sequence(f"la{i}", f"ha{i}")))
        right = right.withColumn(f"c{i}", F.explode(F.sequence(f"lb{i}", f"hb{i}")))
        keys.append(f"c{i}")
        least = least & (F.col(f"c{i}") == F.greatest(f"la{i}", f"lb{i}"))
    gaps = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.greatest(F.lit(0.0), F.get("box_a", i) - F.get("box_b", i + width), F.get("box_b", i) - F.get("box_a", i + width)))
    square = F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g * g)
    return left.join(right, keys).where("a <= b").where(least).where(square <= (eps + CLOSE) ** 2).select("a", "b")


def _links(nodes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(node, links, root) of nodes(node, embedding, group, copies) with up to dim components."""
    axes = _axes(nodes, dim)
    eps = float(np.sqrt(2 - 2 * threshold))
    gridded = nodes.mapInArrow(_gridder(axes, eps), "node long, embedding array<double>, group long, copies long, cells array<int>")
    ordered = gridded.repartitionByRange("group", "cells", "node").sortWithinPartitions("group", "cells", "node")
    # Long vectors make shorter intervals: two of them are in one task's hands.
    interval = max(1, min(INTERVAL, CELLS // dim))
    # Range boundaries are drawn from a sample, so what was cut is kept.
    cuts = cut(ordered.mapInArrow(_cutter(axes, interval), "node long, embedding array<double>, group long, copies long, interval long, box array<double>"))
    units = cut(_units(cuts, min(AXES, dim), eps))
    sides = units.select("a", "b", F.col("a").alias("interval"), F.lit(False).alias("second")).union(units.where("a <> b").select("a", "b", F.col("b").alias("interval"), F.lit(True).alias("second")))
    placed = cuts.select("interval", "node", "embedding", "copies").withColumn("place", F.monotonically_increasing_id())
    # Dealt out by pair: the join by interval before may then be split.
    return sides.join(placed, "interval").repartition("a", "b").groupBy("a", "b").applyInPandas(_unit_joiner(axes, threshold), "node long, links long, root long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links among vectors(vec_id, embedding, label, ...) of equal label and length with cosine at the threshold or over it.

    One row for each row: vec_id, n_links (other rows linked directly), component_id (smallest vec_id
    that links reach), kept (vec_id is component_id). A null label, and a vector that is null, empty,
    all zeros, or holds null, NaN or infinite components, links with nothing, and vectors of different
    lengths do not link. Components of any finite size count, and vectors of any length. Equal vectors of a label are one node with a number of copies, told apart by 128
    bits of hashes. A null vec_id takes part but is never the smallest; where a component has none other, component_id is null
    and kept is true. Other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("long"))
    rows = rows.select("*", F.xxhash64("label", "embedding").alias("h"), F.xxhash64(F.lit(1), "label", "embedding").alias("g"))
    fine = _usable(rows).groupBy("h", "g").agg(F.first("embedding").alias("embedding"), F.first("label").alias("label"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("vec_id"))
    # Numbers by place in what is written: no two nodes share one.
    nodes = cut(fine).withColumn("node", F.monotonically_increasing_id())
    size = F.size("embedding")
    # Lengths are taken together up to the next power of two, which makes 31 classes at most; a group has one label and one length.
    fold = F.ceil(F.log2(size)).alias("fold")
    widths = {r["fold"]: r["dim"] for r in nodes.groupBy(fold).agg(F.max(size).alias("dim")).collect()}
    found = None
    for k, dim in sorted(widths.items()):
        part = nodes.where(fold == k).select("node", "embedding", F.xxhash64("label", size).alias("group"), "copies")
        links = _links(part, dim, threshold)
        found = links if found is None else found.union(links)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut(found)
    labels = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy(F.col("node").alias("cn")).agg(F.sum("links").alias("links"))
    lab = labels.select(F.col("node").alias("ln"), F.col("component").alias("lc"))
    each = nodes.select("h", "g", "node", "copies", "vec_id").join(counts, F.col("node") == F.col("cn"), "left").join(lab, F.col("node") == F.col("ln"), "left")
    each = each.select("h", "g", "vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("lc", "node").alias("comp"))
    least = each.groupBy(F.col("comp").alias("gc")).agg(F.min("vec_id").alias("component"))
    each = each.join(least, F.col("comp") == F.col("gc")).select(F.col("h").alias("jh"), F.col("g").alias("jg"), "links", "component")
    joined = rows.select("vec_id", "h", "g").join(each, (F.col("h") == F.col("jh")) & (F.col("g") == F.col("jg")), "left")
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: All pairs, and components by following links to smaller ids.
SQL = """with recursive v as materialized (select vec_id, label, embedding::double[] as x from embeddings where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0),
e as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.x) = len(b.x) and a.vec_id <> b.vec_id where list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.93),
r as (select vec_id as a, vec_id as c from embeddings union select e.a, r.c from r join e on e.b = r.a where r.c < e.a),
m as (select a, min(c) as c from r group by 1)
select m.a as vec_id, (select count(*) from e where e.a = m.a) as n_links, m.c as component_id, m.a = m.c as kept from m"""
