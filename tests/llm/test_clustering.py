import hashlib
import math
import random

import numpy as np
import pyarrow as pa

from pairlens.llm.clustering import SQL, Tree, ball_tree, cluster_vectors, op12_centroids, squares, whole_numbers
from tests.verify import compare, connect

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, __x string"


def brute(rows, k=8, rounds=10, dim=64):
    kept = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [r[1] for r in order[:k]]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        cents = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c for j, c in enumerate(cents)]
    found = [(i, *nearest(x)) for i, x in kept]
    per = {}
    for _, d, j in found:
        per[j] = per.get(j, 0) + d
    return sorted(((i, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, d, j in found), key=str)


def run(spark, rows, parts=3, **more):
    df = spark.createDataFrame([(i, v, 0, 7, "x") for i, v in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in cluster_vectors(df, **more).collect()), key=str)


def test_like_brute_force_with_ties_copies_and_odd_rows(spark):
    draw = random.Random(5)
    centres = [[draw.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    rows = [(i, [c + draw.gauss(0, 0.01 if i % 3 else 0.4) for c in draw.choice(centres)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 64) for i in range(150)]  # copies: a ball of radius 0
    rows += [(2000 + i, [float(i % 2)] + [0.0] * 63) for i in range(40)]  # ties
    rows += [(3, rows[3][1]), (None, rows[5][1]), (None, [9.0] * 64), (3000, None), (3001, []), (3002, [1.0] * 63), (3003, [1.0] * 65)]
    rows += [(3004, [None] + [1.0] * 63), (3005, [math.nan] * 64), (3006, [math.inf] + [0.0] * 63), (3007, [-4000.0] * 64)]
    assert run(spark, rows) == brute(rows)


def test_fewer_vectors_than_clusters_and_empty(spark):
    rows = [(1, [0.25] * 64), (2, [-0.25] * 64), (2, [0.75] * 64)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_components_beyond_the_limit_count_as_the_limit(spark):
    rows = [(1, [1e300] * 64), (2, [-1e300] * 64), (3, [1.0] * 64)]
    limit = [(1, [131072.0] * 64), (2, [-131072.0] * 64), (3, [1.0] * 64)]
    assert run(spark, rows) == brute(limit)


def test_balls_are_given_whole_only_where_exact_search_agrees():
    draw = np.random.default_rng(1)
    for spread in (1, 30, 4000):
        x = (draw.integers(-5, 5, (40, 8)) * 1000)[draw.integers(0, 40, 3000)] + draw.integers(-spread, spread, (3000, 8))
        order, nodes, radius, sums = ball_tree(x)
        assert sorted(order) == list(range(len(x))) and (sums[0] == x.sum(0)).all()
        tree = Tree({"ids": None, "x": x[order].astype(np.int32).tobytes(), "nodes": nodes.tobytes(), "radius": radius.tobytes(), "sums": sums.tobytes()}, 8)
        centroids = x[:7].copy()
        label, far = tree.labels(centroids)
        exact = squares(x[order], centroids)
        assert (label == exact.argmin(1)).all() and (far == exact.min(1)).all()
        if spread == 1:
            assert len(tree.filtered(centroids)[0])  # some balls do go whole


def test_whole_numbers_round_down():
    fine, x = whole_numbers(pa.array([[-0.0001, 0.9999], None, [1.0]], pa.list_(pa.float64())), 2)
    assert fine.tolist() == [0] and x.tolist() == [[-1, 1023]]


def test_like_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert compare(spark, connect(folder), op12_centroids, SQL, folder) == ""
