import numpy as np
import pytest

from pairlens.llm.embeddings import near_vectors

SCHEMA = "vec_id long, embedding array<double>, label int"


def run(spark, rows):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize("size", [1e200, 1e308, 1e-200, 5e-324, 1.0])
def test_components_of_any_size(spark, size):
    rows = [(1, [size, 0.0], 0), (2, [0.0, size], 0), (3, [size / 2 or size, 0.0], 0), (4, [-size, 0.0], 0), (5, [1.0, 0.0], 0)]
    assert run(spark, rows) == {1: (2, 1, True), 2: (0, 2, True), 3: (2, 1, False), 4: (0, 4, True), 5: (2, 1, False)}


def test_cosine_at_the_threshold_links(spark):
    """0.93 itself, in whole numbers: 93 of 100."""
    at = [93.0, float(np.sqrt(100.0**2 - 93.0**2))]
    below = [92.999, float(np.sqrt(100.0**2 - 92.999**2))]
    got = run(spark, [(1, [1.0, 0.0], 0), (2, at, 0), (3, [1.0, 0.0], 1), (4, below, 1)])
    exact = np.dot([1.0, 0.0], at) / np.linalg.norm(at) >= 0.93
    assert got[2][0] == int(exact) and got[4][0] == 0


def test_very_long_vectors_like_brute_force(spark):
    draw = np.random.default_rng(1)
    base = draw.standard_normal((6, 3000))
    x = np.concatenate([base, base[[0, 0, 1, 2]] + 0.1 * draw.standard_normal((4, 3000)), base[[3, 4]] + 0.45 * draw.standard_normal((2, 3000))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.93) & ~np.eye(len(x), dtype=bool)
    got = run(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(50, [0.0] * 99_999 + [1.0], 0), (51, [0.0] * 99_999 + [2.0], 0)])
    assert [got[i][0] for i in range(len(x))] == links.sum(1).tolist() and links.sum() > 4
    assert got[50] == (1, 50, True) and got[51] == (1, 50, False)
