import random

import numpy as np
import pytest

from pairlens.functions.similarity import longest_common_substring
from pairlens.models.embeddings import StaticEmbeddings, common_direction
from pairlens.operators.pairs import common_substring_pairs, cosine_matrix, similar_texts


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def made(seed, n):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abé") for _ in range(draw.randint(1, 14))) for _ in range(n)]
    return [*words, "anananananan", "nanananananan", "ananananan", "aaaaaaaaaa", "aaaaaaaaa", "", None, words[0]]


@pytest.mark.parametrize("least, q", [(0.75, 2), (0.6, 2), (0.9, 3), (1.0, 2)])
def test_similar_texts_like_all_pairs(spark, least, q):
    texts = made(1, 90)
    got = sorted((r["a"], r["b"], r["edits"]) for r in similar_texts(spark.createDataFrame([(t,) for t in texts], "t string"), None, "t", least, q).collect())
    held = sorted({t for t in texts if t})
    assert got == [(a, b, edits(a, b)) for a in held for b in held if a < b and (max(len(a), len(b)) - edits(a, b)) / max(len(a), len(b)) >= least - 1e-12]


def test_similar_texts_of_two_sides(spark):
    one, two = made(2, 40), made(3, 40)
    frame = lambda x: spark.createDataFrame([(t,) for t in x], "t string")
    got = sorted((r["a"], r["b"]) for r in similar_texts(frame(one), frame(two), "t", 0.7).collect())
    assert got == sorted((a, b) for a in {t for t in one if t} for b in {t for t in two if t} if a != b and (max(len(a), len(b)) - edits(a, b)) / max(len(a), len(b)) >= 0.7 - 1e-12)
    with pytest.raises(ValueError):
        similar_texts(frame(one), None, "t", 0.5)


def test_common_substrings_like_all_pairs(spark):
    one, two = made(4, 30), made(5, 30)
    frame = lambda x, c: spark.createDataFrame([(t,) for t in x], f"{c} string")
    got = sorted((r["a"], r["b"], r["substr"]) for r in common_substring_pairs(frame(one, "t"), frame(two, "t"), "t", 4).collect())
    every = frame({t for t in one if t}, "a").crossJoin(frame({t for t in two if t}, "b"))
    want = sorted((r["a"], r["b"], r["s"]) for r in every.select("a", "b", longest_common_substring("a", "b").alias("s")).where("length(s) >= 4").collect())
    assert got == want and want


def test_cosine_matrix_in_tiles(spark):
    draw = np.random.default_rng(1)
    a, b = draw.normal(size=(37, 5)), draw.normal(size=(53, 5))
    a[3] = 0
    frame = lambda x: spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), (900, None)], "id long, v array<double>")
    unit = lambda x: np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=np.linalg.norm(x, axis=1, keepdims=True) > 0)
    want = unit(a) @ unit(b).T
    got = np.full(want.shape, np.nan)
    for r in cosine_matrix(frame(a), frame(b), "id", "v", tile=10).collect():
        got[r["left"], r["right"]] = r["score"]
    assert got == pytest.approx(want)
    best = {}
    for r in cosine_matrix(frame(a), frame(b), "id", "v", top=4, tile=10).collect():
        best.setdefault(r["left"], []).append((-r["score"], r["right"]))
    assert [[j for _, j in sorted(best[i])] for i in range(37)] == [sorted(range(53), key=lambda j: (-round(want[i, j], 12), j))[:4] for i in range(37)]
    assert cosine_matrix(frame(a), frame(b[:0]), "id", "v").collect() == []


def test_static_embeddings_tell_texts_apart(spark):
    draw = random.Random(6)
    topics = (["red", "green", "blue", "paint"], ["bread", "butter", "milk", "cheese"])
    docs = [(i, [w for _ in range(12) for w in ("the", draw.choice(topics[i % 2]))]) for i in range(60)] + [(60, []), (61, None)]
    df = spark.createDataFrame(docs, "id long, w array<string>")
    model = StaticEmbeddings(size=6).fit(df, "id", "w")
    texts = model.transform(df, "id", "w")
    pairs = spark.createDataFrame([(0, 2), (0, 1), (3, 5), (3, 4), (0, 60), (0, 99)], "a long, b long")
    score = {(r["a"], r["b"]): r["score"] for r in model.text_similarity(texts, "id", pairs).collect()}
    assert score[0, 2] > 0.9 and score[3, 5] > 0.9 and score[0, 1] < 0 and score[3, 4] < 0 and score[0, 60] is None and score[0, 99] is None
    words = {(r["a"], r["b"]): r["score"] for r in model.word_similarity(spark.createDataFrame([("red", "blue"), ("red", "milk"), ("red", "none")], "a string, b string")).collect()}
    assert words["red", "blue"] > words["red", "milk"] and words["red", "none"] is None


def test_common_direction_is_the_leading_one(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(80, 4)) * 0.1 + np.outer(draw.normal(size=80) + 2, [1, 2, 0, -1])
    u = common_direction(spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>"), "v", 4, 20)
    lead = np.linalg.eigh(x.T @ x)[1][:, -1]
    assert abs(u @ lead) == pytest.approx(1, abs=1e-6)
