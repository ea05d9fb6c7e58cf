import math
import random

import pytest

from pairlens.models.topics import STRETCH, Topics, window_coherence, window_counts, word_topics


def texts():
    draw = random.Random(1)
    words = [f"w{i}" for i in range(8)]
    return [(i, [draw.choice(words) for _ in range(n)]) for i, n in enumerate((0, 1, 5, 30, 3 * STRETCH + 7, 2))]


TOPICS = [(0, "w0"), (0, "w1"), (0, "w2"), (1, "w2"), (1, "w5"), (1, "none")]


def brute(window):
    total, counts = 0, {}
    for _, words in texts():
        for s in range(max(1, len(words) - window + 1) if words else 0):
            total += 1
            held = set(words[s : s + window])
            for t, a in TOPICS:
                for u, b in TOPICS:
                    if t == u and a <= b and a in held and b in held:
                        counts[t, a, b] = counts.get((t, a, b), 0) + 1
    return total, counts


@pytest.mark.parametrize("window", [1, 4, 400])
def test_window_counts_and_coherence_like_every_window(spark, window):
    docs = spark.createDataFrame([*texts(), (90, None)], "id long, w array<string>")
    topics = spark.createDataFrame(TOPICS, "topic int, term string")
    total, want = brute(window)
    assert {(r["topic"], r["a"], r["b"]): r["n"] for r in window_counts(docs, "id", "w", topics, window).collect()} == want

    def npmi(t, a, b):
        pa, pb, p = want.get((t, a, a), 0) / total, want.get((t, b, b), 0) / total, want.get((t, min(a, b), max(a, b)), 0) / total + 1e-12
        return math.log(p / (pa * pb)) / -math.log(p) if pa and pb else 0.0

    got = {r["topic"]: r["coherence"] for r in window_coherence(docs, "id", "w", topics, window).collect()}
    for t in (0, 1):
        terms = [w for u, w in TOPICS if u == t]
        rows = {a: [npmi(t, a, b) for b in terms] for a in terms}
        all_ = [sum(rows[a][i] for a in terms) for i in range(len(terms))]
        norm = lambda v: math.sqrt(sum(x * x for x in v))
        cos = [sum(x * y for x, y in zip(rows[a], all_)) / (norm(rows[a]) * norm(all_)) if norm(rows[a]) * norm(all_) else 0.0 for a in terms]
        assert got[t] == pytest.approx(sum(cos) / len(cos), abs=1e-6)


def test_word_topics_share_a_words_occurrences(spark):
    counts = spark.createDataFrame([("d", "a", 4), ("d", "b", 1), ("d", "c", 2)], "k string, word string, n long")
    shares = spark.createDataFrame([("d", 0, 0.75), ("d", 1, 0.25)], "k string, topic int, p double")
    phi = spark.createDataFrame([(0, "a", 0.5), (1, "a", 0.5), (1, "b", 0.1)], "topic int, word string, weight double")
    got = [(r["word"], r["topic"], r["weight"], r["rank"]) for r in word_topics(counts, "k", shares, phi).orderBy("word", "rank").collect()]
    assert got == [("a", 0, 3.0, 1), ("a", 1, 1.0, 2), ("b", 1, 1.0, 1)]


def test_sweep_keeps_the_most_coherent(spark):
    draw = random.Random(2)
    groups = (["red", "green", "blue"], ["milk", "bread", "cheese"])
    docs = spark.createDataFrame([(i, [draw.choice(groups[i % 2]) for _ in range(20)]) for i in range(40)], "id long, w array<string>")
    best, tried = Topics(iterations=10, window=5, top=3).sweep(docs, "id", "w", [2, 3])
    assert [t[0] for t in tried] == [2, 3] and best.k == max(tried, key=lambda t: (t[1], -t[0]))[0] and all(t[2] > 0 for t in tried)
    phi = {r["topic"]: r["s"] for r in best.phi().groupBy("topic").agg({"weight": "sum"}).withColumnRenamed("sum(weight)", "s").collect()}
    assert all(s == pytest.approx(1) for s in phi.values())
    per = best.word_topics(docs, "id", "w", 0.0).groupBy("id").agg({"weight": "sum"}).collect()
    assert all(r["sum(weight)"] == pytest.approx(20) for r in per)
