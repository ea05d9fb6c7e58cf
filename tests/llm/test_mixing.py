import heapq
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.llm.mixing import lap_keys, mix, mixed_texts, n_words, op11_mix, permuted, source_weights, with_quotas, with_targets

SCHEMA = "doc_id long, source string, text string, size int, taken string, part int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(parts)


def brute_targets(sizes, weights=(3.0, 1.0, 2.0), share=1.5, laps=2):
    """By sharing out the excess again and again. sizes: by source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_, left = dict.fromkeys(order, 0.0), set(order), share * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            out[s] += left * weight[s] / total
        left = sum(max(0.0, out[s] - laps * sizes[s]) for s in open_)
        full = {s for s in open_ if out[s] >= laps * sizes[s] - 1e-9}
        out |= {s: float(laps * sizes[s]) for s in full}
        open_ -= full
    return out


def brute_quotas(targets, most, houses):
    """Seat by seat, to the highest quotient."""
    heap = [(-t / 0.5, i, 0) for i, t in enumerate(targets) if t > 0 and most[i]]
    heapq.heapify(heap)
    given, out = [0] * len(targets), []
    for seat in range(houses[-1] + 1):
        while len(out) < len(houses) and houses[len(out)] == seat:
            out.append(list(given))
        if heap:
            _, i, k = heapq.heappop(heap)
            given[i] += 1
            if k + 1 < most[i]:
                heapq.heappush(heap, (-targets[i] / (k + 1.5), i, k + 1))
    return out


def texts(seed, n, sources):
    draw = random.Random(seed)
    return [(i, draw.choice(sources), " ".join("w" * draw.randint(1, 3) for _ in range(draw.choice((0, 1, 5, 40, 300))))) for i in range(n)]


def test_words(spark):
    odd = [None, "", " ", "\x0b\x0c", "a", " a b\tc\nd\x0be\x0cf\rg  ", "a b  c", "\x1c\x1d \x85", "x" * 100_000 + " y", "é\U0001f600 \U0001f600", "a \n" * 50_000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").select("i", n_words(F.col("t")).alias("n")).collect()
    assert {r["i"]: r["n"] for r in got} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(odd)}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 5, "b": 1000, "é": 70, "z": 30, "A": 1, None: 900}, {"a": 0, "b": 10}, {"a": 0}, {f"s{i}": 1 + i * i % 97 for i in range(60)}])
def test_targets_like_sharing_out_again(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in with_targets(source_weights(df)).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_weights_by_name(spark):
    df = spark.createDataFrame([("a", 100), ("b", 100), (None, 100), ("c", 50)], "source string, size long")
    got = {r["source"]: r["target"] for r in with_targets(source_weights(df, {"a": 2, None: 1}), share=0.3).collect()}
    assert got == pytest.approx({"a": 70.0, "b": 0.0, "c": 0.0, None: 35.0})


@pytest.mark.parametrize("targets", [[100.0] * 7, [1000.4, *[0.4] * 100], [64.0, 32.0, 0.0, 1e-3], [3000.0, 16.0, 8.0, 8.0, 8.0], [0.0, 0.0], [7.0 * 1.3**i for i in range(30)]])
def test_quotas_like_seat_by_seat(spark, targets):
    sizes = [int(t / 1.4) + i % 5 + 1 for i, t in enumerate(targets)]
    df = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(zip(sizes, targets))], "rank long, source_size long, target double")
    rows = sorted((r["rank"], r["blocks"], r["quotas"]) for r in with_quotas(df, 16, 5).collect())
    houses = [round(sum(targets) / 16) * (i + 1) // 5 for i in range(5)]
    assert [list(q) for q in zip(*(r[2] for r in rows))] == brute_quotas(targets, [2 * r[1] for r in rows], houses)


def test_permutation():
    for n in (1, 2, 3, 16, 1000):
        for lap in (0, 1):
            got = permuted(np.arange(n), np.full(n, n), lap_keys(7, np.full(n, 3), np.full(n, lap)))
            assert sorted(got) == list(range(n))
    firsts = [int(permuted(np.array([5]), np.array([100]), lap_keys(s, np.array([0]), np.array([0])))[0]) for s in range(4000)]
    counts = np.bincount(firsts, minlength=100)
    assert counts.min() > 10 and counts.max() < 80  # 40 each on average


def test_mix_keeps_to_targets_and_limits(spark):
    rows = texts(1, 400, ["a", "b", "c", "B", "é", None]) + [(5000, "a", "one two three")] * 50 + [(None, None, None), (900, "empty", ""), (901, "a", "w " * 30_000)]
    out = mix(frame(spark, rows)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r["doc_id"]), r["size"]) for r in out) == sorted((str(i), size(t)) for i, _, t in rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    targets, source = brute_targets(sizes), {i: s for i, s, _ in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(targets[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 2 + targets[s] / 250 for s in sizes)
    again = mix(frame(spark, rows, 7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_mixed_texts_hold_what_the_plan_says(spark):
    rows = texts(2, 150, ["a", "b", "c"]) + [(7, "a", "one two three")] * 20
    plan = {}
    for r in mix(frame(spark, rows), shards=4).collect():
        plan[r["doc_id"]] = plan.get(r["doc_id"], 0) + r["taken"]
    got, seats, words = {}, {}, {}
    for r in mixed_texts(frame(spark, rows), shards=4).collect():
        n = len(r["text"].split())
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + n
        words[r["shard"]] = words.get(r["shard"], 0) + n
    assert got == {i: n for i, n in plan.items() if n}
    assert set(words) == {0, 1, 2, 3} and max(words.values()) - min(words.values()) < 200
    long = [(1, "a", " ".join(str(i) for i in range(992)))]
    laps = mixed_texts(frame(spark, long), share=2, shards=3, block=16).collect()
    assert sorted(int(w) for r in laps for w in r["text"].split()) == sorted([*range(992)] * 2)
    assert all(r["text"].split() == [str(r["first"] + i) for i in range(len(r["text"].split()))] for r in laps)


def test_empty_tables(spark):
    assert mix(frame(spark, [], 1)).collect() == []
    assert mixed_texts(frame(spark, [], 1)).collect() == []
    assert [r["taken"] for r in mix(frame(spark, [(1, None, None), (2, "a", " ")])).collect()] == [0, 0]


def test_query(spark):
    rows = op11_mix(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and abs(sum(r["taken"] for r in rows) / sum(r["size"] for r in rows) - 1.5) < 0.005
