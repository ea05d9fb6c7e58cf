import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.functions import similarity as S
from pairlens.functions import text as T
from pairlens.functions.walk import find, nodes, overall_days, tree_rows
from pairlens.operators import relational as rel
from pairlens.operators import scoring, stats
from pairlens.plans import Pipeline, Recipes


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_assignment_is_the_best():
    rng = np.random.default_rng(3)
    for n, m in itertools.product(range(1, 6), repeat=2):
        c = rng.normal(size=(n, m))
        got = sum(c[i, j] for i, j in scoring.assign(c))
        if n <= m:
            want = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        else:
            want = min(sum(c[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
        assert got == pytest.approx(want)


def test_overlap_of_equal_disjoint_and_empty_lists(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], ["b", "a"]), (2, ["a"], ["z"]), (3, [], ["a"]), (4, ["a"], []), (5, None, None)], "id int, l array<string>, r array<string>")
    got = {r["id"]: r["score"] for r in scoring.left_overlap(rows, "id", "l", "r").collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0}


def test_cosine_identities(spark):
    a = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, S.cosine(a(1.0, 1.0, 1.0), a(1.0, 1.0, 1.0))) == pytest.approx(1)
    assert one(spark, S.cosine(a(0.0, 1.0, 0.0), a(1.0, 0.0, 1.0))) == 0
    assert one(spark, S.cosine(a(0.5, 1.0, 2.0), a(2.0, 4.0, 8.0))) == pytest.approx(1)
    assert one(spark, S.cosine(a(0.0), a(1.0))) is None


def test_edit_distance_of_the_demo_pair(spark):
    assert one(spark, F.levenshtein(F.lit("sfurti"), F.lit("shur]]ti"))) == 3
    assert one(spark, S.levenshtein_factor(F.lit(""), F.lit(""))) is None


def test_composite_of_equal_values(spark):
    score, _ = S.composite([(F.lit(0.5), F.lit(c), 1.0) for c in (1.0, 0.01, 0.5)])
    assert one(spark, score) == pytest.approx(0.5)
    assert sum(S.update_importance([0.2, 0.3, 0.5], 1, 0.6)) == pytest.approx(1)


def test_group_split(spark):
    rows = spark.createDataFrame([(20 - i, i % 3, (20 - i) % 5) for i in range(20)], "a int, b int, c int")
    sizes = rel.split_groups(rows, ["b", "c"], 4).select("b", "c", "split").distinct().groupBy("split").count().collect()
    assert sorted(r["count"] for r in sizes) == [3, 4, 4, 4]


def test_n_splits():
    assert rel.n_splits(1000, 4, 1, 32, 8) == 4 and rel.n_splits(100, 8, 0.1, 32, 8) == 4 and rel.n_splits(5, -2, 0.1, 32, 8) == 1


def test_recipes_refuse_twins_and_strangers(spark):
    r = Recipes()
    r.register("case", 1)(F.lower)
    with pytest.raises(RuntimeError):
        r.register("case", 1)(F.upper)
    with pytest.raises(TypeError):
        r.register("case", 2)("no function")
    with pytest.raises(KeyError):
        r.run(F.lit("x"), ("case", 9))
    assert one(spark, r.run(F.lit("ABC"), ("case", 1))) == "abc"


def test_pipeline_captures_and_bypasses(spark):
    p = Pipeline([("low", lambda d: d.withColumn("x", F.lower("x"))), ("in", Pipeline([("rev", lambda d: d.withColumn("x", F.reverse("x")))]))])
    df = spark.createDataFrame([("AB",)], "x string")
    got = {k: v.first()["x"] for k, v in p.captured(df).items()}
    assert got == {"low": "ab", "in__rev": "ba", "in": "ba"}
    assert p.bypassing({"in__rev"})(df).first()["x"] == "ab"


def test_walks():
    doc = {"a": [{"k": 1}, {"k": [2, 3]}], "b": {"k": "x"}}
    assert find(doc, "k") == [1, 2, 3, "x"]
    assert ("a/k", "value", "1") in list(nodes(doc))
    assert overall_days({"resume": {"experience": [{"@start": "10", "@end": "100"}, {"@start": 5, "@end": "present"}]}}, 200) == 195
    assert overall_days({}, 200) == -1
    assert [r[:2] for r in tree_rows("<a><b/><c><d/></c></a>")] == [(0, "a"), (1, "b"), (1, "c"), (2, "d")]


def test_t_tail_against_a_known_value():
    assert stats.t_tail(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    assert stats.t_tail(0.0, 5) == pytest.approx(1)


def test_confidence_rises_with_the_score():
    rng = random.Random(1)
    a, s = np.array([rng.gauss(0.7, 0.1) for _ in range(200)]), np.array([rng.gauss(0.3, 0.1) for _ in range(200)])
    assert scoring.logistic_confidence(a, s, 0.2) < 0.5 < scoring.logistic_confidence(a, s, 0.8)
    assert not math.isnan(scoring.logistic_confidence(a, a, 0.5))


def test_text_rules(spark):
    assert one(spark, T.expand_it(F.lit("IT and I.T. staff, BIT"))) == "information_technology and information_technology staff, BIT"
    assert one(spark, T.slash_words(F.lit("a / b/c"))) == "a_slash_b_slash_c"
    assert one(spark, T.drop_neighbours(F.array(*map(F.lit, ["a", "a", "b", "c"])))) == ["a", "b"]
    assert one(spark, T.split_parentheses(F.lit("X (Y)"))) == ["X", "Y"]
    assert one(spark, T.level_number(F.lit("VIII"))) == 0


def test_sources(spark, tmp_path):
    from pairlens import sources as C

    (tmp_path / "w.txt").write_text("stop word,other\nthird")
    assert sorted(r["word"] for r in C.read_word_list(spark, f"file://{tmp_path}/w.txt").collect()) == ["other", "stop_word", "third"]
    C.write_csv(spark.range(3), f"file://{tmp_path}/c")
    assert C.read_csv(spark, f"file://{tmp_path}/none", "id long", f"file://{tmp_path}/c").count() == 3
    with pytest.raises(ValueError):
        C.read_xml(spark, "x.json", "a")
    v = C.parse_embedding_lines(spark.createDataFrame([("w 1 2.5",)], "value string")).first()
    assert (v["word"], v["vector"]) == ("w", [1.0, 2.5])
