"""Work that must not grow with the square of a text, a group or a list of words."""

import random
import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from pairlens.functions import clean
from pairlens.functions import text as T
from pairlens.operators import lookup, pairs, scoring, stats
from pairlens.operators import relational as rel


def test_neighbours_of_a_long_text_take_one_pass(spark):
    words = " ".join(f"w{i // 2}" for i in range(40000))
    df = spark.createDataFrame([(words,), ("",), ("a",), ("a  b",), (None,)], "t string")
    start = time.time()
    got = [r[0] for r in df.select(T.drop_neighbours(F.split("t", " "))).collect()]
    assert time.time() - start < 20
    assert got == [sorted(f"w{i}" for i in range(19999)), [], [], ["a"], None]


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_near_words_are_found_among_few_candidates(spark):
    rng = random.Random(5)
    parts = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    words = {"".join(rng.choices(parts, k=rng.choice([1, 2, 3, 4, 5, 6, 8, 11, 13]))) for _ in range(260)}
    for w in list(words)[:160]:
        for _ in range(rng.randint(1, 6)):
            at = rng.randrange(len(w) + 1)
            w = w[:at] + rng.choice(["", "x", "é"]) + w[at + rng.randint(0, 1) :]
        words.add(w)
    words = sorted(words - {""})
    near = lambda a, b, least: _edits(a, b) <= int(max(len(a), len(b)) * (1 - least) + 1e-9)
    df = spark.createDataFrame([(w,) for w in words], "t string")
    assert {r[:2] for r in pairs.similar_texts(df, None, "t", 0.75).collect()} == {(a, b) for a in words for b in words if a < b and near(a, b, 0.75)}
    left, right = words[::2], words[1::3]
    two = pairs.similar_texts(spark.createDataFrame([(w,) for w in left], "t string"), spark.createDataFrame([(w,) for w in right], "t string"), "t", 0.7)
    assert {r[:2] for r in two.collect()} == {(a, b) for a in left for b in right if a != b and near(a, b, 0.7)}
    made = pairs._pairs_by_remains(df.withColumn("side", F.lit(0)), 0.75, True).distinct().count()
    assert made < len(words) ** 2 / 2 / 20


def test_keys_of_words_are_made_by_size_and_only_near_pairs_leave_a_task(spark, monkeypatch):
    words = sorted({"".join(random.Random(i).choices("abé", k=7 + i % 8)) for i in range(300)} | {"abababababab", "ababababababa", "語彙語彙語彙語彙", "語彙語彙語彙語"})
    made = list(pairs._remains(words, 0.75))
    # As many passes as kinds of parts, not as words; what is left twice of a text is one key.
    assert len(made) <= sum(len(pairs._cuts(n, 0.75)) for n in {len(w) for w in words})
    keys = [(int(i), int(r), int(h)) for of, role, key in made for i, r, h in zip(of, role, key)]
    assert len(keys) == len(set(keys))
    monkeypatch.setattr(pairs, "STEP", 64)
    near = lambda a, b: _edits(a, b) <= int(max(len(a), len(b)) * 0.25 + 1e-9)
    got = pairs._pairs_by_remains(spark.createDataFrame([(w, 0) for w in words], "t string, side int"), 0.75, True).distinct().collect()
    assert {tuple(r) for r in got} == {(a, b, _edits(a, b)) for a in words for b in words if a < b and near(a, b)}
    sides = [(w, i % 2) for i, w in enumerate(words)] + [(words[0], 1)]
    got = pairs._pairs_by_remains(spark.createDataFrame(sides, "t string, side int"), 0.75, False).distinct().collect()
    assert {tuple(r) for r in got} == {(a, b, _edits(a, b)) for a, x in sides for b, y in sides if x < y and a != b and near(a, b)}


def test_phrases_of_titles_are_never_broadcast(spark):
    titles = spark.createDataFrame([(1, "large ring bolt"), (2, "cold plate"), (2, "cold plate")], "id int, t string")
    held = spark.createDataFrame([("ring", "r", False), ("ring bolt", "rb", False), ("plate", "p", False)], "phrase string, value string, stemmed boolean")
    for out in (rel.longest_phrases(titles, "id", "t", held, "phrase", "value"), lookup.title_matches(titles, ["id"], F.col("t"), held)):
        assert {(r[0], *r[1]) for r in out.collect()} == {(1, "rb"), (2, "p")}
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_wide_tiles_send_a_row_few_times(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 4))
    v[1500:1510] = v[7]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, v array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    scores = unit @ unit.T
    got = pairs.cosine_matrix(df, df, "id", "v", 3)
    assert sorted((r[0], round(r[2], 9)) for r in got.collect()) == sorted((i, round(x, 9)) for i in range(3000) for x in np.sort(scores[i])[-3:])
    # Blocks of a side do not grow in number with the rows until they are WIDEST.
    assert pairs.WIDEST >= 8 * pairs.TILE


def test_a_tile_gives_its_cells_few_at_once_and_its_sums_in_a_row_each(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(1100, 3))
    v[5] = 0
    v[6, 1] = np.nan
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, v array<double>")
    made, apply = [], GroupedData.applyInPandas
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda self, fn, schema: made.append(fn) or apply(self, fn, schema))
    cells = pairs.cosine_matrix(df, df.where("id % 2 = 0"), "id", "v")
    tile = pd.DataFrame({"k": np.arange(2200) % 1100, "v": [*v, *v], "second": np.arange(2200) >= 1100})
    sizes = [len(x) for x in made[0](iter([tile[:700], tile[700:]]))]
    assert sum(sizes) == 1100 * 1100 and max(sizes) <= 1 << 18
    near = lambda rows: {r[0]: (r[1], f"{r[2]:.9f}", f"{r[3]:.9f}") for r in rows.collect()}
    want = near(cells.groupBy("left").agg(F.count(F.lit(1)), F.sum("score"), F.min("score")))
    assert near(pairs.cosine_sums(df, df.where("id % 2 = 0"), "id", "v", 400)) == want and len(want) == 1100
    tile["second"] = tile.index % 2 == 0
    assert [len(x) for x in made[1](iter([tile]))] == [1100]


def test_an_assignment_deals_pairs_to_more_tasks_as_they_grow(spark, monkeypatch):
    df = spark.createDataFrame([(k, str(i), str(j), float(i == j)) for k in range(40) for i in range(3) for j in range(3)], "k int, l string, r string, s double")
    monkeypatch.setattr(scoring, "ROWS", 20)
    out = scoring.optimal_assignment(df, "k", "l", "r", "s")
    assert "hashpartitioning(k" in (plan := out._jdf.queryExecution().executedPlan().toString()) and ", 18)" in plan
    assert out.count() == 120 and out.where("l <> r").count() == 0


def test_many_keys_are_matched_at_once(spark, monkeypatch):
    from itertools import permutations

    rng = np.random.default_rng(6)
    grids = [rng.integers(0, 4, shape).astype(float) for shape in ((1, 1), (2, 3), (3, 2), (4, 4)) for _ in range(50)]
    rows = [(k * 7, f"l{i}", f"é{j}", float(x)) for k, g in enumerate(grids) for (i, j), x in np.ndenumerate(g)]
    passes, many = [], scoring.assign_many
    monkeypatch.setattr(scoring, "assign_many", lambda cost: passes.append(len(cost)) or many(cost))
    got = scoring._matched(pd.DataFrame(rows, columns=list("klrs")))
    assert passes == [50] * 4
    for k, g in enumerate(grids):
        mine, wide = got[got.k == k * 7], g if g.shape[0] <= g.shape[1] else g.T
        assert mine.s.sum() == max(sum(wide[i, j] for i, j in enumerate(p)) for p in permutations(range(wide.shape[1]), len(wide)))
        assert len(mine) == len(wide) == mine.l.nunique() == mine.r.nunique()
        assert all(g[int(r.l[1:]), int(r.r[1:])] == r.s for r in mine.itertuples())


@pytest.mark.parametrize("groups", [1 << 16, 0])
def test_skills_of_profiles_are_made_and_scored_once(spark, monkeypatch, groups):
    from pairlens.models import skills

    monkeypatch.setattr(rel, "GROUPS", groups)
    lists, made = skills.ProfileSkills.lists, []
    monkeypatch.setattr(skills.ProfileSkills, "lists", lambda self, *rest: made.append(1) or lists(self, *rest))
    mapping = spark.createDataFrame([(1, "java", "j"), (2, "java", "jvm"), (3, "sql", "db")], "ordinal int, key string, value string")
    rows = spark.createDataFrame([(i, "", "", "", "", "java:: sql", "java" if i % 2 else "", [], []) for i in range(40)], "id int, job_title string, current_title string, desired_title string, previous_title string, job_skills string, profile_skills string, job_parsed array<string>, person_parsed array<string>")
    model = skills.ProfileSkills(mapping, mapping, mapping, size=4, window=3, iterations=1).fit(rows, "id")
    pairs_ = model.pair_scores(rows, "id")
    got = pairs_.collect()
    assert len(made) == 1 and {r["left"] for r in got if r["id"] == 1} == {"db", "java", "jvm", "sql"}
    assert all(abs(r["score"] - 1) < 1e-9 for r in got if r["left"] == r["right"]) and {r["score"] for r in got if r["id"] == 2} == {0.0}
    assert len(got) == 20 * 4 * 2 + 20 * 4
    assert "zip_with" not in pairs_._jdf.queryExecution().optimizedPlan().toString()
    assert {r["id"] for r in model.transform(rows, "id").collect()} == set(range(40))


def test_a_keys_lines_are_combined_before_they_are_sent(spark):
    mapping = spark.createDataFrame([(i, " K " if i % 2 else "k", f"v{i}") for i in range(50)] + [(60, "m", None), (None, "n", "x"), (-1, "o", "first")], "ordinal int, key string, value string")
    rows = spark.createDataFrame([(1, ["K", "o", "m", "n"]), (2, ["m"])], "id int, i array<string>")
    out = rel.map_in_file_order(rows, "id", "i", mapping)
    assert [tuple(r) for r in out.collect()] == [(1, ["first", "v49"])]
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_terms_are_not_joined_with_their_own_sums(spark):
    docs = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["b", "c"]), (None, ["a"])], "id int, w array<string>")
    out = scoring.tf_idf_log2(docs, "id", "w")
    got = {r[:2]: r[2] for r in out.collect()}
    a, b = 2 * np.log2(3 / 2), np.log2(3 / 2)
    assert got[1, "a"] == pytest.approx(a / np.hypot(a, b)) and {k[0] for k in got} == {1, 2}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 2


def test_cleaning_holds_few_texts_at_once(spark):
    assert clean.cleaned.evalType != PythonEvalType.SQL_SCALAR_PANDAS_UDF and clean.STEP < 10_000
    rows = [(i, None if i % 7 == 0 else f"<p>text {i}</p>") for i in range(200)]
    got = spark.createDataFrame(rows, "i int, t string").coalesce(1).select("i", clean.cleaned("t").alias("c")).collect()
    assert {r[0]: r[1] for r in got} == {i: None if t is None else clean.clean(t) for i, t in rows}


def _range_by_hand(values: list[float], transform: str, k: float) -> tuple[float, float] | None:
    v, n = np.sort(np.array(values, float)), len(values)
    mid = float(np.round(n / 2)) if n % 2 else (n + 1) / 2
    for j in range(28):
        reach = np.round((0.34 + j * 0.025) * mid)
        lo, hi = max(0, int(np.ceil(mid - reach))), min(n - 1, int(np.floor(mid + reach)) + 1)
        if v[hi] > v[lo]:
            break
    else:
        return None
    v = v[lo : hi + 1]
    _, arrays, slope, _ = stats.TRANSFORMS[transform]

    def fit(lam: float) -> tuple:
        y = arrays(v, np.full(len(v), lam))
        return -len(v) / 2 * np.log(y.var()) + (lam - 1) * slope(v).sum(), -abs(lam), lam

    lam = max(fit(round(i / 10 - 2, 1)) for i in range(61))[2]
    for step in (0.01, 0.001, 0.0001):
        lam = max(fit(lam + i * step) for i in range(-10, 11))[2]
    y = arrays(v, np.full(len(v), lam))
    kept = v[np.abs(y - y.mean()) / y.std() <= k]
    return round(float(kept.min()), 1), round(float(kept.max()), 1)


@pytest.mark.parametrize("transform", ["box_cox", "yeo_johnson"])
@pytest.mark.parametrize("most", [1 << 16, 2])
def test_a_group_of_a_range_is_never_one_tasks_work(spark, monkeypatch, transform, most):
    from pairlens.operators import relational

    monkeypatch.setattr(relational, "GROUPS", most)
    rng = np.random.default_rng(8)
    sign = 1 if transform == "box_cox" else -1
    groups = {"a": (rng.lognormal(2, 1, 400) * sign).tolist(), None: rng.gamma(2, 9, 301).tolist(), "ties": [3.0] * 60 + [1.0] * 2 + [sign * 7.0] * 4, "one": [5.0] * 9, "two": [1.0, 2.0]}
    rows = [(g, x) for g, values in groups.items() for x in values] + [("a", None)]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = stats.sigma_ranges(spark.createDataFrame(rows, "g string, x double"), "g", "x", 1.5, transform)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r[0]: (r[1], r[2]) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    want = {g: _range_by_hand(values, transform, 1.5) for g, values in groups.items()}
    assert got == {g: r for g, r in want.items() if r}
    # Few groups meet their rows where these are; as one key's partition they were sent to one task.
    assert ("SortMergeJoin" in plan) == (most == 2)


def test_right_items_are_not_made_again_for_each_left_item(spark):
    words = [f"w{i:03d}" for i in range(300)]
    rows = spark.range(3).select("id", F.array(*map(F.lit, words[1:])).alias("l"), F.array(*map(F.lit, words[:-1])).alias("r")).localCheckpoint()
    out = scoring.left_overlap(rows, "id", "l", "r")
    assert {(round(r["score"], 9), r["n_elem"]) for r in out.collect()} == {(round(1 - 1 / 299, 9), 299)}
    # What is looked up in is a lambda's variable, not the expression that makes it.
    lookups = re.findall(r"(?:element_at|array_position)\((.{7})", out._jdf.queryExecution().optimizedPlan().toString())
    assert lookups and set(lookups) == {"lambda "}


def test_a_filter_of_sizes_is_not_moved_to_where_scores_are_made(spark, monkeypatch):
    plans, fits = [], scoring.bucket_fits
    monkeypatch.setattr(scoring, "bucket_fits", lambda rows, *rest: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or fits(rows, *rest))
    rows = spark.createDataFrame([(i, ["a", "b", "c"][: 1 + i % 3], ["a", "b"][: i % 3]) for i in range(60)], "id long, l array<string>, r array<string>")
    actual = scoring.left_overlap(rows, "id", "l", "r")
    out = scoring.overlap_confidence(actual, scoring.permutations(rows, "id", "l", "r", 2), least=5)
    assert {r["n_elem"] for r in out.collect()} == {1, 2, 3}
    assert len(plans) == 1 and "sort_array" not in plans[0]
