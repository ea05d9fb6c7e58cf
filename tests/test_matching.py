"""Stems, cleaning, stages, nested documents and models on small made-up rows, by hand or against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens import sources as C
from pairlens.functions import clean, nested
from pairlens.functions import similarity as S
from pairlens.functions import text as T
from pairlens.functions.stemmer import stem_word
from pairlens.models import overlap, skills
from pairlens.operators import lookup, scoring, stats
from pairlens.operators import relational as rel
from pairlens.plans import Echo, Keyed, Pipeline, Step, by_columns, keyed_dict, left_join, project, select

STEMS = "consigned:consign consistency:consist consolatory:consolatori conspiracy:conspiraci knackeries:knackeri knives:knive generally:general communication:communic hopping:hop hoping:hope happily:happili cries:cri ties:tie gas:gas kiwis:kiwi analogies:analog sensational:sensat replacement:replac skies:sky dying:die news:news exceeding:exceed programming:program".split()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("pair", STEMS)
def test_stems(pair):
    word, stem = pair.split(":")
    assert stem_word(word) == stem


def test_cleaning(spark):
    assert clean.clean("Don't <p>SKILLS: C++ &amp; IT</p><ul><li>One (a) Two</li></ul> 1. see it's • x") == "Do not. SKILLS: C++ & IT. One (a). Two. see it is. x"
    assert clean.clean("a/b / c C# C & H x@y", True) == "a_slash_b_slash_c C_sharp C_and_H x_at_y"
    assert clean.stem("The engineers were developing. They're testing.") == "engin develop. re test. "
    assert clean.underscored_stems(["Java Programming", "data, mining"]) == ["data_mine", "java_program"]
    rows = spark.createDataFrame([("<b>Testing</b> engines.",), (None,)], "t string")
    assert [r[0] for r in rows.select(clean.cleaned_and_stemmed("t")).collect()] == ["test engin. ", None]


def test_word_rules(spark):
    cases = {"a@b@c": "a_at_b_at_c", "@b": "at_b", "http://x@y": "x_at_y", "a@@b": "a_at_at_b"}
    assert all(one(spark, T.at_words(F.lit(k))) == v for k, v in cases.items())
    assert one(spark, T.uri_words(F.lit("http://www.a.com. x"))) == "www_dot_a_dot_com. x"
    assert one(spark, T.dot_words(F.lit(".net a.b.c"))) == "dot_net a_dot_bdot_c"
    assert one(spark, T.slash_words(F.lit("a / b/c/d/e/f"))) == "a_slash_b_slash_c_slash_d_slash_e_slash_f"
    assert one(spark, T.expand_it(F.lit("IT I.T. BIT aI.T."))) == "information_technology information_technology BIT aIT"
    assert one(spark, T.parse_list(F.lit("['A', \"b's\"]"))) == ["a", "b's"] and one(spark, T.parse_list(F.lit("no list"))) is None
    assert one(spark, T.seniority_tags(F.lit("Sr Java Lead level IV"))) == ["level 4", "senior"]
    assert one(spark, T.fixed_lemmas(F.array(F.lit("datum"), F.lit("x")), {"datum": "data"})) == ["data", "x"]
    assert one(spark, T.without_stop_words(F.array(F.lit("a"), F.lit("x")), ["a"])) == ["x"]


def test_posting_words(spark):
    assert one(spark, T.posting_words(F.lit("An IT job (new); R&D camelCase a.Then \x01"))) == ["an", "information", "technology", "job", "new", "randd", "camel", "case", "", ""]


def test_longest_common_substring_like_brute_force(spark):
    rng = np.random.default_rng(3)
    pairs = [("".join(rng.choice(list("abé"), rng.integers(0, 9))), "".join(rng.choice(list("abé"), rng.integers(0, 9)))) for _ in range(200)] + [("x", None)]

    def want(a, b):
        if a is None or b is None:
            return None
        return max((a[i:j] for i in range(len(a)) for j in range(i, len(a) + 1) if a[i:j] in b), key=len, default="")

    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = {r["i"]: r["s"] for r in rows.select("i", S.longest_common_substring("a", "b").alias("s")).collect()}
    assert got == {i: want(*p) for i, p in enumerate(pairs)}
    assert one(spark, S.substring_factor(F.lit("ab"), F.lit("abcd"), F.lit("xab"))) == pytest.approx(2 / 3)


def test_quantile_knots_like_numpy(spark):
    rng = np.random.default_rng(5)
    for values in (rng.normal(size=1501), rng.integers(0, 9, 700).astype(float), np.array([2.0]), np.array([1.0, 1.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(5)
        k = min(1000, len(values))
        want = np.quantile(values, np.linspace(0, 1, k)) if k > 1 else values
        assert np.allclose(stats.quantile_knots(df, "v"), want)
    assert stats.quantile_knots(spark.createDataFrame([], "v double"), "v") == []


def test_group_quantiles(spark):
    rng = np.random.default_rng(6)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 4, 500), rng.integers(0, 40, 500))]
    got = {r["g"]: (r["q_0"], r["q_1"]) for r in stats.group_quantiles(spark.createDataFrame(rows, "g int, v double"), "g", "v", [0.25, 0.9]).collect()}
    for g in range(4):
        x = [v for k, v in rows if k == g]
        assert got[g] == pytest.approx(tuple(np.quantile(x, [0.25, 0.9])))


def test_importance_grid():
    grid = S.importance_grid(3, 4)
    assert len(grid) == 15 and all(sum(g) == pytest.approx(1) for g in grid) and S.importance_grid(1) == [(1.0,)]


def test_confidence(spark):
    rng = np.random.default_rng(7)
    a, s = rng.normal(0.7, 0.1, 300), rng.normal(0.3, 0.1, 300)
    slope, intercept = scoring.l1_logistic(np.concatenate([a, s]), np.concatenate([np.ones(300), np.zeros(300)]))
    assert slope > 0 and abs(-intercept / slope - 0.5) < 0.1
    frame = lambda x: spark.createDataFrame([(i, float(v), 1 + i % 2) for i, v in enumerate(x)], "id long, score double, n_elem long")
    fits = scoring.overlap_confidence(frame(a).select("n_elem", "score"), frame(s).select("n_elem", "score"))
    conf = {r["id"]: r["confidence"] for r in scoring.bucket_confidence(frame(a), "id", fits).collect()}
    assert len(conf) == 300 and np.mean(list(conf.values())) > 0.2
    rows = spark.createDataFrame([(1, 0.9, [0.1, 0.2, 0.3] * 10), (2, 0.1, [0.1, 0.2, 0.3] * 10), (3, None, [0.1])], "id long, score double, r array<double>")
    got = {r["id"]: r["confidence"] for r in scoring.row_confidence(rows, "id", "score", "r", list(a)).collect()}
    assert got[1] > 0.5 > got[2] and got[3] == 0


def test_nested_documents(spark):
    doc = '{"a": {"@std": "NA", "k": [1, "x"]}, "b": {"k": {"c": 2}}}'
    assert one(spark, nested.find_values(F.lit(doc), "k")) == ["1", "x", '{"c": 2}']
    assert one(spark, nested.first_value(F.lit(doc), "@std")) == "" and one(spark, nested.joined_values(F.lit("nonsense"), "k")) == "-1"
    person = '{"resume": {"experience": [{"@start": "100", "@end": "830"}]}}'
    assert one(spark, nested.overall_experience(F.lit(person), 999)) == 2 and one(spark, nested.overall_experience(F.lit("{}"), 9)) == -1


class Doubled(Step):
    version = "1.0"

    def fit(self, df):
        self.top_ = df.agg(F.max("x")).first()[0]
        return self

    def transform(self, df):
        return df.withColumn("x", F.col("x") * 2 / self.top_)


def test_stages(spark):
    df = spark.createDataFrame([(1, 4.0), (2, 8.0)], "k int, x double")
    step = Doubled().fit(df)
    assert [r["x"] for r in step(df).sort("k").collect()] == [1.0, 2.0] and step.fitted() == ["top_"]
    step.clear()
    assert step.fitted() == []
    with pytest.raises(AttributeError):
        step.version = "2"
    keyed = Keyed(lambda k: Echo(), ["x"]).fit(df)
    assert keyed(df).count() == 2 and set(keyed.steps_) == {"x"}
    assert project(df.withColumnRenamed("x", "b__"), ["b__"]).columns == ["b"]
    assert select({"a": 1, "b": 2}, ["b"]) == 2 and select(df, ["k"]).columns == ["k"] and keyed_dict({"a": 1}, str, ["a", "z"]) == {"a": "1"}
    out = by_columns(df, [("n", lambda d: d.withColumn("x", -F.col("x")), ["x"])], "passthrough")
    assert out.columns == ["n__x", "k"] and sorted(r["n__x"] for r in out.collect()) == [-8.0, -4.0]
    p = Pipeline([("d", Doubled()), ("e", Echo())]).fit(df)
    assert [r["x"] for r in p(df).sort("k").collect()] == [1.0, 2.0] and '"x":1.0' in p.detailed(df, ["k"]).sort("k").first()["detail"]
    with pytest.raises(ValueError):
        left_join(p, p, ["k"], on="none")
    with pytest.raises(ValueError):
        left_join(p, p, ["k"])


def test_lookup(spark):
    words = spark.createDataFrame([(1, ["A", "b", "z"]), (2, [])], "k int, w array<string>")
    dim = spark.createDataFrame([("a", ["x", "y"]), ("B", ["q"])], "s string, t array<string>")
    kept = {r["k"]: r["w"] for r in rel.map_items(words, "k", "w", dim, "s", "t", "source", any_case=True).collect()}
    assert kept == {1: ["q", "x", "y", "z"], 2: [""]}
    assert {r["k"]: r["w"] for r in rel.map_items(words, "k", "w", dim, "s", "t", "drop").collect()} == {1: [], 2: []}
    dictionary = lookup.title_dictionary(spark.createDataFrame([("Java",), ("Java Programming",), ("Programming",)], "t string"), "t", clean.stemmed_phrase)
    found = lookup.title_matches(spark.createDataFrame([(1, "senior java programmers"), (2, "cook")], "k int, t string"), ["k"], F.col("t"), dictionary, clean.stemmed_phrase).collect()
    assert [(r["k"], r["values"]) for r in found] == [(1, ["Java"])] or [(r["k"], r["values"]) for r in found] == [(1, ["Java Programming"])]
    previous = spark.createDataFrame([(1, ["Java dev", "nothing", "programming"]), (2, [])], "k int, t array<string>")
    got = {r["k"]: r["values"] for r in lookup.title_list_matches(previous, "k", "t", dictionary).collect()}
    assert got == {1: ["Java", "Programming"], 2: []}


def test_models(spark):
    pairs = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.7)], "left string, right string, weight double")
    rows = spark.createDataFrame([(1, ["a", "b"], ["x", "y"]), (2, [], ["x"])], "k long, j array<string>, p array<string>")
    got = {r["k"]: r["score"] for r in skills.table_assignment(rows, "k", "j", "p", pairs).collect()}
    assert got == {1: pytest.approx(0.75), 2: 0.0}
    docs = spark.createDataFrame([(k, f'{{"s": {{"canonskill": ["a", "w{k}"]}}}}', '{"s": {"canonskill": ["a", "c"]}}') for k in range(9)], "k long, job string, person string")
    out = overlap.SkillsOverlap().transform(docs, "k").collect()
    assert len(out) == 9 and {r["score"] for r in out} == {0.5} and {r["n_elem"] for r in out} == {2}
    best = sum(max(sum(m[i][p[i]] for i in range(2)) for p in itertools.permutations(range(2))) for m in ([[0.9, 0.8], [0.7, 0.0]],))
    assert math.isclose(best / 2, 0.75)


def test_branch_maps_and_buckets(spark):
    names = spark.createDataFrame([("Anne", "Bancroft", 20), ("Bob", "Dylan", 21), ("Charlie", "Chaplin", 22), ("Bob", "Marley", 23)], "first_name string, last_name string, age int")
    assert [r["both"] for r in rel.keyed_map(names, lambda a, b: F.concat_ws(" ", a, b), {("first_name", "last_name"): "both"}).collect()][0] == "Anne Bancroft"
    assert rel.branches(names, {"a": {"low": F.lower("first_name")}, "b": {"n": F.length("last_name")}}).columns == ["a__low", "b__n"]
    assert [one(spark, S.threshold_bucket(F.lit(x))) for x in (0.0, 0.2, 0.3, 0.5, 0.7, 0.8, 1.0)] == [1, 5, 2, 3, 4, 5, 5]


def test_sources_and_reports(spark, tmp_path):
    root = f"file://{tmp_path}"
    (tmp_path / "j.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert C.read_json_lines(spark, f"{root}/j.json", "a long").count() == 2
    (tmp_path / "r.json").write_text('{"results": {"bindings": [{"t": {"value": "x", "xml:lang": "en-US"}}, {"t": {"value": "y", "xml:lang": "fr"}}, {"t": {"value": "x", "xml:lang": "en-US"}}]}}')
    assert [r["t"] for r in C.read_sparql_results(spark, f"{root}/r.json", "t", "en").collect()] == ["x"]
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    assert C.cached_table(make, f"{root}/c", spark).count() == 3 == C.cached_table(make, f"{root}/c", spark).count() and calls == [1]
    assert C.cached_table(make, None, spark) is None
    results = spark.createDataFrame([("1.0.2", "m", '{"n_correct": 3, "importances": [0.25, 0.75], "timing": {"median": 12.4}}'), ("2.0.10", "m", "{}")], "version string, name string, body string")
    rows = C.report_rows(results).collect()
    assert [r["version"] for r in rows] == ["2.0.10", "1.0.2"] and rows[1]["importances"] == "0.25, 0.75" and rows[1]["timing median ms"] == "12"
    C.write_report(results, f"{root}/h")
    assert "<td>1.0.2</td>" in "".join(r[0] for r in spark.read.text(f"{root}/h").collect())
    C.save_model({"a": spark.range(2), "b": spark.range(3)}, f"{root}/m", {"a"})
    assert C.load_model(spark, f"{root}/m", ["a"])["a"].count() == 2
    C.write_csv(spark.range(3), f"{root}/far/x")
    assert C.read_csv(spark, f"{root}/far/x", "id long", roots=[f"{root}/near", f"{root}/far"]).count() == 3
    assert C.under_roots("s3://b/x/y.csv", ["s3://b"]) == "x/y.csv"


def test_latency():
    ticks = iter(range(100))
    assert stats.latency(lambda r: None, [1, 2], clock=lambda: next(ticks)) == {"mean": 1000, "median": 1000, "min": 1000, "max": 1000}
