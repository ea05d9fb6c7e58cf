import random
import re
import zlib
from collections import Counter

from pairlens.llm.variants import SQL, damaged, op13_variants, roots, runs, spelling_variants
from tests.verify import compare, connect

SCHEMA = "doc_id long, text string, word string, n int"


def brute(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    letters = sorted({c for w in words for c in w})
    near = {}
    for w in words:
        forms = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        near[w] = sorted((-words[f], f) for f in forms - {w} if f in words)
    form = {w: x[0][1] for w, x in near.items() if x and -x[0][0] >= 2 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items())


def run(spark, docs, **more):
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in spelling_variants(df, **more).select("word", "form", "root", "n", "n_near", "form_n").collect())


def made(seed, n):
    """Texts of words over few letters, so that chains of forms, ties and edits at the middle are common."""
    draw = random.Random(seed)
    words = ["".join(draw.choice("abÀé") for _ in range(draw.randint(4, 9))) for _ in range(60)]
    words += [w[:i] + draw.choice("abÀé") + w[i + draw.randint(0, 1) :] for w in words for i in (0, len(w) // 2, len(w) - 1)]
    return [(draw.randrange(50), " ".join(w.upper() if w.isascii() and draw.random() < 0.2 else w for w in draw.choices(words, k=draw.randint(0, 80)))) for _ in range(n)]


def test_like_brute_force(spark):
    docs = [*made(1, 120), (1, None), (None, "Wörter wörter wörter WÖRTER"), (2, ""), (3, "1 2 3 ×÷×÷× ×÷×÷× ×÷×÷×"), (4, "abcde " * 40 + "abcdf " * 20 + "abcgf " * 10 + "abhgf " * 5)]
    want = brute(docs)
    assert any(w[1] and w[2] != w[1] for w in want) and any(w[4] > 3 for w in want)
    assert run(spark, docs) == want


def test_blocks_and_shards_change_nothing(spark):
    docs = made(2, 120)
    assert run(spark, docs, shard=20, block=7) == brute(docs)


def test_one_half_that_very_many_words_share(spark):
    draw = random.Random(3)
    tails = {"".join(draw.choice("abcd") for _ in range(4)) for _ in range(150)}
    docs = [(i, " ".join(f"same{t}" for t in tails)) for i in range(3)]
    assert run(spark, docs, shard=50, block=16) == brute(docs)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "one two"), (2, None)]) == []


def test_long_texts_are_split_between_runs_only(spark):
    draw = random.Random(4)
    text = "".join(draw.choice(("abcde", "é", " ", "\n", "\U0001f600", "zz")) for _ in range(90_000))
    got = [r["run"] for r in runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()]
    assert got == re.findall("[A-Za-zÀ-ÿ]+", text)
    whole = "q" * 200_000
    assert [len(r["run"]) for r in runs(spark.createDataFrame([(1, f"{whole} a")], "doc_id long, text string")).collect()] == [200_000, 1]


def test_damage(spark):
    rows = [(i, w) for i in range(300) for w in ("fünfte", "a", "letters")]
    df = spark.createDataFrame(rows, "i long, w string")
    got = df.select("i", "w", damaged(df["i"], df["w"]).alias("d")).collect()
    for i, w, d in got:
        h = zlib.crc32(f"{i}:{w}".encode())
        assert d == (w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :])
    assert any(w != d for _, w, d in got)


def test_long_chains_of_forms(spark):
    links = spark.createDataFrame([(str(i), str(i + 1)) for i in range(40)], "word string, form string")
    assert {(r["word"], r["root"]) for r in roots(links).collect()} == {(str(i), "40") for i in range(40)}


def test_like_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert compare(spark, connect(folder), op13_variants, SQL, folder) == ""
