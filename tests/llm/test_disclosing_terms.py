import math
import random
import re

from pairlens.llm.pii import CHANCE, DISCLOSURE, FACTORS, find_personal_data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def brute(texts):
    """Terms that disclose an address, from every pair of an address and a word."""
    rows = [(frozenset(m.lower() for m in EMAIL.findall(t)), frozenset(w.lower() for w in re.findall(r"\w+", EMAIL.sub(" ", t))), t) for t in texts]
    n, distinct = len(rows), {t: (e, w) for e, w, t in rows}
    tests = sum(len(e) * len(w) for e, w in distinct.values())
    out = set()
    for entity in set().union(*(e for e, *_ in rows)):
        n_e, k_e = sum(entity in e for e, *_ in rows), sum(entity in e for e, _ in distinct.values())
        for term in set().union(*(w for e, w in distinct.values() if entity in e)):
            n_t, both, k = sum(term in w for _, w, _ in rows), sum(entity in e and term in w for e, w, _ in rows), sum(entity in e and term in w for e, w in distinct.values())
            ic = math.log2(n / n_e)
            if ic <= 0 or math.log2(both * n / (n_e * n_t)) < DISCLOSURE * ic:
                continue
            if sum(math.log((k_e - i) * (n_t - i) / ((n - i) * (k - i))) for i in range(min(k, FACTORS))) <= math.log(CHANCE / tests):
                out.add(term)
    return out


def corpus(seed):
    draw = random.Random(seed)
    words = [f"w{i}x" for i in range(120)]
    texts = []
    for i in range(400):
        who = draw.randrange(12)
        text = " ".join(draw.choices(words, k=12))
        if draw.random() < 0.5:
            text += f" p{who}@mail.org"
            if draw.random() < 0.9:
                text += f" nick{who}a"  # gives the address away
            if draw.random() < 0.5:
                text += " club"  # common to all
        texts.append(text)
    return texts + [texts[0]] * 5 + ["", "once@only.org single word"]


def test_terms_like_all_pairs(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        want = brute(texts)
        assert len(want) >= 8 and "club" not in want
        got = set()
        for r in find_personal_data(spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string")).collect():
            got |= {texts[r["doc_id"]][s["start"] : s["end"]].lower() for s in r["span_list"] if s["kind"] == 4} if r["doc_id"] is not None else set()
        assert got == want


def test_small_texts_in_a_far_larger_corpus_may_meet_once(spark):
    texts = ["a@b.org zebra"] + [f"t{i}" for i in range(300)]
    want = brute(texts)
    rows = find_personal_data(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    assert {texts[r["doc_id"]][s["start"] : s["end"]] for r in rows for s in r["span_list"] if s["kind"] == 4} == want == {"zebra"}


def test_very_many_values_and_words_in_one_text(spark):
    """Pairs that cannot pass are not made: 3000 addresses times 20000 words would be 60 million."""
    text = " ".join(f"u{i}@x.org" for i in range(3000)) + " " + " ".join(f"word{i}" for i in range(20_000))
    rows = find_personal_data(spark.createDataFrame([(1, text), (2, "plain")], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_email"] for r in rows} == {1: 3000, 2: 0}
