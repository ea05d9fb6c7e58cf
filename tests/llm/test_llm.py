"""Small and awkward tables for each operator, against brute force where there is one."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from pairlens.llm import bpe, decontamination, embeddings, html, linededup, minhash, pii, secrets, sharding, toxicity
from pairlens.llm.common import components

ODD = [(1, None, "x"), (2, "", "y"), (None, "a lone row without an id here", "z"), (3, "same text of some words in it", None), (3, "same text of some words in it", None), (4, "same text of some words in it", "q"), (5, "ß " * 3000, "long")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, n long".replace("n long", "node string"))


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        if len(seen) > 1:
            want[n] = min(seen)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_lines(spark, odd, none):
    docs = spark.createDataFrame([(1, "keep this one here\nUser 17 logged in from here now\nthe quick brown fox jumps over it"), (2, "User 99 logged in from here now\nown words in this very line"), (3, "short one\nshort one"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.drop_recurring_lines(docs).collect()}
    assert got[1].count("\n") == 2 and got[2] == "own words in this very line" and got[3] == "short one\nshort one" and got[4] is None
    rows = linededup.drop_recurring_lines(odd).collect()
    assert len(rows) == len(ODD) and [r["text"] for r in rows if r["doc_id"] == 4] == [""] and [r["text"] for r in rows if r["doc_id"] is None] == [ODD[2][1]]
    assert linededup.drop_recurring_lines(none).count() == 0


def test_lines_with_odd_white_space(spark):
    docs = spark.createDataFrame([(1, "a  b\tc 12x d\r\nx1y  z2 p q r s"), (2, " a b c 99 d\nx2y z3 p q r s "), (3, "é ü 4ß a b c d\x0b"), (4, "é ü 5ß a b c d"), (5, "$1 a b c d e\n\n"), (6, "$2 a b c d e")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.drop_recurring_lines(docs).collect()}
    assert [got[i] for i in (2, 4, 6)] == ["", "", ""] and got[1].startswith("a  b\tc 12x") and got[3].endswith("\x0b") and got[5] == "$1 a b c d e\n\n"


def test_near_duplicates_in_long_lists(spark):
    """A group around the threshold, larger than SHORT, whose chains need links that leaders miss."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(90):
        t = base[:]
        for at in rng.sample(range(60), rng.choice([0, 1, 2, 4, 5, 6])):
            t[at] = f"x{rng.randrange(3)}"
        texts.append(" ".join(t))
    sets = [frozenset(zip(w, w[1:])) for w in map(str.split, texts)]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2).collect()}
    assert got == dict(enumerate(label)) and len(set(label)) > 1


def test_near_duplicates(spark, odd, none):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 12, 80]))]
        for _ in range(rng.choice([1, 6])):
            t = base[:]
            for _ in range(len(t) // 25):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts.append(" ".join(t))
    sets = [frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)]) for w in map(str.split, texts)]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2).collect()}
    assert got == {i: (len(sets[i]), label[i]) for i in range(len(texts))}
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and {r["doc_id"]: r["component_id"] for r in rows} == {1: 1, 2: 2, None: None, 3: 3, 4: 3, 5: 5}
    assert minhash.near_duplicates(none).count() == 0 and minhash.drop_near_duplicates(odd).count() == len(ODD) - 1


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(20, 8))
    x = np.concatenate([base, base[:10] + 0.1 * rng.normal(size=(10, 8)), base[:3]])
    rows = [(i, x[i].tolist(), i % 2) for i in range(len(x))] + [(90, None, 0), (91, [0.0] * 8, 0), (92, [float("nan")] * 8, 0), (93, x[0].tolist(), None), (94, [], 0), (95, [1.0, None] * 4, 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = (u @ u.T >= 0.93) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2)
    np.fill_diagonal(hit, False)
    assert {i: got[i][0] for i in range(len(x))} == {i: int(hit[i].sum()) for i in range(len(x))}
    assert all(got[i] == (0, i) for i in range(90, 96))
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_personal_data(spark, odd, none):
    text = "é a@b.co, 1.2.3.4 999.1.1.1 +1 (222) 333-4444 or 4111 1111 1111 1111 x@y"
    r = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    assert [text[s["start"] : s["end"]] for s in r["span_list"]] == ["a@b.co", "1.2.3.4", "+1 (222) 333-4444", "4111 1111 1111 1111"]
    rng = random.Random(3)
    filler = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(40))
    docs = [(i, f"{filler()} agent Nightowl {i} wrote from owl@example.com {filler()}") for i in range(6)] + [(i, filler()) for i in range(10, 60)]
    found = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all("term:" in found[i] for i in range(6)) and not any(found[i] for i in range(10, 60))
    assert pii.find_personal_data(odd).count() == len(ODD) and pii.find_personal_data(none).count() == 0


def test_personal_data_wherever_terms_stand(spark):
    """A disclosing term alone in a row, far from the value, short, and beside a value that few texts hold."""
    rng = random.Random(3)
    filler = lambda k=40: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(k))
    docs = [(i, f"{filler()} agent Nightowl wrote from owl@example.com {filler()}") for i in range(6)] + [(6, f"{filler()} then Nightowl left {filler()}")]
    docs += [(7, f"Bo Nightowl {filler(60)} owl@example.com")] + [(i, f"{filler(3)} Xu {filler(50)} xu@example.org") for i in (8, 9)]
    docs += [(i, filler(10)) for i in range(10, 400)]
    texts = dict(docs)
    found = {r["doc_id"]: r["span_list"] for r in pii.find_personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    terms = {i: [texts[i][s["start"] : s["end"]] for s in found[i] if s["kind"] == 4] for i in texts}
    assert all("Nightowl" in terms[i] for i in range(8)) and "Nightowl" not in pii_clean(spark, texts, found, 6)
    assert all("Xu" in terms[i] for i in (8, 9)) and not any(terms[i] for i in range(10, 400))


def pii_clean(spark, texts, found, i):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(texts[i], [tuple(s) for s in found[i]])], "text string, spans array<struct<start:int,kind:int,end:int>>")
    return row.select(pii.sanitised(F.col("text"), F.col("spans"))).first()[0]


def test_bpe_round_trip(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, lib = bpe.codec(path), Tokenizer.from_file(path)
    lib.no_truncation()
    rng = random.Random(4)
    texts = ["", "a<|endoftext|>b", "it's WE'RE 2³½ ªß İ x\u0085y", "Σας ΣΑΣ", "日本語 😀 é é", "ab" * 400, *("".join(rng.choice("abcdeghinorst é.'7!") for _ in range(120)) for _ in range(60))]
    for t in texts:
        want = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want and own.decode(want) == lib.decode(want, skip_special_tokens=False)
    rows = bpe.encode_documents(odd, path).collect()
    assert len(rows) == len(ODD) and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    assert bpe.encode_documents(none, path).count() == 0


def test_shards(spark, odd, none, tmp_path):
    rows = sharding.assign_slots(odd, 3, bucket_rows=2).collect()
    by = Counter(r["shard"] for r in rows)
    assert max(by.values()) - min(by.values()) <= 1 and sorted((r["shard"], r["slot"]) for r in rows) == [(s, k) for s in range(3) for k in range(by[s])]
    assert sorted(rows, key=str) == sorted(sharding.assign_slots(odd.repartition(5), 3, bucket_rows=2).collect(), key=str)
    assert sharding.assign_slots(none).count() == 0
    sharding.write_shards(odd, f"file://{tmp_path}/s", 3, 2)
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == len(ODD)


def test_toxicity(spark, odd, none):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices(["ka", "lo", "mi", "ten", "sa"], k=rng.randint(1, 3)))
    text = lambda bad: " ".join("zorgfrat" + word() if bad and k % 12 == 5 else word() for k in range(60))
    docs = spark.createDataFrame([(i, text(i % 3 == 0)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(docs, labels).where("held_out").collect()
    assert rows and sum(r["predicted"] == (r["doc_id"] % 3 == 0) for r in rows) >= 0.95 * len(rows)
    assert toxicity.score_toxicity(odd, labels).count() == len(ODD) and toxicity.score_toxicity(none, labels.where("false")).count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(odd, labels.where("false")).collect()} == {1e-4}


def test_pages(spark):
    trees = html.trained(80)
    rng, right, n = random.Random(99), 0, 40
    for _ in range(n):
        source = html.made_up_page(rng)
        page, y = html._labels(source)
        right += page.written(y > 0) == html.main_text(source, trees)
    assert right >= 0.8 * n
    rows = spark.createDataFrame([(1, None, None), (2, "u", ""), (None, "v", "<p"), (3, "w", "<div>" * 500 + "x" + "<a title='open>")], "page_id long, url string, html string")
    assert html.extract(rows, trees).count() == 4 and html.extract(rows.where("false"), trees).count() == 0


def test_pages_with_icons_and_controls():
    para = lambda k: " ".join(f"Kalo miren {w} sapol duven, tor ales nigro." for w in [f"salo{k}", f"rimi{k}", f"tenka{k}"])
    body = "".join(f"<p>{para(k)}</p>" for k in range(6))
    trees = html.trained()
    whole = html.main_text(f"<html><body><header><h2>Ka lo</h2></header><article>{body}</article></body></html>", trees)
    assert all(para(k) in whole for k in range(6))
    for icon in ('<svg class="icon" width="1"/>', "<math/>", "<button>Menu", "<select><option>a<option>b", "<svg><path d='x'/>", "<canvas></canvas>", "<svg><g><path d='x'/></g></svg>"):
        got = html.main_text(f"<html><body><header><h2>Ka lo</h2>{icon}</header>{icon}<article>{body}</article></body></html>", trees)
        assert all(para(k) in got for k in range(6)), icon
    for tag in ("noscript", "object", "math"):
        inner = f"<p>Miren {para(9)} <{tag}>sapol ales</{tag}> tor.</p>"
        assert "sapol ales" in "".join(t or "" for _, t in html.Page(f"<article>{body}{inner}</article>").texts), tag


def test_secrets(spark, odd, none):
    text = "base = 'k9Xq2LmZ7vR4'\napi_secret_key = base + \"Tt81\"\ncolour = 'nothing here'\n<password>aB3dE5gH7jK</password>\npassword=abcdefabcdefabcdef12 AKIA" + "Q" * 16
    got = [text[a:b] for a, _, b in secrets.literal_spans(text)]
    assert "k9Xq2LmZ7vR4" in got and "aB3dE5gH7jK" in got and "nothing here" not in got
    assert [k for _, k, _ in secrets.base_spans(text)] == [0, 2, 1]
    assert secrets.scan_secrets(odd).count() == len(ODD) and secrets.scan_secrets(none).count() == 0


def test_secrets_of_many_literals():
    rng = random.Random(1)
    literals = ["".join(rng.choices("abcdefghjkmnpqrstuvwxyzABCDEFGH23456789", k=14)) for _ in range(300)]
    found = lambda text: {text[a:b] for a, _, b in secrets.literal_spans(text)}
    assert found("api_secret = " + " + ".join(f'"{x}"' for x in literals)) == set(literals)
    chain = [f'part_0 = "{literals[0]}"'] + [f'part_{k} = part_{k - 1} + "{x}"' for k, x in enumerate(literals) if k]
    assert found("\n".join([*chain, "password = part_299"])) == set(literals)
    assert found("\n".join([*chain, "colour = part_299"])) == set()
    long = "x" * 200 + "_password"
    assert found(f'{long} = "{literals[1]}"') == {literals[1]} and found(f"<{long}>{literals[2]}</{long}>") == {literals[2]}


def test_decontamination(spark, odd, none):
    rng = random.Random(8)
    words = [f"v{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 20, 60])))) for i in range(12)]
    filler = lambda k: " ".join(rng.choice(words) for _ in range(k))
    docs = [(i, f"{filler(30)} {t.upper() if i % 2 else t} {filler(9)}") for i, t in items] + [(100 + k, filler(80)) for k in range(30)]
    frame = lambda rows, c: spark.createDataFrame(rows, f"{c} long, text string")
    token = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    want = set()
    for d, t in docs:
        w = token.findall(t.lower())
        for i, x in items:
            y = token.findall(x)
            k = min(5, len(y))
            grams = lambda z: Counter(zip(*(z[j:] for j in range(k))))  # noqa: E731,B023
            for at in range(len(w) - len(y) + 1):
                a, b = grams(w[at : at + len(y)]), grams(y)
                both = sum((a & b).values())
                if both >= 0.8 * (sum(a.values()) + sum(b.values()) - both):
                    want.add((d, i))
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_contamination(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert got == want and len(want) >= 12
    assert decontamination.drop_contaminated(frame(docs, "doc_id"), frame(items, "item_id")).count() == len(docs) - len({d for d, _ in want})
    assert decontamination.find_contamination(odd, frame([(1, None), (2, "")], "item_id")).count() == 0 and decontamination.find_contamination(none, frame(items, "item_id")).count() == 0


def test_decontamination_of_edited_passages(spark):
    """Against brute force over every start, with changes at both ends, an insertion between and repeats."""
    rng = random.Random(9)
    words = [f"v{i}" for i in range(400)]
    items = [(i, [rng.choice(words) for _ in range(n)]) for i, n in enumerate([100, 100, 60, 40, 12])] + [(5, ["v1", "v2"] * 20)]
    filler = lambda k: [f"x{rng.randrange(400)}" for _ in range(k)]
    docs = [(0, filler(200) + filler(2) + items[0][1][2:50] + filler(5) + items[0][1][50:98] + filler(2) + filler(30))]
    for k in range(1, 25):
        x = items[k % 6][1][:]
        for _ in range(k % 5):
            at = rng.randrange(len(x))
            x[at : at + rng.randrange(2)] = filler(rng.randrange(4))
        docs.append((k, filler(k) + x + filler(20)))
    docs.append((60, ["v1", "v2"] * 60))
    grams = lambda z: Counter(zip(*(z[j:] for j in range(5))))
    want = {}
    for d, w in docs:
        for i, y in items:
            b, m = grams(y), min(len(y), len(w))
            for at in range(len(w) - m + 1):
                a = grams(w[at : at + m])
                both = sum((a & b).values())
                s = both / (sum(a.values()) + sum(b.values()) - both)
                if s >= 0.8 and s > want.get((d, i), (0, 0))[0]:
                    want[d, i] = s, at
    frame = lambda rows, c: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], f"{c} long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"]) for r in decontamination.find_contamination(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert got == want and (0, 0) in got and len(want) < len(docs)


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns, name
        assert 0 < after.count() <= docs.count()
        docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
