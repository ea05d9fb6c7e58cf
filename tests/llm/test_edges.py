"""Edges that plain tables do not have: several templates in a leaf, clashing columns, odd letters, hash traps, hostile pages."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from pairlens.llm import bpe, decontamination, embeddings, html, linededup, minhash, pii, secrets, sharding, toxicity, wordhash

CLASH = ["drop", "di", "dt", "id", "th", "__id", "gone", "slot", "node", "vals", "term", "__x"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, f"some words of text number {'abcde'[i % 5]} here", *[0] * len(CLASH)) for i in range(12)] + [(None, None, *[0] * len(CLASH))]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in CLASH))


def _line_templates(texts: dict[int, str]) -> dict[int, str]:
    """Brute force of line dedup: {doc: text without later occurrences}."""
    masked = {}
    for d, t in texts.items():
        for pos, raw in enumerate(t.split("\n")):
            tokens = raw.split()
            fields = [linededup.FIELD if re.search("[0-9]", x) else x for x in tokens]
            if tokens:
                masked[d, pos] = tuple(tokens if all(x == linededup.FIELD for x in fields) else fields)
    leaves = defaultdict(set)
    for line in masked.values():
        leaves[len(line), line[: linededup.DEPTH]].add(line)
    template = {}

    def part(key: tuple, lines: set) -> None:
        if len(lines) < 2:
            return
        n = len(next(iter(lines)))
        counts = [Counter(x[k] for x in lines) for k in range(n)]
        constant = [next((w for w, c in counts[k].items() if 2 * c > len(lines)), None) for k in range(n)]
        fit = {x for x in lines if sum(a == b for a, b in zip(x, constant)) >= linededup.SIMILAR * n}
        template.update(dict.fromkeys(fit, key))
        places = [(len(c), k) for k, c in enumerate(counts) if 1 < len(c) < len(lines)]
        if places:
            groups = defaultdict(set)
            for x in lines - fit:
                groups[x[min(places)[1]]].add(x)
            for w, g in groups.items():
                part((*key, min(places)[1], w), g)

    for key, lines in leaves.items():
        part(key, lines)
    seen = defaultdict(list)
    for (d, pos), line in masked.items():
        seen[template.get(line, ("own", line))].append((d, pos))
    gone = {at for where in seen.values() if len({d for d, _ in where}) > 1 for at in set(where) - {min(where)}}
    return {d: "\n".join(x for pos, x in enumerate(t.split("\n")) if (d, pos) not in gone) for d, t in texts.items()}


def test_lines_like_brute_force(spark):
    rng = random.Random(11)
    name = lambda: "".join(rng.choices("abcdefgh", k=7))
    families = [
        lambda: f"alpha beta gamma delta red fox runs over hill {name()}",
        lambda: f"alpha beta gamma delta old cat naps upon rugs {name()}",
        lambda: f"alpha beta gamma delta {name()} {name()} {name()} {name()} {name()} {name()}",
        lambda: f"2024-01-{rng.randrange(30)} 10:{rng.randrange(60)} {rng.randrange(999)} user {rng.choice(['ann', 'bob', name()])} opened the door",
        lambda: f"2024-01-{rng.randrange(30)} 10:{rng.randrange(60)} {rng.randrange(999)} disk {name()} has failed badly today",
        lambda: rng.choice(["The.", "All rights reserved.", "page 7", "12 5", "99 3 1", "", "   "]),
        lambda: f"own {name()} line {name()} of this {name()} text",
    ]
    texts = {d: "\n".join(rng.choice(families)() for _ in range(rng.randrange(1, 9))) for d in range(120)}
    got = {r["doc_id"]: r["text"] for r in linededup.drop_recurring_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    want = _line_templates(texts)
    assert got == want and want != texts


def test_lines_of_two_families_in_one_leaf(spark):
    rows = [(i, f"alpha beta gamma delta {'red fox runs over hill' if i % 2 else 'old cat naps upon rugs'} {'abcdefghij'[i]}zz") for i in range(10)]
    out = linededup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"), "lines", "dropped").collect()
    assert sum(r["dropped"] for r in out) == 8 and {r["doc_id"] for r in out if r["text"]} == {0, 1} and {r["lines"] for r in out} == {1}


def test_clashing_columns(spark, clashing, tmp_path):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "no such words in any of the texts")], "item_id long, text string")
    model = toxicity.train(clashing, labels)
    for out in (linededup.drop_recurring_lines(clashing), minhash.drop_near_duplicates(clashing), toxicity.drop_toxic(clashing, model), decontamination.drop_contaminated(clashing, items)):
        assert out.columns == clashing.columns and out.count() <= 13
    for out in (minhash.near_duplicates(clashing), pii.find_personal_data(clashing), secrets.scan_secrets(clashing), sharding.assign_slots(clashing), toxicity.score_toxicity(clashing, labels)):
        assert out.count() == 13
    sharding.write_shards(clashing, f"file://{tmp_path}/s", 3, 4)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert back.count() == 13 and set(clashing.columns) < set(back.columns)


def test_shard_order_does_not_hang_on_partitions(spark):
    docs = spark.range(500).selectExpr("id % 400 as doc_id", "if(id > 300, 'same', cast(id as string)) as text")
    rows = lambda frame: sorted(map(tuple, sharding.assign_slots(frame, 5, bucket_rows=16).collect()), key=str)
    first = rows(docs.repartition(3))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert rows(docs.repartition(11)) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert first != sorted(map(tuple, sharding.assign_slots(docs, 5, bucket_rows=16, seed=1).collect()), key=str)
    by = Counter(r[4] for r in first)
    assert max(by.values()) - min(by.values()) <= 1
    assert sorted((r[4], r[5]) for r in first) == [(s, k) for s in range(5) for k in range(by[s])]


def test_written_shards_hold_each_row_once(spark, tmp_path):
    docs = spark.range(300).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "if(id % 3 = 0, 'hot', cast(id as string)) as text", "id as n").repartition(6)
    sharding.write_shards(docs, f"file://{tmp_path}/w", 4, 32)
    back = spark.read.parquet(f"file://{tmp_path}/w").collect()
    assert sorted(r["n"] for r in back) == list(range(300))
    assert len({(r["shard"], r["slot"]) for r in back}) == 300


def test_bpe_of_every_plain_letter():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, lib = bpe.codec(path), Tokenizer.from_file(path)
    lib.no_truncation()
    for u in [*range(0x250), *range(0x2010, 0x2028), *range(0x20A0, 0x20BA)]:
        for form in ("a%sb", "%s", "A %s1", "%s's x"):
            text = form % chr(u)
            assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids, (hex(u), form)


def test_word_hashes_tell_tricky_words_apart():
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    a, b = (bytes(97 + (x ^ flip) for x in bits) for flip in (0, 1))
    h, *_ = wordhash.words([a + b" " + b + b" " + a.upper()], wordhash.WHITE)
    assert h[0] != h[1] and h[0] == h[2]


def test_vectors_over_many_blocks_and_lengths(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 6))
    x = np.concatenate([base[rng.integers(60, size=700)] + rng.choice([0.01, 0.25, 0.4], size=(700, 1)) * rng.normal(size=(700, 6)), base[:1], base[:1]])
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)] + [(1000, [1.0, 2.0], 0), (1001, [1.0, 2.0], 0), (1002, [2.0, 4.0, 0.0], 0), (1003, [1.0, 2.0], 1), (1004, [2.0, 4.0], 0), (1005, [3.0], 0)]
    kept = embeddings.INTERVAL, embeddings.LEAF
    embeddings.INTERVAL, embeddings.LEAF = 64, 8
    try:
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    finally:
        embeddings.INTERVAL, embeddings.LEAF = kept
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = (u @ u.T >= 0.93) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2)
    np.fill_diagonal(hit, False)
    label = np.arange(len(x))
    while (new := np.where(hit, label[None, :], len(x)).min(1)).min() < len(x) and ((less := np.minimum(new, label)) != label).any():
        label = less
    assert all(got[i] == (int(hit[i].sum()), int(label[i])) for i in range(len(x)))
    assert [got[i] for i in range(1000, 1006)] == [(2, 1000), (2, 1000), (0, 1002), (0, 1003), (2, 1000), (0, 1005)]


@pytest.mark.parametrize("piece", ["<a ", "<div>", "<!", "<template>", "<li><ul>", '<a "', "<p title=\"x>", "<svg>", "<p>", "</div>", "<b", "< "])
def test_hostile_pages_take_linear_time(piece):
    def took(n: int) -> float:
        began = time.process_time()
        html.Page(piece * n)
        return time.process_time() - began

    took(1000)
    assert took(40_000) < 0.5 + 12 * took(10_000)


def test_markup_in_an_article_is_kept():
    page = html.Page("<article><p>a <math><mi>x</mi></math> 1 < 2 and b</p><iframe>no end <p>after</p></article>")
    assert "x" in "".join(t or "" for _, t in page.texts) and "after" in "".join(t or "" for _, t in page.texts) and "1 < 2" in "".join(t or "" for _, t in page.texts)
    assert [t for _, t in html.Page("<script>if (a<b) { c = 'x' }</script>text").texts if t] == ["text"]


def test_secrets_that_are_named_later():
    found = lambda text: [text[a:b] for a, _, b in secrets.literal_spans(text)]
    assert found('api_secret_key = base\nbase = "k9Xq2LmZ7vR4"') == ["k9Xq2LmZ7vR4"]
    assert found('password = a1\na1 = b1 + c1\nb1 = "zQ8#kkP0w"\nc1 = a1\n') == ["zQ8#kkP0w"]
    assert found('colour = base\nbase = "k9Xq2LmZ7vR4"') == []


def test_toxicity_of_no_rows_and_long_texts(spark):
    docs = spark.createDataFrame([(i, f"{'bad word zorg ' if i % 2 else 'good word lamo '}{i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model.curve is not None and len(model.scores([])) == 0
    long = spark.createDataFrame([(1, "good word lamo " * 60_000), (2, None), (3, ""), (4, "x" * 300_000)], "doc_id long, text string")
    rows = toxicity.score_toxicity(long.union(docs), labels).collect()
    assert len(rows) == 204 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.drop_toxic(long.where("false"), model).count() == 0


def _base_plain(text: str) -> list[tuple[int, str, int]]:
    out = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(x) for x in m[0] if x.isdigit()]
        double = [sum(divmod(2 * x, 10)) for x in d[-2::-2]]
        if 14 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(double)) % 10 == 0:
            out.append((m.start(), "card", m.end()))
    out += [(m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(x.isdigit() for x in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[1])))


def test_base_spans_like_plain_patterns(spark):
    rng = random.Random(12)
    bits = ["a@b.co", "x.y@z", "@", "a@b@c.de", "é", "1.2.3.4", "300.1.2.3", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111 1111-1111 ", "+1 (222) 333-4444", "+49", "0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0", ".", "-", " ", "7", "++1 2345678901", "A%b+c@d-e.f-g"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", ",", "\n"]) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        own = [(s["start"], pii.KINDS[s["kind"]], s["end"]) for s in got[i]["span_list"] if s["kind"] < 4]
        assert own == _base_plain(t), t
        names = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "term": ""}
        out, at = "", 0
        for s in got[i]["span_list"]:
            if s["start"] >= at:
                out, at = out + t[at : s["start"]] + names[pii.KINDS[s["kind"]]], s["end"]
        assert got[i]["sanitised_sha256"] == hashlib.sha256((out + t[at:]).encode()).hexdigest()


def test_base_secrets_like_plain_patterns():
    rng = random.Random(13)
    bits = ["password", "Secret", "api_key", "apikey", "TOKEN", '"', "'", " ", "=", ":", "abcdefABCDEF", "0123456789abcdef", "AKIA", "QWERTYUIOP1234", "x", "é", "\n"]
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 12)))
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert secrets.base_spans(t) == sorted(want), t
