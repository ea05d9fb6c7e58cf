import random
import re
import time
import tracemalloc
from collections import Counter

from pairlens.llm.decontamination import Index


def brute(items, texts):
    """Every window of every text against every item."""
    cut = lambda t: re.findall(r"[0-9a-z]+", t.lower())
    out = {}
    for t, text in enumerate(texts):
        w = cut(text)
        for i, item in items:
            v = cut(item)
            k = min(5, len(v))
            own = [tuple(v[j : j + k]) for j in range(len(v) - k + 1)]
            all_ = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
            if not own or not all_:
                continue
            if k < 5:
                sim = 1.0 if own[0] in all_ else 0.0
            else:
                size, mine, sim = min(len(own), len(all_)), Counter(own), 0.0
                for j in range(len(all_) - size + 1):
                    both = sum((mine & Counter(all_[j : j + size])).values())
                    sim = max(sim, both / (len(own) + size - both))
            if sim >= 0.8:
                out[t, i] = sim
    return out


def test_like_every_window():
    draw, hits = random.Random(1), 0
    for _ in range(40):
        words = [f"v{i}" for i in range(draw.choice((3, 6, 30)))]
        items = [(i, " ".join(draw.choices(words, k=draw.randint(1, 40)))) for i in range(draw.randint(1, 8))]
        texts = ["", "..."]
        for _ in range(12):
            text = draw.choices(words, k=draw.randint(0, 40))
            if draw.random() < 0.7:
                edited = draw.choice(items)[1].split()
                for _ in range(draw.randint(0, 2)):
                    edited[draw.randrange(len(edited))] = "zz"
                text += edited
            texts.append(" ".join(text))
        got = {(t, i): s for t, i, s, _ in Index(items).search([t.encode() for t in texts])}
        assert got == brute(items, texts)
        hits += len(got)
    assert hits > 100


def test_items_that_share_boilerplate_cost_little():
    shared = "this very sentence is the shared boilerplate of all the items in the benchmark and goes on for a while here"
    for own in (3, 25):
        index = Index([(i, f"{shared} {' '.join(f'q{i}x{j}' for j in range(own))}") for i in range(2000)])
        text = f"{shared} " * (200_000 // len(shared))
        tracemalloc.start()
        began = time.process_time()
        assert index.search([text.encode()]) == []
        took, (_, most) = time.process_time() - began, tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert took < 2 * 3 and most < 200e6  # 2 s, with room for a slow machine under the tracer


def test_alike_items_are_all_found():
    index = Index([(i, "one two three four five six seven eight nine ten eleven twelve " + " ".join(["end"] * (i % 2))) for i in range(500)])
    got = index.search([b"so one two three four five six seven eight nine ten eleven twelve it is"])
    assert sorted(i for _, i, _, _ in got) == list(range(500)) and {w for *_, w in got} <= {0, 1}
