"""Benchmark decontamination by the similarity of item-sized windows.

A window has as many words as an item, or all words of a shorter text; every start counts. Both are
compared by their five-word shingles, weighted by their counts. The similarity grows with the number
of shared shingles alone, and that grows only where a shingle of the item enters the window, so those
places in order meet the best window of each text and item. Which items are judged at all is settled
before: a text must hold one of an item's rarest shingles, and enough of all of them; what many items
share is rare in none, and items that share the same with a text are judged once. All exact.

This takes the place of SimHash fingerprints with blocks: at sampled starts they miss edited passages, and
at every start, as tried, they cost several times what the check allows (figures in the README).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import byte_chunks, table, trimmed
from .wordhash import NOT_ALNUM, shingles, words

SHINGLE, SIMILARITY = 5, 0.8
#: Words of the items that are searched for at once, at least one item: what bounds an index. More make further passes over the documents.
WORDS = 1 << 19


class Index:
    """The items' shingles, and which items each leads."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids, self.size, counts = [], [], []
        self.short: dict[int, dict[int, list[int]]] = {}
        entries: list[tuple[int, int]] = []
        for item_id, text in items:
            h, _, _, doc = words([(text or "").encode()], NOT_ALNUM)
            if not len(h):
                continue
            s, _ = shingles(h, doc, min(SHINGLE, len(h)))
            if len(h) < SHINGLE:
                self.short.setdefault(len(h), {}).setdefault(int(s[0]), []).append(item_id)
                continue
            held = Counter(s.tolist())
            entries += [(x, len(self.ids)) for x in sorted(held)]
            self.ids.append(item_id)
            self.size.append(len(s))
            counts.append(held)
        self.sizes = np.array(self.size, np.int64)
        each = np.array([e[0] for e in entries], np.uint64)
        #: Shingles of all items, and for each item the places of its own there with their counts, item after item.
        self.distinct, own = np.unique(each, return_inverse=True)
        item = np.array([e[1] for e in entries], np.int64)
        count = np.array([counts[c][x] for x, c in entries], np.int64)
        common = np.bincount(own, minlength=len(self.distinct))
        # The rarest first: a text within the similarity holds one of an item's leading shingles, whose counts add up to what it may miss and one more.
        order = np.lexsort((own, common[own], item))
        self.own, self.count, item = own[order], count[order], item[order]
        self.begin = np.searchsorted(item, np.arange(len(self.ids) + 1))
        before = np.cumsum(self.count) - self.count
        before -= before[self.begin[:-1]][item] if len(item) else 0
        lead = before <= self.sizes[item] - np.ceil(SIMILARITY * self.sizes[item] - 1e-9)
        by = np.argsort(self.own[lead], kind="stable")
        self.leading = item[lead][by]
        #: The items led by distinct[i] are leading[offset[i]:offset[i + 1]].
        self.offset = np.searchsorted(self.own[lead][by], np.arange(len(self.distinct) + 1))

    def _candidates(self, here: np.ndarray, times: np.ndarray, n: int, held: np.ndarray) -> np.ndarray:
        """The items that may reach the similarity in a text of n shingles that holds the shingles `here` so many times. held: a zero for each shingle, before and after."""
        lo, hi = self.offset[here], self.offset[here + 1]
        if not (hi - lo).sum():
            return np.zeros(0, np.int64)
        items = np.unique(self.leading[np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange((hi - lo).sum())])
        held[here] = times
        begin, end = self.begin[items], self.begin[items + 1]
        place = np.repeat(begin - np.cumsum(end - begin) + (end - begin), end - begin) + np.arange((end - begin).sum())
        both = np.add.reduceat(np.minimum(self.count[place], held[self.own[place]]), np.cumsum(end - begin) - (end - begin))
        held[here] = 0
        # No window holds more shared shingles than the text, nor than it has itself.
        window = np.minimum(self.sizes[items], n)
        both = np.minimum(both, window)
        return items[both / (self.sizes[items] + window - both) >= SIMILARITY]

    @staticmethod
    def _best_end(places: list[np.ndarray], counts: np.ndarray, window: int) -> tuple[int, int]:
        """(shared shingles, last place) of the first best window, where a shingle occurs at places[i] and counts at most counts[i] times."""
        # An occurrence counts in windows that end from it on, until it falls out or enough later ones are in.
        stops = [np.minimum(p + window, np.append(p[c:], np.full(min(c, len(p)), np.iinfo(np.int64).max))) for p, c in zip(places, counts)]
        starts, stops = np.sort(np.concatenate(places)), np.sort(np.concatenate(stops))
        both = np.arange(1, len(starts) + 1) - np.searchsorted(stops, starts, "right")
        best = int(both.argmax())
        return int(both[best]), int(starts[best])

    def search(self, texts: list[bytes]) -> list[tuple[int, int, float, int]]:
        """(text, item id, best similarity, first word of that window)."""
        h, _, _, doc = words(texts, NOT_ALNUM)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        for m, known in self.short.items():
            s, at = shingles(h, doc, m)
            for k in np.flatnonzero(np.isin(s, np.array(list(known), np.uint64))):
                t = int(doc[at[k]])
                if first[t + 1] - first[t] >= m:
                    for item_id in known[int(s[k])]:
                        best.setdefault((t, item_id), (1.0, int(at[k] - first[t])))
        if not len(self.distinct):
            return [(t, i, s, w) for (t, i), (s, w) in best.items()]
        s, at = shingles(h, doc, SHINGLE)
        place = np.minimum(np.searchsorted(self.distinct, s), len(self.distinct) - 1)
        found = np.flatnonzero(self.distinct[place] == s)
        none = np.zeros(len(self.distinct), np.int64)
        for own in np.split(found, np.flatnonzero(np.diff(doc[at[found]])) + 1):
            if not len(own):
                continue
            t = int(doc[at[own[0]]])
            n = int(first[t + 1] - first[t]) - SHINGLE + 1
            if n < 1:
                continue
            # A text's occurrences by shingle, each in order; each run of words gives one shingle.
            by = np.argsort(place[own], kind="stable")
            here, begin = np.unique(place[own][by], return_index=True)
            spots = np.split(at[own][by] - first[t], begin[1:])
            items = self._candidates(here, np.diff(np.append(begin, len(by))), n, none)
            judged: dict[bytes, tuple[float, int]] = {}
            for c in items.tolist():
                mine, most = (x[self.begin[c] : self.begin[c + 1]] for x in (self.own, self.count))
                k = np.minimum(np.searchsorted(here, mine), len(here) - 1)
                held = here[k] == mine
                k, most = k[held], most[held]
                # Items of one size that share the same shingles with the text are judged once.
                alike = np.concatenate([[self.size[c]], k, most]).tobytes()
                if alike not in judged:
                    window = min(self.size[c], n)
                    both, end = self._best_end([spots[i] for i in k.tolist()], most, window)
                    judged[alike] = both / (self.size[c] + window - both), max(0, end - window + 1)
                sim, start = judged[alike]
                key = (t, self.ids[c])
                if sim >= SIMILARITY and sim > best.get(key, (0.0, 0))[0]:
                    best[key] = sim, start
        return [(t, i, x, w) for (t, i), (x, w) in best.items()]


def _indexes(benchmark: DataFrame) -> list[Index]:
    """Indexes of up to WORDS words of items each."""
    rows = benchmark.select("item_id", "text").where("text is not null").distinct().orderBy("item_id", "text").toLocalIterator()
    out, now, size = [], [], 0
    for r in rows:
        words_in = len(r["text"].split())
        if now and size + words_in > WORDS:
            out.append(Index(now))
            now, size = [], 0
        now.append((r["item_id"], r["text"]))
        size += words_in
    return [*out, Index(now)] if now or not out else out


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Passages of benchmark(item_id, text, ...) in the whole texts of docs(doc_id, text, ...).

    Words are runs of letters and digits (in ASCII, and all other characters), A-Z taken as a-z. One row for each row of docs and item with
    similarity 0.8 or more: doc_id, item_id, similarity of the best window, start_word. Items of under
    five words are one shingle and must occur as they are. Null, empty and wordless texts match nothing; so
    do such items. A null doc_id stays null; repeated rows give repeated results; repeated items count
    once; other columns are ignored.
    """
    out = None
    for index in _indexes(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in trimmed(batches):
                rows = [(at + t, i, s, w) for at, texts in byte_chunks(batch.column(1)) for t, i, s, w in held.value.search(texts)]
                cols = list(zip(*rows)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], (pa.int64(), pa.float64(), pa.int64())))], names=["doc_id", "item_id", "similarity", "start_word"])

        part = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, similarity double, start_word long")
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...), all columns, without the rows that hold a benchmark passage: see find_contamination.

    Null, empty and wordless texts stay; equal rows stay or go together; a null doc_id says nothing. An
    empty table, or an empty benchmark, drops nothing. Other columns, whatever their names, are kept.
    """
    at = docs.columns.index("text")

    def keep(index) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in trimmed(batches):
                fine = np.ones(len(batch), bool)
                for start, texts in byte_chunks(batch.column(at)):
                    fine[[start + t for t, *_ in index.value.search(texts)]] = False
                yield batch.filter(pa.array(fine))

        return run

    for index in _indexes(benchmark):
        docs = docs.mapInArrow(keep(docs.sparkSession.sparkContext.broadcast(index)), docs.schema)
    return docs


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Every window that ends at a shared shingle, for pairs that share enough.
SQL = r"""with d as materialized (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from documents),
i as materialized (select distinct item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from benchmark),
ds as materialized (select doc_id, len(w) - k + 1 as n, k, unnest(range(0, len(w) - k + 1)) as p, w from d, (select distinct least(5, len(w)) as k from i where len(w) > 0) where len(w) >= k),
dg as materialized (select doc_id, n, k, p, array_to_string(w[p + 1:p + k], ' ') as s from ds),
ig as (select item_id, least(5, len(w)) as k, len(w) - least(5, len(w)) + 1 as size, unnest([array_to_string(w[j + 1:j + least(5, len(w))], ' ') for j in range(0, len(w) - least(5, len(w)) + 1)]) as s from i where len(w) > 0),
c as materialized (select item_id, k, size, s, count(*) as c from ig group by all),
h as materialized (select g.doc_id, c.item_id, g.p, c.s, c.c, c.size, least(c.size, g.n) as win from dg g join c on g.s = c.s and g.k = c.k),
t as (select doc_id, item_id from h group by 1, 2 having least(count(*), any_value(win)) / (any_value(size) + any_value(win) - least(count(*), any_value(win)))::double >= 0.8),
x as (select a.doc_id, a.item_id, a.p, b.s, least(count(*), any_value(b.c)) as m, any_value(a.size) as size, any_value(a.win) as win from h a semi join t on a.doc_id = t.doc_id and a.item_id = t.item_id join h b on a.doc_id = b.doc_id and a.item_id = b.item_id and b.p between a.p - a.win + 1 and a.p group by 1, 2, 3, 4),
y as (select doc_id, item_id, p, sum(m)::bigint as m, any_value(size) as size, any_value(win) as win from x group by 1, 2, 3),
z as (select *, m / (size + win - m)::double as similarity from y qualify row_number() over (partition by doc_id, item_id order by m desc, p) = 1)
select doc_id, item_id, similarity, greatest(0, p - win + 1)::bigint as start_word from z where similarity >= 0.8"""
