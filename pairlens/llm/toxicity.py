"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled rows: one on ordinary text, one that also holds
what sets toxic text apart. A text is cut into windows of a few words; how many bytes shorter the
toxic dictionary makes a window is its margin. A logistic curve over the margins, fitted on the
labelled rows and set to their share of toxic ones, gives the score.

The ordinary dictionary is zstandard's own (COVER) over windows of ordinary rows. The toxic one puts
segments in front of it, found in the same way but by contrast: character n-grams frequent among
toxic rows and rare among ordinary ones, chosen one by one by how many toxic rows they still have to
cover, and extended while nearly all words that hold them agree. In front, they leave all distances
to ordinary content as they are, so that a margin comes from toxic segments alone.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_chunks, table, trimmed

#: The bound of the training sample: rows of each class, by the hash of their id, and characters of one row.
SAMPLE = {1: 1000, 0: 2000}
SAMPLE_CHARS = 200_000
#: Words of a window, bytes of the ordinary dictionary, zstandard's level.
WINDOW, DICTIONARY, LEVEL = 5, 4096, 5
#: The model's size and what it learns from the sample, nothing that a scored text meets. Sizes of n-grams; least share and number of toxic rows that hold one; how much more frequent it is among toxic rows; segments that cover a row; segments at most.
GRAMS, LEAST_SHARE, LEAST, CONTRAST, COVER, SEGMENTS = (4, 5), 0.01, 8, 8, 4, 120
#: Scores from here on are toxic.
THRESHOLD = 0.3
#: Windows that are compressed in one call.
BATCH = 20_000
MARGINS = (1, 2, 3, 4, 5, 6)


def _grams(word: str) -> set[str]:
    padded = f" {word}"
    return {padded[i : i + k] for k in GRAMS for i in range(len(padded) - k + 1)}


def _segments(toxic: list[str], ordinary: list[str]) -> list[str]:
    """What sets toxic rows apart, the most telling first."""
    count = lambda rows: Counter(g for words in rows for g in set().union(*map(_grams, words)))
    toxic_words, ordinary_words = ([set(t.lower().split()) for t in ts] for ts in (toxic, ordinary))
    of_toxic, of_ordinary = count(toxic_words), count(ordinary_words)
    share = lambda g: (of_toxic[g] / len(toxic)) / ((of_ordinary[g] + 1) / len(ordinary))
    telling = {g for g, n in of_toxic.items() if n >= max(LEAST, LEAST_SHARE * len(toxic)) and share(g) >= CONTRAST}
    # Copies of one row all say the same: what counts is in how many different contexts an n-gram occurs.
    contexts: dict[str, set[tuple[str, str]]] = defaultdict(set)
    for text in toxic:
        words = text.lower().split()
        for before, word, after in zip(["", *words], words, [*words[1:], ""]):
            for g in _grams(word) & telling:
                contexts[g].add((before, after))
    telling = {g for g in telling if len(contexts[g]) >= max(LEAST, 0.6 * of_toxic[g])}
    rows: dict[str, set[int]] = defaultdict(set)
    for i, words in enumerate(toxic_words):
        for g in set().union(*map(_grams, words)) & telling:
            rows[g].add(i)
    holding: dict[str, Counter] = defaultdict(Counter)
    for words in toxic_words:
        for w in words:
            for g in _grams(w) & telling:
                holding[g][f" {w}"] += 1
    covered, chosen = Counter(), []
    while rows and len(chosen) < SEGMENTS:
        best = max(rows, key=lambda g: (sum(covered[i] < COVER for i in rows[g]) - CONTRAST * of_ordinary[g], len(g), g))
        if sum(covered[i] < COVER for i in rows[best]) < max(LEAST, LEAST_SHARE * len(toxic)):
            break
        segment, total = best, sum(holding[best].values())
        while len(segment) < 24:
            longer = Counter()
            for w, n in holding[best].items():
                at = w.find(segment)
                if at > 0:
                    longer[w[at - 1] + segment] += n
                if at >= 0 and at + len(segment) < len(w):
                    longer[segment + w[at + len(segment)]] += n
            if not longer or longer.most_common(1)[0][1] < 0.8 * total:
                break
            segment = longer.most_common(1)[0][0]
        chosen.append(segment)
        covered.update(rows[best])
        # N-grams that mostly come with this segment say nothing new.
        mine = holding[best]
        for g in [g for g in rows if g == best or sum(n for w, n in holding[g].items() if w in mine) >= 0.5 * sum(holding[g].values())]:
            del rows[g]
    return chosen


def _windows(text: str) -> list[bytes]:
    words = text.lower().split()
    return [f" {' '.join(words[i : i + WINDOW])} ".encode() for i in range(0, len(words), WINDOW)] or [b" "]


class Model:
    """Two dictionaries and a calibrated curve; small, and sent to the tasks as it is."""

    def __init__(self, toxic: list[str], ordinary: list[str], share: float) -> None:
        self.share, self.curve = share, None
        if not toxic or not ordinary:
            return
        samples = [w for t in ordinary for w in _windows(t)]
        try:
            base = zstandard.train_dictionary(DICTIONARY, samples).as_bytes()[-DICTIONARY:]
        except zstandard.ZstdError:  # too few or too short samples for COVER
            base = b"".join(samples)[-DICTIONARY:]
        self.segments = _segments(toxic, ordinary)
        self.dictionaries = base, "".join(reversed(self.segments)).encode() + base
        x = self.features([*toxic, *ordinary])
        y = np.array([1.0] * len(toxic) + [0.0] * len(ordinary))
        mean, spread = x.mean(0), x.std(0) + 1e-9
        z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
        w = np.zeros(z.shape[1])
        ridge = np.eye(len(w)) * 0.01 * len(y)
        ridge[-1, -1] = 1e-6
        for _ in range(50):
            p = 1 / (1 + np.exp(-z @ w))
            w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        # From the sample's share of toxic rows to that of all labelled rows.
        w[-1] += np.log(share / (1 - share) * len(ordinary) / len(toxic))
        self.curve = mean, spread, w

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        made = (zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in self.dictionaries)
        return [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False) for d in made]

    def _margins(self, windows: list[bytes], compressors: list) -> np.ndarray:
        parts = []
        for at in range(0, len(windows), BATCH):
            ordinary, toxic = (np.array([len(s) for s in c.multi_compress_to_buffer(windows[at : at + BATCH])]) for c in compressors)
            parts.append(ordinary - toxic)
        return np.concatenate([np.zeros(0, int), *parts])

    def features(self, texts: list[str], compressors: list | None = None) -> np.ndarray:
        cut = [_windows(t) for t in texts]
        margins = self._margins([w for ws in cut for w in ws], compressors or self._compressors())
        out, at = [], 0
        for ws in cut:
            m = margins[at : at + len(ws)]
            at += len(ws)
            top = np.sort(m)[-2:]
            out.append([top[-1], top[0] if len(m) > 1 else 0, *(np.log1p((m >= k).sum()) for k in MARGINS), np.log1p(len(m))])
        return np.array(out, float).reshape(len(texts), len(MARGINS) + 3)

    def scores(self, texts: list[str | None], compressors: list | None = None) -> np.ndarray:
        if self.curve is None:
            return np.full(len(texts), self.share)
        mean, spread, w = self.curve
        x = self.features([t or "" for t in texts], compressors)
        return 1 / (1 + np.exp(-(((x - mean) / spread) @ w[:-1] + w[-1])))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on labelled rows that are not held out: at most SAMPLE of each class, by the hash of their id, one text for an id."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for value, n in SAMPLE.items():
        part = known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = part if picked is None else picked.union(part)
    # A bounded number of ids, so they may be sent to all tasks.
    ids = F.broadcast(picked.select(F.col("doc_id").alias("__id"), F.col("toxic").alias("__toxic")))
    rows = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("__id")).groupBy("__id", "__toxic").agg(F.min(F.substring("text", 1, SAMPLE_CHARS)).alias("t")).orderBy("__id").collect()
    toxic, ordinary = ([r["t"] for r in rows if r["__toxic"] == v and r["t"]] for v in (1, 0))
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    return Model(toxic, ordinary, min(max(n1 / max(n1 + n0, 1), 1e-4), 1 - 1e-4))


def _scores(model: Model, column: pa.Array, compressors: list | None) -> np.ndarray:
    """Scores of a batch, a bounded number of bytes at a time."""
    return np.concatenate([np.zeros(0), *(model.scores([t.decode() for t in texts], compressors) for _, texts in byte_chunks(column))])


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores every whole text of docs(doc_id, text, ...) by a model fitted on labels(doc_id, toxic, ...).

    One row for each row: doc_id, held_out, score (0 to 1), predicted (1 from THRESHOLD on). Null and
    empty texts are scored as a text without words. Without labelled rows of both classes every score
    is the share of toxic ones (0.0001 at least). A null doc_id is not held out; repeated rows give repeated results; ids
    labelled twice count as toxic if one label says so; other columns are ignored.
    """
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model._compressors() if model.curve else None
        for batch in trimmed(batches):
            s = _scores(model, batch.column(1), compressors)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text, ...), all columns, without the rows that the model calls toxic.

    Null and empty texts are scored as a text without words; equal texts stay or go together; doc_id says
    nothing. An empty table gives no rows. Other columns, whatever their names, are kept.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model._compressors() if model.curve else None
        for batch in trimmed(batches):
            yield batch.filter(pa.array(_scores(model, batch.column(at), compressors) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
