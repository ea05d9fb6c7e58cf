"""Pairs of text columns by the cosine of their term weights, put together to one quantile."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import composite, quantile_class
from ..operators.relational import exploded, written
from ..operators.scoring import pair_cosine
from ..operators.stats import quantile_knots, quantile_place


def corpus(rows: DataFrame, columns: list[str | list[str]]) -> DataFrame:
    """(text): the distinct texts of each column, one after the other; a list of columns is coupled by '. '.

    Signs beyond ASCII become stops, stops stand alone, and line feeds become carriage returns.
    """
    out = None
    for c in columns:
        one = F.concat_ws(". ", *c) if isinstance(c, list) else F.col(c)
        part = rows.select(one.alias("text")).where("text is not null").distinct()
        out = part if out is None else out.union(part)
    text = F.regexp_replace("text", r"[^\x00-\x7F]", " . ")
    return out.select(F.replace(F.replace(text, F.lit("."), F.lit(" . ")), F.lit("\n"), F.lit("\r")).alias("text"))


def terms(text: Column) -> Column:
    """Words of two or more word characters, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


@dataclass
class PairCosines:
    """Fitted by `fit`: the inverse document frequencies of the corpus, each pair's knots, and the composite's.

    Modes of `transform`: clean (texts as they are weighed), vectors (long form), cossims, quantile_parts,
    and composite, the default.
    """

    pairs: list[tuple[str, str]]
    corpus_columns: list[str | list[str]]
    min_df: float = 0.01
    importances: list[float] | None = None
    clean: Callable[[Column], Column] | None = None
    idf: DataFrame | None = field(default=None, repr=False)
    knots: list[list[float]] = field(default_factory=list, repr=False)
    composite_knots: list[float] = field(default_factory=list, repr=False)

    def _columns(self) -> list[str]:
        return list(dict.fromkeys(c for p in self.pairs for c in p))

    def _cleaned(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({c: self.clean(F.col(c)) for c in self._columns()}) if self.clean else rows

    def _weights(self, cleaned: DataFrame, key: str) -> DataFrame:
        """(id, term, weight): a document is a row's key and a column; each at length 1."""
        docs = None
        for c in self._columns():
            part = cleaned.select(F.concat_ws("\x01", F.col(key).cast("string"), F.lit(c)).alias("id"), terms(F.coalesce(c, F.lit(""))).alias("w"))
            docs = part if docs is None else docs.union(part)
        tf = exploded(docs, ["id"], "w", "term").groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
        raw = tf.join(self.idf, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
        norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
        return raw.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("weight"))

    def _cosines(self, cleaned: DataFrame, key: str) -> DataFrame:
        """(key, score_0, score_1, ...)."""
        # Written once: each pair takes its two columns from it.
        weights = written(self._weights(cleaned, key))
        name = lambda c: F.concat_ws("\x01", F.col(key).cast("string"), F.lit(c))
        out = cleaned.select(key)
        for k, (a, b) in enumerate(self.pairs):
            wanted = cleaned.select(name(a).alias("a"), name(b).alias("b"))
            scored = pair_cosine(weights, "id", wanted).select(F.substring_index("a", "\x01", 1).alias(f"__k{k}"), F.col("score").alias(f"score_{k}"))
            out = out.join(scored, F.col(key).cast("string") == F.col(f"__k{k}"), "left").drop(f"__k{k}")
        return out

    def fit(self, rows: DataFrame, key: str) -> PairCosines:
        cleaned = self._cleaned(rows)
        docs = corpus(cleaned, self.corpus_columns).select(F.array_distinct(terms(F.col("text"))).alias("w"))
        n = docs.agg(F.count(F.lit(1)).alias("__n"))
        df = exploded(docs, [], "w", "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        # One number, broadcast.
        self.idf = written(df.crossJoin(F.broadcast(n)).where(F.col("df") >= self.min_df * F.col("__n")).select("term", (F.log((1 + F.col("__n")) / (1 + F.col("df"))) + 1).alias("idf")))
        self.importances = self.importances or [1 / len(self.pairs)] * len(self.pairs)
        cosines = written(self._cosines(cleaned, key))
        self.knots = [quantile_knots(cosines, f"score_{k}") for k in range(len(self.pairs))]
        self.refit(cosines)
        return self

    def refit(self, cosines: DataFrame) -> None:
        """The composite's knots for the present importances, from cosines of the training rows."""
        self.composite_knots = quantile_knots(self._composite(self._parts(cosines)), "composite_score")

    def _parts(self, cosines: DataFrame) -> DataFrame:
        on = range(len(self.pairs))
        return cosines.withColumns({f"qtile_{k}": quantile_place(F.col(f"score_{k}"), self.knots[k]) for k in on} | {f"confidence_{k}": F.lit(1.0) for k in on})

    def _composite(self, parts: DataFrame) -> DataFrame:
        score, confidence = composite([(F.col(f"qtile_{k}"), F.col(f"confidence_{k}"), i) for k, i in enumerate(self.importances)])
        return parts.withColumns({"composite_score": score, "confidence": confidence})

    def transform(self, rows: DataFrame, key: str, mode: str = "composite") -> DataFrame:
        cleaned = self._cleaned(rows)
        if mode == "clean":
            return cleaned
        if mode == "vectors":
            return self._weights(cleaned, key).select(F.substring_index("id", "\x01", 1).alias(key), F.substring_index("id", "\x01", -1).alias("column"), "term", "weight")
        cosines = self._cosines(cleaned, key)
        if mode == "cossims":
            return cosines
        parts = self._parts(cosines)
        if mode == "quantile_parts":
            return parts
        out = self._composite(parts).withColumn("qtile", quantile_place(F.col("composite_score"), self.composite_knots))
        return out.withColumn("class", quantile_class(F.col("qtile"), F.col("confidence"))).select(key, "composite_score", "qtile", "confidence", "class")
