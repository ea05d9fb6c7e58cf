"""How much of a job's skills or titles a person covers: lists from several sources, then the left overlap."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nested
from ..functions.similarity import quantile_class
from ..operators import lookup
from ..operators import relational as rel
from ..operators.scoring import left_overlap
from ..operators.stats import quantile_map



def _list(c: str | Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def with_class(scored: DataFrame, confidence: Column | None = None) -> DataFrame:
    """Adds qtile, confidence (1 if not given) and class to rows with a score, which are written: the knots need them all before any row has its place."""
    scored = rel.written(scored)
    out = quantile_map(scored, "score", "qtile").withColumn("confidence", F.lit(1.0) if confidence is None else confidence)
    return out.withColumn("class", quantile_class(F.col("qtile"), F.col("confidence")))


@dataclass
class SkillsOverlap:
    """Skills named in two documents, with what taxonomy(skill, cluster), crosswalk(name, others, skill), aliases(skill, aliases) and titles(title, skills) add.

    Each dimension is optional. Lists of a side are joined: skills by their house names in any case, skills
    found in the job's title, skills of the occupations, clusters and house skills.
    """

    taxonomy: DataFrame | None = None
    crosswalk: DataFrame | None = None
    aliases: DataFrame | None = None
    occupations: DataFrame | None = None
    skills_from_titles: bool = False
    stem: lookup.Stem | None = None
    skill_key: str = "canonskill"
    occupation_key: str = "occ"

    def dictionary(self) -> DataFrame | None:
        if self.crosswalk is None or self.aliases is None:
            return None
        return lookup.skill_dictionary(self.crosswalk.select("skill", "others"), self.aliases, self.stem)

    def _side(self, rows: DataFrame, key: str, document: str, title: str | None) -> DataFrame:
        """(key, items) of one side."""
        base = rows.select(key, nested.find_values(F.col(document), self.skill_key).alias("skills"), *([nested.find_values(F.col(document), self.occupation_key).alias("occs")] if self.occupations is not None else []), *([title] if title else []))
        parts, dictionary = [], self.dictionary()
        if self.skills_from_titles and dictionary is not None and title:
            parts.append(lookup.title_matches(base, [key], F.col(title), dictionary, self.stem).select(key, F.col("values").alias("items")))
        if self.occupations is not None:
            parts.append(rel.map_items(base, key, "occs", self.occupations, "title", "skills", "blank").select(key, F.col("occs").alias("items")))
        if self.taxonomy is not None:
            clusters = rel.map_items(base, key, "skills", self.taxonomy, "skill", "cluster", "drop")
            parts.append(clusters.select(key, F.filter("skills", lambda x: x != "").alias("items")))
        if self.crosswalk is not None:
            parts.append(rel.map_items(base, key, "skills", self.crosswalk, "name", "others", "blank").select(key, F.col("skills").alias("items")))
        own = base.select(key, F.col("skills").alias("items"))
        if dictionary is not None:
            names = dictionary.where("not stemmed").select("phrase", "value")
            own = rel.map_items(base, key, "skills", names, "phrase", "value", "source", any_case=True).select(key, F.col("skills").alias("items"))
        every = rel.union_by_name([own, *parts])
        return every.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list("items"))).alias("items"))

    def lists(self, rows: DataFrame, key: str, job: str = "job", person: str = "person", title: str | None = None) -> DataFrame:
        """(key, left, right): all lists of the job and of the person."""
        a = self._side(rows, key, job, title).withColumnRenamed("items", "left")
        b = self._side(rows, key, person, None).withColumnRenamed("items", "right")
        return rows.select(key).join(a, key, "left").join(b, key, "left").select(key, _list("left").alias("left"), _list("right").alias("right"))

    def transform(self, rows: DataFrame, key: str, job: str = "job", person: str = "person", title: str | None = None, scale: str = "sqrt") -> DataFrame:
        """(key, score, n_elem, qtile, confidence, class)."""
        return with_class(left_overlap(self.lists(rows, key, job, person, title), key, "left", "right", scale))


@dataclass
class TitleMapping:
    """Titles mapped to those of a dictionary(phrase, value, stemmed): previous ones by a list, the job's and the desired one."""

    dictionary: DataFrame
    stem: lookup.Stem | None = None
    stem_form: lookup.Stem | None = None

    def _one(self, rows: DataFrame, key: str, title: str) -> DataFrame:
        ready = lookup.title_ready(F.col(title))
        found = lookup.title_matches(rows, [key], ready, self.dictionary, self.stem, self.stem_form(ready) if self.stem_form else None)
        return found.select(F.col(key).alias(f"__{title}"), F.col("values").alias(f"{title}_match"))

    def transform(self, rows: DataFrame, key: str, previous: str = "previous_title", titles: tuple[str, ...] = ("job_title", "desired_title"), separator: str = ":: ") -> DataFrame:
        """rows with a column <title>_match for each title, [] without a match."""
        filled = rows.fillna("", [previous, *titles])
        listed = filled.withColumn("__list", F.split(previous, separator))
        prepare = (lambda t: self.stem_form(lookup.title_ready(t))) if self.stem_form else None
        out = filled.join(lookup.title_list_matches(listed, key, "__list", self.dictionary, self.stem, lookup.title_ready, prepare).withColumnRenamed("values", f"{previous}_match"), key, "left")
        for t in titles:
            one = self._one(filled, key, t)
            out = out.join(one, out[key] == one[f"__{t}"], "left").drop(f"__{t}").withColumn(f"{t}_match", _list(f"{t}_match"))
        return out


def occupation_titles(occupations: DataFrame, sub: DataFrame) -> DataFrame:
    """(name, code, sub): all occupations and sub-occupations by name, whichever side has them."""
    return occupations.join(sub.select("name", "sub").distinct(), "name", "full").select("name", "code", "sub")


@dataclass
class TitlesOverlap:
    """Titles of a job against those of a person: clusters of the occupations in both documents and mapped titles.

    clusters(code, titles) gives an occupation's titles, synonyms(title, titles) those of a mapped title.
    keep says which lists count, in their order; of several the first that has items is taken for a side, or
    all where union is set.
    """

    clusters: DataFrame
    synonyms: DataFrame
    mapping: TitleMapping
    union: bool = False

    def lists(self, rows: DataFrame, key: str, job: str = "job", person: str = "person") -> DataFrame:
        """(key, left, right)."""
        from ..functions.text import desired_or_current

        base = rows.withColumn("desired_title", desired_or_current(F.coalesce("desired_title", F.lit("")), F.coalesce("current_title", F.lit(""))))
        base = base.select("*", *nested.key_columns(F.col(job), {"occ": "bgt_occ"}, "j"), *nested.key_columns(F.col(person), {"occ": "@bgtocc"}, "p"))
        mapped = self.mapping.transform(base, key).select(key, F.array("j_occ").alias("j_occ"), F.array("p_occ").alias("p_occ"), F.col("job_title_match").alias("j_titles"), F.array_union("previous_title_match", "desired_title_match").alias("p_titles"))
        out = mapped.select(key)
        for side in ("j", "p"):
            occ = rel.map_items(mapped, key, f"{side}_occ", self.clusters, "code", "titles", "drop").withColumnRenamed(f"{side}_occ", f"{side}_a")
            own = rel.map_items(mapped, key, f"{side}_titles", self.synonyms, "title", "titles", "source").withColumnRenamed(f"{side}_titles", f"{side}_b")
            both = occ.join(own, key).select(key, _list(f"{side}_a").alias("a"), F.filter(_list(f"{side}_b"), lambda x: x != "").alias("b"))
            taken = F.array_union("a", "b") if self.union else F.when(F.size("a") > 0, F.col("a")).otherwise(F.col("b"))
            out = out.join(both.select(key, F.array_sort(taken).alias({"j": "left", "p": "right"}[side])), key, "left")
        return out

    def transform(self, rows: DataFrame, key: str, job: str = "job", person: str = "person", scale: str = "sqrt") -> DataFrame:
        """(key, score, n_elem, qtile, confidence, class)."""
        return with_class(left_overlap(self.lists(rows, key, job, person), key, "left", "right", scale))
