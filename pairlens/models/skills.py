"""Skills of a job against those of a person: by generations of clusters, and by word vectors and the best assignment."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import cosine, generation_score
from ..operators import lookup
from ..operators import relational as rel
from ..operators.scoring import assigned_quantile, optimal_assignment
from .overlap import with_class


def combined_skills(*lists: Column) -> Column:
    """The distinct skills of several lists, sorted."""
    return F.array_sort(F.array_distinct(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists))))


def skill_findings(rows: DataFrame, key: str, job: str, person: str, clusters: DataFrame) -> DataFrame:
    """(key, found, missing, others, missing_chains, other_chains) with clusters(skill, chain): what the person has of the job's skills, what not,
    the person's other skills where something is missing, and the chains of ancestors of both."""
    base = rows.select(key, F.array_sort(F.array_intersect(job, person)).alias("found"), F.array_sort(F.array_except(job, person)).alias("missing"), F.col(person).alias("__p"))
    base = base.select(key, "found", "missing", F.when(F.size("missing") > 0, F.array_sort(F.array_except("__p", "found"))).otherwise(F.array().cast("array<string>")).alias("others"))
    out = base
    for name in ("missing", "others"):
        held = base.select(key, F.explode(name).alias("__s")).join(clusters.select(F.col("skill").alias("__c"), "chain"), F.col("__s") == F.col("__c"))
        held = held.groupBy(F.col(key).alias("__k")).agg(F.array_sort(F.collect_list("chain")).alias({"missing": "missing_chains", "others": "other_chains"}[name]))
        out = out.join(held, out[key] == held["__k"], "left").drop("__k")
    none = F.array().cast("array<array<string>>")
    return out.withColumns({c: F.coalesce(c, none) for c in ("missing_chains", "other_chains")})


def generation_model(rows: DataFrame, key: str, job: str, person: str, clusters: DataFrame, decay: float = 1.0, compat: bool = True) -> DataFrame:
    """(key, one_to_one, final_score, confidence): skills in common count in full, missing ones by how far up their chain the person's others have an ancestor."""
    found = skill_findings(rows, key, job, person, clusters).join(rows.select(key, F.size(job).alias("__n")), key)
    # Chains that begin with the same skill count once.
    heads = F.transform("missing_chains", lambda c: F.get(c, F.lit(0)))
    chains = F.filter("missing_chains", lambda c, i: F.array_position(heads, F.get(c, F.lit(0))) == i + 1)
    score = generation_score(F.size("found"), chains, F.flatten("other_chains"), F.col("__n"), decay, compat)
    return found.select(key, F.size("found").alias("one_to_one"), score.alias("final_score"), F.lit(1.0).alias("confidence"))


def table_assignment(rows: DataFrame, key: str, job: str, person: str, weights: DataFrame) -> DataFrame:
    """(key, score): the mean weight of the best assignment of the job's skills to the person's by weights(left, right, weight); pairs without one weigh 0, an empty side scores 0."""
    pairs = lookup.pairs_of_rows(rows, key, job, person).where("left <> '' and right <> ''")
    scored = pairs.join(weights, ["left", "right"], "left").select(key, "left", "right", F.coalesce("weight", F.lit(0.0)).alias("s"))
    best = optimal_assignment(scored, key, "left", "right", "s").groupBy(F.col("k").alias("__k")).agg(F.avg("s").alias("__m"))
    return rows.select(key).join(best, F.col(key) == F.col("__k"), "left").select(key, F.coalesce("__m", F.lit(0.0)).alias("score"))


#: Words that one task trains word vectors on; Spark averages what several tasks find.
WORDS = 1 << 22


@dataclass
class ProfileSkills:
    """Skills of both sides from titles, lists and documents, mapped and stemmed; pairs of them by word vectors, the best
    assignment of each row, and the quantile q of its scores.

    mapping(ordinal, key, value) is the crosswalk, broader(ordinal, key, value) the taxonomy, title_skills(ordinal, key, value)
    what titles bring. Columns of rows: job_title, current_title, desired_title, previous_title, job_skills, profile_skills
    as texts, job_parsed and person_parsed as lists.
    """

    mapping: DataFrame
    broader: DataFrame
    title_skills: DataFrame
    q: float = 0.8
    size: int = 500
    window: int = 25
    iterations: int = 5
    vectors: DataFrame | None = field(default=None, repr=False)
    made: tuple[DataFrame, str, DataFrame] | None = field(default=None, init=False, repr=False)

    def lists(self, rows: DataFrame, key: str) -> DataFrame:
        """(key, job, person): the distinct skills of each side."""
        from ..functions.clean import stemmed_lists

        base = rows.select(
            key,
            *(T.title_list(F.coalesce(c, F.lit(""))).alias(c) for c in ("job_title", "current_title", "desired_title")),
            *(T.split_list(F.coalesce(c, F.lit("")), ":: ").alias(c) for c in ("previous_title", "job_skills", "profile_skills")),
            *(F.flatten(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda s: T.split_parentheses(F.lower(s)))).alias(c) for c in ("job_parsed", "person_parsed")),
        )
        # Sixteen lookups read it.
        base = rel.written(base)
        out = base.select(key)
        for side, titles, skills, parsed in (("job", ["job_title"], "job_skills", "job_parsed"), ("person", ["previous_title", "current_title", "desired_title"], "profile_skills", "person_parsed")):
            words = base.withColumns({f"__w_{c}": T.phrase_words(F.col(c)) for c in [*titles, skills]})
            parts = [
                lookup.expanded(base, key, titles, self.title_skills),
                lookup.expanded(words, key, [f"__w_{c}" for c in [*titles, skills]], self.mapping),
                lookup.expanded(lookup.expanded(base, key, [skills, parsed], self.mapping), key, ["values"], self.broader),
                base.select(key, stemmed_lists(F.concat(skills, parsed)).alias("values")),
            ]
            every = rel.union_by_name(parts).groupBy(F.col(key).alias(f"__{side}")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("values")))).alias(side))
            out = out.join(every, F.col(key) == F.col(f"__{side}"), "left").drop(f"__{side}")
        return out

    def _sides(self, rows: DataFrame, key: str) -> DataFrame:
        """lists of rows, written once for fit and transform of the same frame."""
        if self.made is None or self.made[0] is not rows or self.made[1] != key:
            self.made = rows, key, rel.written(self.lists(rows, key))
        return self.made[2]

    def fit(self, rows: DataFrame, key: str) -> ProfileSkills:
        from pyspark.ml.feature import Word2Vec
        from pyspark.ml.functions import vector_to_array

        if self.vectors is None:
            words = self._sides(rows, key).select(F.concat("person", "job").alias("w"))
            parts = max(1, -(-(words.agg(F.sum(F.size("w"))).first()[0] or 0) // WORDS))
            model = Word2Vec(vectorSize=self.size, windowSize=self.window, minCount=1, stepSize=0.01, maxIter=self.iterations, numPartitions=parts, seed=1, inputCol="w", outputCol="v").fit(words)
            self.vectors = model.getVectors().select("word", vector_to_array("vector").alias("vector"))
        return self

    def pair_scores(self, rows: DataFrame, key: str) -> DataFrame:
        """(key, left, right, score): each pair of a row's skills; 0 where one is blank or has no vector."""
        pairs = lookup.pairs_of_rows(self._sides(rows, key), key, "job", "person")
        a = self.vectors.select(F.col("word").alias("left"), F.col("vector").alias("__x"))
        b = self.vectors.select(F.col("word").alias("right"), F.col("vector").alias("__y"))
        # Skills recur from row to row: two of them are scored once.
        known = pairs.select("left", "right").distinct().join(a, "left", "left").join(b, "right", "left")
        known = rel.written(known.select("left", "right", F.coalesce(cosine(F.col("__x"), F.col("__y")), F.lit(0.0)).alias("score")))
        few = known.count() <= rel.GROUPS
        return pairs.join(F.broadcast(known) if few else known, ["left", "right"]).select(key, "left", "right", "score")

    def transform(self, rows: DataFrame, key: str) -> DataFrame:
        """(key, score, qtile, confidence, class): score is the quantile q of the assigned pairs' scores."""
        best = optimal_assignment(self.pair_scores(rows, key), key, "left", "right", "score")
        scored = assigned_quantile(rows.select(key), key, best.select(F.col("k").alias(key), "s"), "s", self.q)
        return with_class(scored)
