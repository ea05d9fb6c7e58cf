"""Phrase and taxonomy lookup: dictionaries, longest matches of titles, crosswalks and expansions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import relational as rel

Stem = Callable[[Column], Column]


def crosswalk(df: DataFrame, name: str, exact: str, others: str) -> DataFrame:
    """(name, others as a list, skill) of a dimension whose column others is separated by `;`.

    The exact match is the one given, else the first of others that differs from the name in case alone. It
    leaves the list once, and is the skill; without one the name is.
    """
    parts = F.split(F.coalesce(others, F.lit("")), ";")
    same = F.get(F.filter(parts, lambda x: (F.lower(x) == F.lower(name)) & (x != F.col(name))), F.lit(0))
    found = F.coalesce(F.nullif(F.col(exact), F.lit("")), same, F.lit(""))
    rows = df.select(name, parts.alias("__p"), found.alias("__e"))
    at = F.array_position("__p", F.col("__e")).cast("int")
    left = F.filter("__p", lambda _, i: i + 1 != at)
    return rows.select(name, left.alias(others), F.coalesce(F.nullif("__e", F.lit("")), F.col(name)).alias("skill"))


def own_cluster_blank(df: DataFrame, label: str, cluster: str) -> DataFrame:
    """The taxonomy without clusters that are the label itself."""
    return df.withColumn(cluster, F.when(F.col(label) == F.col(cluster), "").otherwise(F.coalesce(cluster, F.lit(""))))


def title_dictionary(titles: DataFrame, title: str, stem: Stem | None = None) -> DataFrame:
    """(phrase, value, stemmed): each title by its lower case and, with stem, by its stems."""
    value = F.coalesce(title, F.lit(""))
    lowered = titles.select(F.lower(value).alias("phrase"), value.alias("value"), F.lit(False).alias("stemmed"))
    return lowered.unionByName(titles.select(stem(value).alias("phrase"), value.alias("value"), F.lit(True).alias("stemmed"))) if stem else lowered


def skill_dictionary(skills: DataFrame, house: DataFrame, stem: Stem | None = None) -> DataFrame:
    """(phrase, value, stemmed) from skills(skill, others) and house(skill, aliases separated by `;`).

    Aliases lead to their skill, and a skill with aliases to itself; an alias of several skills counts only
    for the one that it names. All skills and others lead to themselves where no alias does. One value for a phrase:
    the least of an alias's, then the least plain one.
    """
    plain = skills.select("skill").union(skills.select(F.explode("others"))).where("skill is not null").distinct()
    named = house.where("coalesce(aliases, '') <> ''").select("skill", F.explode(F.split(F.concat_ws(";", "skill", "aliases"), ";")).alias("alias"))
    shared = named.groupBy(F.col("alias").alias("__a")).agg(F.count(F.lit(1)).alias("__n"))
    named = named.join(shared, F.col("alias") == F.col("__a")).where("not (__n > 1 and skill <> alias)").select("skill", "alias")
    both = named.select(F.col("alias").alias("phrase"), F.col("skill").alias("value"), F.lit(0).alias("rank")).union(plain.select("skill", "skill", F.lit(1)))
    keyed = both.select(F.lower("phrase").alias("phrase"), "value", "rank", F.lit(False).alias("stemmed"))
    if stem:
        keyed = keyed.union(both.select(stem(F.lower("phrase")), "value", "rank", F.lit(True)))
    # The least pair of rank and value, combined before the shuffle.
    best = keyed.where("phrase <> ''").groupBy("phrase", "stemmed").agg(F.min(F.struct("rank", "value")).alias("b"))
    return best.select("phrase", "b.value", "stemmed")


def title_ready(title: Column) -> Column:
    """A title without parentheses, slashes between spaces."""
    return F.replace(F.regexp_replace(title, "[()]", ""), F.lit("/"), F.lit(" / "))


def title_matches(df: DataFrame, key: list[str], title: Column, dictionary: DataFrame, stem: Stem | None = None, for_stems: Column | None = None) -> DataFrame:
    """(key, values): the values of the longest phrases of a title, in lower case and, with stem, by stems too.

    A phrase whose words all lie in phrases after it, which are longer, is left out. for_stems is the title as it is
    to be stemmed, if other. A title without a match has no row.
    """
    phrases = lambda t: rel.sub_phrases(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    rows = df.select(*key, F.explode(phrases(F.lower(title))).alias("__p"), F.lit(False).alias("__s"))
    if stem:
        words = df.select(*key, (for_stems if for_stems is not None else F.lower(title)).alias("__f"))
        words = words.select(*key, F.explode(phrases(F.col("__f"))).alias("__p"))
        # Phrases repeat over titles: each is stemmed once.
        stems = words.select("__p").distinct().select(F.col("__p").alias("__w"), stem(F.col("__p")).alias("__t"))
        rows = rows.union(words.join(stems, F.col("__p") == F.col("__w")).where("__t <> ''").select(*key, F.col("__t").alias("__p"), F.lit(True).alias("__s")))
    held = dictionary.select(F.col("phrase").alias("__d"), F.col("value").alias("__v"), F.col("stemmed").alias("__ds"))
    # Never the broadcast that Spark plans by the size of a compressed file: a title's phrases are many times its bytes.
    hits = rows.join(held.hint("merge"), (F.col("__p") == F.col("__d")) & (F.col("__s") == F.col("__ds"))).select(*key, "__p", "__v")
    return rel.longest_only(hits, key)


def title_list_matches(df: DataFrame, key: str, titles: str, dictionary: DataFrame, stem: Stem | None = None, prepare: Stem = title_ready, prepare_stems: Stem | None = None) -> DataFrame:
    """(key, values): each title of a list matched by itself, the values of all in order, without blanks and `Other`. Every row has one."""
    rows = df.select(key, F.posexplode(titles).alias("__at", "__title"))
    found = title_matches(rows, [key, "__at"], prepare(F.col("__title")), dictionary, stem, prepare_stems(F.col("__title")) if prepare_stems else None)
    gathered = found.groupBy(F.col(key).alias("__k")).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("__at", "values"))), lambda x: x["values"])).alias("values"))
    fine = F.filter(F.coalesce("values", F.array().cast("array<string>")), lambda x: ~x.isin("", "Other"))
    return df.select(key).join(gathered, F.col(key) == F.col("__k"), "left").select(key, fine.alias("values"))


def row_synonyms(df: DataFrame, columns: list[str]) -> Column:
    """The distinct values of a row's columns, sorted, without blanks and `Other`."""
    every = F.array_distinct(F.array(*(F.coalesce(c, F.lit("")) for c in columns)))
    return F.array_sort(F.filter(every, lambda x: ~x.isin("", "Other")))


def group_synonyms(df: DataFrame, code: str, columns: list[str]) -> DataFrame:
    """(code, titles): the distinct values of all rows of a code, sorted, without blanks and `Other`."""
    rows = df.select(code, F.explode(row_synonyms(df, columns)).alias("t")).distinct()
    kept = rows.groupBy(F.col(code).alias("__c")).agg(F.array_sort(F.collect_list("t")).alias("titles"))
    none = F.array().cast("array<string>")
    return df.select(code).distinct().join(kept, F.col(code) == F.col("__c"), "left").select(code, F.coalesce("titles", none).alias("titles"))


def joined_distinct(df: DataFrame, group: list[str], text: str, separator: str = ",") -> DataFrame:
    """(group, text): the distinct parts, not empty, of a group's texts, sorted and joined again."""
    parts = df.select(*group, F.explode(F.split(text, separator)).alias("__p")).where("__p <> ''").distinct()
    kept = parts.groupBy(*(F.col(g).alias(f"__{g}") for g in group)).agg(F.array_join(F.array_sort(F.collect_list("__p")), separator).alias("__t"))
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group]
    return df.select(*group).distinct().join(kept, same, "left").select(*group, F.coalesce("__t", F.lit("")).alias(text))


def expanded(df: DataFrame, key: str, lists: list[str], mapping: DataFrame) -> DataFrame:
    """(key, values): each list's items mapped in the mapping's order, list after list; distinct values, sorted, no blanks."""
    out = df.select(key)
    for k, c in enumerate(lists):
        found = rel.map_in_file_order(df, key, c, mapping).select(F.col(key).alias(f"__k{k}"), F.col("values").alias(f"__v{k}"))
        out = out.join(found, F.col(key) == F.col(f"__k{k}"), "left")
    none = F.array().cast("array<string>")
    every = F.flatten(F.array(*(F.coalesce(f"__v{k}", none) for k in range(len(lists)))))
    return out.select(key, F.array_sort(F.array_distinct(F.filter(every, lambda x: x != ""))).alias("values"))


def pairs_of_rows(rows: DataFrame, key: str, left_items: str, right_items: str) -> DataFrame:
    """(key, left, right): every pair of two lists of a row, one row for each key; a list without items gives ''. Nothing is joined."""
    a = rows.dropDuplicates([key]).select(key, right_items, F.explode_outer(left_items).alias("left"))
    return a.select(key, F.coalesce("left", F.lit("")).alias("left"), F.explode_outer(right_items).alias("right")).withColumn("right", F.coalesce("right", F.lit("")))


def pairs_by_key(left: DataFrame, right: DataFrame, key: str, left_items: str, right_items: str) -> DataFrame:
    """(key, left, right): every pair of a key's items; a side without items, or without the key, gives ''."""
    a = left.dropDuplicates([key]).select(key, F.explode_outer(left_items).alias("left"))
    b = right.dropDuplicates([key]).select(key, F.explode_outer(right_items).alias("right"))
    return a.join(b, key, "full").select(key, F.coalesce("left", F.lit("")).alias("left"), F.coalesce("right", F.lit("")).alias("right"))
