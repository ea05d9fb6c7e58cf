"""Personal data: fixed patterns, and information-theoretic sanitisation of the words around them.

The protected entities are the values that the patterns find (an address, a number). The corpus tells
how much a word outside such values reveals of one: PMI(term; entity) / IC(entity), from the numbers of
rows that hold the entity, the term, and both. At 1 the term gives the entity away. Terms at or over
the threshold, whose meetings with the entity chance does not explain, become spans of kind `term`
wherever they stand in the corpus, which `sanitised` generalises or removes. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bits_of, cut, may_hold, table

KINDS = ("email", "ip", "card", "phone", "term")
# The base patterns. Possessive quantifiers and the guard before a run of the first class
# match the same spans as the plain forms, without retries inside a run and without deep recursion.
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: What a text needs for a pattern to match at all.
HINTS = (r"@[A-Za-z0-9-]", r"[0-9]\.[0-9]", r"[0-9](?:[\x20-]?[0-9]){13}", r"\+[0-9]")
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: The share of the entity's information at which a term discloses it; the chance that any pair of the corpus meets as often without a link.
DISCLOSURE, CHANCE = 0.9, 0.01
#: Factors of the bound on that chance.
FACTORS = 30

_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _valid(kind: int, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == 1:
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == 2:
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == 3:
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _placed(text: Column, pattern: str, made, kept, type_: str) -> Column:
    """The matches of pattern for which kept(match) holds, as made(start, end, match), in order.

    What split() leaves between the matches gives their places.
    """
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        found = acc["found"]
        return F.struct(end.alias("at"), F.when(x["match"].isNotNull() & kept(x["match"]), F.concat(found, F.array(made(start, end, x["match"])))).otherwise(found).alias("found"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(type_).alias("found")), step, lambda acc: acc["found"])


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, sorted by start, then kind. text must not be null."""
    found = []
    for kind, (pattern, hint) in enumerate(zip(PATTERNS, HINTS)):
        made = lambda start, end, _, kind=kind: F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        spans = _placed(text, pattern, made, lambda m, kind=kind: _valid(kind, m), _SPANS)
        found.append(F.when(text.rlike(hint), spans).otherwise(F.array().cast(_SPANS)))
    return F.sort_array(F.concat(*found))


_WORD = r"[\p{L}\p{N}_]++"


def _outside(text: Column, spans: Column) -> Column:
    """text with each span as so many spaces, so that places stay."""

    def step(acc: Column, s: Column) -> Column:
        start = F.greatest(acc["at"], s["start"])
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, start - acc["at"]), F.repeat(F.lit(" "), s["end"] - start))
        return F.when(s["end"] > acc["at"], F.struct(out.alias("out"), s["end"].alias("at"))).otherwise(acc)

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    masked = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text) - acc["at"])))
    return F.when(F.size(spans) > 0, masked).otherwise(text)


def _terms(text: Column) -> Column:
    """The different words of a text in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), lambda w: F.lower(w)))


def written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def _disclosing(held: DataFrame, words: DataFrame, total: int, disclosure: float, chance: float) -> DataFrame:
    """Terms over the threshold for some entity. held: key, more, copies, entities, terms, one row for each text (key, more) with values; words: term, one row for each row of the corpus and different word.

    Pairs are made only of terms and entities that can still pass: a term that reveals an entity is hardly
    commoner than it, and unless the corpus is far larger than the meetings in it, chance explains whatever
    meets in one text alone.
    """
    n = float(total)
    # Each meeting of an entity and a term in a text is a test.
    tests = max(held.agg(F.sum(F.size("entities").cast("long") * F.size("terms"))).first()[0] or 0, 1)
    least = 2 if tests > chance * n else 1
    found = held.select("key", "more", "copies", F.explode("entities").alias("entity"))
    entities = found.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count(F.lit(1)).alias("k_entity"))
    entities = cut(entities.where((F.col("k_entity") >= least) & (F.col("n_entity") < n)))
    # n_both <= n_entity, so that PMI(term; entity) >= disclosure * IC(entity) bounds a term's rows.
    most = lambda c: F.pow(c, F.lit(disclosure)) * (n ** (1 - disclosure) * (1 + 1e-9))
    top = entities.agg(F.max("n_entity")).first()[0]
    # The terms' counts cover every row of the corpus and are combined before the shuffle.
    terms = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).where((F.col("n_term") >= least) & (F.col("n_term") <= most(F.lit(float(top or 0)))))
    there = held.select("key", "more", F.explode("terms").alias("term")).join(terms, "term")
    pairs = found.join(entities, "entity").join(there, ["key", "more"]).where(F.col("n_term") <= most(F.col("n_entity")))
    scored = pairs.groupBy("entity", "term").agg(F.sum("copies").alias("n_both"), F.count(F.lit(1)).alias("k"), F.max("n_entity").alias("n_entity"), F.max("k_entity").alias("k_entity"), F.max("n_term").alias("n_term"))
    information = F.log2(n / F.col("n_entity"))
    pmi = F.log2(F.col("n_both") * n / (F.col("n_entity") * F.col("n_term")))
    # P(k or more of the entity's texts hold the term) <= E[C(K, j)] / C(k, j) for every j up to k; copies of a text are one.
    factor = lambda i: F.log((F.col("k_entity") - i) * (F.col("n_term") - i) / ((n - i) * (F.col("k") - i)))
    bound = F.aggregate(F.sequence(F.lit(0).cast("long"), F.least(F.col("k"), F.lit(FACTORS)) - 1), F.lit(0.0), lambda s, i: s + factor(i))
    fine = scored.where((F.col("k") >= least) & (pmi >= disclosure * information)).where(bound <= F.log(F.lit(chance / tests)))
    return fine.select("term").distinct()


def find_personal_data(docs: DataFrame, disclosure: float = DISCLOSURE, chance: float = CHANCE) -> DataFrame:
    """Personal data in every whole text of docs(doc_id, text, ...), one row for each row.

    Returns doc_id, span_list (array of (start, kind, end) in code points, kind as its place in KINDS),
    n_email, n_ip, n_card, n_phone, base_sha256, spans and sanitised_sha256 (of the text as `sanitised` makes it).
    Null and empty texts give zeros and empty spans; a null doc_id stays null; repeated rows give repeated results and count as many rows, but
    as one text; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    # Rows and texts are told apart by 128 bits of hashes.
    two = lambda a, b, *of: (F.xxhash64(*of).alias(a), F.xxhash64(F.lit(1), *of).alias(b))
    key = ["__key", "__more"]
    rows = rows.select("doc_id", *two(*key, "doc_id", "text"), "text")
    found = rows.withColumn("base", base_spans(F.col("text")))
    base = cut(found.select("doc_id", *key, "base", F.sha2(sanitised(F.col("text"), F.col("base")), 256).alias("__clean")))
    outside = found.withColumn("outside", _outside(F.col("text"), F.col("base")))
    values = F.array_distinct(F.transform("base", lambda s: F.concat(s["kind"].cast("string"), F.lit(":"), F.lower(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))))
    held = outside.where("size(base) > 0").select(*two("key", "more", "text"), values.alias("entities"), _terms(F.col("outside")).alias("terms"))
    held = cut(held.groupBy("key", "more").agg(F.count(F.lit(1)).alias("copies"), F.first("entities").alias("entities"), F.first("terms").alias("terms")))
    words = outside.select(*key, F.explode(_terms(F.col("outside"))).alias("term"))
    disclosing = cut(_disclosing(held, words, base.count(), disclosure, chance))
    # Every row is searched for them: filters keep nearly all other words, and rows, out of the shuffle, the joins decide.
    some = words.withColumn("__term", F.xxhash64("term"))
    some = some.where(may_hold(bits_of(disclosing.select(F.xxhash64("term").alias("h"))), "__term")).select(*key, "term")
    # A term that a third of all rows hold: inner join, whose large partitions Spark splits.
    told = cut(some.join(disclosing, "term").groupBy(*key).agg(F.collect_set("term").alias("terms")))
    texts = rows.where(may_hold(bits_of(told, "__key"), "__key")).join(told, key).dropDuplicates(key)
    texts = texts.withColumn("base", base_spans(F.col("text"))).withColumn("outside", _outside(F.col("text"), F.col("base")))
    made = lambda a, b, _: F.struct(a.alias("start"), F.lit(4).alias("kind"), b.alias("end"))
    more = texts.select(F.col("__key").alias("__k"), F.col("__more").alias("__m"), "text", "base", _placed(F.col("outside"), _WORD, made, lambda m: F.array_contains("terms", F.lower(m)), _SPANS).alias("more"))
    more = more.select("__k", "__m", "more", F.sha2(sanitised(F.col("text"), F.sort_array(F.concat("base", "more"))), 256).alias("__cleaner"))
    joined = base.join(more, (F.col("__key") == F.col("__k")) & (F.col("__more") == F.col("__m")), "left")
    # One argument alone: a second one of the function would be the place in the array.
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    n = [number(k).alias(f"n_{KINDS[k]}") for k in range(4)]
    joined = joined.select("doc_id", "base", F.coalesce("__cleaner", "__clean").alias("sanitised_sha256"), F.sort_array(F.concat("base", F.coalesce("more", F.array().cast(_SPANS)))).alias("span_list"))
    return joined.select("doc_id", "span_list", *n, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("span_list")).alias("spans"), "sanitised_sha256")


def sanitised(text: Column, span_list: Column) -> Column:
    """text with its fixed spans generalised to <KIND> and its disclosing terms removed; overlapping spans take the first."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS[:4]), F.lit(""))

    def step(acc: Column, s: Column) -> Column:
        new = F.struct(
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"])).alias("out"),
            s["end"].alias("at"),
        )
        return F.when(s["start"] >= acc["at"], new).otherwise(acc)

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(span_list, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text) - acc["at"])))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents")).drop("span_list")
