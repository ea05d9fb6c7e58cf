"""Cleaning rules, tags, lists and recipes."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import Pipeline, Recipes
from ..sources import table
from .base import Registry

R = Registry()
QUERIES, SQL = R.queries, R.sql


#: What each rule does, in SQL of its own: the table, and the pattern and replacement in DuckDB's dialect.
_RULES_SQL = {
    "period_before_li": ("pages", "'[.]?\\s*</li>', '.</li>'"),
    "ampersand_pair": ("documents", "'([\\pL\\pN_]+)\\s*&(amp;)?\\s*([\\pL\\pN_]+)', '\\1_and_\\3'"),
    "caps_heading": ("documents", "'([A-Z\\s]+:)', '. \\1'"),
    "paren_break": ("documents", "'[)]\\s*([^a-z])', '). \\1'"),
    "newline_capital": ("documents", "concat(chr(10), '([A-Z])'), '. \\1'"),
    "list_end": ("pages", "'(<\\s*/(li|ul|LI|UL)\\s*>)', '. \\1'"),
    "div_end": ("pages", "'(<\\s*/\\s*div\\s*>)', '. \\1'"),
    "break_to_crlf": ("pages", "'<br\\s*/>', concat(chr(13), chr(10))"),
    "paragraph_to_stop": ("pages", "'<p>|</p>', '. '"),
    "strip_tags": ("pages", "'<[^>]*>', ' '"),
    "space_collapse": ("documents", "'\\s+', ' '"),
    "space_before_dot": ("documents", "'\\s*[.]', '.'"),
    "dots_to_one": ("documents", "'[.]+', '.'"),
    "url_strip": ("pages", "'https?://\\S+', ''"),
    "number_bullets": ("documents", "'\\s\\d+.\\s+', ' '"),
    "camel_split": ("pages", "'([a-z])([A-Z])', '\\1 \\2'"),
    "plus_plus": ("documents", "'[+]{2}', 'plusplus'"),
    "c_sharp": ("documents", "'C\\s*#', 'C_sharp'"),
}


def _digest(table_name: str, out) -> tuple:
    key, column = ("page_id", "html") if table_name == "pages" else ("doc_id", "text")

    def run(spark, d):
        made = out(F.col(column))
        return table(spark, d, table_name).select(key, F.md5(made.cast("binary")).alias("digest"), F.length(made).cast("long").alias("n"))

    return run, key, column


for _name, (_table, _args) in _RULES_SQL.items():
    _run, _key, _column = _digest(_table, lambda c, name=_name: T.rule(c, name))
    QUERIES[f"clean_step_{_name}"] = _run
    SQL[f"clean_step_{_name}"] = f"select {_key}, md5(t) as digest, length(t) as n from (select {_key}, regexp_replace({_column}, {_args}, 'g') as t from {_table})"

_WORD = "[\\pL\\pN_]"


def _passes(text: str, pattern: str, put: str, times: int = 4) -> str:
    for _ in range(times):
        text = f"regexp_replace({text}, '{pattern}', '{put}', 'g')"
    return text


def _chain_sql(sign: str, name: str) -> str:
    """Both forms, again and again: chains take a pass for each second word."""
    return _passes(_passes("text", f"({_WORD}+://)?({_WORD}+){sign}({_WORD})", f"\\2_{name}_\\3"), f"({_WORD}+://)?{sign}({_WORD})", f"{name}_\\2")


_IT_SQL = f"regexp_replace(text, '({_WORD})?I[.]*T[.]*({_WORD})?', concat(chr(2), '\\1', chr(3), '\\2', chr(4)), 'g')"
_WORDS_SQL = {
    "at_words": (T.at_words, _chain_sql("@", "at")),
    "uri_words": (T.uri_words, _chain_sql("[.]", "dot")),
    "slash_words": (T.slash_words, _passes("text", f"({_WORD})\\s*/\\s*({_WORD})", "\\1_slash_\\2")),
    "dot_words": (T.dot_words, f"regexp_replace(replace(regexp_replace(text, '({_WORD}*)[.]({_WORD}+)', concat(chr(2), '\\1', chr(3), '\\2'), 'g'), concat(chr(2), chr(3)), 'dot_'), concat(chr(2), '([^', chr(3), ']+)', chr(3)), '\\1_dot_', 'g')"),
    "expand_it": (T.expand_it, f"regexp_replace(replace({_IT_SQL}, concat(chr(2), chr(3), chr(4)), 'information_technology'), concat(chr(2), '([^', chr(3), ']?)', chr(3), '([^', chr(4), ']?)', chr(4)), '\\1IT\\2', 'g')"),
}
for _name, (_fn, _text) in _WORDS_SQL.items():
    QUERIES[f"clean_step_{_name}"] = _digest("documents", _fn)[0]
    SQL[f"clean_step_{_name}"] = f"select doc_id, md5(t) as digest, length(t) as n from (select doc_id, {_text} as t from documents)"


@R.add()
def clean_whole(spark, d):
    from ..functions.clean import cleaned, cleaned_for_stemming

    return table(spark, d, "pages").select("page_id", cleaned("html").alias("text"), cleaned_for_stemming("html").alias("for_stemming"))


@R.add()
def stem_texts(spark, d):
    from ..functions.clean import cleaned_and_stemmed

    return table(spark, d, "benchmark").select("item_id", cleaned_and_stemmed("text").alias("text_stemmed"))


_RANKS = ["Sr", "Junior level 2", "intern", "Chief", "lvl IV", "Head of", "Associate", "Graduate", "assistant vice", "assistant to the", "Scrum master", "web master", "master", "masterdata", "vice president", "president", "post-doctoral", "mid level", "midlevel", "college grad", "l3", "viii", "tier three", "SNR", "entry to some level", "fresher", "certified", "staff", "officer", "beginner expert", "advanced professional fellow", ""]
_RANK_LIST = "[" + ", ".join(f"'{r}'" for r in _RANKS) + "]"


def _ranked_titles(spark, d):
    """A title for each part: a rank and the part's name."""
    ranks = F.array(*map(F.lit, _RANKS))
    return table(spark, d, "part").select("p_partkey", F.concat_ws(" ", F.get(ranks, F.pmod("p_partkey", F.lit(len(_RANKS))).cast("int")), "p_name").alias("t"))


_TITLES = f"with t as (select p_partkey, concat_ws(' ', {_RANK_LIST}[p_partkey % {len(_RANKS)} + 1], p_name) as t from part)"
# Look-arounds are not to be had: what they rule out is taken out first.
_TAGS_SQL = {
    "senior": "x ~ '(?i).*\\b(senior|sr|snr)\\b.*'", "junior": "x ~ '(?i).*\\b(junior|jr|jnr)\\b.*'", "intern": "x ~ '(?i).*(\\bintern(ship)?\\b|\\btrainee\\b).*'",
    "assistant": "regexp_replace(x, '(?i)\\bassistant\\W+vice\\b', '', 'g') ~ '(?i).*\\bassistant\\b.*'", "associate": "x ~ '(?i).*\\bassoc.*'",
    "entry_level": "x ~ '(?i).*(\\bentry.*level\\b|\\bbeginner\\b|\\bfresh|\\bcollegegrad).*'", "master": "regexp_replace(x, '(?i)(scrum|web)\\smaster', '', 'g') ~ '(?i).*master($|[^datmngen ].*)'",
    "principal": "x ~ '(?i).*\\bprincipal\\b.*'", "head": "x ~ '(?i).*\\bhead\\b.*'", "fellow": "x ~ '(?i).*\\bfellow\\b.*'", "advanced": "x ~ '(?i).*\\badvanced\\b.*'",
    "post_doctoral": "x ~ '(?i).*\\bpost.*doctoral\\b.*'", "president": "regexp_replace(x, '(?i)vice\\spresident', '', 'g') ~ '(?i).*\\bpresident\\b.*'", "professional": "x ~ '(?i).*\\bprofessional\\b.*'",
    "expert": "x ~ '(?i).*\\bexpert\\b.*'", "midlevel": "x ~ '(?i).*(midlevel|\\bmid\\b).*'", "chief": "x ~ '(?i).*\\bchief\\b.*'", "officer": "x ~ '(?i).*\\bofficer\\b.*'", "certified": "x ~ '(?i).*\\bcertif.*'",
    "graduate": "x ~ '(?i).*\\bgraduate\\b.*'", "degree": "x ~ '(?i).*\\bgraduate\\b.*'", "staff": "x ~ '(?i).*\\bstaff\\b.*'",
}
_LEVELS_SQL = ["regexp_extract_all(x, '(?i)\\b(?:level|lvl|tier)\\b\\s+(\\b[1-8]\\b|one|two|three|iii|ii|iv|viii|vii|vi|v|i)', 1)", "regexp_extract_all(x, '(?i)\\bl(i+|v|[0-9])\\b', 1)", "regexp_extract_all(x, '(?i)\\b(i+|v|iv|vi+)\\b', 1)"]
_LEVEL_SQL = "coalesce(try_cast(y as int), case lower(y) when 'i' then 1 when 'ii' then 2 when 'iii' then 3 when 'iv' then 4 when 'v' then 5 when 'vi' then 6 when 'vii' then 7 when 'one' then 1 when 'two' then 2 when 'three' then 3 else 0 end)"


@R.add(_TITLES + ", g as (" + " union all ".join(f"select p_partkey, '{k}' as tag from (select p_partkey, t as x from t) where {v}" for k, v in _TAGS_SQL.items()) + " union all " + " union all ".join(f"select p_partkey, 'level ' || {_LEVEL_SQL} from (select p_partkey, unnest({v}) as y from (select p_partkey, t as x from t))" for v in _LEVELS_SQL) + ") select t.p_partkey, coalesce(array_to_string(list_sort(list(distinct tag) filter (where tag is not null)), ','), '') as tags from t left join g on t.p_partkey = g.p_partkey group by 1")
def seniority_tags(spark, d):
    return _ranked_titles(spark, d).select("p_partkey", F.array_join(T.seniority_tags(F.col("t")), ",").alias("tags"))


@R.add(f"select o_orderkey, {_LEVEL_SQL} as level from (select o_orderkey, ['iv', 'VIII', '12', 'vii', 'one', 'x', '9', 'Three', '123456', '', 'II', substr(o_orderpriority, 1, 1)][o_orderkey % 12 + 1] as y from orders)")
def level_number(spark, d):
    words = F.array(*map(F.lit, ["iv", "VIII", "12", "vii", "one", "x", "9", "Three", "123456", "", "II"]), F.substring("o_orderpriority", 1, 1))
    return table(spark, d, "orders").select("o_orderkey", T.level_number(F.get(words, (F.col("o_orderkey") % 12).cast("int"))).alias("level"))


_TITLE_SQL = r"[sj]r._level_|^[seju]{2}nior[,_]*|[seju]{2}nior-?_|,*_\(*[seju]{2}nior\)*_*|[seju]{2}nior[.]|senior[/-]lead_|-[seju]{2}nior|[seju]{2}nior/|[seju]{2}nior-level_|/contract/[seju]{2}nior|/[seju]{2}nior|[seju]{2}nior[-_]mid_|/*[seju]{2}nior[-_]*level_?|/*mid[-_]*level_?|mid[ -_to]{4}[seju]{2}nior[ -_]level[ -_]|mid/sr_level_|[-_]{0,3}mid_level|[-_]{0,3}mid|_level_[0-9]+"


@R.add(_TITLES + f" select p_partkey, regexp_replace(regexp_replace(lower(t), '[ ()]', '_', 'g'), '{_TITLE_SQL}', '', 'g') as title from t")
def normal_titles(spark, d):
    return _ranked_titles(spark, d).select("p_partkey", T.normal_title(F.col("t")).alias("title"))


@R.add(_TITLES + " select p_partkey, array_to_string(list_filter([regexp_replace(ltrim(lower(t || '. ~ (x)')), '[^\\pL\\pN_\\s]', '', 'g')], lambda x: x <> ''), '|') as titles from t")
def title_lists(spark, d):
    return _ranked_titles(spark, d).select("p_partkey", F.array_join(T.title_list(F.concat("t", F.lit(". ~ (x)"))), "|").alias("titles"))


@R.add("select p_partkey, array_to_string([lower(p_brand), lower(p_type)], '|') as parsed, array_to_string(list_filter([trim(x) for x in string_split(replace(p_name || ' (' || p_brand || ')', ')', ''), '(')], lambda x: x <> ''), '|') as parts, array_to_string(list_sort(list_distinct(string_split(p_name || ' ' || p_name, ' '))), '|') as words from part")
def list_forms(spark, d):
    p = table(spark, d, "part")
    written = F.concat(F.lit("['"), "p_brand", F.lit("', '"), "p_type", F.lit("']"))
    with_brand = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return p.select("p_partkey", F.array_join(T.parse_list(written), "|").alias("parsed"), F.array_join(T.split_parentheses(with_brand), "|").alias("parts"), F.array_join(T.phrase_words(F.array("p_name", "p_name")), "|").alias("words"))


@R.add("select doc_id, array_to_string(list_sort(list_distinct([w[i] for i in range(1, len(w)) if w[i] <> w[i + 1] and w[i] <> ''])), ',') as kept from (select doc_id, string_split(lower(text), ' ') as w from documents)")
def drop_neighbours(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.drop_neighbours(F.split(F.lower("text"), " ")), ",").alias("kept"))


@R.add("with c as (select c_custkey, lower(c_mktsegment) as job, case when c_custkey % 3 = 0 then '' else lower(c_name) end as cur, case when c_custkey % 4 = 0 then lower(c_mktsegment) || '`other' else 'none`' || lower(c_name) end as des from customer), x as (select *, case when contains(des, job) then job when cur = '' then des else cur end as taken from c) select c_custkey, array_to_string(list_sort(list_distinct(list_concat(string_split(taken, '`'), string_split(des, '`')))), '::') as titles from x")
def reconciled_titles(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.lower("c_mktsegment").alias("job"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.lower("c_name")).alias("cur"), F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lower("c_mktsegment"), F.lit("`other"))).otherwise(F.concat(F.lit("none`"), F.lower("c_name"))).alias("des"))
    return c.select("c_custkey", T.reconcile_titles(F.col("job"), F.col("cur"), F.col("des")).alias("titles"))


@R.add()
def posting_words(spark, d):
    return table(spark, d, "documents").select("doc_id", T.posting_words(F.col("text")).alias("words"))


@R.add("select doc_id, md5(lower(replace(replace(regexp_replace(text, '<br\\s*/>', concat(chr(13), chr(10)), 'g'), 'e.g.', 'for example'), 'E.g.', 'For example'))) as digest from documents")
def recipe_v1(spark, d):
    r = Recipes()
    r.register("breaks", 1)(lambda c: T.rule(c, "break_to_crlf"))
    r.register("examples", 1)(lambda c: F.replace(F.replace(c, F.lit("e.g."), F.lit("for example")), F.lit("E.g."), F.lit("For example")))
    r.register("case", 1)(F.lower)
    return table(spark, d, "documents").select("doc_id", F.md5(r.run(F.col("text"), ("breaks", 1), ("examples", 1), ("case", 1)).cast("binary")).alias("digest"))


@R.add("select p_partkey, array_to_string(list_transform(list_filter(string_split(p_name, ' '), lambda x: trim(x) <> ''), lambda x: lower(trim(x))), '|') as items from part")
def split_lists(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(T.split_list(F.col("p_name"), " "), "|").alias("items"))


@R.add("select n_nationkey, lower(n_name) as low, upper(n_name) as up, reverse(n_name) as back, repeat(n_name, 2) as twice, concat('x_', n_name) as pre, length(n_name) as n, (length(n_name) * length(n_name))::double as n2 from nation")
def demo_stages(spark, d):
    p = Pipeline([("low", lambda x: x.withColumn("low", F.lower("n_name"))), ("more", Pipeline([("up", lambda x: x.withColumn("up", F.upper("n_name"))), ("back", lambda x: x.withColumn("back", F.reverse("n_name")))]))])
    out = p(table(spark, d, "nation").select("n_nationkey", "n_name"))
    return out.select("n_nationkey", "low", "up", "back", F.repeat("n_name", F.lit(2)).alias("twice"), F.concat(F.lit("x_"), "n_name").alias("pre"), F.length("n_name").cast("long").alias("n"), F.pow(F.length("n_name"), F.lit(2)).alias("n2"))


@R.add("select w as word, count(*) as n from (select unnest(list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '')) as w from documents) group by 1 order by 2 desc, 1 limit 100")
def tokens_top(spark, d):
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " "), lambda x: x != "")
    return table(spark, d, "documents").select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(100)


@R.add("""select c_custkey, case when contains(lower(c_name), lower(c_mktsegment)) then c_name when trim(c_mktsegment) = '' then c_name else concat(c_name, '. ', c_mktsegment) end as coupled from customer""")
def title_reconciliation(spark, d):
    n, m = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", F.when(F.contains(F.lower(n), F.lower(m)) | (F.trim(m) == ""), n).otherwise(F.concat_ws(". ", n, m)).alias("coupled"))


@R.add("""select p_partkey, p_name || ' quickly sell experienced seller' as lemmas from part""")
def kept_lemmas(spark, d):
    """Lemmas of the content words of a sentence about each part."""
    from ..functions.lemmas import kept_lemmas as kept

    words = F.split(F.concat(F.lit("the "), "p_name", F.lit("s are quickly sold by experienced sellers")), " ")
    return table(spark, d, "part").select("p_partkey", F.array_join(kept(words), " ").alias("lemmas"))
