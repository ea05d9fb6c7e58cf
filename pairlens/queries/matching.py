"""Lookup and matching models over jobs and persons made from the driver's tables."""

from pyspark.sql import functions as F

from ..functions import nested
from ..functions import text as T
from ..models import overlap, skills
from ..models.tfidf import PairCosines
from ..operators import lookup
from ..operators import relational as rel
from ..sources import table
from .base import Registry
from .scores import _place_sql

R = Registry()
QUERIES, SQL = R.queries, R.sql


def _words(spark, d):
    """(w): the different words of all part names."""
    return table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")).distinct()


_W = "ws as (select distinct unnest(string_split(lower(p_name), ' ')) as w from part)"


def _crosswalk(spark, d):
    """(name, exact, others): words, a given match for those of odd length that begin before k, others separated by `;`."""
    w = F.col("w")
    exact = F.when((F.length(w) % 2 == 1) & (w < "k"), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 99))).otherwise("")
    return _words(spark, d).select(w.alias("name"), exact.alias("exact"), F.concat_ws(";", F.concat(w, F.lit("ing")), F.upper(w), F.reverse(w)).alias("others"))


_CROSS = _W + """, cw as (select w as name, case when length(w) % 2 = 1 and w < 'k' then upper(w[1]) || w[2:] else '' end as exact, [w || 'ing', upper(w), reverse(w)] as o from ws),
cx as (select name, coalesce(nullif(exact, ''), list_filter(o, lambda x: lower(x) = lower(name) and x <> name)[1], '') as e, o from cw),
cross_walk as (select name, list_filter(o, lambda x: x <> e) as others, coalesce(nullif(e, ''), name) as skill from cx)"""


@R.add("with " + _CROSS + " select name, array_to_string(others, ';') as others, skill from cross_walk")
def crosswalk(spark, d):
    return lookup.crosswalk(_crosswalk(spark, d), "name", "exact", "others").select("name", F.array_join("others", ";").alias("others"), "skill")


def _house(spark, d):
    """(skill, aliases): words of five letters or more; `common` is an alias of all, and so of none."""
    return _words(spark, d).where("length(w) >= 5").select(F.col("w").alias("skill"), F.concat(F.substring("w", 1, 4), F.lit(";common;"), F.col("w"), F.lit(" work")).alias("aliases"))


_DICT = _CROSS + """, house as (select w as skill, [w, w[1:4], 'common', w || ' work'] as a from ws where length(w) >= 5), al as (select skill, unnest(a) as alias from house),
ok as (select * from al where not (alias in (select alias from al group by 1 having count(*) > 1) and skill <> alias)), pl as (select skill from cross_walk union select unnest(others) from cross_walk),
bo as (select lower(alias) as phrase, skill as value, 0 as r from ok union all select lower(skill), skill, 1 from pl), dict as (select phrase, arg_min(value, (r, value)) as value from bo where phrase <> '' group by 1)"""


def _dictionary(spark, d):
    return lookup.skill_dictionary(lookup.crosswalk(_crosswalk(spark, d), "name", "exact", "others").select("skill", "others"), _house(spark, d))


@R.add("with " + _DICT + " select phrase, value from dict")
def skill_dictionary(spark, d):
    return _dictionary(spark, d).select("phrase", "value")


@R.add()
def skill_dictionary_stemmed(spark, d):
    from ..functions.clean import stemmed_phrase

    return lookup.skill_dictionary(lookup.crosswalk(_crosswalk(spark, d), "name", "exact", "others").select("skill", "others"), _house(spark, d), stemmed_phrase)


_MATCH = """ph as (select distinct k, array_to_string(list_slice(w, i, i + n - 1), ' ') as p from tw, range(1, 14) a(i), range(1, 14) b(n) where i + n - 1 <= len(w)),
ht as (select distinct k, p, value as v, len(string_split(p, ' ')) as n, length(p) as l from ph join dict on p = phrase),
lt as (select h.*, (select list(distinct u) from (select unnest(string_split(g.p, ' ')) as u from ht g where g.k = h.k and (g.n, g.l, g.p, g.v) > (h.n, h.l, h.p, h.v))) as later from ht h),
found as (select k, list_sort(list(distinct v)) as vals from lt where later is null or len(list_filter(string_split(p, ' '), lambda y: not list_contains(later, y))) > 0 group by 1)"""
_READY = "list_filter(string_split_regex(lower(replace(regexp_replace({0}, '[()]', '', 'g'), '/', ' / ')), '\\s+'), lambda x: x <> '')"


def _titles(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("("), F.initcap("p_name"), F.lit(")/"), "p_type").alias("title"))


_TW = "tw as (select p_partkey as k, " + _READY.format("'(' || p_name || ')/' || p_type") + " as w from part)"


@R.add("with " + _DICT + ", " + _TW + ", " + _MATCH + " select k as p_partkey, array_to_string(vals, '|') as skills from found")
def skills_in_titles(spark, d):
    out = lookup.title_matches(_titles(spark, d), ["p_partkey"], lookup.title_ready(F.col("title")), _dictionary(spark, d))
    return out.select("p_partkey", F.array_join("values", "|").alias("skills"))


@R.add()
def skills_in_titles_stemmed(spark, d):
    from ..functions.clean import stemmed_phrase

    out = lookup.title_matches(_titles(spark, d), ["p_partkey"], lookup.title_ready(F.col("title")), skill_dictionary_stemmed(spark, d), stemmed_phrase)
    return out.select("p_partkey", F.array_join("values", "|").alias("skills"))


def _people(spark, d):
    """(id, job_title, desired_title, current_title, previous_title) of customers: names of parts as titles, some blank."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    n = p.count()
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), *((F.col("c_custkey") * m % n + 1).alias(f"t{i}") for i, m in enumerate((7, 11, 13, 17))))
    for i, name in enumerate(("job_title", "desired_title", "current_title", "previous")):
        c = c.join(p.select(F.col("p_partkey").alias(f"t{i}"), F.col("p_name").alias(name)), f"t{i}", "left")
    blank = lambda c, k: F.when(F.col("id") % k == 0, "").otherwise(F.coalesce(c, F.lit("")))
    return c.select("id", blank("job_title", 9).alias("job_title"), blank("desired_title", 4).alias("desired_title"), F.coalesce("current_title", F.lit("")).alias("current_title"), F.concat_ws(":: ", "previous", blank("current_title", 3)).alias("previous_title"))


_PEOPLE = """np as (select count(*) as n from part), pj as (select c_custkey as id, coalesce(a.p_name, '') as a, coalesce(b.p_name, '') as b, coalesce(x.p_name, '') as c, y.p_name as e from customer cross join np left join part a on a.p_partkey = c_custkey * 7 % n + 1 left join part b on b.p_partkey = c_custkey * 11 % n + 1 left join part x on x.p_partkey = c_custkey * 13 % n + 1 left join part y on y.p_partkey = c_custkey * 17 % n + 1),
people as (select id, case when id % 9 = 0 then '' else a end as job_title, case when id % 4 = 0 then '' else b end as desired_title, c as current_title, concat_ws(':: ', e, case when id % 3 = 0 then '' else c end) as previous_title from pj)"""
_TDICT = "dict as (select lower(p_type) as phrase, p_type as value from (select distinct p_type from part) union select lower(w), w from (select distinct string_split(p_name, ' ')[1] as w from part) union select lower(w), w from (select distinct p_name as w from part where p_partkey % 3 = 0))"


def _title_dictionary(spark, d):
    p = table(spark, d, "part")
    names = p.select(F.col("p_type").alias("t")).union(p.select(F.get(F.split("p_name", " "), F.lit(0)))).union(p.where("p_partkey % 3 = 0").select("p_name")).distinct()
    return lookup.title_dictionary(names, "t")


def _mapped_sql(column: str, tag: str) -> str:
    """Longest matches of one title column as m_<tag>(k, vals)."""
    body = _MATCH.replace("ph as", f"ph_{tag} as").replace("from tw", f"from tw_{tag}").replace("ht as", f"ht_{tag} as").replace("from ph", f"from ph_{tag}").replace("from ht", f"from ht_{tag}").replace("lt as", f"lt_{tag} as").replace("from lt", f"from lt_{tag}").replace("found as", f"m_{tag} as")
    return f"tw_{tag} as (select id as k, {_READY.format(column)} as w from people where {column} <> ''), {body}"


_PREVIOUS = "pv as (select id, pos, trim(t) as t from (select id, unnest(string_split(previous_title, ':: ')) as t, generate_subscripts(string_split(previous_title, ':: '), 1) as pos from people))"
_PREV_MATCH = _MATCH.replace("ph as", "ph_p as").replace("from tw", "from tw_p").replace("ht as", "ht_p as").replace("from ph", "from ph_p").replace("from ht", "from ht_p").replace("lt as", "lt_p as").replace("from lt", "from lt_p").replace("found as", "m_p as")
_MAPPING = f"{_PEOPLE}, {_TDICT}, {_mapped_sql('job_title', 'j')}, {_mapped_sql('desired_title', 'd')}, {_PREVIOUS}, tw_p as (select id * 100 + pos as k, {_READY.format('t')} as w from pv where t <> ''), {_PREV_MATCH}, m_q as (select k // 100 as k, list_filter(flatten(list(vals order by k)), lambda x: x <> '' and x <> 'Other') as vals from m_p group by 1)"


@R.add(f"with {_MAPPING} select p.id, coalesce(array_to_string(j.vals, '|'), '') as job, coalesce(array_to_string(e.vals, '|'), '') as desired, coalesce(array_to_string(q.vals, '|'), '') as previous from people p left join m_j j on j.k = p.id left join m_d e on e.k = p.id left join m_q q on q.k = p.id")
def title_mapping(spark, d):
    out = overlap.TitleMapping(_title_dictionary(spark, d)).transform(_people(spark, d), "id")
    return out.select("id", *(F.array_join(f"{c}_match", "|").alias(n) for c, n in (("job_title", "job"), ("desired_title", "desired"), ("previous_title", "previous"))))


@R.add()
def title_mapping_stemmed(spark, d):
    from ..functions.clean import cleaned_for_stemming, stemmed_phrase

    p = table(spark, d, "part")
    dictionary = lookup.title_dictionary(p.select(F.col("p_type").alias("t")).distinct(), "t", lambda t: stemmed_phrase(cleaned_for_stemming(t)))
    out = overlap.TitleMapping(dictionary, stemmed_phrase, cleaned_for_stemming).transform(_people(spark, d), "id")
    return out.select("id", *(F.array_join(f"{c}_match", "|").alias(n) for c, n in (("job_title", "job"), ("desired_title", "desired"), ("previous_title", "previous"))))


_OVERLAP_SQL = """li as (select id, i, sqrt(count(*)) as v from (select id, unnest(l) as i from sides) group by 1, 2), ri as (select id, i, sqrt(count(*)) as v from (select id, unnest(r) as i from sides) group by 1, 2),
jo as (select li.id, li.v / avg(li.v) over (partition by li.id) as lv, ri.v / avg(ri.v) over (partition by li.id) as rv, ri.v as rr from li left join ri on li.id = ri.id and li.i = ri.i),
sc as (select id, case when count(rr) = 0 then 0.0 else 1 - avg(greatest(0.0, lv - coalesce(rv, 0))) end as score, count(*) as n_elem from jo group by id)
select sides.id, round(coalesce(score, 0.0), 6) as score, coalesce(n_elem, 0) as n_elem from sides left join sc on sides.id = sc.id"""


def _documents(spark, d):
    """(id, job, person, job_title): skills as words of two parts in documents of the two kinds, and a title."""
    p = table(spark, d, "part").select("p_partkey", "p_name", F.split(F.lower("p_name"), " ").alias("w"))
    n = p.count()
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7 % n + 1).alias("a"), (F.col("c_custkey") * 11 % n + 1).alias("b"), (F.col("c_custkey") * 13 % n + 1).alias("e"))
    c = c.join(p.select(F.col("p_partkey").alias("a"), F.col("w").alias("wa"), F.col("p_name").alias("job_title")), "a").join(p.select(F.col("p_partkey").alias("b"), F.col("w").alias("wb")), "b").join(p.select(F.col("p_partkey").alias("e"), F.col("w").alias("we")), "e")
    doc = lambda x: F.to_json(F.struct(F.struct(x.alias("canonskill")).alias("skills")))
    return c.select("id", doc(F.concat("wa", "wb")).alias("job"), doc(F.concat("wb", "we")).alias("person"), "job_title")


_DOCS = "np as (select count(*) as n from part), docs as (select c_custkey as id, list_concat(string_split(lower(a.p_name), ' '), string_split(lower(b.p_name), ' ')) as j, list_concat(string_split(lower(b.p_name), ' '), string_split(lower(e.p_name), ' ')) as p, a.p_name as title from customer cross join np join part a on a.p_partkey = c_custkey * 7 % n + 1 join part b on b.p_partkey = c_custkey * 11 % n + 1 join part e on e.p_partkey = c_custkey * 13 % n + 1)"
_TW_DOCS = "tw as (select id as k, list_filter(string_split_regex(lower(title), '\\s+'), lambda x: x <> '') as w from docs)"


def _skills_side(name: str, column: str) -> str:
    """All lists of one side as s_<name>(id, x): own names, clusters, house skills."""
    one = f"(select id, unnest({column}) as s from docs)"
    return f"s_{name} as (select id, coalesce(dict.value, s) as x from {one} t left join dict on lower(s) = phrase union all select id, upper(s[1:3]) from {one} where length(s) % 2 = 0 union all select id, unnest(others) from {one} t join cross_walk on s = name)"


@R.add(f"with {_DICT}, {_DOCS}, {_TW_DOCS}, {_MATCH}, {_skills_side('j', 'j')}, {_skills_side('p', 'p')}, jl as (select id, list(x) as l from (select * from s_j union all select k, unnest(vals) from found) group by 1), pr as (select id, list(x) as r from s_p group by 1), sides as (select docs.id, coalesce(l, []) as l, coalesce(r, []) as r from docs left join jl using (id) left join pr using (id)), {_OVERLAP_SQL}")
def skills_overlap(spark, d):
    words = _words(spark, d)
    taxonomy = words.where("length(w) % 2 = 0").select(F.col("w").alias("skill"), F.upper(F.substring("w", 1, 3)).alias("cluster"))
    model = overlap.SkillsOverlap(taxonomy, lookup.crosswalk(_crosswalk(spark, d), "name", "exact", "others"), _house(spark, d), skills_from_titles=True)
    docs = _documents(spark, d)
    from ..operators.scoring import left_overlap

    return left_overlap(model.lists(docs, "id", title="job_title"), "id", "left", "right").select("id", F.round("score", 6).alias("score"), "n_elem")


@R.add()
def skills_overlap_classes(spark, d):
    """The whole model, to the class."""
    model = overlap.SkillsOverlap(crosswalk=lookup.crosswalk(_crosswalk(spark, d), "name", "exact", "others"), aliases=_house(spark, d))
    return model.transform(_documents(spark, d), "id").select("id", "qtile", "confidence", "class")


def _occupations(spark, d):
    """(person rows, clusters, synonyms) for the titles model."""
    people = _people(spark, d)
    code = lambda k, key: F.to_json(F.struct(F.when(F.col("id") % 5 == 0, "NA").otherwise(F.concat(F.lit("c"), (F.col("id") * k % 25).cast("string"))).alias(key)))
    rows = people.select("*", code(3, "bgt_occ").alias("job"), code(5, "@bgtocc").alias("person"))
    n = table(spark, d, "nation")
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("sub"))
    occupations = n.select(F.col("n_regionkey").alias("name"), F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("title"))
    named = overlap.occupation_titles(occupations.select("name", "code"), r.select(F.col("k").alias("name"), "sub"))
    titled = named.join(occupations.select("code", "title"), "code")
    clusters = lookup.group_synonyms(titled, "code", ["title", "sub"])
    p = table(spark, d, "part")
    synonyms = lookup.group_synonyms(p.select(F.get(F.split("p_name", " "), F.lit(0)).alias("title"), "p_type"), "title", ["p_type"]).select("title", "titles")
    return rows, clusters, synonyms


_OCC_SQL = """occ as (select 'c' || n_nationkey as code, list_sort(list_distinct([n_name, r_name])) as titles from nation join region on n_regionkey = r_regionkey),
syn as (select string_split(p_name, ' ')[1] as title, list_sort(list_distinct(list(p_type))) as titles from part group by 1),
ja as (select id, titles as t from people join occ on code = case when id % 5 = 0 then '' else 'c' || (id * 3 % 25) end), pa as (select id, titles as t from people join occ on code = case when id % 5 = 0 then '' else 'c' || (id * 5 % 25) end),
jb as (select k as id, list(x) as t from (select k, unnest(coalesce(titles, [v])) as x from (select k, unnest(vals) as v from m_j) left join syn on v = title) group by 1),
pm as (select p.id, list_distinct(list_concat(coalesce(q.vals, []), coalesce(e.vals, []))) as vals from pd p left join m_q q on q.k = p.id left join m_d e on e.k = p.id),
pb as (select id, list(x) as t from (select id, unnest(coalesce(titles, [v])) as x from (select id, unnest(vals) as v from pm) left join syn on v = title) group by 1),
sides as (select p.id, list_distinct(list_concat(coalesce(ja.t, []), coalesce(jb.t, []))) as l, list_distinct(list_concat(coalesce(pa.t, []), coalesce(pb.t, []))) as r from people p left join ja using (id) left join jb using (id) left join pa using (id) left join pb using (id))"""
_MAPPING_2 = f"{_PEOPLE}, pd as (select id, job_title, case when desired_title = '' then current_title else desired_title end as desired_title, previous_title from people), {_TDICT}, {_mapped_sql('job_title', 'j')}, {_mapped_sql('desired_title', 'd').replace('from people', 'from pd')}, {_PREVIOUS}, tw_p as (select id * 100 + pos as k, {_READY.format('t')} as w from pv where t <> ''), {_PREV_MATCH}, m_q as (select k // 100 as k, list_filter(flatten(list(vals order by k)), lambda x: x <> '' and x <> 'Other') as vals from m_p group by 1)"


@R.add(f"with {_MAPPING_2}, {_OCC_SQL}, {_OVERLAP_SQL}")
def titles_overlap(spark, d):
    from ..operators.scoring import left_overlap

    rows, clusters, synonyms = _occupations(spark, d)
    model = overlap.TitlesOverlap(clusters, synonyms, overlap.TitleMapping(_title_dictionary(spark, d)), union=True)
    return left_overlap(model.lists(rows, "id"), "id", "left", "right").select("id", F.round("score", 6).alias("score"), "n_elem")


@R.add("select 'c' || n_nationkey as code, array_to_string(list_sort(list_distinct([n_name, r_name])), '|') as titles from nation join region on n_regionkey = r_regionkey")
def occupation_clusters(spark, d):
    return _occupations(spark, d)[1].select("code", F.array_join("titles", "|").alias("titles"))


@R.add("select l_returnflag as g, array_to_string(list_sort(list_filter(list_distinct(flatten(list(string_split(t, ',')))), lambda x: x <> '')), ',') as t from (select l_returnflag, concat(l_linestatus, ',,', l_linenumber) as t from lineitem) group by 1")
def grouped_texts(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.concat_ws(",,", "l_linestatus", F.col("l_linenumber").cast("string")).alias("t"))
    return lookup.joined_distinct(rows, ["g"], "t")


def _sides(spark, d):
    """(id, job, person) lists of words of parts."""
    docs = _documents(spark, d)
    return docs.select("id", nested.find_values(F.col("job"), "canonskill").alias("job"), nested.find_values(F.col("person"), "canonskill").alias("person"))


_CHAINS = _W + ", chains as (select w as skill, [w, w[1:3], w[1:1]] as chain from ws)"
_FINDINGS = f"{_CHAINS}, {_DOCS}, f as (select id, list_sort(list_distinct(list_filter(j, lambda x: list_contains(p, x)))) as found, list_sort(list_distinct(list_filter(j, lambda x: not list_contains(p, x)))) as missing, list_distinct(j) as jd, len(j) as n, p from docs), g as (select *, case when len(missing) > 0 then list_sort(list_distinct(list_filter(p, lambda x: not list_contains(found, x)))) else [] end as others from f)"


def _cluster_chains(spark, d):
    return _words(spark, d).select(F.col("w").alias("skill"), F.array("w", F.substring("w", 1, 3), F.substring("w", 1, 1)).alias("chain"))


@R.add(f"with {_FINDINGS} select id, array_to_string(found, '|') as found, array_to_string(missing, '|') as missing, array_to_string(others, '|') as others, array_to_string([x[1:3] for x in missing], '|') as parents from g")
def skill_findings(spark, d):
    out = skills.skill_findings(_sides(spark, d), "id", "job", "person", _cluster_chains(spark, d))
    join = lambda c: F.array_join(c, "|")
    return out.select("id", join("found").alias("found"), join("missing").alias("missing"), join("others").alias("others"), join(F.transform("missing_chains", lambda c: F.get(c, F.lit(1)))).alias("parents"))


@R.add(f"with {_FINDINGS}, po as (select id, list_distinct(flatten([[x, x[1:3], x[1:1]] for x in others])) as pool, missing, len(found) as nf, n from g), sc as (select id, nf, n, list_sum([case when list_contains(pool, x) then exp(-1) when list_contains(pool, x[1:3]) then exp(-2) when list_contains(pool, x[1:1]) then exp(-3) else 1.0 end for x in missing]) as partial from po) select id, nf::int as one_to_one, round((nf + coalesce(partial, 0)) / n, 6) as final_score from sc")
def generation_model(spark, d):
    out = skills.generation_model(_sides(spark, d), "id", "job", "person", _cluster_chains(spark, d))
    return out.select("id", "one_to_one", F.round("final_score", 6).alias("final_score"))


@R.add(f"with {_DOCS} select id, array_to_string(list_sort(list_distinct(list_concat(j, p, [lower(title)]))), '|') as combined from docs")
def combined_skills(spark, d):
    docs = _documents(spark, d).select("id", "job_title").join(_sides(spark, d), "id")
    return docs.select("id", F.array_join(skills.combined_skills(F.col("job"), F.col("person"), F.array(F.lower("job_title"))), "|").alias("combined"))


@R.add(f"with {_DOCS}, j as (select id, unnest(list_concat(j, case when id % 5 = 0 then [] else ['x'] end)) as l from docs where id % 7 <> 0), p as (select id, unnest(p) as r from docs where id % 6 <> 0) select id, coalesce(l, '') as left, coalesce(r, '') as right, count(*) as n from j full join p using (id) group by 1, 2, 3")
def skill_pairs(spark, d):
    s = _sides(spark, d)
    job = s.where("id % 7 <> 0").select("id", F.when(F.col("id") % 5 == 0, F.col("job")).otherwise(F.concat("job", F.array(F.lit("x")))).alias("l"))
    return lookup.pairs_by_key(job, s.where("id % 6 <> 0"), "id", "l", "person").groupBy("id", "left", "right").agg(F.count(F.lit(1)).alias("n"))


@R.add("with m as (select p_partkey as o, string_split(p_name, ' ')[1] as k, p_type as v from part where p_partkey % 7 = 0), l as (select k, arg_max(v, o) as v from m group by 1), x as (select p_partkey, unnest(string_split(p_name, ' ')) as k from part union all select p_partkey, lower(string_split(p_name, ' ')[1]) from part) select part.p_partkey, coalesce(array_to_string(list_sort(list(distinct l.v) filter (where l.v is not null)), ','), '') as vals from part left join x on x.p_partkey = part.p_partkey left join l on x.k = l.k group by 1")
def expanded_titles(spark, d):
    p = table(spark, d, "part")
    m = p.where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("ordinal"), F.get(F.split("p_name", " "), F.lit(0)).alias("key"), F.col("p_type").alias("value"))
    rows = p.select("p_partkey", F.split("p_name", " ").alias("a"), F.array(F.get(F.split("p_name", " "), F.lit(0))).alias("b"))
    return lookup.expanded(rows, "p_partkey", ["a", "b"], m).select("p_partkey", F.array_join("values", ",").alias("vals"))


@R.add(f"with {_W}, k as (select list(w) as keep from ws where length(w) > 4), s as (select list(w) as stop from ws where w[1:1] < 'd') select p_partkey, array_to_string(list_filter(string_split(lower(p_name), ' '), lambda x: list_contains(keep, x) and not list_contains(stop, x)), ' ') as words from part, k, s")
def keep_minus_stop(spark, d):
    w = _words(spark, d)
    # Word lists are small, one row each.
    lists = w.agg(F.collect_list(F.when(F.length("w") > 4, F.col("w"))).alias("keep"), F.collect_list(F.when(F.substring("w", 1, 1) < "d", F.col("w"))).alias("stop"))
    return table(spark, d, "part").crossJoin(F.broadcast(lists)).select("p_partkey", F.array_join(T.keep_minus_stop(F.split(F.lower("p_name"), " "), F.col("keep"), F.col("stop")), " ").alias("words"))


@R.add(f"""with recursive {_DOCS}, u as (select id, list_distinct(j) as a, list_distinct(p) as b from docs), s as (select id, case when len(a) <= len(b) then a else b end as x, case when len(a) <= len(b) then b else a end as y from u),
r as (select id, x, y, 0::bigint as i, []::bigint[] as used, 0.0::double as t from s union all select id, x, y, i + 1, list_append(used, k), t + case when x[i + 1] = y[k] then 1.0 when x[i + 1][1] = y[k][1] then 0.5 else 0.1 end from r, range(1, 9) g(k) where i < len(x) and k <= len(y) and not list_contains(used, k))
select id, round(max(t) / len(x), 6) as score from r where i = len(x) group by id, len(x)""")
def table_assignment(spark, d):
    """The best of all assignments of a job's skills to a person's."""
    w = _words(spark, d).select(F.col("w").alias("left"))
    weights = w.crossJoin(F.broadcast(w.select(F.col("left").alias("right")))).select("left", "right", F.when(F.col("left") == F.col("right"), 1.0).when(F.substring("left", 1, 1) == F.substring("right", 1, 1), 0.5).otherwise(0.1).alias("weight"))
    return skills.table_assignment(_sides(spark, d), "id", "job", "person", weights).withColumn("score", F.round("score", 6))


def _turn_pairs(spark, d):
    c = table(spark, d, "conversations")
    a = c.where("turn % 2 = 0").select("conv_id", "turn", F.col("text").alias("ask"), F.col("role"))
    b = c.where("turn % 2 = 1").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return a.join(b, ["conv_id", "turn"]).select(F.concat_ws("-", "conv_id", "turn").alias("id"), "ask", "answer", "role")


def _pair_model(spark, d):
    rows = _turn_pairs(spark, d)
    return rows, PairCosines([("ask", "answer"), ("ask", "role")], ["answer", ["ask", "role"]]).fit(rows, "id")


_WORDS_2 = "regexp_extract_all(lower({0}), '[\\pL\\pN_]{{2,}}')"
_PAIR_SQL = f"""with c as (select conv_id || '-' || turn as id, conv_id, turn, text, role from conversations), r as (select a.conv_id || '-' || a.turn as id, a.text as ask, b.text as answer, a.role from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.turn % 2 = 0),
corpus as (select distinct answer as t, 1 as k from r where answer is not null union all select distinct concat_ws('. ', ask, role), 2 from r), cl as (select row_number() over () as d, replace(replace(regexp_replace(t, '[^\\x00-\\x7F]', ' . ', 'g'), '.', ' . '), chr(10), chr(13)) as t from corpus),
n as (select count(*) as n from cl), df as (select w, count(*) as df from (select d, unnest(list_distinct({_WORDS_2.format('t')})) as w from cl) group by 1), idf as (select w, ln((1 + n) / (1.0 + df)) + 1 as idf from df, n where df >= 0.01 * n),
docs as (select id, 'ask' as c, unnest({_WORDS_2.format("coalesce(ask, '')")}) as w from r union all select id, 'answer', unnest({_WORDS_2.format("coalesce(answer, '')")}) from r union all select id, 'role', unnest({_WORDS_2.format("coalesce(role, '')")}) from r),
tf as (select id, c, w, count(*) * any_value(idf) as x from docs join idf using (w) group by 1, 2, 3), z as (select id, c, sqrt(sum(x * x)) as z from tf group by 1, 2), v as (select tf.id, tf.c, w, x / z as x from tf join z on tf.id = z.id and tf.c = z.c),
s0 as (select a.id, sum(a.x * b.x) as s from v a join v b on a.id = b.id and a.w = b.w where a.c = 'ask' and b.c = 'answer' group by 1), s1 as (select a.id, sum(a.x * b.x) as s from v a join v b on a.id = b.id and a.w = b.w where a.c = 'ask' and b.c = 'role' group by 1)
select r.id, round(coalesce(s0.s, 0), 6) as score_0, round(coalesce(s1.s, 0), 6) as score_1 from r left join s0 on s0.id = r.id left join s1 on s1.id = r.id"""


@R.add(_PAIR_SQL)
def pair_cosines(spark, d):
    rows, model = _pair_model(spark, d)
    return model.transform(rows, "id", "cossims").select("id", F.round("score_0", 6).alias("score_0"), F.round("score_1", 6).alias("score_1"))


def _placed(source: str, value: str) -> str:
    return f"(with {_place_sql(source, 'id', value)} select k as id, q from placed)"


@R.add(f"""with scores as materialized ({_PAIR_SQL.replace('round(coalesce(s0.s, 0), 6)', 'coalesce(s0.s, 0)').replace('round(coalesce(s1.s, 0), 6)', 'coalesce(s1.s, 0)')}),
both as materialized (select a.id, 0.5 * a.q + 0.5 * b.q as composite from {_placed('scores', 'score_0')} a join {_placed('scores', 'score_1')} b on a.id = b.id)
select p.id, round(composite, 4) as composite_score, round(q, 4) as qtile, 1.0::double as confidence, 1 + (q >= .1)::int + (q >= .3)::int + (q >= .7)::int + (q >= .9)::int as class from {_placed('"both"', 'composite')} p join "both" b on b.id = p.id""".replace("both as materialized", '"both" as materialized'))
def pair_composite(spark, d):
    """The whole model, to the class."""
    rows, model = _pair_model(spark, d)
    return model.transform(rows, "id").withColumns({c: F.round(c, 4) for c in ("composite_score", "qtile")})


@R.add()
def profile_skills(spark, d):
    p = table(spark, d, "part")
    by = lambda value: p.where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("ordinal"), F.get(F.split("p_name", " "), F.lit(0)).alias("key"), value.alias("value"))
    model = skills.ProfileSkills(by(F.col("p_type")), by(F.lower("p_brand")), by(F.lower("p_name")), size=50, iterations=1)
    sides = _sides(spark, d)
    rows = _people(spark, d).join(sides, "id").select("*", F.array_join("job", ":: ").alias("job_skills"), F.array_join("person", ":: ").alias("profile_skills"), F.col("job").alias("job_parsed"), F.col("person").alias("person_parsed"))
    return model.fit(rows, "id").transform(rows, "id").select("id", "score", "qtile", "class")
