"""Relational queries: joins with a policy for what does not match, lookups, sets, order and sampling."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as rel
from ..operators.stats import range_text
from ..sources import table
from .base import Registry

R = Registry()
QUERIES, SQL = R.queries, R.sql


def _parts(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.split(F.lower("p_name"), " ").alias("w"))
    words = p.select(F.explode("w").alias("s")).distinct().where(F.length("s") % 2 == 0)
    return p, words.select("s", F.upper("s").alias("t"))


_PARTS = """with p as (select p_partkey, string_split(lower(p_name), ' ') as w from part), x as (select p_partkey, unnest(w) as s from p),
m as (select distinct s, upper(s) as t from x where length(s) % 2 = 0), j as (select x.p_partkey, x.s, m.t from x left join m on x.s = m.s)
select p_partkey, coalesce(array_to_string(list_sort(list({v}){f}), ','), '') as items from j group by 1"""


def _mapped(policy: str):
    def run(spark, d):
        p, m = _parts(spark, d)
        return rel.map_items(p, "p_partkey", "w", m, "s", "t", policy).select("p_partkey", F.array_join("w", ",").alias("items"))

    return run


for _name, _policy, _v, _f in (("cluster_map_drop", "drop", "t", " filter (where t is not null)"), ("cluster_map_keep", "blank", "coalesce(t, '')", ""), ("cluster_map_fallback", "source", "coalesce(t, s)", "")):
    QUERIES[_name], SQL[_name] = _mapped(_policy), _PARTS.format(v=_v, f=_f)


@R.add("select n.n_name, r.r_name, count(*) as n from nation n join region r on n.n_regionkey = r.r_regionkey join customer c on c.c_nationkey = n.n_nationkey group by 1, 2")
def inner_chain(spark, d):
    n, r, c = (table(spark, d, t) for t in ("nation", "region", "customer"))
    return c.join(F.broadcast(n), n.n_nationkey == c.c_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey).groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n"))


@R.add("select r.r_name, n.n_name from (select * from region where r_regionkey > 0) r full join (select * from nation where n_nationkey % 2 = 0) n on r.r_regionkey = n.n_regionkey")
def outer_dim(spark, d):
    r, n = table(spark, d, "region").where("r_regionkey > 0"), table(spark, d, "nation").where("n_nationkey % 2 = 0")
    return r.join(n, r.r_regionkey == n.n_regionkey, "full").select("r_name", "n_name")


@R.add("select user_id, count(*) filter (where event_type = 'click') as click, count(*) filter (where event_type = 'view') as view, count(*) as n from events group by 1")
def tag_outer(spark, d):
    n = lambda k: F.count(F.when(F.col("event_type") == k, 1))
    return table(spark, d, "events").groupBy("user_id").agg(n("click").alias("click"), n("view").alias("view"), F.count(F.lit(1)).alias("n"))


@R.add("""with r as (select event_type as family, user_id as tag, round(min(value), 1) || ' - ' || round(max(value), 1) as years from events where event_id % 5 = 0 group by 1, 2)
select tag, coalesce(max(years) filter (where family = 'click'), '') as click_range, coalesce(max(years) filter (where family = 'view'), '') as view_range, coalesce(max(years) filter (where family = 'purchase'), '') as purchase_range from r where family in ('click', 'view', 'purchase') group by 1""")
def tag_ranges(spark, d):
    """The range of each family by tag, side by side by chained full outer joins."""
    e = table(spark, d, "events").where("event_id % 5 = 0")
    ranges = e.groupBy("event_type", F.col("user_id").alias("tag")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    ranges = ranges.select("event_type", "tag", range_text(F.round("lo", 1), F.round("hi", 1)).alias("years"))
    return rel.outer_by_key({k: ranges.where(F.col("event_type") == k).select("tag", "years") for k in ("click", "view", "purchase")}, "tag", "years", "range")


@R.add("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 100000)")
def semi_join(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 100000")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@R.add("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 250000)")
def anti_join(spark, d):
    dear = table(spark, d, "orders").where("o_totalprice > 250000")
    return table(spark, d, "customer").join(dear, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@R.add("select c.c_custkey, coalesce(o.n, 0) as n from customer c left join (select o_custkey, count(*) as n from orders group by 1) o on c.c_custkey = o.o_custkey")
def left_back(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return rel.natural_left_join(table(spark, d, "customer").select("c_custkey"), o).fillna(0, ["n"])


@R.add("select a.n_name as a, b.n_name as b, levenshtein(a.n_name, b.n_name)::double as edits, round((greatest(length(a.n_name), length(b.n_name)) - levenshtein(a.n_name, b.n_name)) / greatest(length(a.n_name), length(b.n_name))::double, 6) as factor from nation a join nation b on a.n_nationkey < b.n_nationkey")
def lev_pairs(spark, d):
    from ..functions.similarity import levenshtein_factor

    n = table(spark, d, "nation")
    a, b = n.select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("a")), n.select(F.col("n_nationkey").alias("j"), F.col("n_name").alias("b"))
    return a.join(b, F.col("i") < F.col("j")).select("a", "b", F.levenshtein("a", "b").cast("double").alias("edits"), F.round(levenshtein_factor(F.col("a"), F.col("b")), 6).alias("factor"))


@R.add("select r_name, n_name from region, nation")
def cartesian(spark, d):
    return table(spark, d, "region").select("r_name").crossJoin(table(spark, d, "nation").select("n_name"))


_SUBS = """with s as (select n_nationkey, n_name from nation), p as (select a.n_name as a, b.n_name as b from s a join s b on a.n_nationkey < b.n_nationkey),
x as (select a, b, substr(a, i::int, l::int) as t, l, i from p, range(1, 30) r(i), range(1, 30) q(l) where i + l - 1 <= length(a)),
m as (select a, b, arg_max(t, l * 1000 - i) as substr, max(l) as substr_len from x where contains(b, t) group by 1, 2)
"""


@R.add(_SUBS + "select p.a, p.b, coalesce(m.substr, '') as substr, coalesce(m.substr_len, 0) as substr_len from p left join m on p.a = m.a and p.b = m.b")
def common_substrings(spark, d):
    from ..functions.similarity import longest_common_substring

    n = table(spark, d, "nation")
    a, b = n.select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("a")), n.select(F.col("n_nationkey").alias("j"), F.col("n_name").alias("b"))
    out = a.join(b, F.col("i") < F.col("j")).select("a", "b", longest_common_substring(F.col("a"), F.col("b")).alias("substr"))
    return out.withColumn("substr_len", F.length("substr").cast("long"))


@R.add(_SUBS + "select substr, count(*) as substr_freq from m where substr_len >= 2 group by 1 order by 2 desc, 1 limit 10")
def top_substrings(spark, d):
    return common_substrings(spark, d).where("substr_len >= 2").groupBy("substr").agg(F.count(F.lit(1)).alias("substr_freq")).orderBy(F.desc("substr_freq"), "substr").limit(10)


@R.add("""with w as (select p_partkey, string_split(lower(p_name), ' ') as w from part), d as (select distinct unnest(w) as p from w where p_partkey % 3 = 0 union select distinct w[1] || ' ' || w[2] from w where p_partkey % 5 = 0 and len(w) > 1),
x as (select p_partkey, array_to_string(list_slice(w, i, i + k - 1), ' ') as p, i from w, range(1, 12) a(i), range(1, 12) b(k) where i + k - 1 <= len(w)),
h as (select distinct p_partkey, x.p, len(string_split(x.p, ' ')) as n, length(x.p) as l from x join d on x.p = d.p),
k as (select h.*, (select list(distinct u) from (select unnest(string_split(g.p, ' ')) as u from h g where g.p_partkey = h.p_partkey and (g.n, g.l, g.p) > (h.n, h.l, h.p))) as later from h)
select p_partkey, array_to_string(list_sort(list(p)), '|') as phrases from k where later is null or len(list_filter(string_split(p, ' '), lambda y: not list_contains(later, y))) > 0 group by 1""")
def phrase_match(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("t"), F.split(F.lower("p_name"), " ").alias("w"))
    one = p.where("p_partkey % 3 = 0").select(F.explode("w").alias("p"))
    two = p.where("p_partkey % 5 = 0 and size(w) > 1").select(F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("p"))
    dictionary = one.union(two).distinct().withColumn("v", F.col("p"))
    return rel.longest_phrases(p, "p_partkey", "t", dictionary, "p", "v").select("p_partkey", F.array_join("values", "|").alias("phrases"))


@R.add("""with m as (select p_partkey as o, lower(string_split(p_name, ' ')[1]) as k, p_type as v from part where p_partkey % 7 = 0), l as (select k, min(o) as f, arg_max(v, o) as v from m group by 1),
x as (select p_partkey, unnest(list_distinct(string_split(lower(p_name), ' '))) as k from part)
select p_partkey, array_to_string(list(l.v order by l.f), ',') as vals from x join l on x.k = l.k group by 1""")
def map_file_order(spark, d):
    p = table(spark, d, "part")
    m = p.where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("ordinal"), F.get(F.split("p_name", " "), F.lit(0)).alias("key"), F.col("p_type").alias("value"))
    return rel.map_in_file_order(p.select("p_partkey", F.split("p_name", " ").alias("i")), "p_partkey", "i", m).select("p_partkey", F.array_join("values", ",").alias("vals"))


@R.add("select p_brand, min(p_partkey) as p_partkey from part group by 1")
def keep_first(spark, d):
    return rel.keep_first(table(spark, d, "part").select("p_brand", "p_partkey"), ["p_brand"], [F.col("p_partkey")])


@R.add("select o_orderkey, o_custkey, o_orderpriority from orders where (o_custkey, o_orderpriority) in (select o_custkey, o_orderpriority from orders group by 1, 2 having count(*) = 1)")
def drop_repeated(spark, d):
    return rel.drop_repeated(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), ["o_custkey", "o_orderpriority"])


@R.add("select event_type, user_id % 3 as k, (dense_rank() over (order by event_type, user_id % 3) - 1) % 4 as split, count(*) as n from events group by 1, 2")
def group_split(spark, d):
    e = table(spark, d, "events").select("event_type", (F.col("user_id") % 3).alias("k"))
    return rel.split_groups(e, ["event_type", "k"], 4).groupBy("event_type", "k", F.col("split").cast("long").alias("split")).agg(F.count(F.lit(1)).alias("n"))


@R.add("select o_orderpriority, ntile(4) over (order by o_orderpriority) as part from (select distinct o_orderpriority from orders)")
def row_ranges(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority").distinct()
    return o.select("o_orderpriority", F.ntile(4).over(Window.orderBy("o_orderpriority")).cast("long").alias("part"))


@R.add("select n_nationkey as k, n_name as v from nation union all select r_regionkey, r_name from region")
def union_rows(spark, d):
    return rel.union_by_name([table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")), table(spark, d, "region").select(F.col("r_name").alias("v"), F.col("r_regionkey").alias("k"))])


@R.add("select l_orderkey, array_to_string(list(l_returnflag order by l_linenumber, l_returnflag), '|') as modes from lineitem where l_orderkey in (select o_orderkey from orders where o_totalprice > 300000) group by 1")
def grouped_join(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 300000")
    li = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    modes = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda s: s["l_returnflag"])
    return li.groupBy("l_orderkey").agg(F.array_join(modes, "|").alias("modes"))


@R.add("select l_suppkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as rn from lineitem) where rn <= 3")
def top_per_group(spark, d):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, d, "lineitem").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("l_suppkey", "l_orderkey", "l_linenumber")


@R.add("select event_type, arg_max(event_id, value * 1e6 + event_id * 1e-6) as best, max(value) as top from events group by 1")
def argmax_topic(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.max_by("event_id", F.col("value") * 1e6 + F.col("event_id") * 1e-6).alias("best"), F.max("value").alias("top"))


@R.add("select event_id, value from (select *, quantile_cont(round(value, 3), .95) over (partition by event_type) as c from events) where round(value, 3) > c")
def above_percentile(spark, d):
    from ..operators.scoring import top_above_percentile

    return top_above_percentile(table(spark, d, "events"), "event_type", "value").select("event_id", "value")


@R.add("select event_id, (props::json ->> 'k')::bigint as k, to_json({'user': user_id, 'kind': event_type})::varchar as doc from events")
def json_export(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind"))).alias("doc"))


@R.add("select event_id, array_to_string(list_filter(string_split(replace(replace(t.fullkey, '$', ''), '\"', ''), '.'), lambda x: x <> ''), '/') as path, case when t.type = 'OBJECT' then 'object' when t.type = 'ARRAY' then 'list' else 'value' end as kind, case when t.type in ('OBJECT', 'ARRAY') then null else t.atom ->> '$' end as value from events, json_tree(props::json) t")
def json_walk(spark, d):
    from ..functions.walk import walk

    return walk(table(spark, d, "events").select("event_id", "props"), "event_id", "props")


@R.add("select c_custkey, upper(c_name) as c_name, length(c_mktsegment)::int as n, concat(c_name, '/', c_mktsegment) as both, lower(c_mktsegment) as low, upper(c_mktsegment) as up from customer")
def keyed_maps(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    c = rel.keyed_map(c, lambda a, b: F.concat_ws("/", a, b), {("c_name", "c_mktsegment"): "both"})
    c = rel.keyed_map(rel.keyed_map(c, F.length, {"c_mktsegment": "n"}), lambda x: (F.lower(x), F.upper(x)), {"c_mktsegment": ("low", "up")})
    return rel.keyed_map(c, F.upper, ["c_name"]).select("c_custkey", "c_name", "n", "both", "low", "up")


@R.add("select n_nationkey, lower(n_name) as names__low, reverse(n_name) as names__back, n_regionkey * 2 as numbers__twice from nation")
def side_by_side(spark, d):
    return rel.branches(table(spark, d, "nation"), {"names": {"low": F.lower("n_name"), "back": F.reverse("n_name")}, "numbers": {"twice": F.col("n_regionkey") * 2}}, ["n_nationkey"])


@R.add("select lower(n_name) as text__n_name, n_regionkey + 1 as number__n_regionkey, n_nationkey from nation")
def column_branches(spark, d):
    from ..plans import by_columns

    parts = [("text", lambda x: x.withColumn("n_name", F.lower("n_name")), ["n_name"]), ("number", lambda x: x.withColumn("n_regionkey", F.col("n_regionkey") + 1), ["n_regionkey"])]
    return by_columns(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), parts, "passthrough")


@R.add("select n_nationkey, upper(trim(n_name)) as left__name, length(trim(n_name)) as right__name from nation")
def joined_pipelines(spark, d):
    from ..plans import Pipeline, left_join

    trim = ("trim", lambda x: x.withColumn("name", F.trim("name")))
    a = Pipeline([trim, ("up", lambda x: x.withColumn("name", F.upper("name")))])
    b = Pipeline([trim, ("n", lambda x: x.withColumn("name", F.length("name").cast("long")))])
    return left_join(a, b, ["n_nationkey"], on="trim")(table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name")))


@R.add("select n_nationkey, to_json({'low': {'name': lower(n_name)}, 'n': {'name': lower(n_name), 'n': length(n_name)}})::varchar as detail from nation")
def detailed_stages(spark, d):
    from ..plans import Pipeline

    p = Pipeline([("low", lambda x: x.withColumn("name", F.lower("name"))), ("n", lambda x: x.withColumn("n", F.length("name")))])
    return p.detailed(table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name")), ["n_nationkey"])


@R.add("select o_orderkey from orders order by md5('5:' || o_orderkey), o_orderkey limit 44")
def sample_for_pairs(spark, d):
    return rel.sample_for_pairs(table(spark, d, "orders").select("o_orderkey"), 1000, ["o_orderkey"], 5)


@R.add("with v as (select n_nationkey, concat(n_regionkey, '.', n_nationkey % 3, '.', n_nationkey) as v from nation union all select 99, '1.x.2'), s as (select v, string_split(v, '.') as p from v where regexp_full_match(v, '[0-9]+[.][0-9]+[.][0-9]+')) select v as version, row_number() over (order by p[3]::int desc, p[2]::int desc, p[1]::int desc) as place from s")
def sorted_versions(spark, d):
    v = table(spark, d, "nation").select(F.concat_ws(".", "n_regionkey", F.col("n_nationkey") % 3, "n_nationkey").alias("version"))
    v = v.union(spark.createDataFrame([("1.x.2",)], "version string"))
    # Versions are a few dozen.
    gathered = rel.sort_versions(v, "version").coalesce(1).withColumn("place", F.monotonically_increasing_id() + 1)
    return gathered.select("version", "place")


@R.add("select event_id, case when (props::json ->> 'k') is null then '' else props::json ->> 'k' end as first, coalesce(props::json ->> 'k', '-1') as joined from events")
def json_find(spark, d):
    from ..functions import nested

    e = table(spark, d, "events")
    return e.select("event_id", nested.first_value(F.col("props"), "k").alias("first"), nested.joined_values(F.col("props"), "k").alias("joined"))


@R.add("""with o as (select o_custkey, min(o_orderkey % 9000) as s, max(o_orderkey % 9000 + o_orderkey % 400) as e from orders group by 1) select o_custkey, round(greatest(-1, least(25, (e - s) / 365.0)), 6) as years from o""")
def overall_experience(spark, d):
    from ..functions import nested

    spans = F.struct((F.col("o_orderkey") % 9000).cast("string").alias("@start"), (F.col("o_orderkey") % 9000 + F.col("o_orderkey") % 400).cast("string").alias("@end"))
    docs = table(spark, d, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.struct(F.collect_list(spans).alias("experience")).alias("resume"))).alias("doc"))
    return docs.select("o_custkey", F.round(nested.overall_experience(F.col("doc"), 740_000), 6).alias("years"))


@R.add("select n_nationkey, unnest([0, 1, 1])::int as depth, unnest(['nation', 'name', 'region']) as tag, unnest(['{}', '{}', '{\"key\": \"' || n_regionkey || '\"}']) as attributes, unnest(['', n_name, '']) as text from nation")
def xml_rows(spark, d):
    from ..functions import nested

    n = table(spark, d, "nation")
    doc = F.concat(F.lit("<nation><name>"), "n_name", F.lit('</name><region key="'), F.col("n_regionkey").cast("string"), F.lit('"/></nation>'))
    return n.select("n_nationkey", F.explode(nested.xml_nodes(doc)).alias("x")).select("n_nationkey", "x.*")
