"""Sources and sinks by writing and reading again, and what steps and pipelines do."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import plans, sources
from ..functions import nested
from ..functions import similarity as S
from ..functions import text as T
from ..operators import relational as rel
from ..plans import Echo, Keyed, Pipeline, Step
from ..sources import table
from .base import Registry

R = Registry()
QUERIES, SQL = R.queries, R.sql


def _folder(spark) -> str:
    return f"{rel.shared_folder(spark)}/{uuid4().hex}"


@R.add("select c_custkey, c_name || ', \"' || c_mktsegment || '\"' as label, round(c_acctbal, 2) as balance from customer")
def csv_again(spark, d):
    """Customers to CSV, with quotation marks and commas, and back by the second of two paths."""
    path = _folder(spark)
    c = table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("label"), F.col("c_acctbal").cast("double").alias("balance"))
    sources.write_csv(c, f"{path}/customer.csv")
    read = sources.read_csv(spark, f"{path}/none.csv", c.schema, f"{path}/customer.csv")
    return read.withColumn("balance", F.round("balance", 2))


@R.add("select n_nationkey, n_name from nation")
def csv_under_roots(spark, d):
    """A file that lies under the second of two roots."""
    path = _folder(spark)
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    sources.write_csv(n, f"{path}/two/data/nation.csv")
    return sources.read_csv(spark, f"{path}/one/data/nation.csv", n.schema, roots=[f"{path}/one", f"{path}/two"])


@R.add("select event_id, event_type, round(value, 6) as value from events")
def json_lines_again(spark, d):
    path = _folder(spark)
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    e.write.json(path)
    return sources.read_json_lines(spark, path, e.schema).withColumn("value", F.round("value", 6))


@R.add("select p_partkey as id, p_name || ' & <' || p_brand || '>' as name from part")
def xml_again(spark, d):
    """Parts as elements of XML files, read by their tag."""
    path = f"{_folder(spark)}/parts.xml"
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" & <"), "p_brand", F.lit(">")).alias("name"))
    rows.write.option("rootTag", "parts").option("rowTag", "part").xml(path)
    return sources.read_xml(spark, path, "part", "id long, name string")


@R.add("select distinct replace(trim(w), ' ', '_') as word from (select unnest([p_name, ' ' || p_type || ' ', '']) as w from part) where trim(w) <> ''")
def word_list_again(spark, d):
    path = _folder(spark)
    table(spark, d, "part").select(F.concat_ws(",", "p_name", F.concat(F.lit(" "), "p_type", F.lit(" ")), F.lit(""))).write.text(path)
    return sources.read_word_list(spark, path)


@R.add("select 'w' || vec_id as word, len(embedding) as size, round(list_sum(embedding::double[]), 4) as total from embeddings")
def embedding_lines_again(spark, d):
    path = _folder(spark)
    e = table(spark, d, "embeddings")
    e.select(F.concat_ws(" ", F.concat(F.lit("w"), F.col("vec_id").cast("string")), F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), " "))).write.text(path)
    v = sources.parse_embedding_lines(spark.read.text(path))
    return v.select("word", F.size("vector").cast("long").alias("size"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@R.add("select event_type, count(*) as n from events group by 1")
def model_again(spark, d):
    """A model of two tables saved lean, and the one that is kept loaded again."""
    path, e = _folder(spark), table(spark, d, "events")
    sources.save_model({"counts": e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "rows": e}, path, lean={"counts"})
    return sources.load_model(spark, path, ["counts"])["counts"]


@R.add("select user_id, count(*) as n from events group by 1")
def memoised(spark, d):
    """Made the first time, read the second: the second maker would fail."""

    def never() -> DataFrame:
        raise AssertionError("made twice")

    path = _folder(spark)
    sources.cached_table(lambda: table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), path, spark)
    return sources.cached_table(never, path, spark)


@R.add("select distinct n_name as name from nation where n_nationkey % 2 = 0")
def sparql_again(spark, d):
    """Names in one language of an endpoint's answer."""
    path = _folder(spark)
    n = table(spark, d, "nation")
    value = F.struct(F.col("n_name").alias("value"), F.when(F.col("n_nationkey") % 2 == 0, F.when(F.col("n_nationkey") % 4 == 0, "en").otherwise("en-GB")).otherwise("de").alias("xml:lang"))
    # One answer holds all bindings, as an endpoint's does: 25 nations.
    n.agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct(value.alias("name"))).alias("bindings")).alias("results")))).write.text(path)
    return sources.read_sparql_results(spark, path, "name", "en")


_RESULTS = "with r as (select n_regionkey || '.' || n_nationkey || '.1' as version, n_name as name, n_nationkey as k from nation where n_nationkey <> 3)"


def _results(spark, d):
    n = table(spark, d, "nation")
    body = F.concat(F.lit('{"gaussian_accuracy": '), (F.col("n_nationkey") / 10.0).cast("string"), F.lit(', "n_correct": '), F.col("n_nationkey").cast("string"), F.lit(', "importances": [0.25, 0.75], "timing": {"median": 12.0}}'))
    version = F.when(F.col("n_nationkey") == 3, "none").otherwise(F.concat_ws(".", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string"), F.lit("1")))
    return n.select(version.alias("version"), F.col("n_name").alias("name"), body.alias("body"))


@R.add(_RESULTS + " select version, name, printf('%.3f', k / 10.0) as accuracy, printf('%.0f', k::double) as correct, '0.25, 0.75' as importances, '12' as median from r")
def report_figures(spark, d):
    """What a report shows of each model; what has no version of three numbers is left out."""
    return sources.report_rows(_results(spark, d)).select("version", "name", F.col("gaussian_accuracy").alias("accuracy"), F.col("n_correct").alias("correct"), "importances", F.col("timing median ms").alias("median"))


@R.add(_RESULTS + " select '<tr><td>' || version || '</td><td>' || name || '</td><td>' || printf('%.3f', k / 10.0) || '</td>' as line from r")
def report_page(spark, d):
    """The same as a page, written and read again."""
    path = _folder(spark)
    sources.write_report(_results(spark, d), path)
    return spark.read.text(path).where(F.startswith("value", F.lit("<tr><td>"))).select(F.regexp_extract("value", "^(<tr>(?:<td>[^<]*</td>){3})", 1).alias("line"))


class _Twice(Step):
    version = "1.2.0"
    output = ("r_name__", "twice")

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(F.col("r_name").alias("r_name__"), F.repeat("r_name", F.lit(2)).alias("twice"), "r_regionkey")


@R.add("select r_name, repeat(r_name, 2) as twice from region")
def output_projection(spark, d):
    """A step that names what it gives; underscores of a nameless branch are cut."""
    return _Twice()(table(spark, d, "region"))


@R.add("select r_regionkey, 'r_name__,twice' as named, 'r_regionkey,r_name' as echoed, '1.2.0' as version from region")
def feature_names(spark, d):
    """The names a step gives, and without any those of its result."""
    r = table(spark, d, "region").select("r_regionkey", "r_name")
    return r.select("r_regionkey", F.lit(",".join(_Twice().columns_out(r))).alias("named"), F.lit(",".join(Echo().columns_out(r))).alias("echoed"), F.lit(_Twice.version).alias("version"))


@R.add("select n_nationkey, n_name from nation")
def select_and_echo(spark, d):
    """Columns by name after a step that changes nothing."""
    return plans.select(Pipeline([("echo", Echo())])(table(spark, d, "nation")), ["n_nationkey", "n_name"])


@R.add("select n_nationkey as k, upper(n_name) as n from nation")
def dict_keys(spark, d):
    """A function on the entries of a dict that it has."""
    values = plans.keyed_dict({"k": F.col("n_nationkey"), "n": F.col("n_name")}, F.upper, ["n", "none"])
    return table(spark, d, "nation").select(*(c.alias(n) for n, c in values.items()))


class _Least(Step):
    """Takes a column's least value from it."""

    def __init__(self, key: str) -> None:
        self.key = key

    def fit(self, df: DataFrame) -> _Least:
        self.least_ = df.agg(F.min(self.key)).first()[0]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.key, F.col(self.key) - F.lit(self.least_))

    def parts(self) -> dict[str, DataFrame]:
        return getattr(self, "seen_", {})


@R.add("select l_orderkey, l_linenumber, round((l_quantity - min(l_quantity) over ())::double, 4) as l_quantity, round((l_extendedprice - min(l_extendedprice) over ())::double, 4) as l_extendedprice from lineitem")
def keyed_fit(spark, d):
    """A step for each of two columns, each fitted on its own."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"), F.col("l_extendedprice").cast("double").alias("l_extendedprice"))
    keyed = Keyed(_Least, ["l_quantity", "l_extendedprice"])
    return Pipeline([("least", keyed)]).fit(rows)(rows).withColumns({c: F.round(c, 4) for c in ("l_quantity", "l_extendedprice")})


@R.add("select c_custkey, round((c_acctbal - (select min(c_acctbal) from customer))::double, 4) as c_acctbal, 'least_' as learned, '' as left from customer")
def step_protocol(spark, d):
    """What a step has learned, and that clear forgets it."""
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    step = _Least("c_acctbal").fit(rows)
    learned, out = step.fitted(), step.transform(rows)
    step.clear()
    return out.select("c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"), F.lit(",".join(learned)).alias("learned"), F.lit(",".join(step.fitted())).alias("left"))


class _Halves(Step):
    """Adds half; its rows of even keys are a result on the way."""

    def transform(self, df: DataFrame) -> DataFrame:
        self.even_ = df.where("c_custkey % 2 = 0")
        return df.withColumn("half", F.col("c_custkey") / 2)

    def parts(self) -> dict[str, DataFrame]:
        return {"even": self.even_}


def _nested(spark) -> Pipeline:
    upper = lambda df: df.withColumn("c_name", F.upper("c_name"))
    return Pipeline([("outer", Pipeline([("upper", upper), ("halves", _Halves())])), ("echo", Echo())])


@R.add("select c_custkey, upper(c_name) as c_name from customer")
def captured_stage(spark, d):
    """The frame after a nested step."""
    return _nested(spark).captured(table(spark, d, "customer").select("c_custkey", "c_name"), keys={"outer__upper"})["outer__upper"]


@R.add("select c_custkey, upper(c_name) as c_name from customer where c_custkey % 2 = 0")
def captured_part(spark, d):
    """A result on the way that a nested step shows by a name of its own."""
    return _nested(spark).captured(table(spark, d, "customer").select("c_custkey", "c_name"))["outer__halves__even"]


@R.add("select c_custkey, c_name, c_custkey / 2 as half, 2 as steps from customer")
def bypassed_stage(spark, d):
    """The pipeline without a nested step, and how many steps it finds in itself."""
    pipe = _nested(spark)
    out = pipe.bypassing({"outer__upper"})(table(spark, d, "customer").select("c_custkey", "c_name"))
    return out.withColumn("steps", F.lit(len(pipe.find(Step))))


@R.add("select c_custkey, case when c_custkey % 3 = 0 then c_mktsegment else c_name end as title from customer")
def desired_default(spark, d):
    desired = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", T.desired_or_current(desired, F.col("c_mktsegment")).alias("title"))


@R.add("select event_id, case when event_id % 4 = 0 then '-1' when event_id % 4 = 1 then (props::json ->> 'k') else (props::json ->> 'k') || ', x' end as found from events")
def joined_values(spark, d):
    """All values of a key at any depth as one text, -1 without any."""
    k = F.get_json_object("props", "$.k")
    doc = F.when(F.col("event_id") % 4 == 0, "{}").when(F.col("event_id") % 4 == 1, F.col("props")).otherwise(F.concat(F.lit('{"k": "'), k, F.lit('", "more": [{"k": "x"}]}')))
    return table(spark, d, "events").select("event_id", nested.joined_values(doc, "k").alias("found"))


@R.add("select p_partkey, lower(p_name) || '|' || lower(p_brand) as low, '' as none from part")
def lower_lists(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(T.lower_list(F.array("p_name", "p_brand")), "|").alias("low"), F.array_join(T.lower_list(F.lit(None).cast("array<string>")), "|").alias("none"))


@R.add("""with s as (select n_nationkey, n_name from nation), p as (select a.n_name as a, b.n_name as b from s a join s b on a.n_nationkey < b.n_nationkey),
x as (select a, b, l from p, range(1, 30) r(i), range(1, 30) q(l) where i + l - 1 <= length(a) and contains(b, substr(a, i::int, l::int))), m as (select a, b, max(l) as l from x group by 1, 2)
select p.a, p.b, round(coalesce(l, 0) / least(length(p.a), length(p.b))::double, 6) as factor from p left join m on p.a = m.a and p.b = m.b""")
def substring_factors(spark, d):
    """The longest common substring's share of the shorter name."""
    n = table(spark, d, "nation")
    a, b = n.select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("a")), n.select(F.col("n_nationkey").alias("j"), F.col("n_name").alias("b"))
    return a.join(b, F.col("i") < F.col("j")).select("a", "b", F.round(S.substring_factor(S.longest_common_substring(F.col("a"), F.col("b")), F.col("a"), F.col("b")), 6).alias("factor"))


@R.add("with c as (select event_type, count(*) / sum(count(*)) over ()::double as x, row_number() over (order by event_type) as i from events group by 1) select event_type, round(case when i = 2 then 0.5 else x * 0.5 / (1 - max(x) filter (where i = 2) over ()) end, 6) as importance from c")
def updated_importances(spark, d):
    """One importance set to a half, the others scaled to the rest; kinds of events are few."""
    c = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy("event_type").collect()
    total = sum(r["n"] for r in c)
    new = S.update_importance([r["n"] / total for r in c], 1, 0.5)
    return spark.createDataFrame([(r["event_type"], round(x, 6)) for r, x in zip(c, new)], "event_type string, importance double")
