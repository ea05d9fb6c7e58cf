"""Scans and sinks: CSV, JSON lines, XML, word lists, embedding text, SPARQL results, Parquet models, cached tables, reports."""

from __future__ import annotations

from collections.abc import Callable
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def under_roots(path: str, roots: list[str]) -> str:
    """A path without any of the roots, if it lies under one, and without a leading slash."""
    for root in roots:
        if root and root in path:
            path = path.split(root)[-1]
    return path.lstrip("/")


def read_csv(spark: SparkSession, path: str, schema: StructType | str, fallback: str | None = None, roots: list[str] | None = None) -> DataFrame:
    """A CSV with header; the second path is tried where the first has no such file. With roots the path is taken under each, in order."""
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
    tries = [f"{r.rstrip('/')}/{under_roots(path, roots)}" for r in roots] if roots else [path, *([fallback] if fallback else [])]
    return reader.csv(next((p for p in tries[:-1] if _exists(spark, p)), tries[-1]))


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: StructType | str | None = None) -> DataFrame:
    """Elements named row_tag of an .xml file."""
    if not path.endswith(".xml"):
        raise ValueError(f"not an .xml file: {path}")
    reader = spark.read.option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).xml(path)


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """Words separated by commas or line ends; spaces within one become underscores."""
    words = spark.read.text(path).select(F.explode(F.split("value", ",")).alias("word"))
    return words.select(F.replace(F.trim("word"), F.lit(" "), F.lit("_")).alias("word")).where("word <> ''").distinct()


def parse_embedding_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """`word v1 v2 ...` to (word, vector)."""
    parts = F.split(column, " ")
    return lines.select(F.get(parts, F.lit(0)).alias("word"), F.slice(parts, F.lit(2), F.size(parts) - 1).cast("array<double>").alias("vector"))


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV with header that read_csv reads back: quotation marks within a value are doubled."""
    df.write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def save_model(tables: dict[str, DataFrame], path: str, lean: set[str] | None = None) -> None:
    """A fitted model is a set of small tables; lean names those that a saved model needs."""
    for name, df in tables.items():
        if lean is None or name in lean:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def read_sparql_results(spark: SparkSession, path: str, variable: str, language: str | None = None) -> DataFrame:
    """Distinct values of a variable from SPARQL results in JSON, as an endpoint returns them; with a language only values of it or its regions.

    The endpoint itself is asked by its own client: a query is no scan that Spark can split.
    """
    value = "struct<value:string,`xml:lang`:string>"
    docs = spark.read.option("multiLine", True).schema(f"results struct<bindings:array<struct<`{variable}`:{value}>>>").json(path)
    rows = docs.select(F.explode("results.bindings").alias("b")).select(F.col(f"b.{variable}.value").alias(variable), F.col(f"b.{variable}.`xml:lang`").alias("__lang"))
    if language:
        rows = rows.where((F.lower("__lang") == language.lower()) | F.lower("__lang").startswith(f"{language.lower()}-"))
    return rows.where(F.col(variable).isNotNull()).select(variable).distinct()


def cached_table(make: Callable[[], DataFrame], path: str | None, spark: SparkSession) -> DataFrame | None:
    """What make() gives, written under path the first time and read from there later; without a path nothing, as without a memory."""
    if path is None:
        return None
    if not _exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# What a report shows of a model's results, with digits after the point.
REPORT = {"gaussian_accuracy": 3, "one_half_accuracy": 3, "absolute_accuracy": 3, "n_correct": 0, "n_records": 0, "prediction_thresholds": 3, "importances": 2, "disk_mb": 2}


def report_rows(results: DataFrame) -> DataFrame:
    """One row for each model of results(version, name, body), body as JSON: the figures of REPORT and the median time, the newest version first."""
    from ..operators.relational import sort_versions

    def figure(name: str, digits: int):
        one = F.get_json_object("body", f"$.{name}")
        many = F.from_json(one, "array<double>")
        shown = lambda x: F.format_string(f"%.{digits}f", x.cast("double"))
        return F.when(many.isNotNull(), F.array_join(F.transform(many, shown), ", ")).when(one.isNotNull(), shown(one)).otherwise("").alias(name)

    median = F.coalesce(F.format_string("%.0f", F.get_json_object("body", "$.timing.median").cast("double")), F.lit(""))
    timing = F.when(F.get_json_object("body", "$.timing.median").isNull(), "").otherwise(median).alias("timing median ms")
    return sort_versions(results, "version").select("version", "name", *(figure(n, d) for n, d in REPORT.items()), timing)


def write_report(results: DataFrame, path: str) -> None:
    """An HTML page with a table of all models; models are few, and come to the driver."""
    rows = report_rows(results)
    cells = lambda tag, values: "<tr>" + "".join(f"<{tag}>{escape(str(v))}</{tag}>" for v in values) + "</tr>"
    body = "\n".join([cells("th", rows.columns), *(cells("td", r) for r in rows.collect())])
    spark = results.sparkSession
    spark.createDataFrame([(f"<html><h1>Models</h1><table border=\"1\">\n{body}\n</table></html>",)], "value string").coalesce(1).write.mode("overwrite").text(path)
