"""Values of nested documents as Column functions over JSON or XML texts, in Arrow batches.

A text that is null or no document has no values.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import date
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, StringType, StructField, StructType

from .walk import find, overall_days, tree_rows

#: Days from year 1 that a date has in the documents.
EPOCH = date(1, 1, 1).toordinal()


def _loaded(text: str | None) -> object:
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def _over(fn: Callable, kind: DataType) -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fn(_loaded(t)) for t in texts], dtype=object)

    return run


def find_values(text: Column, key: str) -> Column:
    """All values of a key at any depth, depth first, lists opened; what is no text is written as JSON."""
    return _over(lambda d: [_text(v) for v in find(d, key)], ArrayType(StringType()))(text)


def first_value(text: Column, key: str) -> Column:
    """The first value of a key at any depth; '' where there is none, and for NA."""
    first = F.coalesce(F.get(find_values(text, key), F.lit(0)), F.lit(""))
    return F.when(first == "NA", "").otherwise(first)


def joined_values(text: Column, key: str) -> Column:
    """All values of a key joined by a comma and a space, -1 without any."""
    joined = F.array_join(find_values(text, key), ", ")
    return F.when(F.coalesce(joined, F.lit("")) == "", "-1").otherwise(joined)


def key_columns(text: Column, keys: dict[str, str], prefix: str) -> list[Column]:
    """Columns prefix_name with the first value of each key; see first_value. A document is parsed once for all keys."""

    @F.pandas_udf(StructType([StructField(name, StringType()) for name in keys]))
    def run(texts: pd.Series) -> pd.DataFrame:
        docs = [_loaded(t) for t in texts]
        return pd.DataFrame({name: pd.Series([next(map(_text, find(d, key)), None) for d in docs], dtype=object) for name, key in keys.items()})

    found = run(text)
    held = {name: F.coalesce(found[name], F.lit("")) for name in keys}
    return [F.when(v == "NA", "").otherwise(v).alias(f"{prefix}_{name}") for name, v in held.items()]


# Where the two kinds of documents keep a title's parts.
JOB_KEYS = {"bgt_occ": "bgt_occ", "clean_job_title": "clean_job_title", "standard_title": "standard_title", "consolidated_title": "consolidated_title"}
PERSON_KEYS = {"bgt_occ": "@bgtocc", "clean_job_title": "@clean", "standard_title": "@std", "consolidated_title": "@consolidated"}


def overall_experience(text: Column, today: int | None = None) -> Column:
    """Years between the earliest start and the latest end, from -1 (no such record) to 25."""
    now = date.today().toordinal() - EPOCH if today is None else today
    days = _over(lambda d: float(overall_days(d, now)) if isinstance(d, dict) else -1.0, DoubleType())(text)
    return F.greatest(F.lit(-1.0), F.least(F.lit(25.0), F.when(days > -1, days / 365).otherwise(days)))


_NODE = StructType([StructField("depth", IntegerType()), StructField("tag", StringType()), StructField("attributes", StringType()), StructField("text", StringType())])


@F.pandas_udf(ArrayType(_NODE))
def xml_nodes(texts: pd.Series) -> pd.Series:
    """The elements of an XML text, depth first, as (depth, tag, attributes as JSON, text); explode for rows."""

    def rows(text: str | None) -> list[dict] | None:
        try:
            return [dict(zip(("depth", "tag", "attributes", "text"), r)) for r in tree_rows(text)] if text else None
        except ElementTree.ParseError:
            return None

    return pd.Series([rows(t) for t in texts], dtype=object)
