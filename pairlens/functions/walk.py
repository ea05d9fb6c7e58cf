"""Walks over nested documents: every node of JSON texts, and all values of a key at any depth."""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame


def nodes(value: object, path: tuple[str, ...] = ()) -> Iterator[tuple[str, str, str | None]]:
    """(path, kind, value) depth first; places in a list are not part of the path."""
    if isinstance(value, dict):
        yield "/".join(path), "object", None
        for k, v in value.items():
            yield from nodes(v, (*path, k))
    elif isinstance(value, list):
        yield "/".join(path), "list", None
        for v in value:
            yield from nodes(v, path)
    else:
        yield "/".join(path), "value", None if value is None else value if isinstance(value, str) else json.dumps(value)


def find(value: object, key: str) -> list:
    """All values of a key at any depth; lists are opened."""
    out: list = []
    if isinstance(value, dict):
        for k, v in value.items():
            if k == key:
                out += v if isinstance(v, list) else [v]
            out += find(v, key)
    elif isinstance(value, list):
        for v in value:
            out += find(v, key)
    return out


def overall_days(document: dict, today: int) -> int:
    """Latest end less earliest start, in days; what is not a number counts as present, a document without a root as -1."""
    root = find(document, "resume")
    if not root:
        return -1
    ints = lambda k, other: [int(x) if str(x).lstrip("-").isdigit() else other for x in find(root, k)]
    present = next(iter(ints("@present", today)), today)
    return max(ints("@end", present) or [present]) - min(ints("@start", present) or [present])


def tree_rows(text: str) -> Iterator[tuple[int, str, str, str]]:
    """(depth, tag, attributes as JSON, text) of an XML text, depth first."""

    def go(e: ElementTree.Element, depth: int) -> Iterator[tuple[int, str, str, str]]:
        yield depth, e.tag, json.dumps(e.attrib), (e.text or "").strip()
        for child in e:
            yield from go(child, depth + 1)

    yield from go(ElementTree.fromstring(text), 0)


def walk(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, kind, value) of each node of a JSON column; texts that are no JSON give no rows."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, text in zip(pdf[key], pdf[column]):
                try:
                    rows += [(k, *n) for n in nodes(json.loads(text))]
                except (TypeError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=[key, "path", "kind", "value"])

    return df.select(key, column).mapInPandas(run, f"{key} {kind}, path string, kind string, value string")
