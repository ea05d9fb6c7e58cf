"""Stages, pipelines and recipes over DataFrames."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import left_join_of

Stage = Callable[[DataFrame], DataFrame]


class Step(ABC):
    """A stage with a version of its own. What fit learns is kept in attributes whose names end in an underscore.

    fit learns nothing unless overridden, and returns the step; output names what transform adds.
    """

    version = "0.0.0"
    output: tuple[str, ...] | None = None

    def __setattr__(self, name: str, value: object) -> None:
        if name == "version":
            raise AttributeError("a step's version is its class's")
        super().__setattr__(name, value)

    def fit(self, df: DataFrame) -> Step:
        return self

    @abstractmethod
    def transform(self, df: DataFrame) -> DataFrame: ...

    def __call__(self, df: DataFrame) -> DataFrame:
        return project(self.transform(df), self.output) if self.output else self.transform(df)

    def fitted(self) -> list[str]:
        return [v for v in vars(self) if v.endswith("_") and not v.startswith("__")]

    def clear(self) -> None:
        for name in self.fitted():
            delattr(self, name)

    def columns_out(self, df: DataFrame) -> list[str]:
        """The names given, else those of the result."""
        return list(self.output) if self.output else self.transform(df).columns

    def parts(self) -> dict[str, DataFrame]:
        """Frames on the way to the last result, by name, that a capture shows as step__name."""
        return {}


class Echo(Step):
    """Gives what it gets."""

    def transform(self, df: DataFrame) -> DataFrame:
        return df


@dataclass
class Keyed(Step):
    """A step made for each key by make(key), each fitted on that column alone and kept in steps_."""

    make: Callable[[str], Step]
    keys: list[str]

    def fit(self, df: DataFrame) -> Keyed:
        self.steps_ = {k: self.make(k).fit(df.select(k)) for k in self.keys}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for k in self.keys:
            df = self.steps_[k](df)
        return df


def project(df: DataFrame, names: tuple[str, ...] | list[str]) -> DataFrame:
    """df with these columns; the underscores that mark a column of a branch without a name are cut. A missing name is an error."""
    return df.select(*(F.col(n).alias(n.removesuffix("__")) for n in names))


def select(values: DataFrame | dict, names: list[str]) -> DataFrame | dict | object:
    """Columns of a frame, or entries of a dict; of a dict with one name left, its value."""
    if isinstance(values, dict):
        kept = {n: values[n] for n in names if n in values}
        return next(iter(kept.values())) if len(kept) == 1 else kept
    return values.select(*names)


def keyed_dict(values: dict, fn: Callable, keys: list[str]) -> dict:
    """A dict with fn applied to the entries of keys that it has."""
    return values | {k: fn(values[k]) for k in keys if k in values}


def by_columns(df: DataFrame, branches: list[tuple[str, Stage, list[str]]], remainder: str = "drop") -> DataFrame:
    """Each branch's stage on its columns, results named branch__column side by side; the other columns follow if remainder is `passthrough`.

    Stages add or change columns row by row, so that all is one projection of one scan.
    """
    used, out, made = set(), df, []
    for name, stage, columns in branches:
        used |= set(columns)
        held = {c: f"__{name}__{c}" for c in columns}
        inner = stage(out.select(*out.columns, *(F.col(c).alias(h) for c, h in held.items())).select(*(F.col(c).alias(f"__keep__{c}") for c in out.columns), *(F.col(h).alias(c) for c, h in held.items())))
        new = [c for c in inner.columns if not c.startswith("__keep__")]
        out = inner.select(*(F.col(f"__keep__{c}").alias(c) for c in out.columns), *(F.col(c).alias(f"{name}__{c}") for c in new))
        made += [f"{name}__{c}" for c in new]
    rest = [c for c in df.columns if c not in used] if remainder == "passthrough" else []
    return out.select(*made, *rest)


def left_join(left: Pipeline, right: Pipeline, key: list[str], on: str | None = None, left_on: str | None = None, right_on: str | None = None, names: tuple[str, str] = ("left", "right")) -> Pipeline:
    """A pipeline that runs left's stages up to a step once, then the rest of both, side by side as name__column.

    Raises ValueError where a step is not named, or not in its pipeline.
    """
    left_on, right_on = left_on or on, right_on or on
    if left_on is None or right_on is None:
        raise ValueError("name the step in both pipelines")
    cut = []
    for pipe, step, side in ((left, left_on, "left"), (right, right_on, "right")):
        at = next((i for i, (n, _) in enumerate(pipe.stages) if n == step), None)
        if at is None:
            raise ValueError(f"no step {step} in the {side} pipeline")
        cut.append(at + 1)
    a, b = Pipeline(left.stages[cut[0] :]), Pipeline(right.stages[cut[1] :])
    return Pipeline([("pre", Pipeline(left.stages[: cut[0]])), ("branch", lambda df: left_join_of(a(df), b(df), key, *names))])


@dataclass
class Pipeline:
    """Named stages in order; a stage may be a Pipeline."""

    stages: list[tuple[str, Stage]] = field(default_factory=list)

    def __call__(self, df: DataFrame) -> DataFrame:
        for _, stage in self.stages:
            df = stage(df)
        return df

    def captured(self, df: DataFrame, prefix: str = "", keys: set[str] | None = None) -> dict[str, DataFrame]:
        """The frame after each stage, nested names joined by __; with keys only those, and nothing after the last is planned."""
        out: dict[str, DataFrame] = {}
        for name, stage in self.stages:
            full = f"{prefix}{name}"
            if isinstance(stage, Pipeline):
                out |= stage.captured(df, f"{full}__")
            df = stage(df)
            if isinstance(stage, Step):
                out |= {f"{full}__{k}": v for k, v in stage.parts().items()}
            out[full] = df
            if keys is not None and keys <= out.keys():
                break
        return {k: v for k, v in out.items() if keys is None or k in keys}

    def fit(self, df: DataFrame) -> Pipeline:
        """Fits steps in order, each on what those before make of df."""
        for _, stage in self.stages:
            if isinstance(stage, Step | Pipeline):
                stage.fit(df)
            df = stage(df)
        return self

    def detailed(self, df: DataFrame, key: list[str]) -> DataFrame:
        """(key, detail): a row's values after each stage as one JSON document, for stages that keep the key."""
        out = df.select(*key)
        for name, frame in self.captured(df).items():
            rows = frame.select(*key, F.struct(*(c for c in frame.columns if c not in key)).alias(f"__{name}")) if set(frame.columns) - set(key) else None
            out = out.join(rows, key, "left") if rows is not None else out
        steps = [c for c in out.columns if c.startswith("__")]
        return out.select(*key, F.to_json(F.struct(*(F.col(c).alias(c.removeprefix("__")) for c in steps))).alias("detail"))

    def bypassing(self, names: set[str], prefix: str = "") -> Pipeline:
        """The same without some stages."""
        kept = []
        for name, stage in self.stages:
            full = f"{prefix}{name}"
            if full not in names:
                kept.append((name, stage.bypassing(names, f"{full}__") if isinstance(stage, Pipeline) else stage))
        return Pipeline(kept)

    def find(self, kind: type) -> list[Stage]:
        """Stages of a type, at any depth, each once."""
        out: list[Stage] = []
        for _, stage in self.stages:
            for s in ([stage] if isinstance(stage, kind) else []) + (stage.find(kind) if isinstance(stage, Pipeline) else []):
                if not any(s is x for x in out):
                    out.append(s)
        return out


class Recipes:
    """Text steps by purpose and version."""

    def __init__(self) -> None:
        self.steps: dict[tuple[str, int], Callable[[Column], Column]] = {}

    def register(self, purpose: str, version: int) -> Callable:
        def add(step: Callable[[Column], Column]) -> Callable[[Column], Column]:
            if not callable(step):
                raise TypeError("a step is a function of a Column")
            if (purpose, version) in self.steps:
                raise RuntimeError(f"there is a step for {purpose}, version {version}")
            self.steps[purpose, version] = step
            return step

        return add

    def run(self, text: Column, *steps: tuple[str, int]) -> Column:
        for key in steps:
            text = self.steps[key](text)
        return text
