"""What surrounds a run: settings, tools and their limits, calls that are tried again, reports and events."""

from __future__ import annotations

import dataclasses
import json
import random
import time
import typing
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tablesense.plans.routing import Budget

#: Words for true and false in settings.
TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")
#: Answers of a server, besides 500 and above, after which a call is worth another try.
RETRIED = (408, 425, 429)


@dataclass(frozen=True)
class Scoring:
    tolerance: float = 1e-2
    penalty: float = 0.5


@dataclass(frozen=True)
class Voting:
    samples: int = 1
    least: int = 2


@dataclass(frozen=True)
class Retrieval:
    first: int = 30
    final: int = 6
    budget: int = 12_000
    dense: bool = False


@dataclass(frozen=True)
class Settings:
    scoring: Scoring = Scoring()
    voting: Voting = Voting()
    retrieval: Retrieval = Retrieval()


def _as(kind: type, value: object) -> object:
    if dataclasses.is_dataclass(kind):
        return settings(value or {}, kind)
    if kind is bool and not isinstance(value, bool):
        word = str(value).strip().lower()
        if word not in TRUE + FALSE:
            raise ValueError(f"{value!r} is neither true nor false")
        return word in TRUE
    return kind(value)


def settings(values: Mapping, kind: type = Settings):
    """Settings from nested mappings: defaults for what isn't named or is null, text read as the type of its place. A name that is no setting raises
    ValueError."""
    kinds = typing.get_type_hints(kind)
    if odd := sorted(set(values) - set(kinds)):
        raise ValueError(f"no such settings: {', '.join(odd)}")
    return kind(**{k: _as(kinds[k], v) for k, v in values.items() if v is not None})


def read_settings(path: str) -> Settings:
    """From a file of JSON, or of YAML where its library is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        return settings(yaml.safe_load(text) or {})
    return settings(json.loads(text))


class Tools:
    """Callables by name. ``limits`` bounds how often some may be called; a subset counts with the whole."""

    def __init__(self, tools: Mapping[str, Callable], limits: Mapping[str, int] | None = None, budget: Budget | None = None) -> None:
        self.tools = dict(tools)
        self.budget = budget or Budget(dict(limits or {}))

    def subset(self, names: Sequence[str]) -> Tools:
        return Tools({n: self.tools[n] for n in names}, budget=self.budget)

    def call(self, name: str, **arguments: object) -> object:
        if name not in self.tools:
            raise KeyError(f"{name} isn't one of {', '.join(sorted(self.tools))}")
        if name in self.budget.limits:
            self.budget.spend(name)
        return self.tools[name](**arguments)


def worth_retrying(error: Exception) -> bool:
    status = getattr(error, "status", None)
    return isinstance(error, ConnectionError | TimeoutError) or (isinstance(status, int) and (status in RETRIED or status >= 500))


def retried(call: Callable, attempts: int = 4, base: float = 0.5, most: float = 30.0, sleep: Callable[[float], None] = time.sleep, draw: Callable[[], float] = random.random) -> object:
    """The result of ``call``, tried again after errors that may pass, after a random part of a pause that doubles."""
    for n in range(attempts):
        try:
            return call()
        except Exception as error:
            if n + 1 == attempts or not worth_retrying(error):
                raise
            sleep(draw() * min(most, base * 2**n))
    raise ValueError("a call has one attempt at least")


@dataclass(frozen=True)
class Report:
    """What a worker found: a summary, and a table if there is one."""

    summary: str
    columns: tuple[str, ...] = ()
    rows: tuple[tuple, ...] = ()

    def __post_init__(self) -> None:
        if not self.summary.strip():
            raise ValueError("a report has a summary")
        if self.rows and not self.columns:
            raise ValueError("rows have columns")
        if bad := [i for i, r in enumerate(self.rows) if len(r) != len(self.columns)]:
            raise ValueError(f"row {bad[0]} has {len(self.rows[bad[0]])} cells, not {len(self.columns)}")

    def table(self, spark: SparkSession) -> DataFrame | None:
        """Cells as text; None without columns."""
        if not self.columns:
            return None
        schema = ", ".join(f"c{i} string" for i in range(len(self.columns)))
        return spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in self.rows], schema).toDF(*self.columns)


#: What each kind of event is called.
TITLES = {
    "en": {"task": "task", "route": "route", "plan": "plan", "code": "code", "score": "score"},
    "zh": {"task": "任务", "route": "路由", "plan": "计划", "code": "代码", "score": "得分"},
}


@dataclass
class Events:
    """Events of a run, each written as a line of JSON: at (seconds since the start), kind, title, and what it is about."""

    write: Callable[[str], object]
    language: str = "en"
    clock: Callable[[], float] = time.monotonic
    began: float = field(init=False)

    def __post_init__(self) -> None:
        self.began = self.clock()

    def emit(self, kind: str, **about: object) -> None:
        title = TITLES[self.language][kind]
        self.write(json.dumps({"at": round(self.clock() - self.began, 3), "kind": kind, "title": title, **about}, ensure_ascii=False, default=str) + "\n")
