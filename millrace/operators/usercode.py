"""Callables of the user inside plans: item pipelines, routes, validators, hooks and named factories.

Callables are named Python objects, never source text. They run in the tasks, on batches of items (JSON texts).
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[[dict], object]


def run_steps(item: dict, steps: list[Step]) -> tuple[dict | None, bool, str | None]:
    """(item, dropped, error): an object or list replaces the item, None drops it, any other value keeps it, an exception ends it."""
    for step in steps:
        try:
            found = step(item)
        except Exception as e:  # noqa: BLE001 - the row carries it
            return None, False, str(e)
        if found is None:
            return None, True, None
        if isinstance(found, (dict, list)):
            item = found
    return item, False, None


def pipeline(df: DataFrame, steps: list[Step], column: str = "item") -> DataFrame:
    """``df`` with ``item`` as the steps left it, ``dropped`` and ``error``; no row goes, so counts can be taken from it."""
    others = [c for c in df.columns if c != column]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [run_steps(json.loads(x), steps) if x is not None else (None, True, None) for x in frame[column]]
            out = frame[others].copy()
            out[column] = [None if item is None else json.dumps(item, separators=(",", ":"), ensure_ascii=False) for item, _, _ in rows]
            out["dropped"], out["error"] = [d for _, d, _ in rows], [e for _, _, e in rows]
            yield out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != column)
    return df.mapInPandas(run, f"{fields + ', ' if fields else ''}`{column}` string, dropped boolean, error string")


def route_items(pages: DataFrame, handlers: dict[str, Callable[[dict], Iterator[dict]]], default: Callable | None = None, route: str = "route") -> DataFrame:
    """Items that the handler of each page's route gives, none or many: (page_id, route, seq, item). Pages without a handler go to ``default``."""
    columns = pages.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page in frame.to_dict("records"):
                handler = handlers.get(page[route], default)
                for seq, item in enumerate(handler({k: page[k] for k in columns}) if handler else ()):
                    rows.append((page["page_id"], page[route], seq, json.dumps(item, separators=(",", ":"), ensure_ascii=False)))
            yield pd.DataFrame(rows, columns=["page_id", "route", "seq", "item"])

    return pages.mapInPandas(run, "page_id bigint, route string, seq int, item string")


def validated(df: DataFrame, check: Callable[[dict], dict], column: str = "item") -> DataFrame:
    """``df`` with ``ok``, ``data`` (what the check returns) and ``error`` (what it raises)."""

    def one(text: str) -> tuple[bool, str | None, str | None]:
        try:
            return True, json.dumps(check(json.loads(text)), separators=(",", ":"), ensure_ascii=False), None
        except Exception as e:  # noqa: BLE001 - the row carries it
            return False, None, str(e)

    @F.pandas_udf("struct<ok:boolean,data:string,error:string>")
    def run(items: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in items], columns=["ok", "data", "error"])

    return df.withColumn("_v", run(F.col(column))).select("*", "_v.*").drop("_v")


class Plugins:
    """Ordered plugins with named hooks, and named factories that make them.

    A hook takes a payload and returns an object to merge into the answer or nothing; ``skip`` in an answer ends the round.
    ``stages`` does the same for DataFrames: each plugin's hook of that name is a ``DataFrame.transform``.
    """

    HOOKS = ("beforeEnqueue", "beforeRequest", "afterFetch", "afterResponse", "afterExtract", "onError", "onFailedRequest", "onJobStart", "onJobComplete")

    def __init__(self):
        self.factories: dict[str, Callable] = {}
        self.plugins: list[dict[str, Callable]] = []

    def register(self, name: str, factory: Callable) -> Plugins:
        if not name or not callable(factory):
            raise ValueError("a plugin needs a name and a factory")
        self.factories[name] = factory
        return self

    def use(self, name: str, /, **options) -> Plugins:
        if name not in self.factories:
            raise KeyError(f"no plugin {name}; known: {sorted(self.factories)}")
        self.plugins.append(self.factories[name](**options))
        return self

    def hook(self, name: str, payload: dict) -> dict:
        answer: dict = {}
        for plugin in self.plugins:
            found = plugin[name](payload) if callable(plugin.get(name)) else None
            if isinstance(found, dict):
                answer |= found
                if found.get("skip"):
                    break
        return answer

    def stages(self, name: str, df: DataFrame) -> DataFrame:
        for plugin in self.plugins:
            if callable(plugin.get(name)):
                df = df.transform(plugin[name])
        return df


def with_retry(f: Callable, attempts: int = 3, delay_ms: int = 0, growth: float = 2.0) -> Callable:
    """``f`` that is tried again when it raises, after a delay that grows; the last exception is raised."""

    def run(*args, **named):
        wait = delay_ms
        for left in range(attempts - 1, -1, -1):
            try:
                return f(*args, **named)
            except Exception:
                if not left:
                    raise
            time.sleep(wait / 1000)
            wait *= growth

    return run
