"""User code at fixed places: a verifier for requests, and hooks that may only add columns."""

from __future__ import annotations

import asyncio
import inspect
import math
import time
from collections import ChainMap
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from numbers import Real

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Decision:
    """What a verifier may return, besides a bool or a mapping with `passes`."""

    passes: bool
    service_time_s: float | None = None
    metadata: Mapping | None = None


#: Shapes that an answer may have, and how each is read as named fields.
SHAPES: dict[type, Callable] = {bool: lambda answer: {"passes": answer}, Decision: lambda answer: dict(vars(answer)), Mapping: dict}

#: Fields with a meaning: the value of a missing one, the test of a present one, and what the test asks for.
FIELDS = {
    "passes": (None, lambda x: type(x) is bool, "passes must be a bool"),
    "service_time_s": (None, lambda x: x is None or (isinstance(x, Real) and type(x) is not bool and 0 <= x < math.inf), "service_time_s must be a finite number from 0 on"),
    "metadata": ({}, lambda x: x is None or isinstance(x, Mapping), "metadata must be a mapping"),
}


def checked(raw, elapsed: float) -> tuple[bool, float, dict[str, str]]:
    """(passes, service time, metadata) of a verifier's answer; the time it took stands in for one it does not give.

    Fields without a meaning of their own are metadata. All faults of an answer
    are told at once.
    """
    named = [read(raw) for shape, read in SHAPES.items() if isinstance(raw, shape)]
    if not named:
        raise TypeError(f"{type(raw).__name__} is not one of {', '.join(s.__name__ for s in SHAPES)}")
    known = {name: named[0].pop(name, missing) for name, (missing, _, _) in FIELDS.items()}
    faults = [want for name, (_, test, want) in FIELDS.items() if not test(known[name])]
    if faults:
        raise ValueError("; ".join(faults))
    labels = ChainMap(named[0], known["metadata"] or {})
    seconds = known["service_time_s"]
    return known["passes"], float(elapsed if seconds is None else seconds), {str(k): str(labels[k]) for k in labels}


def verified(requests: DataFrame, verifier: Callable, payload: str, key: str = "item_key") -> DataFrame:
    """(key, passes, service_time_s, metadata) of every request.

    The verifier is a function, or a coroutine function, of the payload; it sees
    neither the key nor any other column. Calls of a coroutine function run
    together within an Arrow batch. A wrong answer fails the job.
    """
    kind = requests.schema[key].dataType.simpleString()
    is_async = inspect.iscoroutinefunction(verifier) or inspect.iscoroutinefunction(getattr(verifier, "__call__", None))

    async def timed(value):
        began = time.perf_counter()
        return await verifier(value), time.perf_counter() - began

    async def together(values):
        return await asyncio.gather(*(timed(v) for v in values))

    def one(value):
        began = time.perf_counter()
        return verifier(value), time.perf_counter() - began

    def run(batches):
        for pdf in batches:
            got = asyncio.run(together(pdf["__payload"])) if is_async else [one(v) for v in pdf["__payload"]]
            rows = [checked(raw, elapsed) for raw, elapsed in got]
            yield pd.DataFrame({"__key": pdf["__key"], "passes": [r[0] for r in rows], "service_time_s": [r[1] for r in rows], "metadata": [r[2] for r in rows]})

    asked = requests.select(F.col(key).alias("__key"), F.col(payload).alias("__payload"))
    out = asked.mapInPandas(run, f"__key {kind}, passes boolean, service_time_s double, metadata map<string,string>")
    return out.withColumnRenamed("__key", key)


def with_hook(df: DataFrame, hook: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """`df` with the columns that the hook adds, matched by `key`, which must be unique.

    The hook gets the frame and returns one with the key and new columns, or the
    whole frame with new columns behind. What it does to old columns or rows has
    no effect: only new columns are taken, null where it has no row. A hook that
    changes the type of an old column, or returns no key, is refused.
    """
    out = hook(df)
    if key not in out.columns:
        raise ValueError(f"the hook returns no {key}")
    changed = [c for c in out.columns if c in df.columns and out.schema[c].dataType != df.schema[c].dataType]
    if changed:
        raise ValueError(f"a hook may add columns, not replace {changed}")
    new = [c for c in out.columns if c not in df.columns]
    if not new:
        return df
    return df.join(out.select(key, *new).dropDuplicates([key]), key, "left").select(*df.columns, *new)
