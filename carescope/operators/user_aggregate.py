"""A user's own aggregate in two phases (D1): reduce, merge, finish.

``reduce`` turns some rows of one group into a state, ``merge`` joins two states, ``finish`` turns a
state into a result. Every task reduces its rows a batch at a time and merges as it goes, so it sends
one state a group (or a few, if it sees more than ``HELD`` groups); states are then merged through a
shuffle, in two steps of bounded fan-in, so neither a group's rows nor all of its states meet in one
task. States are what the user makes them; they should stay small beside the rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bootstrap import UNITS_AT_ONCE, _Draw

HELD = 10_000       # groups whose states a task holds before it sends them
FAN = 32            # first merges of a group


@dataclass(frozen=True)
class UserAggregate:
    """``reduce(rows) -> state``, ``merge(state, state) -> state``, ``finish(state) -> row`` (a dict of output columns)."""

    reduce: Callable[[pd.DataFrame], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], dict | list[dict]]


def aggregate_by(df: DataFrame, keys: Sequence[str], columns: Sequence[str], agg: UserAggregate, schema: str) -> DataFrame:
    """(keys..., columns of ``schema``): the finished aggregate of every group; a null key is a group of its own.

    ``finish`` may return several rows a group. An empty input has no group and gives no row.
    """
    g, spark_types = list(keys), {c: df.schema[c].dataType.simpleString() for c in keys}
    kinds = "".join(f"`{c}` {spark_types[c]}, " for c in g)

    def groups(batch: pd.DataFrame):
        return batch.groupby(g, dropna=False, sort=False) if g else [((), batch)]

    def rows(held: dict) -> pd.DataFrame:
        out = pd.DataFrame([list(k) for k in held], columns=g, dtype=object) if g else pd.DataFrame(index=range(len(held)))
        return out.assign(state=[pickle.dumps(s) for s in held.values()])

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            if batch.empty:
                continue
            for ident, part in groups(batch):
                ident = tuple(None if pd.isna(v) else v for v in (ident if isinstance(ident, tuple) else (ident,)))
                state = agg.reduce(part[list(columns)])
                held[ident] = agg.merge(held[ident], state) if ident in held else state
            if len(held) > HELD:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    def merged(part: pd.DataFrame) -> Any:
        states = iter(part["state"])
        out = pickle.loads(next(states))
        for s in states:
            out = agg.merge(out, pickle.loads(s))
        return out

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        return part.iloc[:1][[*g, "_salt"]].assign(state=[pickle.dumps(merged(part))])

    def finish(part: pd.DataFrame) -> pd.DataFrame:
        found = agg.finish(merged(part))
        found = pd.DataFrame(found if isinstance(found, list) else [found])
        return found.assign(**{c: [part[c].iloc[0]] * len(found) for c in g})[[*g, *found.columns]]

    states = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*g, *columns])]).mapInPandas(reduce, f"{kinds}state binary")
    salted = states.withColumn("_salt", F.spark_partition_id() % FAN)
    first = salted.groupBy(*g, "_salt").applyInPandas(merge, f"{kinds}_salt int, state binary")
    return first.groupBy(*g).applyInPandas(finish, f"{kinds}{schema}")


def bootstrap_states(df: DataFrame, reduce: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], finish: Callable[[np.ndarray], np.ndarray],
                     merge: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add, key: str = "encounter_id", score: str = "score",
                     label: str = "label", group_cols: Sequence[str] = (), n_iterations: int = 1000, seed: int = 42) -> DataFrame:
    """D1 for the bootstrap: (group..., replicate, value) of a user's metric.

    ``reduce(y, p, w)`` sees some rows with their weights in all replicates (rows x replicates) and returns
    a state whose first axis is the replicate; ``finish(state)`` gives a value for each. The
    replicates are those of ``bootstrap.replicate_weights``, but no (row, replicate) pair leaves a task.
    """
    draw = _Draw("rows", n_iterations, seed)
    named = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(
        *[F.col(f"`{c}`") for c in group_cols], F.col(key).cast("string").alias("_key"), F.col(score).cast("double").alias("_p"),
        F.col(label).cast("double").alias("_y"))

    def states(rows: pd.DataFrame) -> np.ndarray:
        out = None
        for k in range(0, len(rows), UNITS_AT_ONCE):
            some = rows.iloc[k:k + UNITS_AT_ONCE].assign(_pos=1, _neg=0)
            state = reduce(some["_y"].to_numpy(), some["_p"].to_numpy(), draw(some)[0][:, :-1])
            out = state if out is None else merge(out, state)
        return out

    def values(state: np.ndarray) -> list[dict]:
        return [{"replicate": k, "value": None if np.isnan(v) else float(v)} for k, v in enumerate(finish(state))]

    return aggregate_by(named, group_cols, ["_key", "_p", "_y"], UserAggregate(states, merge, values), "replicate int, value double")
