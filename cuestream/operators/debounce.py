"""Greedy minimum gap: keep an event only when far enough from the last one kept.

Which events survive depends on the survivor before, so this is not a prefix
aggregate. It still splits: for one chunk of time-ordered events, the last kept
time on leaving it is a step function of the last kept time on entering it.
Chunks compute their step functions in parallel, a small per-key pass chains
them, and the chunks then mark their events in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuestream.plans.scan import CHUNK, has_hot_group, range_chunks


def greedy_mask(times: np.ndarray, gap: int, last: float | None) -> np.ndarray:
    """Survivors of ascending times, given the last kept time before them."""
    mask = np.zeros(len(times), dtype=bool)
    i = 0 if last is None else int(np.searchsorted(times, last + gap, "left"))
    while i < len(times):
        mask[i] = True
        i = int(np.searchsorted(times, times[i] + gap, "left"))
    return mask


def exit_steps(times: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs (last time of the run, exit time): entering at any event of a run leaves at its exit."""
    n = len(times)
    nxt = np.searchsorted(times, times + gap, "left")
    leave = times.copy()
    for i in range(n - 1, -1, -1):
        if nxt[i] < n:
            leave[i] = leave[nxt[i]]
    # an earlier survivor is at most the first time here, so entry happens within one gap of it
    reach = min(n, int(np.searchsorted(times, times[0] + gap, "left")) + 1)
    ends = np.flatnonzero(np.r_[leave[1:reach] != leave[: reach - 1], True])
    return times[ends], leave[ends]


def debounce(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    tie: str,
    gap: int,
    hot: bool | None = None,
    max_group_rows: int | None = None,
) -> DataFrame:
    """Rows surviving the greedy gap per key, in time order; the tie column is unique per key."""
    keys = list(keys)
    order = [time] if tie == time else [time, tie]
    if hot is None:
        hot = has_hot_group(df, keys, max_group_rows)
    schema = df.schema

    if not hot:

        def survivors(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order, kind="stable")
            return pdf[greedy_mask(pdf[time].to_numpy(np.int64), gap, None)]

        return df.groupBy(*keys).applyInPandas(survivors, schema)

    chunked = range_chunks(df, keys, order)
    part = [*keys, CHUNK]
    key_fields = ", ".join(f"{k} {schema[k].dataType.simpleString()}" for k in keys)

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        ends, leave = exit_steps(np.sort(pdf[time].to_numpy(np.int64)), gap)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in part}, "upto": ends, "leave": leave})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        last, rows = None, []
        for chunk, run in pdf.sort_values([CHUNK, "upto"]).groupby(CHUNK, sort=True):
            rows.append((chunk, last))
            ends, leave = run["upto"].to_numpy(), run["leave"].to_numpy()
            i = 0 if last is None else int(np.searchsorted(ends, last + gap, "left"))
            if i < len(ends):
                last = int(leave[i])
        out = pd.DataFrame(rows, columns=[CHUNK, "_entry"])
        out["_entry"] = out["_entry"].astype("Int64")
        return out.assign(**{k: pdf[k].iloc[0] for k in keys})

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        entry = pdf["_entry"].iloc[0]
        mask = greedy_mask(pdf[time].to_numpy(np.int64), gap, None if pd.isna(entry) else int(entry))
        return pdf.loc[mask, schema.names]

    runs = chunked.select(*part, time).groupBy(*part).applyInPandas(steps, f"{key_fields}, {CHUNK} int, upto bigint, leave bigint")
    entries = runs.groupBy(*keys).applyInPandas(chain, f"{CHUNK} int, _entry bigint, {key_fields}")
    named = entries.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(part)], "_entry")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(part)]
    met = chunked.join(named, same).drop(*[f"_k{i}" for i in range(len(part))])
    return met.groupBy(*part).applyInPandas(mark, schema)
