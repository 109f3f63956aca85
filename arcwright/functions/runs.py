"""Sorted runs inside ``mapInPandas``: groups may straddle Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def whole_runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Re-cut batches of a partition sorted by ``keys`` so that no group is split.

    Only the last, possibly unfinished group of a batch is held back, so memory
    is bounded by one batch plus one group.
    """
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = batch[keys].iloc[-1]
        same = np.ones(len(batch), dtype=bool)
        for k in keys:
            same &= ((batch[k] == last[k]) | (batch[k].isna() & pd.isna(last[k]))).to_numpy(dtype=bool, na_value=False)
        tail = len(batch) - int(same[::-1].argmin()) if not same.all() else 0
        if tail == 0:
            if held and not _same_key(held[-1], batch, keys):
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(batch)
            continue
        yield pd.concat([*held, batch.iloc[:tail]], ignore_index=True)
        held = [batch.iloc[tail:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _same_key(a: pd.DataFrame, b: pd.DataFrame, keys: list[str]) -> bool:
    return all(a[k].iloc[-1] == b[k].iloc[0] or (pd.isna(a[k].iloc[-1]) and pd.isna(b[k].iloc[0])) for k in keys)


def starts_of(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new group begins, plus the length at the end."""
    n = len(frame)
    change = np.zeros(n, dtype=bool)
    if n:
        change[0] = True
        for k in keys:
            v = frame[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), n)
