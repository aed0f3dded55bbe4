"""Pandas batches of rows that are sorted by key, cut so that no key is in two of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of ``batches``, all rows of a ``key`` together."""
    rest: list[pd.DataFrame] = []  # all of one key
    for b in batches:
        if not len(b):
            continue
        key = b["key"].to_numpy()
        if rest and rest[0]["key"].iloc[0] != key[0]:
            yield pd.concat(rest, ignore_index=True)
            rest = []
        at = int(np.searchsorted(key, key[-1]))
        if at:
            yield pd.concat([*rest, b.iloc[:at]], ignore_index=True)
            rest = []
        rest.append(b.iloc[at:])
    if rest:
        yield pd.concat(rest, ignore_index=True)
