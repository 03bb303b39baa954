"""Order-dependent folds over many small groups.

``fold_groups`` sorts each group and streams it through a numpy function. A
task holds one group at a time, and many groups share one Arrow batch, which
costs far less than one pandas frame per group. Callers first cut their
groups at borders the fold can never cross, so groups stay small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Columns = dict[str, np.ndarray]


def fold_groups(
    df: DataFrame, keys: list[str], order: list[str], function: Callable[[Columns], Columns | None], schema: str
) -> DataFrame:
    """Apply ``function`` to the sorted columns of every group.

    It returns arrays of equal length for the columns of ``schema``; keys given
    back as scalars are repeated. ``None`` emits nothing.
    """
    names = df.columns

    def emit(found: list[Columns]) -> pd.DataFrame:
        width = [len(next(v for v in part.values() if isinstance(v, np.ndarray))) for part in found]
        spread = lambda part, name, n: part[name] if isinstance(part[name], np.ndarray) else np.full(n, part[name], dtype=object if isinstance(part[name], str) else None)
        return pd.DataFrame({
            name: np.concatenate([spread(part, name, n) for part, n in zip(found, width)]) for name in found[0]
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []  # batches of the group that may go on

        def folded(frame: pd.DataFrame, borders: np.ndarray) -> pd.DataFrame | None:
            columns = {name: frame[name].to_numpy() for name in names}
            found = []
            for start, stop in zip(borders[:-1], borders[1:]):
                part = function({name: values[start:stop] for name, values in columns.items()})
                if part is not None:
                    found.append(part)
            return emit(found) if found else None

        def differs(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
            out = np.zeros(len(b), dtype=bool)
            for key in keys:
                out |= a[key].to_numpy() != b[key].to_numpy()
            return out

        for batch in batches:
            if not len(batch):
                continue
            if rest and not differs(rest[-1].iloc[-1:], batch.iloc[:1])[0] and not differs(batch.iloc[-1:], batch.iloc[:1])[0]:
                rest.append(batch)  # all one group: joined once, when it ends
                continue
            batch = pd.concat([*rest, batch], ignore_index=True)
            borders = np.concatenate([[0], 1 + np.flatnonzero(differs(batch.iloc[:-1], batch.iloc[1:])), [len(batch)]])
            rest = [batch.iloc[borders[-2] :]]
            out = folded(batch, borders[:-1]) if len(borders) > 2 else None
            if out is not None:
                yield out
        if rest:
            whole = pd.concat(rest, ignore_index=True)
            out = folded(whole, np.array([0, len(whole)]))
            if out is not None:
                yield out

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
