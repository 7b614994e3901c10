"""Group-wise Python for tables of many small groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def map_groups(df: DataFrame, by: list[str], f, schema: str) -> DataFrame:
    """`f` of each group's rows, as `applyInPandas`, for many small groups: rows come sorted in large batches, of which
    the last group waits for the next batch. A task holds a batch and one group."""

    def run(batches):
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            if not len(b):
                continue
            new = np.r_[True, (b[by].iloc[1:].to_numpy() != b[by].iloc[:-1].to_numpy()).any(1)]
            starts = np.flatnonzero(new)
            parts = [f(b.iloc[i:j].reset_index(drop=True)) for i, j in zip(starts[:-1], starts[1:], strict=True)]
            if parts:
                yield pd.concat(parts, ignore_index=True)
            held = b.iloc[starts[-1] :].reset_index(drop=True)
        if held is not None and len(held):
            yield f(held)

    return df.repartition(*by).sortWithinPartitions(*by).mapInPandas(run, schema)
