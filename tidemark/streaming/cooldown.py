"""The cooldown of `operators.episodes` on a stream of candidates.

State per ticker is the position of the last event and how many candidates it
has absorbed. Within a micro-batch a ticker's candidates are taken in order of
position; a candidate that arrives behind the last event counts as absorbed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

OUTPUT = "ticker string, pos int, kept boolean, anchor int, episode_length int"


def stream_cooldown(candidates: DataFrame, k: int) -> DataFrame:
    """Every candidate of a stream with `ticker, pos`: whether it starts an event,
    the event it belongs to, and the event's length so far. Rows without ticker
    or position are left out. Output mode `append`."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        anchor, length = state.get if state.exists else (None, 0)
        rows = []
        for p in sorted(int(p) for b in batches for p in b["pos"]):
            kept = anchor is None or p - anchor >= k
            anchor, length = (p, 1) if kept else (anchor, length + 1)
            rows.append((key[0], p, kept, anchor, length))
        state.update((anchor, length))
        yield pd.DataFrame(rows, columns=["ticker", "pos", "kept", "anchor", "episode_length"])

    known = candidates.where("ticker IS NOT NULL AND pos IS NOT NULL").select("ticker", "pos")
    return known.groupBy("ticker").applyInPandasWithState(step, OUTPUT, "anchor int, n int", "append", "NoTimeout")
