"""Speech detection on a stream of scored frames: hysteresis with the state of each recording kept between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parlance.session import ship

OUT = "rec_id long, seq long, at_ms long, event string"


def events(frames: DataFrame, onset: float = 0.5, offset: float = 0.35) -> DataFrame:
    """Start and end events of frames (rec_id, seq, at_ms, prob), which come in order within a recording."""
    ship(frames.sparkSession)

    def f(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        on = state.get[0] if state.exists else False
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, at, p in zip(rows["seq"], rows["at_ms"], rows["prob"]):
            if not on and p >= onset:
                on = True
                out.append((key[0], seq, at, "start"))
            elif on and p < offset:
                on = False
                out.append((key[0], seq, at, "end"))
        state.update((on,))
        yield pd.DataFrame(out, columns=["rec_id", "seq", "at_ms", "event"])

    return frames.groupBy("rec_id").applyInPandasWithState(f, OUT, "on boolean", "append", GroupStateTimeout.NoTimeout)
