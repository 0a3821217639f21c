"""Change-point segments and dead-band changes of unbounded streams: the push forms of operators.segments.

State is a few numbers per key, so any number of keys fits the state store. Rows of a key must arrive in their order;
a micro-batch is sorted before it is folded, so only the order between micro-batches is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key long, ord long, value double, segment long, place long, sent boolean"
STATE = "segment long, place long, value double, sent double"


def fold(values: list[float], state: tuple, cut: float, most: int, skip: float) -> tuple[list[tuple], tuple]:
    """segment, place and sent of each value after `state` (segment, place, last value, last value sent), and the state then."""
    segment, place, last, held = state
    out = []
    for v in values:
        if segment < 0 or place + 1 >= most or abs(v - last) > cut:
            segment, place, sent = segment + 1, 0, True
        else:
            place, sent = place + 1, (v - held) ** 2 > skip
        last, held = v, v if sent else held
        out.append((segment, place, sent))
    return out, (segment, place, last, held)


def segmented(stream: DataFrame, key: str, order: str, value: str, cut: float, most: int, skip: float) -> DataFrame:
    """(key, ord, value, segment, place, sent): a segment starts where the value jumps by more than `cut` or after `most` rows."""

    def work(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(frames)).sort_values("ord")
        now = tuple(state.get) if state.exists else (-1, -1, 0.0, 0.0)
        got, now = fold(df["value"].tolist(), now, cut, most, skip)
        state.update(now)
        yield pd.DataFrame({"key": k[0], "ord": df["ord"].to_numpy(), "value": df["value"].to_numpy(), "segment": [g[0] for g in got], "place": [g[1] for g in got], "sent": [g[2] for g in got]})

    rows = stream.selectExpr(f"{key} AS key", f"{order} AS ord", f"cast({value} AS double) AS value")
    return rows.groupBy("key").applyInPandasWithState(work, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
