"""Budgets and resampling of unbounded streams: the push forms of operators.ordered.within_budget and operators.signal.resampled.

State is a few numbers per key for a budget, and the filter's reach of samples for resampling. Rows of a key must
arrive in their order; a micro-batch is sorted before it is folded, so only the order between micro-batches is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideline.operators.signal import AFTER, BEFORE, TAPS, low_pass


def within_budget(stream: DataFrame, key: str, order: str, cost: str, limit: int) -> DataFrame:
    """(key, ord, running_cost, fits): after the first row that doesn't fit, none of its key does; null costs count as 0."""

    def work(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(frames)).sort_values("ord")
        used, over = state.get if state.exists else (0, False)
        running = used + df["cost"].fillna(0).to_numpy(np.int64).cumsum()
        late = over | np.logical_or.accumulate(running > limit)
        state.update((int(running[-1]), bool(late[-1])))
        yield pd.DataFrame({"key": k[0], "ord": df["ord"].to_numpy(), "running_cost": running, "fits": ~late})

    rows = stream.selectExpr(f"{key} AS key", f"{order} AS ord", f"cast({cost} AS long) AS cost")
    return rows.groupBy("key").applyInPandasWithState(work, "key long, ord long, running_cost long, fits boolean", "used long, over boolean", "append", GroupStateTimeout.NoTimeout)


def resampled(stream: DataFrame, key: str, order: str, value: str, in_rate: float, out_rate: float, ends: str | None = None, time: str | None = None, idle: int = 60_000) -> DataFrame:
    """(key, place, sample smallint): the stream of each key at another rate; a sample appears once all that it needs have arrived.

    A stream's last samples, which the batch form pads with silence, come when it is known to have ended: `ends` is an SQL
    condition that holds in its last row (whose value, if not null, still counts), and `time` a column with a watermark: a
    key is over once the watermark has passed its latest row by `idle` milliseconds. Then its state goes; later rows of the
    key begin a new stream at place 0. Without either, the tail waits for more."""
    taps, step = low_pass(in_rate, out_rate)[::-1].copy(), in_rate / out_rate

    def given(x: np.ndarray, first: int, place: int, whole: int | None) -> tuple[np.ndarray, int, int]:
        """The samples that x (from number `first` on) is enough for, where `whole` is the length of a stream that has ended."""
        ready = max(place, int(np.floor((first + len(x) - AFTER - 1) / step)) + 1)
        at = np.arange(place, ready) * step
        left = np.floor(at).astype(np.int64)
        filtered = np.convolve(x, taps, "valid") if len(x) >= TAPS else np.zeros(0)
        base = left - BEFORE - first
        fine = (base + 1 < len(filtered)) & (left < (whole if whole is not None else left + 1))
        at, left, base = at[fine], left[fine], base[fine]
        out = filtered[base] * (1 - (at - left)) + filtered[base + 1] * (at - left)
        done = place + len(out)
        return np.clip(np.floor(out * 32767 + 0.5), -32768, 32767).astype(np.int16), done, max(0, int(np.floor(done * step)) - BEFORE - first)

    def work(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # held: the latest samples; first: the number of the first of them; place: the next sample to give
        first, place, held = state.get if state.exists else (-BEFORE, 0, [0.0] * BEFORE)
        over, latest = state.hasTimedOut, 0
        x = np.array(held, float)
        if not over:
            df = pd.concat(list(frames)).sort_values("ord")
            over, latest = bool(df["ends"].any()), int(df["at"].max())
            x = np.concatenate([x, df["value"].dropna().to_numpy(float)])
        whole = first + len(x) if over else None
        samples, done, keep = given(np.concatenate([x, np.zeros(TAPS + 1)]) if over else x, first, place, whole)
        if over:
            state.remove()
        else:
            state.update((first + keep, done, x[keep:].tolist()))
            if time:
                state.setTimeoutTimestamp(max(latest + idle, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": k[0], "place": np.arange(place, done), "sample": samples})

    at = f"cast(unix_millis(cast({time} AS timestamp)) AS long)" if time else "0L"
    rows = stream.selectExpr(f"{key} AS key", f"{order} AS ord", f"cast({value} AS double) AS value", f"coalesce({ends or 'false'}, false) AS ends", f"{at} AS at", *([time] if time else []))
    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    return rows.groupBy("key").applyInPandasWithState(work, "key long, place long, sample smallint", "first long, place long, held array<double>", "append", timeout)
