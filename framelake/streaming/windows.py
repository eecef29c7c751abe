"""Streaming forms of bursts, blocks, distinct records and state intervals.

Each takes a streaming DataFrame (a batch one gives the same rows), sets a watermark, and returns the
result for writeStream. Late rows beyond the watermark are left out, as event time demands.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bursts(rows: DataFrame, time: str, keys: list[str], gap: str, delay: str, severity: str) -> DataFrame:
    """keys, start, stop, anchors, severity: rows of a key no more than gap apart are one session."""
    own = rows.withWatermark(time, delay)
    out = own.groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("anchors"), F.max(severity).alias("severity"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "anchors", "severity")


def blocks(rows: DataFrame, time: str, keys: list[str], size: str, delay: str, value: str, slide: str | None = None) -> DataFrame:
    """keys, start, n, mean over tumbling windows, or sliding ones."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = rows.withWatermark(time, delay).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return out.select(*keys, F.col("w.start").alias("start"), "n", "mean")


def distinct_records(rows: DataFrame, time: str, signature: list[str], delay: str) -> DataFrame:
    """The first row of each signature within the delay."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(signature)


INTERVALS = "key bigint, state string, first timestamp, last timestamp, n bigint, right_censored boolean"


def residence(rows: DataFrame, key: str, time: str, state: str, delay: str, timeout_ms: int) -> DataFrame:
    """key, state, first, last, n, right_censored: intervals of one state, closed by the next or, open, by a timeout of event time.

    A key's open interval is all the state there is. Rows of a batch are taken in the order of time.
    """

    def step(name: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        cols = ["key", "state", "first", "last", "n", "right_censored"]
        now = held.get if held.exists else None
        if held.hasTimedOut:
            held.remove()
            yield pd.DataFrame([(int(name[0]), now[0], pd.Timestamp(now[1]), pd.Timestamp(now[2]), now[3], True)], columns=cols)
            return
        out = []
        own = pd.concat(list(frames)).sort_values(time, kind="stable")
        for at, s in zip(own[time], own[state]):
            if now is not None and now[0] == s:
                now = (s, now[1], str(at), now[3] + 1)
                continue
            if now is not None:
                out.append((int(name[0]), now[0], pd.Timestamp(now[1]), pd.Timestamp(now[2]), now[3], False))
            now = (s, str(at), str(at), 1)
        held.update(now)
        last = int(pd.Timestamp(now[2]).value // 1_000_000) + timeout_ms
        if last > held.getCurrentWatermarkMs():
            held.setTimeoutTimestamp(last)
        yield pd.DataFrame(out, columns=cols)

    own = rows.withWatermark(time, delay).select(key, time, state)
    return own.groupBy(key).applyInPandasWithState(step, INTERVALS, "state string, first string, last string, n bigint", "append", GroupStateTimeout.EventTimeTimeout)
