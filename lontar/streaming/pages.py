"""The extraction as a stream: fetched pages arrive as files, sentences leave by class.

State is bounded: duplicates are known by digest for as long as the watermark says (for ever without one), and rate
limits are one row per domain. A batch that runs again after a failure replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import vocab

LIMIT_SCHEMA = "domain string, status string, adaptive_delay double, extra_delay double, cooldown_until double, successes long, errors_429 long, errors_503 long, other_errors long, events long"
_STATE = LIMIT_SCHEMA.partition(", ")[2]


def content_dedup(pages: DataFrame, html: str = "html", within: tuple[str, str] | None = None) -> DataFrame:
    """pages with ``content_hash``, the first of each. within: an event-time column and how long a digest is kept."""
    hashed = pages.withColumn("content_hash", F.md5(html))
    if within is None:
        return hashed.dropDuplicates(["content_hash"])
    return hashed.withWatermark(*within).dropDuplicatesWithinWatermark(["content_hash"])


def flush_by_class(rows: DataFrame, path: str, checkpoint: str, label: str = "Label", seconds: int | None = None) -> StreamingQuery:
    """Write each micro-batch below path, by batch and label: every so many seconds, or all that is there and then stop."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy(label).parquet(f"{path}/batch={number}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def _advance(s: list, ts: float, status: int) -> None:
    """One fetch event on [status, delay, extra, cooldown, successes, e429, e503, other, events]."""
    s[8] += 1
    if status in (429, 503):
        s[0], s[2], s[3] = "cooling_down", s[2] + vocab.COOLDOWN_DELAY, ts + vocab.COOLDOWN_SECONDS
        s[5 if status == 429 else 6] += 1
    elif status == 200:
        s[4] += 1
        if s[4] >= vocab.SUCCESSES:
            s[1] = max(vocab.MIN_DELAY, s[1] * vocab.SPEED_UP)
        if s[0] == "cooling_down" and ts >= s[3]:
            s[0] = "slowed" if s[2] > 0 else "active"
    else:
        s[7] += 1
        s[1] = min(vocab.MAX_DELAY, s[1] * vocab.SLOW_DOWN)


def _limits(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    s = list(state.get) if state.exists else ["active", vocab.START_DELAY, 0.0, 0.0, 0, 0, 0, 0, 0]
    events = pd.concat(list(batches)).sort_values("seq")
    for ts, status in zip(events["t"], events["status"], strict=True):
        _advance(s, float(ts), int(status))
    state.update(tuple(s))
    yield pd.DataFrame([[key[0], *s]], columns=[c.split()[0] for c in LIMIT_SCHEMA.split(", ")])


def rate_limits(events: DataFrame) -> DataFrame:
    """The state of each domain after each batch that has events of it. events(domain, seq, t, status)."""
    return events.groupBy("domain").applyInPandasWithState(_limits, LIMIT_SCHEMA, _STATE, "update", GroupStateTimeout.NoTimeout)
