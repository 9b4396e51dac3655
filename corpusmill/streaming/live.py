"""Live feeds: path state and first-seen texts with state kept by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "path_status string, error_count int, last_update long, last_modified long, history long, size long, checksum long"
_OUT = "site_md5 string, path_md5 string, " + _STATE


def advance(state: tuple, event: str, now: int, size: int | None, checksum: int | None, most_errors: int = 5) -> tuple:
    """One event on one path; the batch twin is crawl.apply_events."""
    import math

    status, errors, _, modified, history, old_size, old_sum = state
    if event == "OK":
        if (old_size, old_sum) != (size, checksum) and modified != now:
            passed = now - modified
            age = 37 if modified <= 0 else 41 if passed < 0 else min(41, max(16, math.floor(math.log(passed) / math.log(1.5))))
            history, modified = ((history << 8) | age) & 0xFFFFFFFF, now
        return "OK", 0, now, modified, history, size, checksum
    if event in ("MOVED", "MOVED_FOR_GOOD"):
        return ("OK" if event == "MOVED" else "REDIRECT"), 0, now, modified, history, old_size, old_sum
    if event in ("ERROR", "FATAL"):
        errors += 1
        return ("DISABLED" if event == "FATAL" or errors >= most_errors else "ERROR"), errors, now, modified, history, old_size, old_sum
    return state


def path_states(events: DataFrame, most_errors: int = 5) -> DataFrame:
    """A row for each path and micro-batch in which it had events(site_md5, path_md5, ts, event, size, checksum)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else ("NONE", 0, 0, 0, 0, None, None)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for r in rows.itertuples(index=False):
            now = advance(now, r.event, int(r.ts), None if pd.isna(r.size) else int(r.size), None if pd.isna(r.checksum) else int(r.checksum), most_errors)
        state.update(now)
        yield pd.DataFrame([(*key, *now)], columns=[c.split()[0] for c in _OUT.split(", ")])

    return events.groupBy("site_md5", "path_md5").applyInPandasWithState(run, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def first_seen(texts: DataFrame, text: str = "text", watermark: str | None = None, time: str = "ts") -> DataFrame:
    """The first arrival of each text; with a watermark, state older than it is dropped."""
    rows = texts.withColumn("digest", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    if watermark:
        return rows.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["digest"])
    return rows.dropDuplicates(["digest"])


def crawl_rate(events: DataFrame, size: str = "10 minutes", watermark: str = "1 hour", kind: str = "event_type") -> DataFrame:
    """Events of each kind in windows of their time."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", size), kind).agg(F.count("*").alias("n"))
