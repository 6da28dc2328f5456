"""The run memory as a stateful stream, and windowed views of events.

The stream's rows are those of the batch operators in ``pagetrail.operators.memory``; each action is taken
once, in order of its step, however often it is delivered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagetrail.operators.memory import attempts

OUT = "run_id long, step int, operation string, label string, url string, outcome string, failed boolean, streak long, done long, times long, excluded string"
STATE = "last int, streak long, done long, keys array<string>, counts array<long>, failures array<boolean>"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, streak, done, keys, counts, failures = state.get if state.exists else (-1, 0, 0, [], [], [])
    seen = {k: [n, f] for k, n, f in zip(keys, counts, failures, strict=True)}
    rows = pd.concat(list(batches)).drop_duplicates("step").sort_values("step")
    out = []
    for r in rows.itertuples(index=False):
        if r.step <= last:
            continue
        last = int(r.step)
        streak = 0 if r.outcome == "url_changed" else streak + 1
        done += int(r.completed)
        mark = seen.setdefault("\x1f".join((r.url, r.operation, r.label)), [0, False])
        mark[0] += 1
        mark[1] = mark[1] or bool(r.failed)
        why = "no effect" if mark[1] else "repeated" if mark[0] >= 2 else None
        out.append((key[0], last, r.operation, r.label, r.url, r.outcome, bool(r.failed), streak, done, mark[0], why))
    state.update((last, streak, done, list(seen), [n for n, _ in seen.values()], [f for _, f in seen.values()]))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def remember(history: DataFrame) -> DataFrame:
    """Per action its streak, completed count, number of tries and exclusion reason as of that action.

    ``history`` is a stream of ``memory`` history rows. State per run: the last step, counters, and one mark per
    tried element, which the run's action budget bounds. Rows of an already seen step are ignored, so replays
    change nothing; rows must arrive in step order across batches.
    """
    return attempts(history).groupBy("run_id").applyInPandasWithState(_advance, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per tumbling window and type; events later than ``late`` are dropped (an extension)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of users, closed after ``gap`` without an event (an extension)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")
