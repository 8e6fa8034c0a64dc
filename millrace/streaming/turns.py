"""Turn-by-turn state of tool-using agents: Structured Streaming operators and their batch forms."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# ---- batch forms --------------------------------------------------------------------------------------------------


def active_turns(df: DataFrame, key: str, turn: str, done: str) -> DataFrame:
    """active: no earlier turn of the trajectory was done (once inactive, always inactive)."""
    w = Window.partitionBy(key).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("active", ~F.coalesce(F.max(F.col(done).cast("int")).over(w) == 1, F.lit(False)))


def context_budget(df: DataFrame, key: str, turn: str, length: str, most: int) -> DataFrame:
    """Per turn: what is left of a context of `most` after the shortest running length, at least 0."""
    w = Window.partitionBy(key).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    run = df.withColumn("__len", F.sum(length).over(w))
    return run.groupBy(turn).agg(F.greatest(F.lit(most) - F.min("__len"), F.lit(0)).alias("budget"))


def submission_rewards(df: DataFrame, key: str, turn: str, score: str, penalty: float = -0.05, start: float = 0.0) -> DataFrame:
    """0 where a submission beats the one before it, else the penalty."""
    before = F.lag(score, 1, start).over(Window.partitionBy(key).orderBy(turn))
    return df.withColumn("reward", F.when(F.col(score) > before, 0.0).otherwise(penalty))


def last_write(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Replay of a log: the last write of each key wins."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def sticky_routes(df: DataFrame, request: str, order: str, servers: int) -> DataFrame:
    """Every request goes to the server of its first appearance, in turn."""
    from millrace.operators.batch import positions

    first = df.groupBy(request).agg(F.min(order).alias("first"))
    return positions(first, "first").select(request, (F.col("pos") % servers).cast("int").alias("server"))


def adaptive_coefficient(df: DataFrame, step: str, kl: str, n: str, start: float, target: float, horizon: int) -> DataFrame:
    """Coefficient after each step: a running product of 1 + clip(kl / target - 1, +-0.2) n / horizon.

    One row for each training step; the window over all of them is as small as the training log.
    """
    mult = 1 + F.least(F.greatest(F.col(kl) / target - 1, F.lit(-0.2)), F.lit(0.2)) * F.col(n) / horizon
    w = Window.orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("coefficient", start * F.exp(F.sum(F.log(mult)).over(w)))


def repair_gate(df: DataFrame, key: str, step: str, confidence: str, below: float = 0.7, most: int = 2) -> DataFrame:
    """repair: confidence (0.5 where missing) under the threshold and fewer than `most` repairs so far."""
    low = (F.coalesce(confidence, F.lit(0.5)) < below).cast("int")
    w = Window.partitionBy(key).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__low", low).withColumn("repair", (F.col("__low") == 1) & (F.coalesce(F.sum("__low").over(w), F.lit(0)) < most)).drop("__low")


def route_action(action: Column, finish: Column) -> Column:
    """Tool of an action: none when finished, else the first whose mark the text holds."""
    return (
        F.when(finish, "finish").when(action.contains("```sql"), "sql").when(action.contains("```python"), "python_code").when(action.contains("<search>"), "search").when(action.contains("<tool_call>"), "mcp")
    )


# ---- streams ------------------------------------------------------------------------------------------------------

STATE = "turns int, total double, finished boolean"
OUT = "user_id long, turns int, total double, finished boolean"


def turn_states(stream: DataFrame, most_turns: int = 1_000, done_type: str = "purchase", timeout_ms: int | None = None) -> DataFrame:
    """Running state of each trajectory of a stream of (user_id, event_type, value).

    Ends on the done event or the turn limit; later events of an ended trajectory
    are ignored.  With a time-out, state is evicted that long after a key's last event
    (such a stream never comes to an end by itself).  The rows of a key arrive
    in batches, so a hot key never has to fit into one frame.
    """

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        turns, total, finished = state.get if state.exists else (0, 0.0, False)
        for pdf in frames:
            for kind, value in zip(pdf["event_type"], pdf["value"]):
                if finished:
                    break
                turns += 1
                total += float(value) if value == value else 0.0
                finished = kind == done_type or turns >= most_turns
        state.update((turns, total, finished))
        if timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({"user_id": [key[0]], "turns": [turns], "total": [total], "finished": [finished]})

    return stream.groupBy("user_id").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(stream: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by event type and tumbling window, late rows within the watermark included."""
    x = stream.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return x.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def first_deliveries(stream: DataFrame, key: str | list[str], time: str, late: str = "1 day") -> DataFrame:
    """Each key, of one column or more, once, within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key] if isinstance(key, str) else key)
