"""The login limiter (2.11): five failures within 60 s block a key for 60 s; a success clears its failures.

The rule's state is a key's recent failures and the end of its block; one function replays it for batch
groups and for the stateful stream, so both agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.segments import replayed

FAILURES, WINDOW_S, KEEP_S = 5, 60.0, 900
OUT = "key string, ts double, success boolean, blocked boolean, blocks boolean"
STATE = "failures array<double>, until double"
#: Attempts of one key that are replayed in one go.
PART = 50_000


def replay(attempts, failures: list[float], until: float) -> tuple[list[tuple[float, bool, bool, bool]], list[float], float]:
    """Attempts (ts, success) in order: rows (ts, success, blocked before it, starts a block) and the state after them.

    A blocked key's attempts are turned away and don't count.
    """
    out = []
    for ts, success in attempts:
        blocked, starts = ts < until, False
        if not blocked:
            if success:
                failures, until = [], 0.0
            else:
                failures = [t for t in failures if t > ts - WINDOW_S] + [ts]
                if len(failures) >= FAILURES:
                    failures, until, starts = [], ts + WINDOW_S, True
        out.append((ts, success, blocked, starts))
    return out, failures, until


def keyed(attempts: DataFrame) -> DataFrame:
    """attempts (email, ip, ts timestamp, success) with key and ts in seconds."""
    return attempts.select(F.concat_ws("|", F.lower(F.trim("email")), "ip").alias("key"), (F.unix_micros("ts") / 1e6).alias("ts"), "success", F.col("ts").alias("at"))


def blocked_attempts(attempts: DataFrame, part: int = PART) -> DataFrame:
    """Every attempt with whether it met a block and whether it began one; a key's attempts are replayed in time order.

    A task holds at most `part` attempts; parts of a key are replayed at once, and again where the state before them turns out to be another.
    """

    def run(rows: dict[str, list], state: list[float]):
        out, failures, until = replay(zip(rows["ts"], rows["success"], strict=True), state[1:], state[0])
        now = out[-1][0]  # what no later attempt can tell apart is one state
        left = [until if until > now else 0.0, *(t for t in failures if t > now - WINDOW_S)]
        return {"blocked": [x[2] for x in out], "blocks": [x[3] for x in out]}, left, None

    rows = keyed(attempts).select("key", "ts", "success", F.array(F.lit(0.0)).alias("__start"))
    return replayed(rows, "key", ["ts", "success"], run, "blocked boolean, blocks boolean", "array<double>", part)


def bursts(attempts: DataFrame, failures: int = FAILURES, seconds: int = int(WINDOW_S)) -> DataFrame:
    """Without clearing: failed attempts that are at least the nth of their key within the window, by a range frame."""
    from pyspark.sql import Window

    rows = keyed(attempts).where("not success").withColumn("second", F.floor("ts").cast("long"))
    w = Window.partitionBy("key").orderBy("second").rangeBetween(-seconds, 0)
    return rows.withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("n") >= failures).select("key", "ts", "n")


def blocked_stream(attempts: DataFrame) -> DataFrame:
    """The same as a stream (attempts read with readStream, ts as event time): state is dropped after KEEP_S without attempts."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        failures, until = (list(state.get[0]), state.get[1]) if state.exists else ([], 0.0)
        rows = pd.concat(list(batches)).sort_values(["ts", "success"])
        out, failures, until = replay(zip(rows["ts"], rows["success"], strict=True), failures, until)
        state.update((failures, until))
        state.setTimeoutTimestamp(int(rows["at"].max().timestamp() * 1000) + KEEP_S * 1000)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["key", "ts", "success", "blocked", "blocks"])

    rows = keyed(attempts).withWatermark("at", "1 minute")
    return rows.groupBy("key").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
