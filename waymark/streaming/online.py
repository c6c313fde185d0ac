"""Extension: first threshold crossings of a stream of scored states.

The batch operator ``first_crossing`` is the oracle; states may arrive in any
order within the watermark, and the earliest crossing by index wins.
``decisions`` emits a question's decision as soon as it is certain and keeps
state for it; ``crossings`` is the running minimum of what came so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def crossings(states: DataFrame, threshold: float, lateness: str = "10 minutes") -> DataFrame:
    """``question_id, stop_index`` from streamed ``question_id, state_index, score, ts``."""
    timed = states.withWatermark("ts", lateness).where(F.col("score") >= threshold)
    return timed.groupBy("question_id").agg(F.min("state_index").alias("stop_index"))


#: What ``decisions`` returns.
DECISIONS = "question_id long, stop_index long, score double, complete boolean, decided_at timestamp"


class FirstCrossing(StatefulProcessor):
    """One question: the earliest state whose score reaches the threshold.

    Kept for a question: the earliest crossing so far, the first index that has
    not come yet, indexes that came before their turn, and whether it is
    decided.  A crossing at ``i`` is decided at once if all states before it are
    known; else when no earlier one can come any more, ``wait`` after the newest
    state.  A decided question's later states change nothing; its memory goes
    ``wait`` after its newest state, as does that of a question without a
    crossing, which is then decided as one.
    """

    def __init__(self, threshold: float, wait_ms: int):
        self.threshold, self.wait_ms = threshold, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "best long, score double, next long, early array<long>, decided boolean, timer long")

    def _row(self, key, best, score, complete: bool, at_ms: int) -> pd.DataFrame:
        index = pd.array([best], dtype="Int64")
        return pd.DataFrame({"question_id": [key[0]], "stop_index": index, "score": pd.array([score], dtype="Float64"), "complete": [complete], "decided_at": [pd.Timestamp(at_ms, unit="ms")]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best, score, first_missing, early, decided, timer = self.memory.get() if self.memory.exists() else (None, None, 0, [], False, 0)
        known, newest = set(early or []), 0
        for part in rows:
            newest = max(newest, int(part["ts"].max().value // 1_000_000))
            if decided:
                continue
            known.update(int(i) for i in part["state_index"] if i >= first_missing)
            hits = part[part["score"] >= self.threshold]  # a missing score reaches nothing
            for i, s in zip(hits["state_index"], hits["score"]):
                if best is None or i < best:
                    best, score = int(i), float(s)
        while first_missing in known:
            known.remove(first_missing)
            first_missing += 1
        if not decided and best is not None and best < first_missing:
            decided, known = True, set()
            yield self._row(key, best, score, True, newest)
        if newest + self.wait_ms > timer:
            if timer:
                self.handle.deleteTimer(timer)
            timer = newest + self.wait_ms
            self.handle.registerTimer(timer)
        self.memory.update((best, score, first_missing, sorted(known), decided, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        best, score, _, early, decided, timer = self.memory.get()
        if expiredTimerInfo.getExpiryTimeInMs() == timer:
            self.memory.clear()
            if not decided:
                yield self._row(key, best, score, not early and best is None, timer)

    def close(self) -> None:
        pass


def decisions(states: DataFrame, threshold: float, wait_seconds: int = 600) -> DataFrame:
    """``question_id, stop_index, score, complete, decided_at``: one row a question, as soon as it is certain.

    ``states(question_id, state_index, score, ts)`` is a stream of all of a
    question's states, numbered from 0, in any order; a state that is not
    decided upon has a null score.  ``stop_index`` is null for a question that
    never reaches the threshold.  States more than ``wait_seconds`` behind the
    newest are dropped; ``complete`` tells whether a decision waited for none
    that might be missing.  Memory is bounded by the questions of the last
    ``wait_seconds``; the session must use the RocksDB state store.  The batch
    operator ``first_crossing`` is the oracle.
    """
    timed = states.select("question_id", "state_index", "score", "ts").withWatermark("ts", f"{wait_seconds} seconds")
    return timed.groupBy("question_id").transformWithStateInPandas(FirstCrossing(threshold, wait_seconds * 1000), DECISIONS, "Append", "eventtime")
