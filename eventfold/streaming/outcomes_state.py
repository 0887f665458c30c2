"""Streaming command outcome and timeout (OP-48, OP-49).

Keyed by session: pending commands wait in a ``ListState``; each registers an
event-time timer at ``date + timeout``. The first terminal event of the
session after a command settles it (SUCCESS or CANCELLED, or TIMEOUT when the
terminal came after the deadline); a timer that fires first emits TIMEOUT.
The input needs a watermark on ``date``: it bounds how late a terminal may
arrive and still count, exactly like the confirmation wait of the original.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from eventfold.schema import CANCELLED_TYPES, SUCCESS_TYPES, Errors
from eventfold.streaming.asof_state import STATE_PROVIDER

OUTCOME = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("session_id", T.StringType()),
    T.StructField("aggregate_id", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("date_ms", T.LongType()), T.StructField("status", T.StringType()),
    T.StructField("terminal_seq", T.LongType()), T.StructField("error_type", T.StringType()),
])
_PENDING = "seq long, aggregate_id string, type string, date_ms long"


class OutcomeProcessor(StatefulProcessor):
    def __init__(self, timeout_ms: int, success: Sequence[str], cancelled: Sequence[str]):
        self.timeout_ms = int(timeout_ms)
        self.success = set(success)
        self.cancelled = set(cancelled)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _PENDING)

    def _load(self) -> list[tuple]:
        return [tuple(p) for p in self.pending.get()] if self.pending.exists() else []

    def _store(self, pending: list[tuple]) -> None:
        self.pending.clear()
        if pending:
            self.pending.put(pending)

    def _row(self, key, p, status, term_seq=None, error=None) -> dict:
        return {"seq": p[0], "session_id": key[0], "aggregate_id": p[1], "type": p[2], "date_ms": p[3],
                "status": status, "terminal_seq": term_seq, "error_type": error}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        pending = self._load()
        out = []
        for r in pdf.itertuples(index=False):
            if r.is_command:
                pending.append((int(r.seq), r.aggregate_id, r.type, int(r.date_ms)))
                self.handle.registerTimer(int(r.date_ms) + self.timeout_ms)
            elif r.type in self.success or r.type in self.cancelled:
                keep = []
                for p in pending:
                    if p[0] >= r.seq:
                        keep.append(p)
                    elif int(r.date_ms) <= p[3] + self.timeout_ms:
                        ok = r.type in self.success
                        out.append(self._row(key, p, "SUCCESS" if ok else "CANCELLED", int(r.seq),
                                             None if ok else r.exception_type))
                    else:
                        out.append(self._row(key, p, "TIMEOUT", None, Errors.CONFIRMATION_TIMEOUT))
                pending = keep
        self._store(pending)
        yield pd.DataFrame(out, columns=[f.name for f in OUTCOME.fields])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        pending = self._load()
        done = [p for p in pending if p[3] + self.timeout_ms <= at]
        self._store([p for p in pending if p[3] + self.timeout_ms > at])
        yield pd.DataFrame([self._row(key, p, "TIMEOUT", None, Errors.CONFIRMATION_TIMEOUT) for p in done],
                           columns=[f.name for f in OUTCOME.fields])

    def close(self) -> None:
        pass


def stream_command_outcome(events: DataFrame, is_command: Column, timeout_ms: int, watermark: str = "0 seconds",
                           success_types: Sequence[str] = SUCCESS_TYPES,
                           cancelled_types: Sequence[str] = CANCELLED_TYPES) -> DataFrame:
    """OP-48/49 on a stream of ``seq, session_id, aggregate_id, type, date,
    exception_type`` rows; same output as the batch form (``date`` as epoch ms)."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    terminal = F.col("type").isin(list(success_types) + list(cancelled_types))
    x = (events.withWatermark("date", watermark)
         .where(is_command | terminal)
         .select("session_id", "seq", "aggregate_id", "type", "exception_type", "date",
                 is_command.alias("is_command"), F.unix_millis("date").alias("date_ms")))
    return x.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=OutcomeProcessor(timeout_ms, success_types, cancelled_types), outputStructType=OUTCOME,
        outputMode="Append", timeMode="EventTime")
