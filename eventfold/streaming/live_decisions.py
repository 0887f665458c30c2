"""Commands decided on a stream against the live state of their items (OP-34, 07; the streaming form of ``decide_as_of``).

Log and commands are one keyed stream. First stage, by item: the state is the item's latest event (its order and, as
JSON, the columns that decisions read); a batch's rows of an item are taken in (seq, hop) order, a command before the
events at its own place, and each command gets the event before it. A clone asks two items, so it has two answers:
second stage, by command: the first answer waits in state for the other, or for a timer.

Defined cases: across batches the order is that of arrival, so a command sees what arrived before it, and an event older
than the state it meets does not replace it; a command without any item is decided on no state; repeated commands
each get their row; with ``wait_ms``, a command whose second answer has not come by then is given out as ``UNANSWERED``
(Spark then runs batches without data to look at the clock, so such a query is never idle), without it an answer waits on.
Events without an item are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from eventfold.operators.decisions import _decide_looked_up
from eventfold.schema import PERSISTENCE_ACCEPTS, SELECTION_ACCEPTS
from eventfold.session import ship_package
from eventfold.streaming.asof_state import JSON_OPTS, STATE_PROVIDER

ANSWER = "command string, role int, asked int, seen string"
DECIDED = "command string, target string, source string, complete boolean"


class ItemProcessor(StatefulProcessor):
    """The state of an item; gives each command (``command`` not null) the latest event before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long, turn int, event string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["at", "turn"], kind="stable")
        asks = pdf["command"].notna()
        seed = self.last.get() if self.last.exists() else None
        if seed is not None:  # an event older than the state does not count
            old = ~asks & ((pdf["at"] < seed[0]) | ((pdf["at"] == seed[0]) & (pdf["turn"] <= seed[1])))
            pdf, asks = pdf[~old], asks[~old]
        seen = pdf["event"].ffill()
        if seed is not None:
            seen = seen.fillna(seed[2])
        events = pdf[~asks]
        if len(events):
            e = events.iloc[-1]
            self.last.update((int(e["at"]), int(e["turn"]), e["event"]))
        out = pdf.loc[asks, ["command", "role", "asked"]].assign(seen=seen[asks].astype(object).where(seen[asks].notna(), None))
        if len(out):
            yield out

    def close(self) -> None:
        pass


class CommandProcessor(StatefulProcessor):
    """Joins the answers of a command's target (role 1) and source (role 2)."""

    def __init__(self, wait_ms: int | None = None):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "role int, seen string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = None
        found = []
        for pdf in rows:
            for role, asked, seen in zip(pdf["role"].tolist(), pdf["asked"].tolist(), pdf["seen"].tolist()):
                seen = None if pd.isna(seen) else seen
                if asked < 2:
                    found.append((key[0], seen if role == 1 else None, seen if role == 2 else None, True))
                    continue
                if held is None:
                    held = list(self.waiting.get())
                other = next((i for i, (r, _) in enumerate(held) if r != role), None)
                if other is None:
                    held.append((role, seen))
                else:
                    both = {role: seen, held[other][0]: held[other][1]}
                    del held[other]
                    found.append((key[0], both[1], both[2], True))
        if held:
            self.waiting.put(held)
            if self.wait_ms is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        elif held is not None:
            self.waiting.clear()
        if found:
            yield _frame(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = list(self.waiting.get())
        self.waiting.clear()
        if held:
            yield _frame([(key[0], s if r == 1 else None, s if r == 2 else None, False) for r, s in held])

    def close(self) -> None:
        pass


def _frame(found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(found, columns=["command", "target", "source", "complete"])


def stream_decide(commands: DataFrame, log: DataFrame, wait_ms: int | None = None, selection_accepts: Sequence[str] = SELECTION_ACCEPTS,
                  persistence_accepts: Sequence[str] = PERSISTENCE_ACCEPTS) -> DataFrame:
    """The columns of ``decide_as_of`` for each command of a stream, against the states that a stream of events has left."""
    spark = commands.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    state = F.struct("aggregate_id", "type", "version", "user_id", "session_id", "date",
                     F.col("settings.shared").alias("shared"), "fail_event_type")
    state_type = log.select(state.alias("s")).schema["s"].dataType
    none = F.lit(None).cast("string")
    hop = F.coalesce(F.col("hop"), F.lit(0)) if "hop" in log.columns else F.lit(0)
    events = log.where(F.col("aggregate_id").isNotNull()).select(
        F.lit(True).alias("is_item"), F.col("aggregate_id").alias("item"), F.col("seq").cast("long").alias("at"), (hop + 1).cast("int").alias("turn"),
        F.to_json(state, JSON_OPTS).alias("event"), none.alias("command"), F.lit(0).alias("role"), F.lit(0).alias("asked"))
    # a command that asks nothing has a key of its own, which is no item's
    asked = F.col("target_id").isNotNull().cast("int") + F.col("source_id").isNotNull().cast("int")
    reads = F.array(F.struct(F.lit(True).alias("is_item"), F.col("target_id").alias("item"), F.lit(1).alias("role")),
                    F.struct(F.lit(True).alias("is_item"), F.col("source_id").alias("item"), F.lit(2).alias("role")),
                    F.struct(F.lit(False).alias("is_item"), F.when(asked == 0, F.col("cmd_seq").cast("string")).alias("item"), F.lit(0).alias("role")))
    asks = (commands.select(F.to_json(F.struct(*commands.columns), JSON_OPTS).alias("command"), F.col("cmd_seq").cast("long").alias("at"),
                            asked.alias("asked"), F.explode(F.filter(reads, lambda r: r["item"].isNotNull())).alias("r"))
            .select("r.is_item", "r.item", "at", F.lit(0).alias("turn"), none.alias("event"), "command", "r.role", "asked"))
    answers = events.unionByName(asks).groupBy("is_item", "item").transformWithStateInPandas(ItemProcessor(), ANSWER, "Append", "None")
    joined = answers.groupBy("command").transformWithStateInPandas(CommandProcessor(wait_ms), DECIDED, "Append", "None" if wait_ms is None else "ProcessingTime")
    kinds = T.StructType(commands.schema.fields)
    looked_up = joined.select(F.from_json("command", kinds, JSON_OPTS).alias("c"), F.from_json("target", state_type, JSON_OPTS).alias("_st"),
                              F.from_json("source", state_type, JSON_OPTS).alias("_src"), "complete").select("c.*", "_st", "_src", "complete")
    done = _decide_looked_up(looked_up, selection_accepts, persistence_accepts)
    verdicts = {"decision": F.lit("UNANSWERED"), **{c: F.lit(None) for c in ("out_type", "version", "error_type", "error_args")}}
    return done.withColumns({c: F.when(F.col("complete"), F.col(c)).otherwise(v) for c, v in verdicts.items()}).drop("complete")
