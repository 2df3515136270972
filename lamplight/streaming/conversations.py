"""Conversations as a stream: each question resolved when it arrives, against keyed state.

Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lamplight.operators import followup

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TEXT = T.StructType([T.StructField("value", T.StringType())])


class Resolver(StatefulProcessor):
    """The state of a conversation: its slots as one value, and the evidence of its last turns as a list, a stack to return to.

    A turn of role reset removes the state; so does being idle for idle_ms of processing
    time, if given, by a timer that each turn moves on.  The first turn fixes the mode of the
    conversation; turns of another mode are refused and change nothing.
    """

    def __init__(self, grammar: followup.Grammar, history: int, idle_ms: int | None):
        self.grammar, self.history, self.idle_ms = grammar, history, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getValueState("slots", TEXT)
        self.mode = handle.getValueState("mode", TEXT)
        self.evidence = handle.getListState("evidence", TEXT)

    def loaded(self) -> followup.Memory:
        if not self.slots.exists():
            return followup.Memory()
        memory = followup.from_text(self.slots.get()[0])
        memory.evidence = [json.loads(x[0]) for x in self.evidence.get()] if self.evidence.exists() else []
        return memory

    def save(self, memory: followup.Memory) -> None:
        stack, memory.evidence = memory.evidence, []
        self.slots.update((followup.as_text(memory),))
        if stack:
            self.evidence.put([(json.dumps(e, ensure_ascii=False),) for e in stack])

    def forget(self) -> None:
        for state in (self.slots, self.mode, self.evidence):
            state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        turns = pd.concat(list(rows)).sort_values(["turn", "role"], ascending=[True, False], kind="stable").to_dict("records")
        memory, changed, forgotten = self.loaded(), False, False
        mode = self.mode.get()[0] if self.mode.exists() else None
        for row in turns:
            if mode is not None and row["mode"] != mode:
                out.append({"turn": row["turn"], "status": "refused"})
                continue
            if row["role"] == "reset":
                memory, mode, changed, forgotten = followup.Memory(), None, False, True
                continue
            mode, changed = row["mode"], True
            row["q"] = json.loads(row["q"]) if row["q"] else None
            if found := followup.step(row, memory, self.grammar, self.history):
                out.append({"turn": row["turn"], "status": "resolved", **found})
        if forgotten:
            self.forget()
        if changed:
            self.save(memory)
            self.mode.update((mode,))
            if self.idle_ms:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        names = ["turn", "status", *(name for name, _ in followup.FIELDS)]
        yield pd.DataFrame([{"conv_id": key[0], **{n: r.get(n) for n in names}} for r in out], columns=["conv_id", *names]).astype({"turn": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.forget()
        return iter(())

    def close(self) -> None:
        pass


def resolved_stream(turns: DataFrame, grammar: followup.Grammar = followup.KOREAN, history: int = 8, idle_ms: int | None = None) -> DataFrame:
    """A row per question of a stream of turns, as followup.resolved_turns gives it, with a status.

    turns: conv_id, turn, role, text and optionally chunk_ids, place_id, piece_id and mode.
    Turns of one batch are taken in order; a turn has to arrive no earlier than those before it.
    With idle_ms the stream has timers, and a trigger of availableNow never ends.
    """
    mode = F.coalesce("mode", F.lit("")) if "mode" in turns.columns else F.lit("")
    rows = followup.prepared(turns.withColumn("_mode", mode), grammar, "_mode").withColumn("q", F.to_json("q")).withColumnRenamed("_mode", "mode")
    schema = T.StructType([turns.schema["conv_id"], T.StructField("turn", T.LongType()), T.StructField("status", T.StringType()), *(T.StructField(*f) for f in followup.FIELDS)])
    return rows.groupBy("conv_id").transformWithStateInPandas(Resolver(grammar, history, idle_ms), schema, "append", "processingTime" if idle_ms else "none")
