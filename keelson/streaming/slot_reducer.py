"""Replication messages that come out of order, twice or in conflict, reduced per slot with bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from keelson.operators.folds import streamed

#: Applied messages kept for telling a duplicate from a conflict, and early ones kept until their turn.
HISTORY, BUFFER = 64, 64
SCHEMA = "slot int, sequence bigint, key string, value string, action string, next bigint"


def start() -> dict:
    return {"next": 1, "history": {}, "early": {}}


def reduce_one(s: dict, slot: int, sequence: int, key: str, value: str) -> list[tuple]:
    """Exactly one action for the message (apply, buffer, ignore, conflict, stale or backpressure), and one for each buffered message it lets go.

    Earlier than expected: ignored if it equals what was applied, a conflict if
    it differs, stale if that is forgotten. Later: kept, if there is room.
    """
    payload = (key, value)
    if sequence < s["next"]:
        known = s["history"].get(sequence)
        return [(slot, sequence, key, value, "stale" if known is None else "ignore" if known == payload else "conflict", s["next"])]
    if sequence > s["next"]:
        known = s["early"].get(sequence)
        if known is not None:
            return [(slot, sequence, key, value, "ignore" if known == payload else "conflict", s["next"])]
        if len(s["early"]) >= BUFFER:
            return [(slot, sequence, key, value, "backpressure", s["next"])]
        s["early"][sequence] = payload
        return [(slot, sequence, key, value, "buffer", s["next"])]
    out, now = [], payload
    while now is not None:
        n = s["next"]
        s["history"][n] = now
        s["history"].pop(n - HISTORY, None)
        s["next"] = n + 1
        out.append((slot, n, *now, "apply", n + 1))
        now = s["early"].pop(n + 1, None)
    return out


def reduce_messages(messages: DataFrame) -> DataFrame:
    """The actions for all messages of a batch table, slot by slot in order of ``at`` and ``copy``."""
    return streamed(messages.select("slot", "sequence", "key", "value", "at", "copy"), ["slot"], ["at", "copy", "sequence"], lambda row: start(), lambda s, r: (s, reduce_one(s, r.slot, r.sequence, r.key, r.value)), SCHEMA)


class SlotReducer(StatefulProcessor):
    """The same reducer over a stream: cursor, applied history and early messages are its state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "next bigint")
        self.history = handle.getMapState("history", "sequence bigint", "key string, value string")
        self.early = handle.getMapState("early", "sequence bigint", "key string, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = lambda m: {k[0]: tuple(v) for k, v in m.iterator()}
        s = {"next": self.next.get()[0] if self.next.exists() else 1, "history": held(self.history), "early": held(self.early)}
        before = {n: dict(s[n]) for n in ("history", "early")}
        out = []
        batch = pd.concat(list(rows)).sort_values(["at", "copy", "sequence"], kind="stable")
        for r in batch.itertuples(index=False):
            out += reduce_one(s, int(key[0]), int(r.sequence), r.key, r.value)
        self.next.update((s["next"],))
        for state, name in ((self.history, "history"), (self.early, "early")):
            for k in before[name].keys() - s[name].keys():
                state.removeKey((k,))
            for k, v in s[name].items():
                if before[name].get(k) != v:
                    state.updateValue((k,), v)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def reduce_stream(messages: DataFrame) -> DataFrame:
    """The actions for a stream of (slot, sequence, key, value, at, copy)."""
    return messages.groupBy("slot").transformWithStateInPandas(SlotReducer(), SCHEMA, "Append", "None")
