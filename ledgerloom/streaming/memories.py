"""Memories as keyed state: postings by token, expiry by last access, a start from stored memories.

A user's state is two maps, memories by id and ids by token, and timers in event time. A
candidate reads only the memories that share a token with it and rewrites only those it
changes; the state store keeps the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.memory import SAME, MemoryFold, tokens

CHANGES = "user_id long, memory_id long, ord long, change string, content string, category string, importance double"
_COLUMNS = [c.split()[0] for c in CHANGES.split(", ")]
MOST_HELD = 1 << 14  # memories and postings of a user that a task holds at once
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _StateMaps:
    """What :class:`MemoryFold` asks of its memories and postings, kept in Spark's state maps.

    A call of the state store costs more than the work on what it gives. So what a user's rows of a
    batch read and write stays at hand, up to ``MOST_HELD`` entries, and is written by :meth:`flush`,
    each entry once: to be called before the processor turns to another user.
    """

    def __init__(self, memories: Any, postings: Any) -> None:
        self.memories, self.postings = memories, postings
        self.held: dict[int, dict | None] = {}
        self.ids: dict[str, list[int]] = {}
        self.changed: set[int | str] = set()

    def ids_of(self, token: str) -> list[int]:
        if token not in self.ids:
            self._room()
            self.ids[token] = list(self.postings.getValue((token,))[0]) if self.postings.containsKey((token,)) else []
        return self.ids[token]

    def put_ids(self, token: str, ids: list[int]) -> None:
        self._room()
        self.ids[token] = ids
        self.changed.add(token)

    def memory(self, key: int) -> dict | None:
        if key not in self.held:
            self._room()
            self.held[key] = None
            if self.memories.containsKey((key,)):
                content, category, importance, words, used = self.memories.getValue((key,))
                self.held[key] = {"memory_id": key, "content": content, "category": category, "importance": importance, "tokens": list(words), "used": used}
        return self.held[key]

    def put_memory(self, m: dict) -> None:
        self._room()
        self.held[m["memory_id"]] = m
        self.changed.add(m["memory_id"])

    def drop_memory(self, key: int) -> None:
        self._room()
        self.held[key] = None
        self.changed.add(key)

    def all_ids(self) -> list[int]:
        self.flush()
        return [k[0] for k, _ in self.memories.iterator()]

    def _room(self) -> None:
        if len(self.held) + len(self.ids) >= MOST_HELD:
            self.flush()

    def flush(self) -> None:
        for key in self.changed:
            if isinstance(key, str):
                if self.ids[key]:
                    self.postings.updateValue((key,), (self.ids[key],))
                elif self.postings.containsKey((key,)):
                    self.postings.removeKey((key,))
            elif (m := self.held[key]) is not None:
                self.memories.updateValue((key,), (m["content"], m["category"], m["importance"], m["tokens"], m["used"]))
            elif self.memories.containsKey((key,)):
                self.memories.removeKey((key,))
        self.held, self.ids, self.changed = {}, {}, set()


class KeptMemories(StatefulProcessor):
    """Rows of a user in order of ord: candidates, or (content null) accesses of memory number ord."""

    def __init__(self, same: float = SAME, keep_ms: int | None = None) -> None:
        self.same, self.keep_ms = same, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        maps = _StateMaps(
            handle.getMapState("memories", "memory_id long", "content string, category string, importance double, tokens array<string>, used long"),
            handle.getMapState("postings", "token string", "ids array<long>"))
        self.fold = MemoryFold(maps, self.same)

    def _used(self, memory_id: int, used: int) -> None:
        self.fold.touch(memory_id, used)
        if self.keep_ms is not None:
            self.handle.registerTimer(used + self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        changed = []
        for r in pd.concat(list(rows)).sort_values("place", kind="stable").to_dict("records"):
            used = int(r["used"])
            if r["content"] is None:
                self._used(int(r["ord"]), used)
                continue
            memory_id, change = self.fold.take(int(r["ord"]), r["content"], r["category"], r["importance"], list(r["tokens"]))
            self._used(memory_id, used)
            if change:
                changed.append((key[0], memory_id, int(r["ord"]), change, r["content"], r["category"], r["importance"]))
        self.fold.store.flush()
        yield pd.DataFrame(changed, columns=_COLUMNS).astype({"ord": "Int64"})

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        for r in initialState.to_dict("records"):
            self.fold.hold(int(r["memory_id"]), r["content"], r["category"], r["importance"], list(r["tokens"]))
            self._used(int(r["memory_id"]), int(r["used"]))
        self.fold.store.flush()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now, gone = expiredTimerInfo.getExpiryTimeInMs(), []
        for memory_id in self.fold.store.all_ids():
            m = self.fold.store.memory(memory_id)
            if m["used"] + self.keep_ms <= now:
                self.fold.forget(memory_id)
                gone.append((key[0], memory_id, None, "expired", m["content"], m["category"], m["importance"]))
        self.fold.store.flush()
        yield pd.DataFrame(gone, columns=_COLUMNS).astype({"ord": "Int64"})

    def close(self) -> None:
        pass


def kept_memories(rows: DataFrame, same: float = SAME, keep: int | None = None, late: str = "0 seconds", start: DataFrame | None = None) -> DataFrame:
    """The changes of users' memories: stored, updated or expired ones, as rows (user_id, memory_id,
    ord of the candidate, change, content, category, importance).

    rows: a stream (user_id, ord, content, category, importance, ts). A row without content is an
    access of memory number ord. Rows of a batch count in order of ts, then ord, accesses
    last. keep: a memory that was not stored, changed, met again or accessed for so many
    seconds of event time expires once the watermark, ``late`` behind the newest row, has
    passed. Rows behind the watermark are dropped. start: memories (user_id, memory_id, content,
    category, importance, ts) to begin with; a user's are read when the first row comes.

    The session's state store must be RocksDB (STATE_STORE).
    """
    ms = lambda c: F.unix_millis(c)
    words = tokens(F.col("content"))
    timed = rows.withWatermark("ts", late).select(
        F.col("user_id").cast("long").alias("user_id"), F.col("ord").cast("long").alias("ord"), "content", "category", F.col("importance").cast("double").alias("importance"), "ts",
        words.alias("tokens"), ms(F.col("ts")).alias("used"))
    timed = timed.withColumn("place", F.format_string("%020d %s %020d", F.col("used"), F.when(F.col("content").isNull(), "1").otherwise("0"), F.col("ord")))
    first = None
    if start is not None:
        first = start.select(
            F.col("user_id").cast("long").alias("user_id"), F.col("memory_id").cast("long").alias("memory_id"), "content", "category", F.col("importance").cast("double").alias("importance"),
            tokens(F.col("content")).alias("tokens"), ms(F.col("ts")).alias("used")).groupBy("user_id")
    return timed.groupBy("user_id").transformWithStateInPandas(
        KeptMemories(same, None if keep is None else 1000 * keep), CHANGES, "append", "eventtime" if keep is not None else "none", first)
