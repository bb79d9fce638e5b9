"""Conversations, advice and memories as mutable tables on a change log."""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .listings import derived_title
from .memory import redact_sensitive
from .store import ChangeLog

_S, _B, _D = T.StringType(), T.BooleanType(), T.DoubleType()
_TURNS = T.ArrayType(T.StructType([T.StructField("role", _S), T.StructField("content", _S)]))
SCHEMAS = {
    "conversations": T.StructType([T.StructField(n, t) for n, t in (("id", _S), ("user_id", _S), ("title", _S), ("messages", _TURNS), ("created_at", _S), ("updated_at", _S))]),
    "advice": T.StructType([T.StructField(n, t) for n, t in (
        ("id", _S), ("conversation_id", _S), ("timestamp", _S), ("category", _S), ("short_title", _S), ("key_recommendation", _S), ("full_text", _S), ("source_question", _S), ("saved", _B))]),
    "memories": T.StructType([T.StructField(n, t) for n, t in (
        ("id", _S), ("user_id", _S), ("conversation_id", _S), ("content", _S), ("category", _S), ("importance", _D), ("created_at", _S), ("updated_at", _S), ("last_accessed_at", _S))]),
}


class Store:
    """The three tables under one folder. A method that names an owner touches only theirs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.log, self._lock, self._last = spark, ChangeLog(spark, folder, SCHEMAS), threading.Lock(), 0
        for name in SCHEMAS:
            if not self.log.exists(name):  # an empty first file, so that reading works
                self.log.append(name, spark.createDataFrame([], self.log._schema(name)), "I")

    def _version(self) -> int:
        """Later calls get larger versions, within the process and by the clock across them."""
        with self._lock:
            self._last = max(self._last + 1, time.time_ns())
            return self._last

    @staticmethod
    def _now() -> str:
        return time.strftime("%Y-%m-%dT%H:%M:%S+00:00", time.gmtime())

    def _write(self, name: str, op: str, **values) -> None:
        fields = [f for f in self.log._schema(name).fields if f.name in values]
        rows = self.spark.createDataFrame([(self._version(), *[values[f.name] for f in fields])], T.StructType([T.StructField("version", T.LongType()), *fields]))
        self.log.append(name, rows, op)

    def table(self, name: str) -> DataFrame:
        return self.log.latest(name, "id").drop("version")

    def _has(self, name: str, id_: str, user_id: str | None = None) -> bool:
        rows = self.table(name).where(F.col("id") == id_)
        return bool((rows if user_id is None else rows.where(F.col("user_id") == user_id)).limit(1).count())

    def compact(self) -> None:
        """Rewrites the tables as their current rows; see :meth:`ChangeLog.compact`."""
        for name in SCHEMAS:
            self.log.compact(name, "id")

    # conversations

    def create_conversation(self, messages: list[dict[str, str]], user_id: str = "anonymous", title: str | None = None) -> str:
        first = next((m["content"] for m in messages if m["role"] == "user"), None)
        if title is None:
            title = self.spark.createDataFrame([(first,)], "t string").select(derived_title(F.col("t")).alias("t")).first()["t"]
        id_, now = uuid.uuid4().hex, self._now()
        self._write("conversations", "I", id=id_, user_id=user_id, title=title, messages=[(m["role"], m["content"]) for m in messages], created_at=now, updated_at=now)
        return id_

    def conversation(self, id_: str) -> DataFrame:
        return self.table("conversations").where(F.col("id") == id_)

    def update_conversation(self, id_: str, messages: list[dict[str, str]]) -> None:
        self._write("conversations", "U", id=id_, messages=[(m["role"], m["content"]) for m in messages], updated_at=self._now())

    def rename_conversation(self, id_: str, title: str) -> bool:
        """Leaves updated_at as it is."""
        if not self._has("conversations", id_):
            return False
        self._write("conversations", "U", id=id_, title=title)
        return True

    def delete_conversation(self, id_: str, user_id: str) -> bool:
        """Advice of the conversation goes with it, but only if the owner matches."""
        if not self._has("conversations", id_, user_id):
            return False
        self._write("conversations", "D", id=id_)
        doomed = self.table("advice").where(F.col("conversation_id") == id_).select("id", F.lit(self._version()).alias("version"))
        self.log.append("advice", doomed, "D")
        return True

    def conversations(self, user_id: str) -> DataFrame:
        rows = self.table("conversations").where(F.col("user_id") == user_id)
        last = F.coalesce(F.try_element_at("messages", F.lit(-1))["content"], F.lit(""))
        return rows.select("id", "user_id", "title", "created_at", "updated_at", last.alias("last_message")).orderBy(F.desc("updated_at"), "id")

    # advice

    def add_advice(self, items: DataFrame, conversation_id: str | None = None) -> None:
        """Items as :func:`advice.structured` makes them, with source_question."""
        rows = items.select(
            F.expr("replace(uuid(), '-', '')").alias("id"), F.lit(conversation_id).cast("string").alias("conversation_id"), F.lit(self._now()).alias("timestamp"), "category", "short_title", "key_recommendation",
            "full_text", "source_question", F.lit(False).alias("saved"), F.lit(self._version()).alias("version"))
        self.log.append("advice", rows, "I")

    def advice(self, category: str | None = None) -> DataFrame:
        rows = self.table("advice")
        return (rows.where(F.lower("category") == category.lower()) if category else rows).orderBy(F.desc("timestamp"), "id")

    def advice_item(self, id_: str) -> DataFrame:
        return self.table("advice").where(F.col("id") == id_)

    def save_advice(self, id_: str, saved: bool = True) -> bool:
        if not self._has("advice", id_):
            return False
        self._write("advice", "U", id=id_, saved=saved)
        return True

    # memories

    def create_memory(self, user_id: str, content: str, category: str, importance: float, conversation_id: str | None = None) -> str:
        id_, now = uuid.uuid4().hex, self._now()
        self._write("memories", "I", id=id_, user_id=user_id, conversation_id=conversation_id, content=self._plain(content), category=category, importance=float(importance), created_at=now, updated_at=now, last_accessed_at=now)
        return id_

    def _plain(self, content: str) -> str:
        return self.spark.createDataFrame([(content,)], "t string").select(redact_sensitive(F.col("t")).alias("t")).first()["t"]

    def memory(self, id_: str) -> DataFrame:
        return self.table("memories").where(F.col("id") == id_)

    def memories(self, user_id: str) -> DataFrame:
        return self.table("memories").where(F.col("user_id") == user_id).orderBy(F.desc("created_at"), "id")

    def update_memory(self, id_: str, user_id: str, **changes) -> bool:
        """Sets the given fields, those that are None stay; only for the owner."""
        if not self._has("memories", id_, user_id):
            return False
        changes = {k: v for k, v in changes.items() if v is not None}
        if "content" in changes:
            changes["content"] = self._plain(changes["content"])
        self._write("memories", "U", id=id_, updated_at=self._now(), **changes)
        return True

    def touch_memories(self, ids: DataFrame) -> None:
        """Marks memories (id) as used now."""
        self.log.append("memories", ids.select("id", F.lit(self._now()).alias("last_accessed_at"), F.lit(self._version()).alias("version")), "U")

    def delete_memory(self, id_: str, user_id: str) -> bool:
        if not self._has("memories", id_, user_id):
            return False
        self._write("memories", "D", id=id_)
        return True
