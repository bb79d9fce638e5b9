"""Requests to the store as an application sends them: owners default, missing rows raise."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .tables import Store

ANONYMOUS = "anonymous"
LONGEST_TITLE = 100


class NotFound(LookupError):
    """There is no such row, or not with this owner."""


def _one(rows: DataFrame, kind: str, id_: str) -> DataFrame:
    if not rows.limit(1).count():
        raise NotFound(f"{kind} {id_!r}")
    return rows


def _done(ok: bool, kind: str, id_: str) -> str:
    if not ok:
        raise NotFound(f"{kind} {id_!r}")
    return id_


def list_advice(store: Store, category: str | None = None) -> DataFrame:
    return store.advice(category)


def get_advice(store: Store, id_: str) -> DataFrame:
    return _one(store.advice_item(id_), "advice", id_)


def save_advice(store: Store, id_: str) -> str:
    return _done(store.save_advice(id_), "advice", id_)


def list_conversations(store: Store, user_id: str | None = None) -> DataFrame:
    return store.conversations(user_id or ANONYMOUS)


def get_conversation(store: Store, id_: str) -> DataFrame:
    return _one(store.conversation(id_), "conversation", id_)


def rename_conversation(store: Store, id_: str, title: str) -> str:
    title = title.strip()
    if not title or len(title) > LONGEST_TITLE:
        raise ValueError(f"a title has 1 to {LONGEST_TITLE} characters")
    return _done(store.rename_conversation(id_, title), "conversation", id_)


def delete_conversation(store: Store, id_: str, user_id: str | None = None) -> str:
    return _done(store.delete_conversation(id_, user_id or ANONYMOUS), "conversation", id_)


def list_memories(store: Store, user_id: str | None = None) -> DataFrame:
    return store.memories(user_id or ANONYMOUS)


def delete_memory(store: Store, id_: str, user_id: str | None = None) -> str:
    return _done(store.delete_memory(id_, user_id or ANONYMOUS), "memory", id_)
