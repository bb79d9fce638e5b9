"""Turns and replies as two streams, joined by time, with the facts of a conversation as state.

A user's turn meets the replies of its conversation within ``within`` after it; both sides have
watermarks, so the join forgets turns that no reply can meet any more. Facts are kept by
turn, so a turn that comes late, but before the watermark, takes its place among the others,
and the merged facts are those of the turns in order.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.finance import with_facts

_TURN = "conv_id long, turn long, reply string, n_turns long, facts string"


def exchanges(turns: DataFrame, replies: DataFrame, within: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(conv_id, turn, ts, text, reply_ts, reply): each turn (conv_id, turn, ts, text) with the replies
    (conv_id, ts, reply) of its conversation that come no more than ``within`` after it.

    A row further behind the newest of its stream than ``late`` is dropped. A turn without a reply
    gives no row; one with several gives several.
    """
    asked = turns.select("conv_id", "turn", "ts", "text").withWatermark("ts", late)
    told = replies.select(F.col("conv_id").alias("reply_to"), F.col("ts").alias("reply_ts"), "reply").withWatermark("reply_ts", late)
    soon = (F.col("conv_id") == F.col("reply_to")) & (F.col("reply_ts") >= F.col("ts")) & (F.col("reply_ts") <= F.col("ts") + F.expr(f"interval {within}"))
    return asked.join(told, soon).drop("reply_to")


def merged(parts: list[dict]) -> dict:
    """The facts of several turns, in order, as one; see ``merge_facts`` for the rule."""
    out: dict[str, Any] = {"income": None, "expenses": [], "savings_balance": None, "savings_contributions": [], "debts": [], "debt_payments": [], "goals": []}
    seen: dict[str, set] = {"expenses": set(), "debts": set(), "goals": set()}
    keys = {"expenses": lambda x: x["category"].lower(), "debts": lambda x: (x["description"].lower(), round(x["amount"], 2)), "goals": lambda x: x}
    for facts in parts:
        for name in ("income", "savings_balance"):
            if facts.get(name) is not None:
                out[name] = facts[name]
        for name in ("savings_contributions", "debt_payments"):
            out[name] += facts.get(name) or []
        for name, key in keys.items():
            for x in facts.get(name) or []:
                if key(x) not in seen[name]:
                    seen[name].add(key(x))
                    out[name].append(x)
    return out


class ConversationFacts(StatefulProcessor):
    """Keeps the facts of each turn of a conversation; says the merged ones for each new exchange.

    A call of the state store costs more than the work on what it gives, and merging reads all turns
    anyway: they are one value, which a batch reads once and writes once, if it has a turn more.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getValueState("turns", "facts string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = sorted(rows, key=lambda r: (r["turn"], r["reply_ms"], r["reply"] is None, r["reply"] or ""))
        stored = self.turns.get()
        held = dict(json.loads(stored[0])) if stored else {}
        known = len(held)
        for r in new:
            if r["turn"] not in held:
                held[r["turn"]] = json.loads(r["facts"])
        turns = sorted(held)
        if len(held) > known:
            self.turns.update((json.dumps([(k, held[k]) for k in turns]),))
        told: dict[int, str] = {}
        for r in new:
            n = bisect_right(turns, r["turn"])
            if n not in told:
                told[n] = json.dumps(merged([held[k] for k in turns[:n]]))
            yield Row(conv_id=key[0], turn=r["turn"], reply=r["reply"], n_turns=n, facts=told[n])

    def close(self) -> None:
        pass


def conversation_facts(joined: DataFrame) -> DataFrame:
    """(conv_id, turn, reply, n_turns, facts): for each exchange of :func:`exchanges` the facts of its turn and the earlier ones.

    Several rows of a turn have the same text; its facts count once. Exchanges of one batch
    see each other; an exchange whose earlier turn comes in a later batch has seen less, which n_turns tells.
    """
    stated = with_facts(joined)
    kind = stated.schema["facts"].dataType
    rows = stated.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unix_millis("reply_ts").alias("reply_ms"), "reply", F.to_json("facts").alias("facts"))
    out = rows.groupBy("conv_id").transformWithState(ConversationFacts(), _TURN, "append", "none")
    return out.withColumn("facts", F.from_json("facts", kind))


def latest_facts(rows: DataFrame) -> DataFrame:
    """Of the rows that :func:`conversation_facts` has written, the last word on each conversation."""
    last: Column = F.max_by(F.struct("turn", "facts", "n_turns"), F.struct("turn", "n_turns"))
    return rows.groupBy("conv_id").agg(last.alias("r")).select("conv_id", "r.turn", "r.n_turns", "r.facts")
