"""The facts of a conversation's turns are read from and written to the state store once a batch."""

import json
import random

from pyspark.sql import Row

from ledgerloom.streaming.exchanges import ConversationFacts, merged


class OneValue:
    def __init__(self):
        self.value, self.calls = None, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value


def test_one_read_and_one_write_a_batch():
    state, processor = OneValue(), ConversationFacts()
    processor.init(state)
    facts = [{"income": 100.5 + k, "expenses": [{"category": f"c{k % 7}", "amount": 1.5 * k}], "goals": ["boat"]} for k in range(60)]
    row = lambda k, reply: Row(turn=k, reply_ms=k, reply=reply, facts=json.dumps(facts[k]))
    order = random.Random(5).sample(range(60), 60)
    seen: set[int] = set()
    for part in (order[:25], order[25:], order[:3]):
        state.calls.clear()
        got = list(processor.handleInputRows((9,), iter([row(k, r) for k in part for r in ("b", None, "a")]), None))
        fresh = set(part) - seen
        seen |= set(part)
        assert state.calls == ["get", "update"] if fresh else ["get"]
        assert [(r["turn"], r["reply"]) for r in got] == [(k, r) for k in sorted(part) for r in ("a", "b", None)]
        for r in got:
            known = [facts[k] for k in sorted(seen) if k <= r["turn"]]
            assert r["conv_id"] == 9 and r["n_turns"] == len(known) and json.loads(r["facts"]) == merged(known)
