"""A group takes no lines of a range behind its own."""

import json

from pyarrow import fs

from ledgerloom.sources import epochs as E
from ledgerloom.sources import records as R


def test_a_group_stops_at_its_last_line(tmp_path, monkeypatch):
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"id": k}) + "\n" for k in range(1000)))
    at, taken = str(tmp_path / "a.jsonl"), []

    def counted(system, part):
        for row in R.lines(system, part):
            taken.append(row)
            yield row

    monkeypatch.setattr(E, "lines", counted)
    reader = E.EpochReader({"path": at, "group": "10", "range": str(1 << 20), "counts": "[1000]", "seed": "3"})
    rows = [(p, o, json.loads(v)["id"]) for part in reader.partitions() for b in reader.read(part) for p, o, v in zip(*(c.to_pylist() for c in b.columns))]
    assert [r[0] for r in rows] == list(range(1000)) and sorted(r[1] for r in rows) == list(range(1000)) and all(o == i for _, o, i in rows)
    assert len(taken) == sum(range(10, 1001, 10))  # those before a group in its range, and its own
    assert sum(1 for _ in R.lines(fs.LocalFileSystem(), R.ranges(R.listed(at), 1 << 20)[0])) == 1000
