"""Many small ranges and groups are read by a bounded number of tasks, all of them and in order."""

from ledgerloom.sources import epochs as E
from ledgerloom.sources import records as R


def _file(tmp_path, n):
    at = tmp_path / "a.jsonl"
    at.write_text("".join(f'{{"source": "s{k}"}}\n' for k in range(n)))
    return str(at)


def test_ranges_are_read_together(spark, tmp_path):
    at = _file(tmp_path, 3000)
    assert len(R.ranges(R.listed(at), 64)) > 600
    got = R.read_records(spark, at, size=64).select("ord", "source")
    assert got.rdd.getNumPartitions() <= R.MOST_TASKS
    assert [tuple(r) for r in got.collect()] == [(k, f"s{k}") for k in range(3000)]
    some = R.read_records(spark, at, first=5, size=64).select("ord", "source")
    assert some.rdd.getNumPartitions() <= 5 and sorted(r["ord"] for r in some.collect()) == [0, 1, 2, 3, 4]


def test_groups_are_read_together(spark, tmp_path):
    order = E.EpochOrder(spark, _file(tmp_path, 3000), seed=3, group=4, size=1 << 10)
    got = order.lines(1)
    assert got.rdd.getNumPartitions() <= R.MOST_TASKS
    rows = got.select("position", "ord").collect()
    assert [r[0] for r in rows] == list(range(3000)) and sorted(r[1] for r in rows) == list(range(3000))
    shards = [[r[0] for r in order.lines(1, 100, 2000, k, 2).select("position").collect()] for k in (0, 1)]
    assert sorted(shards[0] + shards[1]) == list(range(100, 2000)) and min(map(len, shards)) > 800
