"""A range of bytes reads little more than itself, whatever its file's size."""

import pytest
from pyarrow import fs

from ledgerloom.sources import records as R


class _Counted:
    """A file system whose files tell how many bytes were read."""

    def __init__(self):
        self.read = 0

    def open_input_file(self, path):
        outer, f = self, fs.LocalFileSystem().open_input_file(path)

        class File:
            def __enter__(self):
                return self

            def __exit__(self, *_):
                f.close()

            def size(self):
                return f.size()

            def read_at(self, n, at):
                data = f.read_at(n, at)
                outer.read += len(data)
                return data

        return File()


def _read(at, size):
    system = _Counted()
    got = [row for part in R.ranges(R.listed(str(at)), size) for row in R.lines(system, part)]
    return got, system.read


@pytest.mark.parametrize("size", [1 << 14, 1 << 16])
def test_ranges_stop_behind_their_last_line(tmp_path, size):
    want = [b"%06d" % k + b"x" * 994 for k in range(3000)]
    (tmp_path / "a.jsonl").write_bytes(b"\n".join(want))
    got, read = _read(tmp_path / "a.jsonl", size)
    assert got == [(1001 * k, line) for k, line in enumerate(want)]
    assert read < 1.5 * 3_003_000


def test_ranges_within_a_long_line_read_themselves_alone(tmp_path):
    want = [b"a", b"b" * 3_000_000, b"c" * 10, b"d" * 70_000, b"e"]
    (tmp_path / "a.jsonl").write_bytes(b"\n".join(want) + b"\n")
    got, read = _read(tmp_path / "a.jsonl", 1 << 15)
    assert [line for _, line in got] == want
    assert read < 3 * 3_070_000
