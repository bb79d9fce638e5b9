"""JSON lines as a Python data source: byte ranges, exact places, a stream, and a sink that commits.

``spark.read.format("records")`` gives (ord, file, at, value): a line's place among all, its file,
the byte where it begins, its text. Lines stay text, so Spark parses them and prunes columns.

* Ranges. Files are cut into ranges of bytes; a range owns the lines that begin in it, so a file
  of any size is read by many tasks and none reads ahead further than its last line.
* Places. ``ord`` needs to know how many lines the ranges before hold. :func:`read_records` counts
  them first, a number a range, and hands the counts over; without them ord is null. With
  them, filters on ord and on file leave out whole ranges.
* Sink. Tasks write files aside; the commit of a job (of a stream: of a batch) moves them into
  place and last writes a manifest, which is what readers go by. A job that fails leaves
  nothing that is read (tasks that still run when it is given up may leave files aside), and a batch
  that runs again finds itself there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
    InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage)

from .jsonl import CLEANED

NAME = "records"
LINE = "ord long, file string, at long, value string"
COUNT = "k int, n long"
RANGE = 32 << 20
MOST_RANGES = 100_000  # ranges grow rather than being more than so many, as the driver plans each
MOST_TASKS = 192  # a task reads neighbouring ranges one after another rather than being one of more than about so many: to start a Python task costs more than to read a range
AHEAD = 1 << 12  # bytes beyond a range that are read at once for the end of its last line; twice as many each time it is not found
BATCH = 4096
_MANIFEST, _STAGING = "_committed-", "_staging"


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """(file, size) in order of names. A folder with manifests holds what they name, and else all
    files that do not begin with a dot or an underscore."""
    system, at = _filesystem(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [(at, info.size)]
    found = [f for f in system.get_file_info(fs.FileSelector(at)) if f.is_file]
    manifests = [f.path for f in found if f.base_name.startswith(_MANIFEST)]
    named = {n for m in manifests for n in json.loads(system.open_input_file(m).read())["files"]}
    plain = [f for f in found if not f.base_name.startswith((".", "_")) and (not manifests or f.base_name in named)]
    return sorted((f.path, f.size) for f in plain)


@dataclass
class Range(InputPartition):
    k: int
    file: str
    start: int
    end: int
    ord: int | None = None
    more: tuple[Range, ...] = ()  # neighbours in the file that the same task reads


def together(parts: list[Range]) -> list[Range]:
    """The same ranges, neighbours of a file as one task where they are more than MOST_TASKS."""
    step, out = -(-len(parts) // MOST_TASKS), []
    for part in parts:
        if out and out[-1].file == part.file and len(out[-1].more) + 1 < step:
            out[-1].more += (part,)
        else:
            out.append(part)
    return out


def ranges(files: list[tuple[str, int]], size: int) -> list[Range]:
    size = max(size, sum(n for _, n in files) // MOST_RANGES + 1)
    out = []
    for file, n in files:
        out += [Range(len(out) + j, file, at, min(at + size, n)) for j, at in enumerate(range(0, n, size))]
    return out


def lines(system: fs.FileSystem, part: Range) -> Iterator[tuple[int, bytes]]:
    """(at, line) of the lines that begin in a range, without blank ones."""
    with system.open_input_file(part.file) as f:
        begin = max(0, part.start - 1)  # the byte before tells whether a line begins at the start
        data = f.read_at(part.end - begin, begin)
        at = data.find(b"\n") + 1 if part.start else 0
        if part.start and not 0 < at < len(data):  # no line begins here
            return
        if not data.endswith(b"\n"):  # the last line ends beyond the range
            held, step = [data], AHEAD
            stop = begin + len(data)
            while more := f.read_at(step, stop):
                end = more.find(b"\n") + 1
                held.append(more[:end] if end else more)
                if end:
                    break
                stop, step = stop + len(more), min(step * 2, 1 << 22)
            data = b"".join(held)
        while at < len(data) and begin + at < part.end:
            end = data.find(b"\n", at)
            end = len(data) if end < 0 else end
            line = data[at:end].removesuffix(b"\r")
            if line.strip():
                yield begin + at, line
            at = end + 1


class _Reader:
    def __init__(self, options: dict) -> None:
        self.path, self.counting = options["path"], options.get("count", "false") == "true"
        self.size = int(options.get("range", RANGE))

    def batches(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(self.path)
        if self.counting:
            yield pa.RecordBatch.from_arrays([pa.array([part.k], pa.int32()), pa.array([sum(1 for _ in lines(system, part))], pa.int64())], ["k", "n"])
            return
        held, place = [], part.ord

        def batch():
            ords = [None] * len(held) if place is None else list(range(place, place + len(held)))
            return pa.RecordBatch.from_arrays([
                pa.array(ords, pa.int64()), pa.array([part.file] * len(held)), pa.array([a for a, _ in held], pa.int64()),
                pa.array([v.decode("utf-8", "replace") for _, v in held], pa.string())], ["ord", "file", "at", "value"])

        for row in lines(system, part):
            held.append(row)
            if len(held) == BATCH:
                yield batch()
                place, held = None if place is None else place + len(held), []
        if held:
            yield batch()


class RecordsReader(_Reader, DataSourceReader):
    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.counts = json.loads(options["counts"]) if "counts" in options else None
        self.low, self.high, self.files = 0, None, None
        if "first" in options:
            self.high = int(options["first"])

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on ord and file leave out ranges; Spark still tests every row."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("ord",):
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    high = f.value + (not isinstance(f, LessThan))
                    self.high = high if self.high is None else min(self.high, high)
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif column == ("file",) and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.files = wanted if self.files is None else self.files & wanted
            yield f

    def partitions(self) -> list[Range]:
        out, before = [], 0
        for part in ranges(listed(self.path), self.size):
            n = self.counts[part.k] if self.counts is not None else None
            if n is not None:
                part.ord = before
                before += n
                if not n or before <= self.low or self.high is not None and part.ord >= self.high:
                    continue
            if self.files is None or part.file in self.files:
                out.append(part)
        return together(out) or [Range(0, "", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for part in (partition, *partition.more) if partition.file else ():
            yield from self.batches(part)


class RecordsStream(_Reader, DataSourceStreamReader):
    """What is appended to the files of a folder, whole lines only; offsets are bytes by file."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, _ = _filesystem(self.path)
        return {file: self._whole(system, file, size) for file, size in listed(self.path)}

    @staticmethod
    def _whole(system: fs.FileSystem, file: str, size: int) -> int:
        """The end of the last whole line."""
        with system.open_input_file(file) as f:
            while size:
                begin = max(0, size - (1 << 16))
                at = f.read_at(size - begin, begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                size = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out: list[Range] = []
        for file, stop in sorted(end.items()):
            out += [Range(len(out) + j, file, at, min(at + self.size, stop)) for j, at in enumerate(range(start.get(file, 0), stop, self.size))]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from self.batches(partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    """Where a task has written: folder and file aside. A stream's commit is another object than its tasks'."""

    job: str
    name: str | None


class _Sink:
    """Files aside, then in place, then the manifest. Messages name what each task has written."""

    def __init__(self, path: str, overwrite: bool = False) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context, out, name = TaskContext.get(), None, None
        system, at = _filesystem(self.path)
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.jsonl"
                        system.create_dir(f"{at}/{_STAGING}/{self.job}", recursive=True)
                        out = system.open_output_stream(f"{at}/{_STAGING}/{self.job}/{name}")
                    out.write(json.dumps({k: v for k, v in row.items() if v is not None}, ensure_ascii=False, default=str).encode() + b"\n")
        finally:
            if out is not None:
                out.close()
        return Written(self.job, name)

    def finish(self, messages: list[Written | None], job: str) -> None:
        system, at = _filesystem(self.path)
        system.create_dir(at, recursive=True)
        manifest = f"{at}/{_MANIFEST}{job}.json"
        if system.get_file_info(manifest).is_file:  # this batch has been committed before
            return self.drop(messages)
        old = [f.path for f in system.get_file_info(fs.FileSelector(at)) if f.is_file] if self.overwrite else []
        names = []
        for m in messages:
            if m is not None and m.name:
                names.append(f"{m.name.removesuffix('.jsonl')}-{job}.jsonl")
                system.move(f"{at}/{_STAGING}/{m.job}/{m.name}", f"{at}/{names[-1]}")
        with system.open_output_stream(f"{at}/{_STAGING}-{self.job}.json") as f:
            f.write(json.dumps({"files": sorted(names)}).encode())
        system.move(f"{at}/{_STAGING}-{self.job}.json", manifest)
        for path in sorted(old, key=lambda p: f"/{_MANIFEST}" not in p):  # manifests first: none may name a file that is gone
            system.delete_file(path)
        self.drop(messages)

    def drop(self, messages: list[Written | None]) -> None:
        system, at = _filesystem(self.path)
        for job in {self.job} | {m.job for m in messages if m is not None}:
            if system.get_file_info(f"{at}/{_STAGING}/{job}").type == fs.FileType.Directory:
                system.delete_dir(f"{at}/{_STAGING}/{job}")


class RecordsWriter(_Sink, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self.finish(messages, self.job)

    def abort(self, messages: list[Written | None]) -> None:
        self.drop(messages)


class RecordsStreamWriter(_Sink, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.finish(messages, f"batch-{batchId}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.drop(messages)


class Records(DataSource):
    """Options: path; range, the bytes of a range; count, to count lines by range instead; counts and first, see :func:`read_records`."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return COUNT if self.options.get("count", "false") == "true" else LINE

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return RecordsReader(dict(self.options))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return RecordsStream(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return RecordsWriter(self.options["path"], overwrite)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return RecordsStreamWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to a session; a reader that takes filters needs them switched on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Records)


def count_ranges(spark: SparkSession, path: str, size: int) -> list[int]:
    """The lines of each range."""
    register(spark)
    counts = [0] * len(ranges(listed(path), size))
    counted = spark.read.format(NAME).option("path", path).option("range", size).option("count", "true").load()
    for k, n in counted.where("n > 0").collect():  # a number a range, MOST_RANGES at most
        counts[k] = n
    return counts


def _lines_of(spark: SparkSession, path: str, size: int, first: int | None) -> DataFrame:
    counts = count_ranges(spark, path, size)
    source = spark.read.format(NAME).option("path", path).option("range", size).option("counts", json.dumps(counts))
    return (source if first is None else source.option("first", first)).load()


def read_records(spark: SparkSession, path: str, schema: T.StructType = CLEANED, first: int | None = None, size: int = RANGE) -> DataFrame:
    """Records of a file or folder with ``ord``, their place from 0 in order of file names and lines.

    Blank lines do not count. A line that is no JSON gives nulls. first: only so many records,
    of which the ranges behind are not read. The files must not change meanwhile.
    """
    rows = _lines_of(spark, path, size, first)
    rows = rows if first is None else rows.where(F.col("ord") < first)
    return rows.select("ord", F.from_json("value", schema).alias("r")).select("ord", "r.*")


def write_records(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Rows as JSON lines, all of them or none; null fields are left out."""
    register(rows.sparkSession)
    rows.write.format(NAME).mode("overwrite" if overwrite else "append").option("path", path).save()
