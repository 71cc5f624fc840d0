"""A streaming source that follows growing text files, and a sink that appends a batch once.

``TailSource`` reads what is appended to the files of a folder, from the end of what was there
when it started. A file is known by its first line (and its inode where files are local), so a file
that was renamed goes on where it stood, and a new or truncated file under the old name starts at
its beginning. Only whole lines are taken; a started last line waits. Large growth is cut into
byte ranges, one task each.

With ``frames`` a batch holds a multiple of that many lines, up to ``most`` lines, and a smaller
rest is let through only when ``seconds`` have passed since the last batch. Offsets of such a
source are kept in the folder ``state`` as well, because a source is not told where it stands when
a query starts again.

``LogSink`` writes JSON lines. A batch is staged by the tasks and moved into place by one commit
record; a batch that runs again finds its record and adds nothing.

Paths are URIs that pyarrow's file systems open.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage,
)
from pyspark.sql import types as T

HEAD_BYTES = 4096
#: Bytes of appended text that one task reads.
SPLIT_BYTES = 32 << 20
STEP_BYTES = 1 << 20
BATCH_LINES = 50_000

LINES = "file string, at long, line string"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def identity(files: pafs.FileSystem, path: str) -> str | None:
    """A name that survives renaming; None while the first line is not whole."""
    with files.open_input_file(path) as stream:
        head = stream.read(HEAD_BYTES)
    end = head.find(b"\n")
    if end < 0 and len(head) < HEAD_BYTES:
        return None
    known = hashlib.sha1(head[:end] if end >= 0 else head).hexdigest()
    if isinstance(files, pafs.LocalFileSystem):
        known += f"-{os.stat(path).st_ino}"
    return known


def present(files: pafs.FileSystem, folder: str) -> dict[str, tuple[str, int]]:
    """Path and size of every file with a whole first line, by identity, in order of names."""
    found: dict[str, tuple[str, int]] = {}
    listed = files.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    for info in sorted(listed, key=lambda i: i.path):
        if info.type != pafs.FileType.File or not info.size:
            continue
        try:
            known = identity(files, info.path)
        except FileNotFoundError:  # renamed since the listing; found at the next one
            continue
        if known is None:
            continue
        if known in found:
            raise ValueError(f"{found[known][0]} and {info.path} begin alike and cannot be told apart")
        found[known] = (info.path, info.size)
    return found


def last_line_end(files: pafs.FileSystem, path: str, start: int, size: int) -> int:
    """The place after the last line break in [start, size); ``start`` where there is none."""
    with files.open_input_file(path) as stream:
        end = size
        while end > start:
            begin = max(start, end - STEP_BYTES)
            stream.seek(begin)
            at = stream.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return start


def after_lines(files: pafs.FileSystem, path: str, start: int, end: int,
                lines: int) -> tuple[int, int]:
    """The place after at most ``lines`` lines from ``start``, and how many there were."""
    seen, at = 0, start
    with files.open_input_file(path) as stream:
        stream.seek(start)
        while at < end:
            block = stream.read(min(STEP_BYTES, end - at))
            n = block.count(b"\n")
            if seen + n >= lines:
                cut = -1
                for _ in range(lines - seen):
                    cut = block.index(b"\n", cut + 1)
                return at + cut + 1, lines
            seen, at = seen + n, at + len(block)
    return end, seen


@dataclass
class Range(InputPartition):
    known: str
    path: str
    first: int
    begin: int
    end: int


class TailReader(DataSourceStreamReader):
    """Offsets are ``{identity: bytes taken}``."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.from_end = options.get("from", "end") == "end"
        self.frames = int(options.get("frames", 0))
        self.most = int(options.get("most", 0)) or self.frames
        self.seconds = float(options.get("seconds", 0))
        self.state = options.get("state")
        if self.frames and not self.state:
            raise ValueError("a tail that counts lines needs a folder for its state")
        self.last = time.monotonic()

    def initialOffset(self) -> dict:
        files, folder = file_system(self.folder)
        sizes = {known: size for known, (_, size) in present(files, folder).items()}
        taken = sizes if self.from_end else dict.fromkeys(sizes, 0)
        return taken

    def latestOffset(self) -> dict:
        files, folder = file_system(self.folder)
        now = present(files, folder)
        if self.frames:
            return self._counted(files, now)
        return {known: last_line_end(files, path, 0, size) for known, (path, size) in now.items()}

    def _counted(self, files: pafs.FileSystem, now: dict[str, tuple[str, int]]) -> dict:
        taken = self._kept()
        ends, spare, passed = {}, self.most, []
        for known, (path, size) in now.items():
            start = min(taken.get(known, 0), size)
            ends[known] = start
            whole = last_line_end(files, path, start, size)
            if spare and whole > start:
                ends[known], n = after_lines(files, path, start, whole, spare)
                spare -= n
                passed.append((known, path, start, n))
        lines = self.most - spare
        extra = lines % self.frames
        if extra and time.monotonic() - self.last < self.seconds:
            for known, path, start, n in reversed(passed):  # give the rest back
                back = min(extra, n)
                ends[known] = after_lines(files, path, start, ends[known], n - back)[0] if (
                    n > back) else start
                extra -= back
                if not extra:
                    break
        return ends

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if self.frames:
            self._keep(end)
            self.last = time.monotonic()
        files, folder = file_system(self.folder)
        now, ranges = present(files, folder), []
        for known, stop in end.items():
            first = start.get(known, 0)
            if stop <= first:
                continue
            if known not in now:
                raise FileNotFoundError(f"{stop - first} appended bytes of a file are gone")
            ranges += [Range(known, now[known][0], first, b, min(b + SPLIT_BYTES, stop))
                       for b in range(first, stop, SPLIT_BYTES)]
        return ranges

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """The lines that start in the range."""
        files, folder = file_system(self.folder)
        path = partition.path
        if not self._is(files, path, partition.known):  # renamed since it was planned
            path = present(files, folder)[partition.known][0]
        with files.open_input_file(path) as stream:
            begin = partition.begin
            stream.seek(max(begin - 1, partition.first))
            data = stream.read(partition.end - stream.tell())
            if begin > partition.first:  # the line that reaches in belongs to the range before
                cut = data.find(b"\n")
                data, begin = (b"", begin) if cut < 0 else (data[cut + 1:], begin + cut)
            while data and data[-1:] != b"\n":
                more = stream.read(STEP_BYTES)
                if not more:
                    break
                cut = more.find(b"\n")
                data += more if cut < 0 else more[:cut + 1]
        name, lines = os.path.basename(path), data.split(b"\n")
        if lines and not lines[-1]:
            lines.pop()
        for k in range(0, len(lines), BATCH_LINES):
            part = lines[k:k + BATCH_LINES]
            places = []
            for line in part:
                places.append(begin)
                begin += len(line) + 1
            yield pa.RecordBatch.from_arrays([
                pa.array([name] * len(part)), pa.array(places, pa.int64()),
                pa.array([x.decode("utf-8", "ignore") for x in part])], ["file", "at", "line"])

    def _is(self, files: pafs.FileSystem, path: str, known: str) -> bool:
        try:
            return identity(files, path) == known
        except FileNotFoundError:
            return False

    def _kept(self) -> dict:
        """Where the last planned batch ends; at first, where the source starts."""
        files, folder = file_system(self.state)
        if files.get_file_info(f"{folder}/taken.json").type != pafs.FileType.File:
            self._keep(self.initialOffset())
        with files.open_input_stream(f"{folder}/taken.json") as stream:
            return json.loads(stream.read())

    def _keep(self, taken: dict) -> None:
        files, folder = file_system(self.state)
        write_whole(files, f"{folder}/taken.json", json.dumps(taken).encode())


def write_whole(files: pafs.FileSystem, path: str, data: bytes) -> None:
    """Puts a small file in place at once."""
    folder, name = os.path.split(path)
    files.create_dir(folder, recursive=True)
    new = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(new) as stream:
        stream.write(data)
    files.move(new, path)


class TailSource(DataSource):
    """Options ``path``, ``from`` (``end`` or ``start``),
    ``frames``, ``most``, ``seconds``, ``state``."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema: T.StructType) -> TailReader:
        return TailReader(dict(self.options))


def registered(spark: SparkSession, source: type[DataSource]) -> str:
    """Makes a source known to a session and returns its name there.

    Spark looks a name up in the active session, or in the frame's, and takes it once in the active
    one; so every use has a name of its own, given to the frame's session first.
    """
    name = f"{source.name()}_{uuid.uuid4().hex}"
    named = type(source.__name__, (source,), {"name": classmethod(lambda cls: name)})
    spark.dataSource.register(named)
    try:
        SparkSession.active().dataSource.register(named)
    except AnalysisException as problem:  # the frame's session is the active one
        if problem.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
            raise
    return name


def tail(spark: SparkSession, folder: str, **options) -> DataFrame:
    """``file, at, line``: lines appended to the files of ``folder``; ``at`` counts bytes."""
    names = {k.rstrip("_"): str(v) for k, v in options.items()}
    return spark.readStream.format(registered(spark, TailSource)).options(
        path=folder, **names).load()


# --- the sink -----------------------------------------------------------------------------------

@dataclass
class Staged(WriterCommitMessage):
    path: str
    rows: int


class LogWriter(DataSourceStreamWriter):
    def __init__(self, path: str, names: list[str]):
        self.path = path
        self.names = names

    def write(self, rows: Iterator) -> Staged:
        files, folder = file_system(self.path)
        files.create_dir(f"{folder}/_staged", recursive=True)
        path, n = f"{folder}/_staged/{uuid.uuid4().hex}.json", 0
        with files.open_output_stream(path) as stream:
            for row in rows:
                record = dict(zip(self.names, row, strict=True))
                stream.write(json.dumps(record, ensure_ascii=False, default=str).encode() + b"\n")
                n += 1
        return Staged(path, n)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        files, folder = file_system(self.path)
        record = f"{folder}/_commits/{batchId:010d}.json"
        staged = [m for m in messages if m is not None]
        if files.get_file_info(record).type == pafs.FileType.File:
            self._drop(files, staged)
            return
        kept = []
        files.create_dir(f"{folder}/lines", recursive=True)
        for k, m in enumerate(m for m in staged if m.rows):
            name = f"lines/{batchId:010d}-{k:06d}.json"
            files.move(m.path, f"{folder}/{name}")  # over what a broken commit may have left
            kept.append({"file": name, "rows": m.rows})
        self._drop(files, [m for m in staged if not m.rows])
        write_whole(files, record, json.dumps({"batch": batchId, "files": kept}).encode())

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        files, _ = file_system(self.path)
        self._drop(files, [m for m in messages if m is not None])

    def _drop(self, files: pafs.FileSystem, staged: list[Staged]) -> None:
        for m in staged:
            if files.get_file_info(m.path).type == pafs.FileType.File:
                files.delete_file(m.path)


class LogSink(DataSource):
    """Option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "append_log"

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> LogWriter:
        return LogWriter(self.options["path"], schema.names)


def append(rows: DataFrame, path: str, checkpoint: str, **trigger):
    """Appends a stream's rows to the log at ``path``, every batch once."""
    name = registered(rows.sparkSession, LogSink)
    writer = (rows.writeStream.format(name).outputMode("append").option("path", path)
              .option("checkpointLocation", checkpoint))
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_log(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of all committed batches."""
    files, folder = file_system(path)
    names = []
    for info in files.get_file_info(pafs.FileSelector(f"{folder}/_commits", allow_not_found=True)):
        if info.base_name.startswith("."):
            continue
        with files.open_input_stream(info.path) as stream:
            names += [f["file"] for f in json.loads(stream.read())["files"]]
    reader = spark.read.schema(schema)
    return reader.json([f"{path}/{n}" for n in names]) if names else spark.createDataFrame([], schema)
