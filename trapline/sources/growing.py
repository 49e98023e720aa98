"""Files that grow: a streaming source of the whole lines appended to them.

The offset of a batch says, for every file, how many bytes have been read and what the
file began with. A batch reads what lies between two offsets, in ranges of bytes that
tasks share, so one large file keeps many tasks busy and many small files make one task. A line
is read once it ends in a line feed; what stands behind the last one waits.

A file that is shorter than what was read of it, or that begins with other bytes, has been
started anew and is read from its beginning. One that begins like a file that has gone or
been started anew has been renamed or copied, and goes on where that was left, provided
there are ``HEAD`` bytes to compare.

Files are found and read through the file system that the path names (local, HDFS or an
object store), below it at any depth; names that begin with a dot or underscore are left out.
The driver keeps one short entry for each file present.
"""

from __future__ import annotations

import fnmatch
import hashlib
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# Executors need not have this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEAD = 256
RANGE_BYTES = 32 << 20
BLOCK = 1 << 20
TAIL = 4 << 10
#: Files of one task, besides its bytes: opening one takes about as long as reading so much.
FILES_PER_TASK = 256
FORMAT = "growing_lines"


def file_system(path: str):
    """The file system that a path names, and the path within it."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _digest(file, size: int) -> str:
    file.seek(0)
    return hashlib.md5(file.read(size)).hexdigest()


def _whole_lines(file, size: int) -> int:
    """Bytes up to the last line feed among the first ``size``."""
    at, step = size, TAIL
    while at > 0:
        begin = max(0, at - step)
        file.seek(begin)
        found = file.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at, step = begin, min(4 * step, BLOCK)
    return 0


@dataclass
class ByteRange:
    """The lines of a file that begin from ``begin`` on and before ``end``; ``low`` begins a line and ``stop`` ends one."""

    path: str
    low: int
    begin: int
    end: int
    stop: int
    head: str
    head_size: int


@dataclass
class ByteRanges(InputPartition):
    """What one task reads: a range of a large file, or several of small ones."""

    ranges: list[ByteRange]


def _share(ranges: list[ByteRange], task_bytes: int, cores: int) -> list[ByteRanges]:
    """Ranges dealt to tasks of at most ``task_bytes``, and to no fewer tasks than there are cores if there is work for them."""
    task_bytes = min(task_bytes, max(BLOCK, sum(r.end - r.begin for r in ranges) // cores))
    tasks, held = [], 0
    for r in ranges:
        if not tasks or held + r.end - r.begin > task_bytes or len(tasks[-1].ranges) >= FILES_PER_TASK:
            tasks.append(ByteRanges([]))
            held = 0
        tasks[-1].ranges.append(r)
        held += r.end - r.begin
    return tasks


class GrowingReader(DataSourceStreamReader):
    def __init__(self, path: str, pattern: str, from_end: bool, range_bytes: int, cores: int = 1):
        self.path, self.pattern, self.from_end, self.range_bytes, self.cores = path, pattern, from_end, range_bytes, cores

    def _files(self) -> dict[str, dict]:
        from pyarrow import fs

        system, base = file_system(self.path)
        found = {}
        for info in system.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True)):
            below = info.path[len(base):].strip("/")
            hidden = any(part.startswith((".", "_")) for part in below.split("/"))
            if info.type != fs.FileType.File or hidden or not fnmatch.fnmatch(info.base_name, self.pattern):
                continue
            try:
                with system.open_input_file(info.path) as file:
                    end = _whole_lines(file, info.size or 0)
                    size = min(end, HEAD)
                    found[info.path] = {"end": end, "head": _digest(file, size), "head_size": size}
            except FileNotFoundError:  # it has gone since it was listed
                continue
        return found

    def initialOffset(self) -> dict:
        return {"files": self._files() if self.from_end else {}}

    def latestOffset(self) -> dict:
        return {"files": self._files()}

    def _begins_like(self, path: str, entry: dict, now: dict) -> bool:
        """Whether a file still begins with the bytes that an earlier entry tells of."""
        if entry["head_size"] == now["head_size"]:
            return entry["head"] == now["head"]
        if entry["head_size"] > now["head_size"]:
            return False
        system, _ = file_system(self.path)
        with system.open_input_file(path) as file:
            return _digest(file, entry["head_size"]) == entry["head"]

    def partitions(self, start: dict, end: dict) -> list[ByteRanges]:
        before, now = start["files"], end["files"]
        read = {p: before[p]["end"] for p, e in now.items() if p in before and e["end"] >= before[p]["end"] and self._begins_like(p, before[p], e)}
        left = {e["head"]: e["end"] for p, e in before.items() if p not in read and e["head_size"] == HEAD}
        ranges = []
        for path, entry in sorted(now.items()):
            moved = left.get(entry["head"], 0) if entry["head_size"] == HEAD else 0
            low = read.get(path, moved if moved <= entry["end"] else 0)
            for begin in range(low, entry["end"], self.range_bytes):
                stop = min(begin + self.range_bytes, entry["end"])
                ranges.append(ByteRange(path, low, begin, stop, entry["end"], entry["head"], entry["head_size"]))
        return _share(ranges, self.range_bytes, self.cores)

    def read(self, partition: ByteRanges) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        for part in partition.ranges:
            try:
                file = system.open_input_file(part.path)
            except FileNotFoundError:
                continue
            with file:
                # A file that was started anew since the batch was planned has none of its lines left.
                if _digest(file, part.head_size) == part.head:
                    yield from _lines(file, part)

    def commit(self, end: dict) -> None:
        pass


def _lines(file, part: ByteRange) -> Iterator[pa.RecordBatch]:
    at = part.begin
    if at > part.low:  # up to the line feed at or after the byte before
        at -= 1
        file.seek(at)
        while True:
            block = file.read(min(BLOCK, part.stop - at))
            found = block.find(b"\n")
            at += found + 1 if found >= 0 else len(block)
            if found >= 0 or not block:
                break
    file.seek(at)
    rest = b""
    while at < part.end:  # every block begins a line
        block = file.read(min(BLOCK, part.stop - at - len(rest)))
        if not block:
            break
        block = rest + block
        cut = block.rfind(b"\n") + 1
        if at + cut > part.end:  # the line that holds the range's last byte is its last
            feed = block.find(b"\n", max(part.end - at - 1, 0))
            cut = cut if feed < 0 else feed + 1
        if cut:
            yield _batch(block[:cut], at, part.path)
        at += cut
        rest = block[cut:]


def _batch(block: bytes, at: int, path: str) -> pa.RecordBatch:
    """Rows of whole lines, the first of which stands at ``at``; taken apart as arrays unless their bytes are no UTF-8."""
    data = np.frombuffer(block, np.uint8)
    feeds = np.flatnonzero(data == 10)
    begins = np.concatenate([[0], feeds[:-1] + 1])
    # A carriage return before the line feed goes with it.
    returns = (feeds > begins) & (data[feeds - 1] == 13)
    try:
        block.decode("utf-8")
        kept = np.ones(len(data), bool)
        kept[feeds] = False
        kept[feeds[returns] - 1] = False
        ends = np.cumsum(feeds - begins - returns)
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        values = pa.StringArray.from_buffers(len(feeds), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[kept].tobytes()))
    except UnicodeDecodeError:
        values = pa.array([line.removesuffix(b"\r").decode("utf-8", "replace") for line in block[:-1].split(b"\n")], pa.string())
    return pa.RecordBatch.from_arrays(
        [values, pa.repeat(pa.scalar(path, pa.string()), len(feeds)), pa.array(begins + at, pa.int64())], ["value", "path", "place"])


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value string, path string, place long"

    def streamReader(self, schema) -> GrowingReader:
        given = self.options
        return GrowingReader(given["path"], given.get("pattern", "*"), given.get("from_end", "false") == "true",
                             int(given.get("range_bytes", RANGE_BYTES)), int(given.get("cores", 1)))


def growing_lines(
    spark: SparkSession, path: str, pattern: str = "*", from_end: bool = False, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Stream of ``value, path, place`` (the line's first byte) for every line that is or will be in the files.

    ``from_end`` leaves out what is there when the stream runs for the first time.
    """
    spark.dataSource.register(GrowingLines)
    return (spark.readStream.format(FORMAT).option("pattern", pattern).option("from_end", str(from_end).lower())
            .option("range_bytes", range_bytes).option("cores", spark.sparkContext.defaultParallelism).load(path))
