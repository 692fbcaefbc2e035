"""A streaming source of lines from logs that grow, by files and byte offsets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

HEAD, BLOCK = 4096, 1 << 16


class Lines(InputPartition):
    """Lines of a file that begin in [start, stop); `first` is where the tick's range of the file begins."""

    def __init__(self, path: str, first: int, start: int, stop: int):
        super().__init__((path, start))
        self.path, self.first, self.start, self.stop = path, first, start, stop


def _mark(source, size: int) -> str:
    """What tells a file from its successor under the same name: its first line, as far as 4,096 bytes."""
    source.seek(0)
    head = source.read(min(HEAD, size))
    return hashlib.sha256(head.split(b"\n", 1)[0]).hexdigest()[:16]


def _last_line_end(source, size: int) -> int:
    """The place behind the last newline within the first `size` bytes, 0 without any."""
    end = size
    while end > 0:
        begin = max(0, end - BLOCK)
        source.seek(begin)
        at = source.read(end - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        end = begin
    return 0


class LogStream(DataSourceStreamReader):
    def __init__(self, path: str, suffix: str, split: int):
        self.path, self.suffix, self.split = path, suffix, split

    def _files(self) -> tuple[FileSystem, list]:
        fs, root = FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (FileSystem.from_uri("file://" + self.path))
        found = fs.get_file_info(FileSelector(root, recursive=True, allow_not_found=True))
        return fs, sorted((f.path, f.size) for f in found if f.type == FileType.File and f.path.endswith(self.suffix) and not f.base_name.startswith(("_", ".")))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, files = self._files()
        out = {}
        for path, size in files:
            if size:
                with fs.open_input_file(path) as source:
                    end = _last_line_end(source, size)
                    if end:  # a first line that is not whole yet has no mark either
                        out[path] = [_mark(source, size), end]
        return out

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        out = []
        for path, (mark, stop) in sorted(end.items()):
            before = start.get(path)
            # another first line or fewer bytes: the file was replaced or cut, and what it holds now is new
            first = before[1] if before and before[0] == mark and before[1] <= stop else 0
            out += [Lines(path, first, at, min(at + self.split, stop)) for at in range(first, stop, self.split)]
        return out

    def read(self, partition: Lines) -> Iterator[tuple]:
        fs, _ = FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else FileSystem.from_uri("file://" + self.path)
        with fs.open_input_file(partition.path) as source:
            at, held = partition.start, b""
            if at > partition.first:  # the line that begins before belongs to the part before
                source.seek(at - 1)
                at -= 1
                while True:
                    block = source.read(BLOCK)
                    if not block:
                        return
                    cut = block.find(b"\n")
                    if cut >= 0:
                        at, held = at + cut + 1, block[cut + 1 :]
                        break
                    at += len(block)
            else:
                source.seek(at)
            while at < partition.stop:
                cut = held.find(b"\n")
                while cut < 0:
                    block = source.read(BLOCK)
                    if not block:
                        return
                    before = len(held)
                    held += block
                    cut = held.find(b"\n", before)
                yield partition.path, at, held[:cut].rstrip(b"\r").decode("utf-8", "replace")
                at, held = at + cut + 1, held[cut + 1 :]

    def commit(self, end: dict) -> None:
        """Nothing to release: files stay where they are."""


class GrowingLogs(DataSource):
    """Lines (file, offset, line) of all files under `path` that end with `suffix`, each once as files grow.

    Options: path (a folder of any file system that pyarrow opens), suffix ("" for all), split (bytes of a partition).
    Offsets are (mark, bytes) for each file. A line counts once its newline is there; until then it waits. A file whose
    first line is another, or that is shorter than what was read, was replaced or cut: all it holds is read anew. A file that
    is gone gives nothing more. Partitions are ranges of bytes; a line belongs to the range in which it begins, so a file of
    any size is many tasks. Lines are decoded as UTF-8 with replacement; an empty line is a line.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return "file string, offset long, line string"

    def streamReader(self, schema) -> LogStream:
        return LogStream(self.options["path"], self.options.get("suffix", ""), int(self.options.get("split", 32 << 20)))


def follow(spark: SparkSession, path: str, suffix: str = "", split: int = 32 << 20) -> DataFrame:
    """A stream of (file, offset, line) from logs that grow; see `GrowingLogs`."""
    spark.dataSource.register(GrowingLogs)
    return spark.readStream.format("growing_logs").option("path", path).option("suffix", suffix).option("split", split).load()
