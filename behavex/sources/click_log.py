"""A raw-line log as a Spark data source: `spark.readStream.format("click_log").load(folder)`.

The log is a folder with a folder for each partition, and in it segments named `<arrival in epoch ms>.log`, to whose last one lines are
appended. The reader's offset is a segment and a byte position for each partition, always at the end of a line, so that a line that is being
written waits, a batch can be read again as it was, and the offset is no larger than the number of partitions. Of each batch a
partition's bytes are read in pieces of at most `piece` bytes, one task each. Any file system that Arrow knows will do."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from behavex.sources.files import Folder

SCHEMA = "partition string, segment string, position bigint, arrived timestamp, value string"
_TAIL, _BLOCK = 1 << 16, 1 << 20


class Piece(InputPartition):
    """Bytes [start, end) of a segment; lines that begin there belong to it."""

    def __init__(self, partition: str, segment: str, start: int, end: int):
        self.partition, self.segment, self.start, self.end = partition, segment, start, end


class Log:
    def __init__(self, folder: str, piece: int, most: int):
        self.folder, self.piece, self.most = folder, piece, most
        self._fs, self._root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)

    def partitions(self) -> list[str]:
        found = self._fs.get_file_info(fs.FileSelector(self._root, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.Directory and f.base_name[0] not in "_.")

    def segments(self, partition: str, first: str = "") -> list[tuple[str, int]]:
        """(name, bytes) of the segments from `first` on; other files are not the log's."""
        found = self._fs.get_file_info(fs.FileSelector(posixpath.join(self._root, partition), allow_not_found=True))
        names = [(f.base_name, f.size) for f in found if f.type == fs.FileType.File and f.base_name.endswith(".log") and f.base_name[:-4].isdigit()]
        return sorted((x for x in names if _number(x[0]) >= _number(first)), key=lambda x: _number(x[0]))

    def _open(self, partition: str, segment: str):
        return self._fs.open_input_file(posixpath.join(self._root, partition, segment))

    def whole_lines(self, partition: str, segment: str, start: int, size: int) -> int:
        """Where the last whole line before `size` ends."""
        with self._open(partition, segment) as f:
            end = size
            while end > start:
                begin = max(start, end - _TAIL)
                f.seek(begin)
                at = f.read(end - begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                end = begin
        return start

    def latest(self, since: dict[str, list]) -> dict[str, list]:
        """The offset up to which a batch may read: at most about `most` bytes of each partition beyond `since`."""
        out = dict(since)
        for p in self.partitions():
            segment, at = since.get(p, ["", 0])
            left = self.most
            found = self.segments(p, segment)
            for i, (name, size) in enumerate(found):
                start = at if name == segment else 0
                end = min(size, start + left)
                last = i + 1 == len(found)
                if last or end < size:
                    end = self.whole_lines(p, name, start, end) or start
                    if end == start and start + left < size:  # one line is longer than a batch may be
                        end = self._line_end(p, name, start, size)
                out[p] = [name, end]
                left -= end - start
                if left <= 0 or end < size:
                    break
        return out

    def _line_end(self, partition: str, segment: str, start: int, size: int) -> int:
        """Where the line that begins at start ends; start if it is not whole yet."""
        with self._open(partition, segment) as f:
            f.seek(start)
            at = start
            while at < size:
                block = f.read(min(_TAIL, size - at))
                found = block.find(b"\n")
                if found >= 0:
                    return at + found + 1
                at += len(block)
        return start

    def pieces(self, since: dict[str, list], to: dict[str, list]) -> list[Piece]:
        out = []
        for p, (last, end) in sorted(to.items()):
            segment, at = since.get(p, ["", 0])
            for name, size in self.segments(p, segment):
                if _number(name) > _number(last):
                    break
                start, stop = at if name == segment else 0, end if name == last else size
                out += [Piece(p, name, a, min(stop, a + self.piece)) for a in range(start, stop, self.piece)]
        return out

    def lines(self, piece: Piece) -> Iterator[tuple]:
        """The lines that begin in a piece, with the last one's end beyond it."""
        arrived = datetime.fromtimestamp(_number(piece.segment) / 1000, UTC)
        with self._open(piece.partition, piece.segment) as f:
            at = max(0, piece.start - 1)
            f.seek(at)
            skip, held = piece.start > 0, b""  # what is left of a line that began before belongs to the piece before
            while at < piece.end and (block := f.read(_BLOCK)):
                *whole, held = (held + block).split(b"\n")
                for raw in whole:
                    if at >= piece.end:
                        return
                    if not skip:
                        yield piece.partition, piece.segment, at, arrived, raw.rstrip(b"\r").decode("utf-8", "replace")
                    at, skip = at + len(raw) + 1, False


def _number(segment: str) -> int:
    return int(segment[:-4]) if segment else -1


class ClickLog(DataSource):
    """Options: path, the log's folder; piece, the bytes of a task; most, the bytes of a batch and partition."""

    @classmethod
    def name(cls) -> str:
        return "click_log"

    def schema(self) -> str:
        return SCHEMA

    def _log(self) -> Log:
        return Log(self.options["path"], int(self.options.get("piece", 64 << 20)), int(self.options.get("most", 1 << 40)))

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self._log())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self._log())


class _Batch(DataSourceReader):
    """The whole log at once."""

    def __init__(self, log: Log):
        self.log = log

    def partitions(self) -> list[Piece]:
        unbounded = Log(self.log.folder, self.log.piece, 1 << 62)
        return self.log.pieces({}, unbounded.latest({})) or [Piece("", "", 0, 0)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        return self.log.lines(partition) if partition.segment else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, log: Log):
        self.log, self.now = log, {}

    def initialOffset(self) -> dict:
        return {"at": {}}

    def latestOffset(self) -> dict:
        self.now = self.log.latest(self.now)
        return {"at": self.now}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.now = max((self.now, end["at"]), key=_order)  # after a restart, from where the stream is
        return self.log.pieces(start["at"], end["at"]) or [Piece("", "", 0, 0)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        return self.log.lines(partition) if partition.segment else iter(())

    def commit(self, end: dict) -> None:
        """Segments stay; who keeps the log decides for how long."""


def _order(offset: dict[str, list]) -> list:
    return sorted((p, _number(s), at) for p, (s, at) in offset.items())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ClickLog)


def append(lines: DataFrame, folder: str, arrived: int, partitions: int = 1) -> None:
    """Adds lines(value) as a new segment of each partition. Segments are written aside and moved in place whole."""
    aside = f"_aside-{uuid.uuid4().hex}"
    log = Folder(lines.sparkSession, folder)
    lines.select("value").repartition(partitions).write.text(f"{folder}/{aside}")
    for i, name in enumerate(n for n in log.names(aside) if n.startswith("part-")):
        Folder(lines.sparkSession, f"{folder}/partition={i}")
        log.move(f"{aside}/{name}", f"partition={i}/{arrived}.log")
    log.delete(aside)
