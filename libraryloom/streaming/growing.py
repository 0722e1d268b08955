"""A streaming source for text files that grow: bytes appended since the last batch, complete lines only.

The offset of a stream is a byte place for each file, just after its last line feed, and a check sum of the file's first
bytes. What follows the last line feed waits. A file that became shorter, or whose first bytes changed, was begun anew:
it is read from its start and its rows say so. A large backlog is read in pieces by many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a piece that one task reads, of a step back to the last line feed, of the check sum, and of a batch of rows.
PIECE, STEP, HEAD, CHUNK = 16 << 20, 1 << 16, 256, 4 << 20
LINES = "path string, modified long, at long, reset boolean, value string"


class Piece(InputPartition):
    """Lines of one file that begin in [start, stop); none reaches beyond ``end``."""

    def __init__(self, path: str, modified: int, first: int, start: int, stop: int, end: int, reset: bool) -> None:
        self.path, self.modified, self.first, self.start, self.stop, self.end, self.reset = path, modified, first, start, stop, end, reset


def _last_line_end(f, size: int) -> int:
    """The place just after the last line feed of the first ``size`` bytes, 0 if there is none."""
    stop = size
    while stop > 0:
        start = max(0, stop - STEP)
        f.seek(start)
        at = f.read(stop - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        stop = start
    return 0


def _head(f, size: int) -> list[int]:
    n = min(size, HEAD)
    f.seek(0)
    return [n, zlib.crc32(f.read(n))]


class GrowingFilesReader(DataSourceStreamReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def _files(self) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
        system, root = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return system, sorted((x for x in found if x.type == fs.FileType.File and not x.base_name.startswith((".", "_"))), key=lambda x: (x.mtime_ns or 0, x.path))

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        system, found = self._files()
        out = {}
        for info in found:
            with system.open_input_file(info.path) as f:
                end = _last_line_end(f, info.size)
                if end:
                    out[info.path] = [end, *_head(f, end)]
        return {"files": out}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        system, found = self._files()
        modified = {x.path: (x.mtime_ns or 0) // 1000 for x in found}
        out = []
        for path, (stop, *_) in end["files"].items():
            place, n, crc = start["files"].get(path, (0, 0, 0))
            anew = place > stop
            if place and not anew:
                with system.open_input_file(path) as f:
                    anew = _head(f, n) != [n, crc]
            first = 0 if anew else place
            out += [Piece(path, modified.get(path, 0), first, at, min(at + PIECE, stop), stop, anew) for at in range(first, stop, PIECE)]
        return out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), "")
        schema = pa.schema([("path", pa.string()), ("modified", pa.int64()), ("at", pa.int64()), ("reset", pa.bool_()), ("value", pa.string())])
        with system.open_input_file(piece.path) as f:
            at = piece.start
            if at > piece.first:  # a line that began before belongs to the piece before
                f.seek(at - 1)
                while (chunk := f.read(STEP)) and (found := chunk.find(b"\n")) < 0:
                    at += len(chunk)
                at += found
            f.seek(at)
            rest = b""
            while at < piece.stop:
                chunk = f.read(min(CHUNK, piece.end - at - len(rest)))
                if not chunk:
                    break
                *lines, rest = (rest + chunk).split(b"\n")
                places, texts = [], []
                for line in lines:
                    if at >= piece.stop:
                        break
                    places.append(at)
                    texts.append(line.decode("utf-8", "replace"))
                    at += len(line) + 1
                if places:
                    k = len(places)
                    yield pa.RecordBatch.from_arrays([pa.array([piece.path] * k), pa.array([piece.modified] * k), pa.array(places), pa.array([piece.reset] * k), pa.array(texts)], schema=schema)


class GrowingFiles(DataSource):
    """``spark.readStream.format("growing_files").load(folder)``: columns of LINES.

    ``at`` is the byte place where a line begins and ``reset`` true where its file was begun anew since the last batch.
    Bytes that are no UTF-8 are replaced; a carriage return stays in the line. Files whose names begin with a point or an
    underscore are left out, and a folder that is not there yet is empty. A batch that runs again reads the same bytes as
    long as the file still has them.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema: StructType) -> GrowingFilesReader:
        return GrowingFilesReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the source known to a session."""
    spark.dataSource.register(GrowingFiles)
