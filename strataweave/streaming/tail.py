"""A streaming source over files that grow: complete new lines of every file, from where the last batch ended.

``spark.readStream.format("tail").option("path", folder).load()`` after
``spark.dataSource.register(TailSource)``. Rows are (path, start, value): a line and
the byte at which it begins. What follows a file's last newline is held back until
its newline comes. A file that was cut short, or whose beginning is another one, is
read anew from its start. Offsets live in the query's checkpoint, a few numbers a
file, so a restarted query goes on where it stood. Folders are opened through
``pyarrow.fs``: a mounted path, or a URI of a store that it knows.
``maxBytesPerTrigger`` bounds a batch; ``availableNow`` runs one batch, so leave the bound out with it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that one task reads, and bytes of a file's beginning that tell it from another file of its name.
SPLIT = 32 << 20
HEAD = 256
_BACK = 1 << 16


class Piece(InputPartition):
    """Lines of a file that begin in [start, stop)."""

    def __init__(self, path: str, start: int, stop: int, whole_line: bool):
        self.path, self.start, self.stop, self.whole_line = path, start, stop, whole_line


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.uri, self.glob = options["path"], options.get("glob", "*")
        self.most = int(options.get("maxbytespertrigger", options.get("maxBytesPerTrigger", 1 << 40)))
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT)))
        self.reached: dict[str, list[int]] = {}

    def _open(self):
        return pafs.FileSystem.from_uri(self.uri) if "://" in self.uri else (pafs.LocalFileSystem(), self.uri)

    def initialOffset(self) -> dict:
        return {"files": {}}

    def _files(self, fs, at: str) -> list:
        found = fs.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True))
        return sorted((f for f in found if f.type == pafs.FileType.File and fnmatch(f.base_name, self.glob)), key=lambda f: f.path)

    @staticmethod
    def _last_line_end(handle, low: int, high: int) -> int:
        """The byte after the last newline of [low, high), or ``low``."""
        while high > low:
            begin = max(low, high - _BACK)
            handle.seek(begin)
            at = handle.read(high - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            high = begin
        return low

    def latestOffset(self) -> dict:
        """Of each file: the end of its last complete line within the trigger's bytes, and the length and checksum of its beginning."""
        fs, at = self._open()
        out, left = {}, self.most
        for info in self._files(fs, at):
            known = self.reached.get(info.path)
            with fs.open_input_file(info.path) as f:
                begun = known[0] if known and self._continues(f, info.size, known) else 0
                stop = min(info.size, begun + max(0, left))
                end = self._last_line_end(f, begun, stop)
                if end == begun and stop < info.size and left == self.most:
                    end = self._last_line_end(f, begun, info.size)  # a line longer than a trigger's bytes goes alone
                f.seek(0)
                head = f.read(min(HEAD, end))
            left -= end - begun
            if end:
                out[info.path] = [end, len(head), zlib.crc32(head)]
            elif known and info.size == 0:
                out[info.path] = [0, 0, 0]
        self.reached = out
        return {"files": out}

    @staticmethod
    def _continues(handle, size: int, known: list[int]) -> bool:
        if size < known[0]:
            return False
        handle.seek(0)
        return zlib.crc32(handle.read(known[1])) == known[2]

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        fs, _ = self._open()
        out = []
        for path, reached in end["files"].items():
            known, stop = start["files"].get(path), reached[0]
            begin = 0
            if known and known[0] <= stop:
                with fs.open_input_file(path) as f:
                    f.seek(0)
                    begin = known[0] if zlib.crc32(f.read(known[1])) == known[2] else 0
            cuts = list(range(begin, stop, self.split))
            out += [Piece(path, a, min(a + self.split, stop), a == begin) for a in cuts]
        return out or [Piece("", 0, 0, True)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = self._open()
        with fs.open_input_stream(partition.path) if partition.start == 0 else fs.open_input_file(partition.path) as f:
            at = partition.start
            if not partition.whole_line:
                # The line that crosses the border belongs to the piece in which it begins.
                f.seek(at - 1)
                at = at - 1 + len(_until_newline(f))
            elif at:
                f.seek(at)
            held, starts, values = b"", [], []
            while at < partition.stop:
                block = f.read(_BACK)
                if not block:
                    break
                *lines, held = (held + block).split(b"\n")
                for line in lines:
                    if at >= partition.stop:
                        break
                    starts.append(at)
                    values.append(line.rstrip(b"\r").decode("utf-8", "replace"))
                    at += len(line) + 1
                if len(values) >= 4096:
                    yield _batch(partition.path, starts, values)
                    starts, values = [], []
        if values:
            yield _batch(partition.path, starts, values)

    def commit(self, end: dict) -> None:
        self.reached = {**end["files"], **self.reached}


def _until_newline(f) -> bytes:
    out = b""
    while block := f.read(_BACK):
        at = block.find(b"\n")
        if at >= 0:
            end = out + block[: at + 1]
            f.seek(f.tell() - len(block) + at + 1)
            return end
        out += block
    return out


def _batch(path: str, starts: list[int], values: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(values), pa.string()), pa.array(starts, pa.int64()), pa.array(values, pa.string())], names=["path", "start", "value"])


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "path string, start bigint, value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))
