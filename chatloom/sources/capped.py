"""A stream of lines with a cap on the rows of a batch, whatever the size of the files.

`maxFilesPerTrigger` caps files; a file may hold any number of messages. This source reads a folder of files with one JSON message per
line, oldest file first, at most `cap` lines at a time, and its offset is the byte of a file at which the next batch begins, so a
restarted query goes on behind the last line it has committed. The rows of a batch pass the driver (a source of Spark's "simple" kind):
that is bounded by the cap, which is the point of it.

A micro-batch costs the same for a hundred rows as for a million, so a long folder can be drained by several queries side by side: the
lines are dealt in runs of `cap`, the runs go round the shares, and every share has offsets of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from chatloom.functions import fixed

FORMAT = "chatloom_capped_lines"
READ_BYTES = 1 << 16


class CappedLines(DataSource):
    """Options: `path`, a folder (sub-folders included), `cap`, the greatest number of rows of a batch, and `share` of `shares`."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        number = lambda name, default: int(self.options.get(name, default))
        return LineReader(self.options["path"], number("cap", fixed.ITEMS_PER_CYCLE), number("share", 0), number("shares", 1))


class LineReader(SimpleDataSourceStreamReader):
    """An offset names a file by its time and path, the byte behind the last line that was read in it, and the lines up to there.

    Files are taken in the order of time and path. A landed file doesn't change and is moved into the folder whole, behind those that
    have landed before. Line n belongs to share `n // cap % shares`.
    """

    def __init__(self, path: str, cap: int, share: int = 0, shares: int = 1):
        if cap < 1:
            raise ValueError("a batch needs room for a row")
        if not 0 <= share < shares:
            raise ValueError(f"there is no share {share} of {shares}")
        self.path, self.cap, self.share, self.shares = path, cap, share, shares

    def initialOffset(self) -> dict:
        return {"time": 0, "file": "", "byte": 0, "line": 0}

    def _files(self) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
        store, where = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        found = store.get_file_info(fs.FileSelector(where, recursive=True, allow_not_found=True))
        hidden = lambda f: any(p[:1] in ("_", ".") for p in f.path[len(where) :].split("/") if p)
        kept = [f for f in found if f.type == fs.FileType.File and f.size and not hidden(f)]
        return store, sorted(kept, key=lambda f: (f.mtime_ns, f.path))

    def _lines(self, start: dict, end: dict | None) -> Iterator[tuple[str, dict]]:
        """Lines after `start` (up to `end`), each with the offset behind it."""
        store, files = self._files()
        for f in files:
            at = (f.mtime_ns, f.path)
            if at < (start["time"], start["file"]) or (end is not None and at > (end["time"], end["file"])):
                continue
            begin = start["byte"] if at == (start["time"], start["file"]) else 0
            stop = end["byte"] if end is not None and at == (end["time"], end["file"]) else f.size
            with store.open_input_file(f.path) as data:
                data.seek(begin)
                held, read = b"", begin
                while read < stop or held:
                    block = data.read(min(READ_BYTES, stop - read)) if read < stop else b""
                    read += len(block)
                    held += block
                    *lines, held = held.split(b"\n")
                    if not block and held:  # the last line of a file may lack its end
                        lines, held = [held], b""
                    for line in lines:
                        begin = min(begin + len(line) + 1, f.size)
                        if line.strip():
                            yield line.decode("utf-8", "replace"), {"time": f.mtime_ns, "file": f.path, "byte": begin}
                    if not block:
                        break

    def _numbered(self, start: dict, end: dict | None) -> Iterator[tuple[bool, str, dict]]:
        """The lines, each with whether it is of this share; an offset of a checkpoint without shares has no number of lines."""
        for n, (line, behind) in enumerate(self._lines(start, end), start.get("line", 0)):
            yield n // self.cap % self.shares == self.share, line, behind | {"line": n + 1}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """At most `cap` lines of the share after `start`, and where the next batch begins; without such lines, `start`."""
        rows, offset = [], start
        for own, line, behind in self._numbered(start, None):
            if own:
                rows.append((line,))
                offset = behind
            if len(rows) == self.cap or rows and not own:
                break
        return iter(rows), offset

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The lines of a batch that runs again."""
        return iter([(line,) for own, line, _ in self._numbered(start, end) if own])


def capped_stream(spark: SparkSession, path: str, schema: str | StructType, cap: int = fixed.ITEMS_PER_CYCLE, share: int = 0, shares: int = 1) -> DataFrame:
    """A folder of JSON lines as a stream of at most `cap` rows per batch; a line that is no message has null fields.

    With `shares`, one of so many streams that together have every line once.
    """
    spark.dataSource.register(CappedLines)
    lines = spark.readStream.format(FORMAT).option("path", path).option("cap", cap).option("share", share).option("shares", shares).load()
    parsed = F.from_json("value", schema if isinstance(schema, StructType) else StructType.fromDDL(schema))
    return lines.select(parsed.alias("row")).select("row.*")
