"""Data sources over growing text files: session transcripts and git logs, by ranges of bytes, in batches and as streams.

    spark.dataSource.register(Transcripts)
    spark.readStream.format("transcripts").load(folder)

Paths are those of pyarrow's file systems, so every executor must see the folder. A record belongs to the range in which it begins.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a range, and of a step when the end of a file is looked for.
RANGE, STEP = 1 << 25, 1 << 16


@dataclass
class Piece(InputPartition):
    """The records of a file that begin in [low, high) and end before `end`."""

    path: str
    low: int
    high: int
    end: int


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else posixpath.abspath(path))


def files(path: str, suffix: str) -> dict[str, int]:
    """Sizes of the files with the suffix under a folder, or of a file itself, by path."""
    from pyarrow import fs

    f, p = _fs(path)
    info = f.get_file_info([p])[0]
    found = [info] if info.type == fs.FileType.File else f.get_file_info(fs.FileSelector(p, allow_not_found=True, recursive=True))
    return {i.path: i.size for i in found if i.type == fs.FileType.File and i.path.endswith(suffix) and not i.base_name.startswith(("_", "."))}


def complete(f, path: str, low: int, size: int) -> int:
    """Where the last whole line before `size` ends; `low` if none ends behind it."""
    with f.open_input_file(path) as h:
        at = size
        while at > low:
            start = max(low, at - STEP)
            h.seek(start)
            cut = h.read(at - start).rfind(b"\n")
            if cut >= 0:
                return start + cut + 1
            at = start
    return low


def pieces(path: str, low: int, end: int, width: int) -> list[Piece]:
    return [Piece(path, at, min(end, at + width), end) for at in range(low, end, width)]


class _Files:
    """What batches and streams share: which lines begin a record and what rows a record gives."""

    suffix = ""

    def __init__(self, options):
        self.path, self.width, self.suffix = options["path"], int(options.get("range", RANGE)), options.get("suffix", self.suffix)

    def starts(self, line: bytes) -> bool:
        return True

    def rows(self, path: str, at: int, lines: list[bytes]) -> Iterator[tuple]:
        raise NotImplementedError

    def read(self, piece: Piece | None) -> Iterator[tuple]:
        if piece is None:  # what a reader gets that has no partitions
            return
        f, _ = _fs(self.path)
        with io.BufferedReader(f.open_input_file(piece.path), STEP) as h:
            at = piece.low
            if at:
                h.seek(at - 1)  # a line that begins at the range's first byte is the range's own
                at += len(h.readline()) - 1
            record, begun = [], at
            while at < piece.end:
                line = h.readline()
                if not line:
                    break
                if self.starts(line):
                    if record:
                        yield from self.rows(piece.path, begun, record)
                    if at >= piece.high:
                        return
                    record, begun = [line], at
                elif record:
                    record.append(line)
                elif at >= piece.high:
                    return
                at += len(line)
            if record:
                yield from self.rows(piece.path, begun, record)


class _Batch(DataSourceReader):
    def partitions(self) -> list[Piece]:
        return [p for path, size in sorted(files(self.path, self.suffix).items()) for p in pieces(path, 0, size, self.width)]


class _Stream(DataSourceStreamReader):
    """An offset is the number of bytes taken of each file. Of a file that grows only whole lines are taken; one that shrank is read anew."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        f, _ = _fs(self.path)
        seen = self.__dict__.setdefault("seen", {})
        for path, size in sorted(files(self.path, self.suffix).items()):
            low = seen.get(path, 0)
            if size != low:
                seen[path] = complete(f, path, low if size > low else 0, size)
        return dict(seen)

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return [p for path, to in sorted(end.items()) for p in pieces(path, start.get(path, 0) if start.get(path, 0) <= to else 0, to, self.width)]


class _Transcript(_Files):
    suffix = ".jsonl"

    def rows(self, path: str, at: int, lines: list[bytes]) -> Iterator[tuple]:
        try:
            event = json.loads(lines[0])
            data = event["data"]
            texts = [c["data"] for c in data["content"] if isinstance(c, dict) and c.get("kind") == "text" and isinstance(c.get("data"), str)]
            kind, message = event.get("kind"), data.get("message_id")
        except (ValueError, KeyError, TypeError, AttributeError):
            return
        session = posixpath.basename(path)[: -len(self.suffix)]
        for n, text in enumerate(texts):
            yield session, at, n, str(kind) if kind is not None else None, str(message) if message is not None else None, text


class _TranscriptBatch(_Transcript, _Batch):
    pass


class _TranscriptStream(_Transcript, _Stream):
    pass


class Transcripts(DataSource):
    """(session, at, part, kind, message_id, text) of JSON-lines transcripts, a row for each text of a message.

    session is the file's name, at the byte at which the message's line begins. Lines that are no messages are left out, as is the unfinished last line of a stream.
    Options: range, the bytes of a task; suffix, of the files' names.
    """

    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return "session string, at bigint, part int, kind string, message_id string, text string"

    def reader(self, schema) -> DataSourceReader:
        return _TranscriptBatch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _TranscriptStream(self.options)


class _GitLog(_Files):
    suffix = ".log"
    head = re.compile(rb"[0-9a-f]{7,40}\|")

    def starts(self, line: bytes) -> bool:
        return self.head.match(line) is not None

    def rows(self, path: str, at: int, lines: list[bytes]) -> Iterator[tuple]:
        head = lines[0].decode("utf-8", "replace").rstrip("\r\n").split("|", 3)
        if len(head) < 4:
            return
        stats = [s for line in lines[1:] if len(s := line.decode("utf-8", "replace").rstrip("\r\n").split("\t", 2)) == 3]
        count = lambda s: int(s) if s.isascii() and s.isdigit() else 0
        yield (*head, [(p, count(a), count(r)) for a, r, p in stats])


class _GitLogBatch(_GitLog, _Batch):
    pass


class GitLog(DataSource):
    """(hash, date, author, subject, files) of logs formatted as %H|%ai|%an|%s with --numstat, a row a commit; binary files count as 0.

    A large log is read by ranges, a commit with its files by the task in whose range it begins. Options: range, the bytes of a task.
    """

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return "hash string, date string, author string, subject string, files array<struct<path:string,added:bigint,removed:bigint>>"

    def reader(self, schema) -> DataSourceReader:
        return _GitLogBatch(self.options)
