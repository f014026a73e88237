"""Server-sent events from files that grow, as a Spark data source with retries.

Each file is one connection: lines of events, of which the last may be incomplete, up to ``data: [DONE]``.
Read a folder as a batch or as a stream:

    spark.dataSource.register(EventStreams)
    spark.read.format("event_stream").option("path", folder).load()
    spark.readStream.format("event_stream").option("path", folder).load()
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Fixed values of the format.
PREFIX, END = b"data: ", b"[DONE]"
READ = 1 << 20


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it, for local folders and stores."""
    scheme, _, rest = path.partition("://")
    if not rest:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    if scheme == "file":
        return fs.LocalFileSystem(), rest
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + "://" + rest)


def attempted(f: Callable[[int], Iterator], attempts: int, wait_seconds: float, sleep: Callable[[float], None] = time.sleep) -> Iterator:
    """What ``f(n)`` gives, n being how many items have come before; after an error it goes on from there.

    There are ``attempts`` in all; the wait grows with their number, and a result without any item is asked for again at once.
    """
    n, last = 0, None
    for attempt in range(1, attempts + 1):
        try:
            for item in f(n):
                yield item
                n += 1
            if n or attempt == attempts:
                return
            last = None
        except OSError as e:
            last = e
            if attempt < attempts:
                sleep(wait_seconds * attempt)
    if last:
        raise last


def lines(path: str, start: int, stop: int | None) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the whole lines between two offsets, without their ends; a last incomplete line is left out."""
    store, name = file_system(path)
    with store.open_input_file(name) as file:
        file.seek(start)
        at, tail = start, b""
        while stop is None or at + len(tail) < stop:
            block = file.read(READ if stop is None else min(READ, stop - at - len(tail)))
            if not block:
                return
            *whole, tail = (tail + block).split(b"\n")
            for line in whole:
                yield at, line
                at += len(line) + 1


def events(path: str, start: int = 0, stop: int | None = None) -> Iterator[tuple[str, int, str]]:
    """(path, offset, JSON) of the events between two offsets, and before the end mark; what isn't JSON is left out."""
    if start and any(line.strip() == PREFIX + END for _, line in lines(path, 0, start)):
        return
    for at, line in lines(path, start, stop):
        if line.startswith(PREFIX):
            data = line[len(PREFIX) :].strip()
            if data == END:
                return
            try:
                json.loads(data, parse_int=str)  # of any length
            except ValueError:
                continue
            yield path, at, data.decode("utf-8", "replace")


@dataclass
class Part(InputPartition):
    path: str
    start: int
    stop: int | None


class _Reader:
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.attempts, self.wait = int(options.get("attempts", 3)), float(options.get("wait_seconds", 2))
        self.most = int(options.get("bytes_a_batch", 1 << 30))

    def files(self) -> dict[str, int]:
        """Sizes of the files, of which hidden ones are left out."""
        store, folder = file_system(self.path)
        found = store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        prefix = "" if isinstance(store, fs.LocalFileSystem) else self.path.partition("://")[0] + "://"
        return {prefix + i.path: i.size for i in found if i.is_file and i.base_name[0] not in "._" and i.size}

    def read(self, part: Part) -> Iterator[tuple[str, int, str]]:
        def after(n: int) -> Iterator:
            for k, event in enumerate(events(part.path, part.start, part.stop)):
                if k >= n:
                    yield event

        return attempted(after, self.attempts, self.wait)


class BatchReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Part]:
        return [Part(path, 0, None) for path in sorted(self.files())] or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[tuple[str, int, str]]:
        return super().read(part) if part.path else iter(())


class StreamReader(_Reader, DataSourceStreamReader):
    """Offsets are the bytes that have been read of each file, always whole lines."""

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        left = self.most
        for path, size in sorted(self.files().items()):
            have = self.seen.get(path, 0)
            if size > have and left > 0:
                stop = self.whole(path, have, min(size, have + left))
                left -= stop - have
                if stop > have:
                    self.seen[path] = stop
        return dict(self.seen)

    @staticmethod
    def whole(path: str, start: int, stop: int) -> int:
        """The end of the last whole line, looked for from the end; a line that is longer than what may be read is read whole."""
        store, name = file_system(path)
        with store.open_input_file(name) as file:
            at = stop
            while at > start:
                low = max(start, at - READ)
                file.seek(low)
                found = file.read(at - low).rfind(b"\n")
                if found >= 0:
                    return low + found + 1
                at = low
            file.seek(stop)
            at = stop
            while block := file.read(READ):
                if (found := block.find(b"\n")) >= 0:
                    return at + found + 1
                at += len(block)
        return start

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self.seen = self.seen or dict(start)
        return [Part(path, start.get(path, 0), stop) for path, stop in sorted(end.items()) if stop > start.get(path, 0)]

    def commit(self, end: dict) -> None:
        pass


class EventStreams(DataSource):
    """Options: path; attempts (3) and wait_seconds (2, times the attempt) for each file; bytes_a_batch of a stream.

    Rows: path, at (the line's offset, so that an event has a key), event (JSON text).
    A stream's offsets are kept by Spark, which reads the same bytes again after a restart.
    """

    @classmethod
    def name(cls) -> str:
        return "event_stream"

    def schema(self) -> str:
        return "path string, at long, event string"

    def reader(self, schema: object) -> DataSourceReader:
        return BatchReader(self.options)

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return StreamReader(self.options)
