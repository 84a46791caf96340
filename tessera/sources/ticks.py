"""A stream of trade prints: a Python data source with offsets, partitions and reconnects.

A service keeps numbered pages of frames for each feed (a feed is a share of the symbols). An offset is the number of pages
of each feed that were read; a micro-batch takes all pages that are there and not read yet, in tasks of at most ``pages`` pages of one feed. Offsets lie in the
query's checkpoint, and a page never changes once the next one has begun, so a restart loses and repeats nothing.

A frame is a JSON array of messages: {"T": "t", "S": symbol, "p": price, "s": size, "t": time} is a print. Messages without symbol or price,
other kinds, and frames that are no JSON are left out; a size that is missing is 0, a time that cannot be read is null. An
{"T": "error"} message, or a failure of the connection, ends the connection: the page is read anew from its beginning, after a
pause that doubles, up to ``retries`` times; then the task fails, and Spark runs it again. What was read of a page before it failed is never passed on.
"""

from __future__ import annotations

import datetime as dt
import importlib
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "feed int, page long, symbol string, price double, size double, ts timestamp"
_ARROW = pa.schema([("feed", pa.int32()), ("page", pa.int64()), ("symbol", pa.string()), ("price", pa.float64()), ("size", pa.float64()), ("ts", pa.timestamp("us", tz="UTC"))])


class PageFolder:
    """A service whose pages lie in folders feed=F/page=N of text files, one frame a line: any file system that Arrow can open."""

    def __init__(self, options: dict[str, str]):
        self.fs, self.root = fs.FileSystem.from_uri(options["path"] if "://" in options["path"] or options["path"].startswith("file:") else "file://" + options["path"])

    def _numbers(self, path: str, name: str) -> list[int]:
        names = [i.base_name for i in self.fs.get_file_info(fs.FileSelector(path, allow_not_found=True))]
        return sorted(int(n.removeprefix(f"{name}=")) for n in names if n.startswith(f"{name}="))

    def feeds(self) -> list[int]:
        return self._numbers(self.root, "feed")

    def pages(self, feed: int) -> int:
        """The number of whole pages: up to the first one that is missing."""
        have = set(self._numbers(f"{self.root}/feed={feed}", "page"))
        n = 0
        while n in have:
            n += 1
        return n

    def frames(self, feed: int, page: int) -> Iterator[str]:
        files = self.fs.get_file_info(fs.FileSelector(f"{self.root}/feed={feed}/page={page}"))
        for f in sorted(i.path for i in files if not i.base_name.startswith(("_", "."))):
            with self.fs.open_input_stream(f) as s:
                yield from s.read().decode().splitlines()


class PageBlocks(PageFolder):
    """Like PageFolder, but many pages lie together: folders feed=F/span=A-B hold the pages from A up to B as Parquet files (page, value: a frame).

    A service of many small pages has a folder for a block of them instead of one for each. A client holds one block at a time.
    """

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.held, self.lines = (-1, 0, 0), {}

    def _spans(self, feed: int) -> list[tuple[int, int]]:
        names = [i.base_name for i in self.fs.get_file_info(fs.FileSelector(f"{self.root}/feed={feed}", allow_not_found=True))]
        return sorted(tuple(map(int, n.removeprefix("span=").split("-"))) for n in names if n.startswith("span="))

    def pages(self, feed: int) -> int:
        n = 0
        for first, end in self._spans(feed):
            n = end if first == n else n
        return n

    def frames(self, feed: int, page: int) -> Iterator[str]:
        if self.held[0] != feed or not self.held[1] <= page < self.held[2]:
            first, end = next((a, b) for a, b in self._spans(feed) if a <= page < b)
            lines = {}
            files = self.fs.get_file_info(fs.FileSelector(f"{self.root}/feed={feed}/span={first}-{end}"))
            for f in sorted(i.path for i in files if not i.base_name.startswith(("_", "."))):
                with self.fs.open_input_file(f) as s:
                    t = pq.ParquetFile(s).read(["page", "value"])
                for at, value in zip(t.column("page").to_pylist(), t.column("value").to_pylist(), strict=True):
                    lines.setdefault(at, []).append(value)
            self.held, self.lines = (feed, first, end), lines
        yield from self.lines.get(page, [])


def service(options: dict[str, str]):
    """The client named by the option ``client`` (module:class), else pages in a folder."""
    module, _, name = options.get("client", f"{__name__}:PageFolder").partition(":")
    return getattr(importlib.import_module(module), name)(options)


def prints(frame: str) -> list[tuple[str, float, float, dt.datetime | None]]:
    """(symbol, price, size, time) of the prints of a frame; raises ConnectionError at an error message."""
    try:
        messages = json.loads(frame)
    except ValueError:
        return []
    out = []
    for m in messages if isinstance(messages, list) else []:
        kind = m.get("T") if isinstance(m, dict) else None
        if kind == "error":
            raise ConnectionError(f"{m.get('msg', 'unknown error')} ({m.get('code')})")
        number = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None
        if kind == "t" and isinstance(m.get("S"), str) and (price := number(m.get("p"))) is not None:
            try:
                at = dt.datetime.fromisoformat(m["t"])
            except (KeyError, TypeError, ValueError):
                at = None
            out.append((m["S"], price, number(m.get("s")) or 0.0, at.replace(tzinfo=at.tzinfo or dt.UTC) if at else None))
    return out


@dataclass
class Pages(InputPartition):
    feed: int
    first: int
    end: int


class TickReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.retries, self.pause, self.most = int(options.get("retries", 5)), float(options.get("pause", 2)), int(options.get("pages", 64))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        s = service(self.options)
        return {str(f): s.pages(f) for f in s.feeds()}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        out = []
        for feed, last in end.items():
            first = start.get(feed, 0)
            out += [Pages(int(feed), p, min(p + self.most, last)) for p in range(first, last, self.most)]
        return out

    def _page(self, feed: int, page: int, connection: list) -> list[tuple]:
        """A page's prints; connection holds the task's client, a new one after a failure."""
        for attempt in range(self.retries + 1):
            try:
                if not connection:
                    connection.append(service(self.options))
                return [p for frame in connection[0].frames(feed, page) for p in prints(frame)]
            except OSError:  # a ConnectionError is one, too
                connection.clear()
                if attempt == self.retries:
                    raise
                time.sleep(self.pause * 2 ** min(attempt, 4))
        return []

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        connection = []
        for page in range(partition.first, partition.end):
            rows = self._page(partition.feed, page, connection)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.record_batch([pa.array([partition.feed] * len(rows), pa.int32()), pa.array([page] * len(rows), pa.int64()), *(pa.array(c, t) for c, t in zip(columns, _ARROW.types[2:], strict=True))], schema=_ARROW)

    def commit(self, end: dict) -> None:
        """Pages stay with the service: nothing to tell it."""


class TickSource(DataSource):
    """Options: path (or client and what it needs), retries, pause (seconds before the first reconnect), pages (of a task)."""

    @classmethod
    def name(cls) -> str:
        return "tessera_ticks"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TickReader:
        return TickReader(self.options)
