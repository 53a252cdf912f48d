"""Files of pages as a Spark data source: ``spark.read.format("page_files").load(path)``.

A file is dealt to tasks by ranges of its bytes; a task reads the pages that begin in
its range, in blocks.  Filters on ``file`` and ``page_num`` and the option ``max_pages``
are pushed into the reader, which stops at the last page that is asked for.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "file string, page_num int, text string, image binary, page_kind string, rotation int"
#: Bytes of a file to a task, and bytes read at a time.
TASK_BYTES, BLOCK = 64 << 20, 1 << 20
FEED = b"\f"


@dataclass(frozen=True)
class Wanted:
    """What is asked of the reader."""

    first: int = 1
    last: int | None = None
    files: frozenset[str] | None = None

    def narrowed(self, f: Filter) -> Wanted | None:
        """With one more filter, or None where the reader cannot apply it."""
        name, value = getattr(f, "attribute", ()), getattr(f, "value", None)
        if name == ("page_num",) and value is not None:
            if isinstance(f, EqualTo):
                return self.within(value, value)
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                return self.within(value + isinstance(f, GreaterThan), None)
            if isinstance(f, (LessThan, LessThanOrEqual)):
                return self.within(1, value - isinstance(f, LessThan))
        if name == ("file",) and isinstance(f, (EqualTo, In)):
            names = frozenset(f.value if isinstance(f, In) else (f.value,))
            return Wanted(self.first, self.last, names if self.files is None else self.files & names)
        return None

    def within(self, first: int, last: int | None) -> Wanted:
        ends = [x for x in (self.last, last) if x is not None]
        return Wanted(max(self.first, first), min(ends) if ends else None, self.files)


@dataclass
class Piece(InputPartition):
    """The pages of a file that begin from byte ``start`` on and before ``stop``."""

    path: str
    start: int
    stop: int


def text_pages(stream, start: int, stop: int, wanted: Wanted) -> Iterator[tuple[int, str | None, bytes | None]]:
    """Pages parted by form feeds; one that is no UTF-8 is empty."""
    page, at, begun, held = 1, 0, 0, []
    ours = lambda: start <= begun < stop and page >= wanted.first

    def done() -> tuple[int, str, None]:
        try:
            return page, b"".join(held).decode(), None
        except UnicodeDecodeError:
            return page, "", None

    while begun < max(stop, 1) and (wanted.last is None or page <= wanted.last):
        block = stream.read(BLOCK)
        if not block:
            if ours() or (begun == stop == 0 and wanted.first == 1):  # an empty file is one empty page
                yield done()
            return
        parts = block.split(FEED)
        for k, part in enumerate(parts):
            if ours():
                held.append(part)
            at += len(part)
            if k < len(parts) - 1:
                at += 1
                if ours() and (wanted.last is None or page <= wanted.last):
                    yield done()
                held, page, begun = [], page + 1, at


def image_pages(stream, start: int, stop: int, wanted: Wanted) -> Iterator[tuple[int, str | None, bytes | None]]:
    """Binary netpbm images one after the other; pixels of pages that are not asked for are skipped, a page that is cut off is empty."""
    page, size = 1, stream.size()
    while stream.tell() < min(stop, size) and (wanted.last is None or page <= wanted.last):
        begun, head, fields = stream.tell(), b"", []
        while len(fields) < 4:
            c = stream.read(1)
            head += c
            if not c:
                raise ValueError(f"page {page} has no whole header")
            if c == b"#":  # a comment, to the line's end
                while stream.read(1) not in (b"\n", b""):
                    pass
                head = head[:-1]
            elif c.isspace() and head.strip():
                fields.append(head.strip())
                head = b""
        if fields[0] not in (b"P5", b"P6") or not all(x.isdigit() for x in fields[1:]):
            raise ValueError(f"page {page} is no binary netpbm image")
        n = int(fields[1]) * int(fields[2]) * (3 if fields[0] == b"P6" else 1) * (2 if int(fields[3]) > 255 else 1)
        ends = stream.tell() + n
        if start <= begun and page >= wanted.first:
            stream.seek(begun)
            yield page, "", stream.read(ends - begun) if ends <= size else None
        stream.seek(min(ends, size))
        page += 1


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        most = options.get("max_pages")
        self.wanted = Wanted(last=int(most) if most else None)
        self.task_bytes = int(options.get("task_bytes", TASK_BYTES))

    def partitions(self) -> Sequence[InputPartition]:
        folder, _, pattern = self.path.rpartition("/") if any(c in self.path for c in "*?[") else (self.path, "", "*")
        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        found = system.get_file_info(root)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(folder)
        files = [found] if found.type == fs.FileType.File else [x for x in system.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, pattern)]
        scheme = folder.partition("://")[0] + "://" if "://" in folder else ""
        wanted = [x for x in sorted(files, key=lambda x: x.path) if self.wanted.files is None or x.base_name in self.wanted.files]
        return [Piece(scheme + x.path, at, min(at + self.task_bytes, x.size)) for x in wanted for at in range(0, max(x.size, 1), self.task_bytes)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        system, path = fs.FileSystem.from_uri(partition.path) if "://" in partition.path else (fs.LocalFileSystem(), partition.path)
        name = path.rpartition("/")[2]
        images = name.lower().endswith((".pgm", ".ppm", ".pnm"))
        with system.open_input_file(path) as stream:
            for page, text, image in (image_pages if images else text_pages)(stream, partition.start, partition.stop, self.wanted):
                yield name, page, text, image, "text", 0


class FilteringReader(Reader):
    """Spark refuses readers that take filters unless its session allows it."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  (Spark's name)
        for f in filters:
            more = self.wanted.narrowed(f)
            if more is None:
                yield f
            else:
                self.wanted = more


class PageFiles(DataSource):
    """Options: ``path`` (a file, a folder, or a pattern of names in one), ``max_pages`` of a file, ``task_bytes``, and ``push`` to take filters."""

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return (FilteringReader if options.get("push") == "true" else Reader)(options)


def read_page_files(spark: SparkSession, path: str, max_pages: int | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """One row a page (``SCHEMA``) of text files, parted by form feeds, and of files of netpbm images (``.pgm``, ``.ppm``, ``.pnm``).

    A page that cannot be read is empty; a file that cannot be read is an error.
    Filters go into the reader where ``spark.sql.python.filterPushdown.enabled`` is set.
    """
    spark.dataSource.register(PageFiles)
    read = spark.read.format("page_files").option("task_bytes", task_bytes).option("push", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    return (read if max_pages is None else read.option("max_pages", max_pages)).load(path)
