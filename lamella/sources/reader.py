"""``spark.read.format("slide")``: directory entries of the TIFF and BigTIFF files below a folder, as a data source that filters are pushed to."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from lamella.sources import containers

#: Files of a partition, and bytes of files after which a partition is full; a file isn't split, as its directories are a chain.
FILES, BYTES = 64, 16 << 30


@dataclass
class Files(InputPartition):
    paths: list[str]


class EntryReader(DataSourceReader):
    """Reads what a filter on path, ifd_no and tag leaves: other files aren't opened, a chain ends behind the last directory asked for, and
    values of other tags aren't read."""

    def __init__(self, path: str, tags: tuple[int, ...] | None) -> None:
        self.path, self.tags, self.asked = path, tags, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and IN on the three columns; Spark applies the others."""
        for f in filters:
            values = f.value if isinstance(f, In) else (f.value,) if isinstance(f, EqualTo) else None
            if values is None or f.attribute not in (("path",), ("ifd_no",), ("tag",)):
                yield f
            else:
                name = f.attribute[0]
                self.asked[name] = self.asked.get(name, set(values)) & set(values)

    def partitions(self) -> list[Files]:
        store, name = containers._place(self.path)
        head = self.path.removesuffix(name)
        found = [store.get_file_info(name)] if containers.is_file(self.path) else store.get_file_info(fs.FileSelector(name, recursive=True))
        out, size = [], BYTES
        for f in sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.path):
            path = containers.plain_path(head + f.path)
            if path not in self.asked.get("path", {path}):
                continue
            if size >= BYTES or len(out[-1].paths) >= FILES:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(path)
            size += f.size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        asked, tags = self.asked, self.asked.get("tag", None if self.tags is None else set(self.tags))
        last = max(asked["ifd_no"], default=-1) if "ifd_no" in asked else None

        def kept(found: Iterator[tuple]) -> Iterator[tuple]:
            for row in found:
                if last is not None and row[0] > last:
                    return
                if row[0] in asked.get("ifd_no", (row[0],)) and row[3] in asked.get("tag", (row[3],)):
                    yield row

        for path in partition.paths:
            with containers._opened(path) as file:
                walked = containers.walk(lambda at, n: file.read_at(n, at), file.size(), None, None if tags is None else frozenset(tags))  # noqa: B023
                yield containers.entry_batch([(path, kept(walked))])


class SlideSource(DataSource):
    """Options: path (a file, or a folder of any depth), tags (numbers, with commas: only their values are read). Columns are those of
    ``containers.tiff_entries``; other files give no rows. Filters are pushed where ``spark.sql.python.filterPushdown.enabled`` is on."""

    @classmethod
    def name(cls) -> str:
        return "slide"

    def schema(self) -> str:
        return containers.ENTRY_SCHEMA

    def reader(self, schema) -> EntryReader:
        tags = self.options.get("tags")
        return EntryReader(containers.plain_path(self.options["path"]), tuple(int(t) for t in tags.split(",")) if tags else None)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and has filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SlideSource)
