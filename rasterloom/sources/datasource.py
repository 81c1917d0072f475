"""Containers as a Spark data source: ``spark.read.format("rasterloom").load(folder)``.

Rows are coded blocks with their place: path, level_step, c, block_y, block_x,
block_index, has_dc, bytes.  A filter on ``level_step`` is pushed into the reader, which
then skips the finer levels' bytes.  Files are listed and opened through
pyarrow's file systems, so the folder may be remote.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

SCHEMA = "path string, level_step int, c int, block_y int, block_x int, block_index int, has_dc boolean, bytes binary"


def _store(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


class OneFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options.get("path", "")
        self.suffix = options.get("suffix", "")
        self.least = 1 << int(options.get("downsampling", 0))
        self.only: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on the level become what is read; all filters are still applied by Spark."""
        for f in filters:
            if getattr(f, "attribute", None) == ("level_step",):
                if isinstance(f, EqualTo):
                    self.only = f.value
                elif isinstance(f, GreaterThanOrEqual):
                    self.least = max(self.least, f.value)
                elif isinstance(f, GreaterThan):
                    self.least = max(self.least, f.value + 1)
            yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, at = _store(self.root)
        found = store.get_file_info(fs.FileSelector(at, recursive=True)) if store.get_file_info(at).type == fs.FileType.Directory else [store.get_file_info(at)]
        return [OneFile(f.path) for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from ..functions import container

        store, _ = _store(self.root)
        with store.open_input_file(partition.path) as f:
            spec, _, start = container.read_head(f.read_at)
            size = f.size()
            for k, (step, at, sizes) in enumerate(container.walk(spec, lambda n, o: f.read_at(n, start + o), size - start)):
                if step < self.least:
                    break
                if self.only is not None and step != self.only:
                    continue
                for index, ((c, by, bx, _, _), n) in enumerate(zip(container.block_windows(spec, step), sizes)):
                    if at + n <= size - start:
                        yield partition.path, step, c, by, bx, index, k == 0 and not by and not bx, f.read_at(n, start + at)
                    at += n


class Containers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rasterloom"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ContainerReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known, with filters pushed into its reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Containers)
