"""Page files as a data source of Spark's: ``spark.read.format("page_files")`` and ``spark.readStream.format("page_files")``.

Options: ``path`` (a folder that the driver and all executors see under this name; files in stores that only Spark reads go through ``pages.scan_files``), ``suffix``
("txt" by default, in any case), ``extractor`` ("module:Class" of a PageExtractor; pages parted by form feeds by default) and ``partition_bytes`` (64 MB). A row is a
page that isn't blank; a file that can't be read is one row with its error.

Files are taken in order of their time and name. A partition has files of ``partition_bytes`` together, or one that is larger. A stream's offset is the time and name of the last file taken, so a batch
that is made again after a failure has the same files; files must be moved into the folder whole, and not changed afterwards.
"""

from __future__ import annotations

import importlib
import os
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tessera.operators.workers import ship

SCHEMA = "source_doc string, page_no int, text string, error string"
START = [-1, ""]


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and the package to the executors."""
    ship(spark)
    spark.dataSource.register(PageFiles)


@dataclass
class Files(InputPartition):
    paths: list[str]


class _Folder:
    def __init__(self, options):
        self.path, self.suffix = options["path"], options.get("suffix", "txt").lower()
        self.extractor = options.get("extractor", "tessera.sources.pages:PlainTextExtractor")
        self.each = int(options.get("partition_bytes", 64 << 20))

    def files(self) -> list[tuple[list, int]]:
        """([time, name], bytes) of every file, in order; none if there is no such folder."""
        try:
            found = [(e.name, e.stat()) for e in os.scandir(self.path) if e.is_file() and e.name.lower().endswith("." + self.suffix)]
        except FileNotFoundError:
            return []
        return sorted(([s.st_mtime_ns, name], s.st_size) for name, s in found)

    def split(self, files) -> list[Files]:
        out, size = [], 0
        for (_, name), n in files:
            if not out or size + n > self.each:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(os.path.join(self.path, name))
            size += n
        return out

    def rows(self, part: Files):
        module, name = self.extractor.split(":")
        extractor = getattr(importlib.import_module(module), name)()
        for path in part.paths:
            doc = os.path.basename(path)
            try:
                with open(path, "rb") as f:
                    found = extractor.pages(f.read())
            except Exception as e:  # a bad file is a row, not the end of the job
                yield doc, None, None, f"{type(e).__name__}: {e}"[:500]
                continue
            for i, t in enumerate(found):
                if t.strip():
                    yield doc, i, t, None


class PageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.folder = _Folder(options)

    def partitions(self):
        return self.folder.split(self.folder.files()) or [Files([])]

    def read(self, partition):
        return self.folder.rows(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options):
        self.folder = _Folder(options)

    def initialOffset(self):
        return {"after": START}

    def latestOffset(self):
        files = self.folder.files()
        return {"after": files[-1][0] if files else START}

    def partitions(self, start, end):
        return self.folder.split([f for f in self.folder.files() if start["after"] < f[0] <= end["after"]])

    def read(self, partition):
        return self.folder.rows(partition)

    def commit(self, end):
        pass
