"""A mounted tree as a table with the status of every entry, so that no link, special or unreadable file fails the scan.

The folder has to be mounted under one path on the driver and on all executors; stores that only Spark reads have no
links and are scanned by ``loamstack.sources.workspace`` as they are. A task reads one folder with all below it, or the
files of a folder whose subfolders have tasks of their own: the planner opens folders, breadth first, until there are
enough of them, and never a file.

Defined cases: a link is a row and is not followed, wherever it leads; an unreadable folder or file, a file that goes or
grows while it is read, a device or a pipe are rows with their status; a file over ``max_bytes`` has a length and no content;
a name that is no Unicode has its bytes replaced; a folder that is missing gives no row, one that lies behind a link one row; the root itself may be a link.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, status string, modified timestamp, length long, content binary"
#: Statuses of entries.
READ, LINK, SPECIAL, UNREADABLE, LARGE = "read", "symlink", "special", "unreadable", "too_large"
#: Folders that the planner deals out, if a tree has as many.
TASKS = 1024
#: Rows and bytes of a batch.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def _source(tasks: int):
    """The data source. It is made here, with all it needs, so that it travels whole to the workers that plan a scan."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    schema, batch_rows, batch_bytes = SCHEMA, BATCH_ROWS, BATCH_BYTES
    read, link, special, unreadable, large = READ, LINK, SPECIAL, UNREADABLE, LARGE

    class Part(InputPartition):
        def __init__(self, folder: str, deep: bool):
            self.folder, self.deep = folder, deep

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.root, self.below, self.limit = options["path"], options.get("folder", "."), int(options["max_bytes"])

        def partitions(self):
            import os
            from collections import deque

            parts, queue = [], deque([self.below])
            while queue and len(parts) + len(queue) < tasks:
                folder = queue.popleft()
                parts.append(Part(folder, False))
                try:
                    queue.extend(os.path.normpath(os.path.join(folder, name)) for name, inner in self._listed(folder) if inner)
                except OSError:
                    pass  # its own task tells
            return parts + [Part(x, True) for x in queue]

        def _linked(self, folder: str) -> bool:
            """Whether the way from the root to a folder leads over a link."""
            import os

            parts = folder.split("/")
            return any(os.path.islink(os.path.join(self.root, *parts[: k + 1])) for k in range(len(parts)))

        def _listed(self, folder: str) -> list[tuple[str, bool]]:
            """The entries of a folder, and which are folders; a link is not opened."""
            import os

            if self._linked(folder):
                raise OSError(folder)
            place = os.open(os.path.join(self.root, folder), os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW)
            try:
                with os.scandir(place) as entries:
                    return sorted((e.name, e.is_dir(follow_symlinks=False)) for e in entries)
            finally:
                os.close(place)

        def _row(self, path: str, status: str, info=None, content=None):
            import datetime as dt

            at = info and dt.datetime.fromtimestamp(int(info.st_mtime), dt.UTC)
            return (path.encode("utf-8", "replace").decode(), status, at or None, info.st_size if info else None, content)

        def _file(self, path: str):
            import os
            import stat

            full = os.path.join(self.root, path)
            try:
                info = os.lstat(full)
                if stat.S_ISLNK(info.st_mode):
                    return self._row(path, link, info)
                if not stat.S_ISREG(info.st_mode):
                    return self._row(path, special, info)
                if info.st_size > self.limit:
                    return self._row(path, large, info)
                # what became a link since then is not followed
                with open(os.open(full, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK), "rb") as file:
                    content = file.read(self.limit + 1)
            except OSError:
                return self._row(path, unreadable)
            return self._row(path, large, info) if len(content) > self.limit else self._row(path, read, info, content)

        def _rows(self, folder: str, deep: bool):
            import os

            if self._linked(folder):
                yield self._row(folder, link)
                return
            try:
                found = self._listed(folder)
            except FileNotFoundError:
                return
            except OSError:
                yield self._row(folder, unreadable)
                return
            for name, inner in found:
                path = os.path.normpath(os.path.join(folder, name))
                if not inner:
                    yield self._file(path)
                elif deep:
                    yield from self._rows(path, True)

        def read(self, partition):
            import pyarrow as pa

            kinds = [pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.binary()]
            names = ["path", "status", "modified", "length", "content"]

            def batch():
                return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

            rows, held = [], 0
            for row in self._rows(partition.folder, partition.deep):
                rows.append(row)
                held += len(row[4] or b"")
                if len(rows) >= batch_rows or held >= batch_bytes:
                    yield batch()
                    rows, held = [], 0
            if rows:
                yield batch()

    class Tree(DataSource):
        @classmethod
        def name(cls):
            return "loamstack_tree"

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader(self.options)

    return Tree


def entries(spark: SparkSession, root: str, folder: str = ".", max_bytes: int = 4 << 20, tasks: int = TASKS) -> DataFrame:
    """path (relative to the root), status, modified, length, content of all that lies below a folder of a mounted tree."""
    spark.dataSource.register(_source(tasks))
    return spark.read.format("loamstack_tree").option("folder", folder).option("max_bytes", max_bytes).load(root.rstrip("/") or "/")
