"""A Spark data source that writes files, each whole or not at all.

Rows are (path below the root, content).  A task writes its files under names of its own
in a hidden folder of the job, and moves them to their places once it has all of them; a
move is one step of the file system, so a reader sees a whole file or none.  A task that
is killed leaves files in the hidden folder only, which the end of the job, good or bad,
removes.  A task that runs twice moves the same bytes to the same places.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Where a job's unfinished files are; Spark's readers pass over names that begin like this.
UNFINISHED = "_unfinished"
#: How often a job's end tries to remove them; what stays then is hidden and read by nobody.
TRIES = 5


def opened(where: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(where) if "://" in where else (fs.LocalFileSystem(), where.removeprefix("file:"))


@dataclass
class Written(WriterCommitMessage):
    files: int


class FileWriter(DataSourceArrowWriter):
    def __init__(self, root: str) -> None:
        self.root = root.rstrip("/")
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = opened(self.root)
        own = f"{root}/{UNFINISHED}/{self.job}/{uuid.uuid4().hex}"
        store.create_dir(own)
        places: list[str] = []
        for batch in iterator:
            for place, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                with store.open_output_stream(f"{own}/{len(places)}") as f:
                    f.write(content.as_buffer())
                places.append(place)
        for folder in {p.rpartition("/")[0] for p in places}:
            store.create_dir(f"{root}/{folder}")
        for k, place in enumerate(places):
            store.move(f"{own}/{k}", f"{root}/{place}")
        return Written(len(places))

    def _clear(self) -> None:
        store, root = opened(self.root)
        folder = f"{root}/{UNFINISHED}"
        for _ in range(TRIES):
            try:
                if store.get_file_info(f"{folder}/{self.job}").type == fs.FileType.Directory:
                    store.delete_dir(f"{folder}/{self.job}")
                if store.get_file_info(folder).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(folder)):
                    store.delete_dir(folder)
                return
            except OSError:  # a task that does not know of the end yet may still write
                time.sleep(1)

    def commit(self, messages: list[Written | None]) -> None:
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()


class WholeFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["root"])


def write_files(rows: DataFrame, root: str) -> None:
    """Writes each row's content to its path below root; a file that is there is replaced in one step."""
    rows.sparkSession.dataSource.register(WholeFiles)
    rows.select("path", "content").write.format("whole_files").mode("append").option("root", root).save()
