"""A data source that writes files under names of their own, each whole or not at all."""

from __future__ import annotations

import posixpath
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Made(WriterCommitMessage):
    """(name while it is written, name) of each file of a task."""

    files: list[tuple[str, str]]


class NamedFiles(DataSource):
    """Rows (name, content), each a file of that name in the folder `path`; a name may begin with folders. Appending replaces files of the same name and keeps others."""

    @classmethod
    def name(cls):
        return "named_files"

    def schema(self):
        return "name string, content string"

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite)


class _Writer(DataSourceWriter):
    """Tasks write under names that begin with a dot; the driver gives the files their names when all tasks are done, or removes them."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _folder(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, iterator):
        store, folder = self._folder()
        store.create_dir(folder, recursive=True)
        made = []
        for name, content in iterator:
            if not name or any(not part or part.startswith(".") for part in name.split("/")):
                raise ValueError(f"not a file's name: {name!r}")
            under = posixpath.join(folder, f".{self.job}-{uuid.uuid4().hex}")
            with store.open_output_stream(under) as out:
                out.write((content or "").encode("utf-8"))
            made.append((under, posixpath.join(folder, name)))
        return Made(made)

    def commit(self, messages):
        store, folder = self._folder()
        files = [f for m in messages if m is not None for f in m.files]
        if len({name for _, name in files}) < len(files):
            self._remove()
            raise ValueError("several rows have one name")
        if self.overwrite:
            self._remove(lambda base: not base.startswith(f".{self.job}"))
        for parent in {posixpath.dirname(name) for _, name in files} - {folder}:
            store.create_dir(parent, recursive=True)
        for under, name in files:
            store.move(under, name)
        self._remove()  # what tasks that failed have left

    def abort(self, messages):
        self._remove()

    def _remove(self, wanted=None):
        from pyarrow import fs

        store, folder = self._folder()
        wanted = wanted or (lambda base: base.startswith(f".{self.job}"))
        for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True)):
            if info.is_file and wanted(info.base_name):
                store.delete_file(info.path)


def write_named(files: DataFrame, path: str, overwrite: bool = False) -> None:
    """Writes rows (name, content) as files of the folder, in one job; a task has a share of the names, and no file is there unless all are."""
    spark = files.sparkSession
    spark.dataSource.register(NamedFiles)
    files.select("name", "content").repartition("name").write.format("named_files").mode("overwrite" if overwrite else "append").save(path)
