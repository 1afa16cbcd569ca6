"""Files of metadata and data through pyarrow's file systems, on the driver and on executors alike.

Paths are plain text, never percent-decoded: a folder named ``p=c%2Fd`` is just that.
"""

from __future__ import annotations

import os
import re
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=64)
def _store(scheme: str, authority: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(f"{scheme}://{authority}/")


def open_uri(uri: str):
    """pyarrow's file system and path of a URI or path."""
    from pyarrow import fs

    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(/.*)?$", uri, re.DOTALL)
    if m is None or m[1] == "file":
        return fs.LocalFileSystem(), re.sub("^/+", "/", uri[5:] if m else uri)
    store, root = _store("s3" if m[1] in ("s3a", "s3n") else m[1], m[2] or "")
    return store, root.rstrip("/") + (m[3] or "")


class Storage:
    """A folder of any scheme that pyarrow opens."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self.fs, self.root = open_uri(self.base)

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def uri(self, name: str = "") -> str:
        return f"{self.base}/{name}" if name else self.base

    def _infos(self, folder: str) -> list:
        from pyarrow import fs

        return self.fs.get_file_info(fs.FileSelector(self._path(folder), allow_not_found=True))

    def exists(self, name: str = "") -> bool:
        from pyarrow import fs

        return self.fs.get_file_info(self._path(name)).type != fs.FileType.NotFound

    def names(self, folder: str) -> list[str]:
        return sorted(i.base_name for i in self._infos(folder))

    def times(self, folder: str) -> dict[str, int]:
        """Epoch milliseconds of the files in a folder, by name: one listing."""
        return {i.base_name: i.mtime_ns // 1_000_000 for i in self._infos(folder)}

    def modified(self, name: str) -> int:
        return self.fs.get_file_info(self._path(name)).mtime_ns // 1_000_000

    def read(self, name: str) -> bytes:
        with self.fs.open_input_file(self._path(name)) as f:
            return f.read()

    def text(self, name: str) -> str:
        return self.read(name).decode("utf-8")

    def write(self, name: str, data: str | bytes, overwrite: bool = False) -> None:
        """Writes beside the place and renames, so that a reader never sees half a file; fails if ``name`` is there."""
        data = data.encode("utf-8") if isinstance(data, str) else data
        temp = f"{name}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(self._path(name).rsplit("/", 1)[0], recursive=True)
        with self.fs.open_output_stream(self._path(temp), compression=None) as f:
            f.write(data)
        self.place(temp, name, overwrite)

    def place(self, temp: str, name: str, overwrite: bool = False) -> None:
        """Puts a finished file in its place; FileExistsError if another one is there.

        A hard link decides that in one step on local file systems, a rename does on HDFS.
        Object stores have neither: there, one writer at a time may commit to a table.
        """
        from pyarrow import fs

        source, target = self._path(temp), self._path(name)
        try:
            if overwrite:
                self.fs.move(source, target)
            elif isinstance(self.fs, fs.LocalFileSystem):
                os.link(source, target)
                os.unlink(source)
            elif self.exists(name):
                raise FileExistsError(target)
            else:
                self.fs.move(source, target)
        except OSError as e:
            if self.exists(temp):
                self.fs.delete_file(source)
            if not overwrite and self.exists(name):
                raise FileExistsError(target) from e
            raise

    def write_lines(self, name: str, lines: DataFrame) -> None:
        """One text file from a DataFrame of one string column, written by a task, put in place if absent.

        Give lines in one partition: whatever others hold would be worked out in that task.
        """
        folder = f"{name}.{uuid.uuid4().hex}.tmp"
        lines.coalesce(1).write.text(self.uri(folder))
        part = next(n for n in self.names(folder) if n.startswith("part-"))
        try:
            self.place(f"{folder}/{part}", name)
        finally:
            self.delete(folder)

    def delete(self, name: str) -> None:
        from pyarrow import fs

        kind = self.fs.get_file_info(self._path(name)).type
        if kind == fs.FileType.Directory:
            self.fs.delete_dir(self._path(name))
        elif kind == fs.FileType.File:
            self.fs.delete_file(self._path(name))
