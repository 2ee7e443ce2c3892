"""Plain files in the shared folder, written by tasks and read by tasks."""

from __future__ import annotations

import os
import time
import uuid
from urllib.parse import urlsplit


class Store:
    """A folder that every machine reaches: a local or mounted path, or whatever pyarrow's file systems open by URI."""

    def __init__(self, uri: str):
        self.uri = uri
        parts = urlsplit(uri)
        self.path = parts.path if parts.scheme in ("", "file") else None

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def write(self, name: str, data: bytes) -> None:
        """Writes under a name of its own first, then renames: readers see all of a file or none, and a repeated task replaces its like."""
        mine = f".{name}-{uuid.uuid4().hex}"
        if self.path is not None:
            os.makedirs(self.path, exist_ok=True)
            with open(f"{self.path}/{mine}", "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            os.replace(f"{self.path}/{mine}", f"{self.path}/{name}")
            return
        fs, root = self._fs()
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{mine}") as f:
            f.write(data)
        fs.move(f"{root}/{mine}", f"{root}/{name}")

    def open(self, name: str):
        if self.path is not None:
            return open(f"{self.path}/{name}", "rb")
        fs, root = self._fs()
        return fs.open_input_file(f"{root}/{name}")

    def read(self, name: str) -> bytes:
        with self.open(name) as f:
            return f.read()

    def mapped(self, name: str):
        """A file as an array of 64-bit numbers: memory-mapped on a mounted path, read into memory elsewhere."""
        import numpy as np

        if self.path is not None:
            return np.memmap(f"{self.path}/{name}", np.uint64, "r")
        return np.frombuffer(self.read(name), np.uint64)

    def create(self, name: str, data: bytes) -> bool:
        """Writes a file that must not be there yet; False if it is. Of two writers one wins.

        On mounted paths a hard link decides. Elsewhere the driver asks Hadoop's file system to rename without overwriting, which
        HDFS decides atomically; a store whose rename isn't atomic needs one writer at a time. Driver only.
        """
        if self.path is not None:
            os.makedirs(self.path, exist_ok=True)
            mine = f"{self.path}/.{name}-{uuid.uuid4().hex}"
            with open(mine, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(mine, f"{self.path}/{name}")
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(mine)
        return self._renamed(name, data)

    def _renamed(self, name: str, data: bytes) -> bool:
        from pyspark.sql import SparkSession

        context = SparkSession.getActiveSession().sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path
        mine, there = path(f"{self.uri}/.{name}-{uuid.uuid4().hex}"), path(f"{self.uri}/{name}")
        fs = there.getFileSystem(context._jsc.hadoopConfiguration())
        out = fs.create(mine, False)
        out.write(bytearray(data))
        out.close()
        try:
            return not fs.exists(there) and fs.rename(mine, there)
        finally:
            fs.delete(mine, False)

    def remove(self, name: str) -> None:
        if self.path is not None:
            os.unlink(f"{self.path}/{name}")
        else:
            fs, root = self._fs()
            fs.delete_file(f"{root}/{name}")

    def ages(self) -> list[tuple[str, float]]:
        """(name, seconds since it was written) of every file."""
        if self.path is not None:
            return [(n, time.time() - os.path.getmtime(f"{self.path}/{n}")) for n in self.names()]
        from pyarrow.fs import FileSelector

        fs, root = self._fs()
        return [(i.base_name, time.time() - i.mtime.timestamp()) for i in fs.get_file_info(FileSelector(root, allow_not_found=True)) if not i.base_name.startswith(".")]

    def names(self) -> list[str]:
        if self.path is not None:
            return sorted(n for n in os.listdir(self.path) if not n.startswith(".")) if os.path.isdir(self.path) else []
        from pyarrow.fs import FileSelector

        fs, root = self._fs()
        return sorted(i.base_name for i in fs.get_file_info(FileSelector(root, allow_not_found=True)) if not i.base_name.startswith("."))
