"""Folders that driver and executors share, for indexes and staged tables.

The folder is the one that the cluster names in spark.checkpoint.dir; only on a local master, where that is
unset, a temporary folder is made.  Files are reached through Hadoop's file systems, never as local paths.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: list[str] = []


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tidemill-')}"
        _made.append(folder[7:])
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/tidemill/{tag}-{uuid.uuid4().hex}"


@atexit.register
def _clean() -> None:
    for folder in _made:
        shutil.rmtree(folder, ignore_errors=True)


class Files:
    """The file system that holds a path."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(path).getFileSystem(self._conf)
        self._jvm, self._gateway = spark.sparkContext._jvm, spark.sparkContext._gateway

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path))) if self.exists(path) else []

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a new file; False, and nothing written, if there is one."""
        try:
            stream = self._fs.create(self._path(path), False)
        except Exception as e:
            if self.exists(path):
                return False
            raise e
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def moved(self, old: str, new: str) -> bool:
        """Move a file to a name that has to be free; False, and nothing moved, if it is not."""
        fs, gateway = self._jvm.org.apache.hadoop.fs, self._gateway
        self._fs.mkdirs(self._path(new).getParent())
        how = gateway.new_array(fs.Options.Rename, 1)
        how[0] = fs.Options.Rename.NONE
        try:
            fs.FileContext.getFileContext(self._path(old).toUri(), self._conf).rename(self._path(old), self._path(new), how)
        except Exception:
            if self.exists(old) and self.exists(new):
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
