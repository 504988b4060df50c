"""Files and folders through Hadoop's file systems, so that local and remote paths work alike."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """File operations of one session."""

    def __init__(self, spark: SparkSession) -> None:
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):  # noqa: ANN202
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self._conf), where

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def is_file(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where) and fs.getFileStatus(where).isFile()

    def is_folder(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where) and fs.getFileStatus(where).isDirectory()

    def names(self, folder: str) -> list[str]:
        fs, where = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(where))

    def size(self, path: str) -> int:
        fs, where = self._at(path)
        return fs.getContentSummary(where).getLength()

    def rename(self, a: str, b: str) -> None:
        fs, where = self._at(a)
        if not fs.rename(where, self._jvm.org.apache.hadoop.fs.Path(b)):
            raise OSError(f"cannot rename {a} to {b}")

    def joined(self, parts: list[str], path: str) -> None:
        """Write the bytes of several files, one after another, as one file."""
        fs, where = self._at(path)
        out = fs.create(where, True)
        try:
            for part in parts:
                source, at = self._at(part)
                stream = source.open(at)
                try:
                    self._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
                finally:
                    stream.close()
        finally:
            out.close()

    def delete(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)

    def write_text(self, path: str, text: str) -> None:
        """Write a small file whole: into a neighbour first, then renamed."""
        beside = f"{path}.{uuid.uuid4().hex}"
        fs, where = self._at(beside)
        out = fs.create(where, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self.exists(path):
            self.delete(path)
        self.rename(beside, path)

    def read_text(self, path: str) -> str:
        fs, where = self._at(path)
        stream = fs.open(where)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
