"""Small files of the driver's (manifests, reports, locks) on any file system that Spark reads, through Hadoop's client."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession):
        self.spark, self.hadoop = spark, spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.hadoop.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def identity(self, path: str) -> tuple[int, int]:
        """Size, and time of the last change in milliseconds."""
        fs, p = self._at(path)
        if not fs.exists(p):
            raise FileNotFoundError(path)
        s = fs.getFileStatus(p)
        return s.getLen(), s.getModificationTime()

    def names(self, folder: str) -> list[str]:
        fs, p = self._at(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """As a whole: readers see the old file or the new one."""
        fs, temp = self._at(f"{path}.tmp")
        self._put(fs.create(temp, True), text)
        over = getattr(self.hadoop, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(over, 1)
        how[0] = over.OVERWRITE
        context = self.hadoop.FileContext.getFileContext(fs.makeQualified(temp).toUri(), self.conf)
        context.rename(fs.makeQualified(temp), fs.makeQualified(self.hadoop.Path(path)), how)

    def create(self, path: str, text: str) -> bool:
        """A file that only its maker can make; False if it is there."""
        fs, p = self._at(path)
        if fs.exists(p):
            return False
        try:
            out = fs.create(p, False)
        except Py4JJavaError:
            if fs.exists(p):
                return False
            raise
        self._put(out, text)
        return True

    @staticmethod
    def _put(out, text: str) -> None:
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    @contextmanager
    def lock(self, path: str, owner: str) -> Iterator[None]:
        if not self.create(path, owner):
            raise RuntimeError(f"{path}: another run is at work here, or one was killed; then remove this file")
        try:
            yield
        finally:
            self.delete(path)
