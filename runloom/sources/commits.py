"""Publishing folders and small files on any Hadoop file system, whole or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder whose entries appear by rename, so that readers never see half of one.
    Names that begin with ``_`` are not seen by Spark's readers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self._conf)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.at(name))

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name) if name else self._jvm.org.apache.hadoop.fs.Path(self.path))

    def names(self) -> list[str]:
        if not self.exists():
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._jvm.org.apache.hadoop.fs.Path(self.path)))

    def fresh(self) -> str:
        """A hidden name to write to before publishing."""
        return f"_writing-{uuid.uuid4().hex}"

    def publish(self, hidden: str, name: str) -> bool:
        """Rename, unless ``name`` is there already; then the hidden entry goes."""
        fs = self._jvm.org.apache.hadoop.fs
        kind = getattr(fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        context = fs.FileContext.getFileContext(self._path(name).toUri(), self._conf)
        try:
            context.rename(self._fs.makeQualified(self._path(hidden)), self._fs.makeQualified(self._path(name)), options)
        except Exception:
            if not self.exists(name):
                raise
            self.remove(hidden)
            return False
        return True

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def write_json(self, name: str, value: dict) -> bool:
        """A small file, whole; False if it is there already."""
        hidden = self.fresh()
        out = self._fs.create(self._path(hidden), False)
        try:
            out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        finally:
            out.close()
        return self.publish(hidden, name)

    def read_json(self, name: str) -> dict:
        source = self._fs.open(self._path(name))
        try:
            size = self._fs.getFileStatus(self._path(name)).getLen()
            return json.loads(bytes(source.readNBytes(int(size))).decode())
        finally:
            source.close()
