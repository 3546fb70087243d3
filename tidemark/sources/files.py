"""File system access through Spark's own Hadoop client, so any store that Spark reads will do."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Files:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def fs(self, text: str):
        return self.path(text).getFileSystem(self._conf)

    def qualified(self, text: str) -> str:
        return self.fs(text).makeQualified(self.path(text)).toString().rstrip("/")

    def exists(self, text: str) -> bool:
        return self.fs(text).exists(self.path(text))

    def make(self, text: str) -> None:
        self.fs(text).mkdirs(self.path(text))

    def delete(self, text: str) -> None:
        self.fs(text).delete(self.path(text), True)

    def names(self, text: str) -> list[str]:
        if not self.exists(text):
            return []
        return sorted(s.getPath().getName() for s in self.fs(text).listStatus(self.path(text)))

    def read(self, text: str) -> str:
        stream = self.fs(text).open(self.path(text))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def publish(self, text: str, lines) -> None:
        """Writes lines to a new file that readers see whole or not at all; raises FileExistsError if it is there.

        The lines go to a hidden file beside it, which then gets the name by a rename that does not overwrite.
        """
        folder, _, name = text.rpartition("/")
        hidden = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"
        self.write(hidden, lines)
        fs = self._jvm.org.apache.hadoop.fs
        target = self.fs(text).makeQualified(self.path(text))
        way = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        way[0] = fs.Options.Rename.NONE
        try:
            fs.FileContext.getFileContext(target.toUri(), self._conf).rename(self.fs(hidden).makeQualified(self.path(hidden)), target, way)
        except Exception as error:
            self.delete(hidden)
            if self.exists(text):
                raise FileExistsError(text) from error
            raise

    def write(self, text: str, lines, overwrite: bool = False) -> None:
        """Writes lines to a new file; raises if it is there and may not be overwritten."""
        try:
            stream = self.fs(text).create(self.path(text), overwrite)
        except Exception as error:
            if not overwrite and self.exists(text):
                raise FileExistsError(text) from error
            raise
        try:
            held: list[str] = []
            for line in lines:
                held.append(line)
                if len(held) >= 1000:
                    stream.write(("\n".join(held) + "\n").encode("utf-8"))
                    held = []
            if held:
                stream.write(("\n".join(held) + "\n").encode("utf-8"))
        finally:
            stream.close()

    def move_all(self, pairs: list[tuple[str, str]]) -> None:
        def one(pair: tuple[str, str]) -> None:
            source, target = self.path(pair[0]), self.path(pair[1])
            fs = source.getFileSystem(self._conf)
            fs.mkdirs(target.getParent())
            if not fs.rename(source, target):
                raise OSError(f"cannot move {pair[0]} to {pair[1]}")

        with ThreadPoolExecutor(8) as pool:
            list(pool.map(one, pairs))

    def listing(self, root: str) -> DataFrame:
        """(path, size, time) of all visible files below, by a distributed listing; ``path`` is relative and as stored."""
        root = self.qualified(root)
        rows = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        return rows.select(
            F.expr("substring(path, {})".format(len(root) + 2)).alias("path"),
            F.col("length").alias("size"),
            F.unix_millis("modificationTime").alias("time"),
        )


def workspace(spark: SparkSession, label: str) -> str:
    """A fresh folder that driver and executors share: below ``spark.checkpoint.dir``, or a local one if that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
