"""Files of any store that Spark reads, reached through Hadoop's file systems, and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Files:
    """A few calls on files; paths are plain local ones or URIs."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        target, system = self._at(path)
        return system.exists(target)

    def names(self, folder: str) -> list[str]:
        """What a folder holds; nothing if it is not there."""
        target, system = self._at(folder)
        return [s.getPath().getName() for s in system.listStatus(target)] if system.exists(target) else []

    def delete(self, path: str) -> None:
        target, system = self._at(path)
        system.delete(target, True)

    def read(self, path: str) -> str:
        return self.spark.read.text(path, wholetext=True).first()[0]

    def tail(self, path: str, length: int = 4096) -> str:
        """Digest of the last bytes of a file."""
        target, system = self._at(path)
        stream = system.open(target)
        try:
            stream.seek(max(0, system.getFileStatus(target).getLen() - length))
            return hashlib.md5(bytes(stream.readNBytes(length))).hexdigest()
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> None:
        """Writes a new file that nobody sees before it is whole."""
        part, system = self._at(f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}")
        stream = system.create(part, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not system.rename(part, self._at(path)[0]):
            raise OSError(f"cannot name {path}")

    def under(self, root: str, pattern: str) -> list[tuple[str, int, int]]:
        """Files below a folder whose names match: plain path, change time in nanoseconds, size. Nothing if the folder is not there."""
        if not self.exists(root):
            return []
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
        rows = found.select(plain_path("_metadata.file_path"), F.unix_micros("modificationTime"), "length").collect()
        return [(path, micros * 1000, size) for path, micros, size in rows]


def plain_path(column: str):
    """A file's plain path with forward slashes; a scheme other than file: stays."""
    plain = F.regexp_replace(F.col(column), "^file:/+", "/")
    return F.replace(F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))), F.lit("\\"), F.lit("/"))


def is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a temporary one, in local runs only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not is_local(spark):
            raise ValueError(f"spark.checkpoint.dir is not set, and {spark.sparkContext.master} needs a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallymill-shared-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: cuts lineage, survives lost executors, and keeps what tasks were dealt.
    The files are deleted when the program ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the session may be gone by now; then the folder stays
        Files(spark).delete(path)
