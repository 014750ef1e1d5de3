"""Session-level helpers shared by all operators."""

from __future__ import annotations

import atexit
import contextlib
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def session(app: str = "sluice", cores: str | int = "*", **conf) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used, but only on a
    local master: on a cluster a machine-local folder would lose data.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not getattr(shared_folder, "own", None):
        shared_folder.own = tempfile.mkdtemp(prefix="sluice-")
    return "file://" + shared_folder.own


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage, survives the loss of executors, gives the next stage real
    size statistics, and reads back only the columns it needs.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sluice-{uuid.uuid4().hex}"
    df.write.option("compression", "lz4").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A path in the shared folder that is free, and cleared when the session ends."""
    path = f"{shared_folder(spark)}/sluice-{uuid.uuid4().hex}/it"
    _written.append((spark, path.rpartition("/")[0]))
    return path


@contextlib.contextmanager
def temporary():
    """Tables that operators write within are deleted at the end: what is lazy
    must have been run by then. Without it they stay until the process ends."""
    before = list(_written)
    try:
        yield
    finally:
        for entry in [e for e in _written if e not in before]:
            _written.remove(entry)
            _delete(*entry)


def forget(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    names = df.inputFiles()
    for entry in [e for e in _written if any(e[1].split("://")[-1] in n for n in names)]:
        _written.remove(entry)
        _delete(*entry)


class Files:
    """The file system of a path, whichever it is: what the driver stores there
    the executors find."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.bytes = spark._jvm.org.apache.commons.io.IOUtils

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def is_folder(self, path: str) -> bool:
        return self.exists(path) and self.fs.getFileStatus(self.path(path)).isDirectory()

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def move(self, old: str, new: str) -> bool:
        """False where ``new`` is taken."""
        self.fs.mkdirs(self.path(new).getParent())
        return not self.exists(new) and self.fs.rename(self.path(old), self.path(new))

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return bytes(self.bytes.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        stream = self.fs.create(self.path(path), True)
        try:
            stream.write(text.encode())
        finally:
            stream.close()


def _delete(spark: SparkSession, path: str) -> None:
    Files(spark, path).delete(path)


@atexit.register
def _clean() -> None:
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # the session is gone: the folder's owner cleans it
            return


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / per_part))


def free_name(taken, wanted: str) -> str:
    """``wanted``, lengthened until no input column has that name."""
    low = {t.lower() for t in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted
