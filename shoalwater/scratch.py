"""Intermediate tables in the shared folder that the cluster names.

Iterative operators cut their lineage by writing a Parquet table under
``spark.checkpoint.dir`` and reading it back.  Such a table outlives lost
executors, keeps file statistics (so adaptive execution can choose a broadcast
by its real size), and its reader is a plain scan, so that skewed join
partitions can be split.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_CREATED: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where none is set and all runs on this machine (as in tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    option = spark.sparkContext._jsc.sc().getCheckpointDir()
    if option.isDefined():
        return option.get().rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="shoalwater-"))
    spark.sparkContext.setCheckpointDir(_LOCAL[0])
    return _LOCAL[0]


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def write_file(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file in any store that Spark reaches."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(content)
    finally:
        out.close()


@atexit.register
def _sweep() -> None:
    for path, spark in list(_CREATED.items()):
        try:
            _remove(spark, path)
        except Exception:  # the session may have ended before the interpreter
            pass


class Scratch:
    """Named intermediate tables of one operator run."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/shoalwater/{purpose}-{uuid.uuid4().hex}"
        self.serial = 0
        self.paths: dict[str, str] = {}
        _CREATED[self.root] = spark

    def put(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Write ``df``; the returned frame scans the written files.

        ``rows``, where known, bounds the number of tasks and files: one for
        each quarter million rows is enough for narrow tables.
        """
        if rows is not None:
            df = df.coalesce(1 + rows // 250_000)
        self.serial += 1
        path = f"{self.root}/{self.serial:03d}-{name}"
        df.write.mode("overwrite").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, *names: str) -> None:
        """Delete all tables but these, which later steps read."""
        self.drop(*(set(self.paths) - set(names)))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            if path := self.paths.pop(name, None):
                _remove(self.spark, path)
