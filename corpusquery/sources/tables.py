"""Tables between steps: written once into the folder that driver and executors share, and read from there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders by application, where no shared folder is set (tests on one machine).
_own_dirs: dict[str, str] = {}
_registered: set[str] = set()


def hadoop_path(spark: SparkSession, path: str):
    """(Hadoop's file system, its path object)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a temporary folder serves a session on one machine; on a cluster, whose executors would each
    write to their own disk, that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        own = spark.sparkContext.applicationId
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if own not in _own_dirs:
            _own_dirs[own] = f"file://{tempfile.mkdtemp(prefix='corpusquery-')}"
        path = _own_dirs[own]
    return path.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The application's folder in the shared one; it goes when the application ends."""
    folder = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    if folder not in _registered:
        files, where = hadoop_path(spark, folder)
        files.deleteOnExit(where)
        _registered.add(folder)
    return folder


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table and reads it back: cuts lineage, survives lost executors, and what made it runs once."""
    path = f"{own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Removes materialised tables that nothing reads any more."""
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            files, where = hadoop_path(table.sparkSession, folder)
            files.delete(where, True)


# A table of parts: folders under one path, each of which counts once its mark stands beside it.


def parts(spark: SparkSession, path: str) -> list[str]:
    """Names of the parts that are complete, in order."""
    files, where = hadoop_path(spark, path)
    if not files.exists(where):
        return []
    names = [s.getPath().getName() for s in files.listStatus(where)]
    return sorted(n.removesuffix(".done") for n in names if n.endswith(".done"))


def mark(spark: SparkSession, path: str, part: str) -> None:
    files, where = hadoop_path(spark, f"{path}/{part}.done")
    files.create(where, True).close()


def unmark(spark: SparkSession, path: str, names: list[str]) -> None:
    """Takes parts out: first their marks, then what they hold."""
    for suffix in (".done", ""):
        for name in names:
            files, where = hadoop_path(spark, f"{path}/{name}{suffix}")
            files.delete(where, True)
