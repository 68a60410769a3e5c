"""Tables that the library writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir`` or by ``setCheckpointDir``.

    Only a session whose executors are the driver itself may go without; it gets a temporary folder.
    """
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="daybook-"))
    return _own[0]


def fresh(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, label: str = "kept") -> DataFrame:
    """``rows`` written and read again: cuts lineage and survives lost executors."""
    path = fresh(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, name: str) -> None:
    """Delete a folder that the library wrote; one that is gone already is no error."""
    path, system = _path(spark, name)
    system.delete(path, True)


def stamp(spark: SparkSession, name: str) -> str:
    """Names, sizes and times of the files of a table: changes whenever the table does."""
    path, system = _path(spark, name)
    found = [path] if system.getFileStatus(path).isFile() else [s.getPath() for s in system.listStatus(path)]
    status = sorted((p.getName(), system.getFileStatus(p).getLen(), system.getFileStatus(p).getModificationTime()) for p in found)
    return str(status)
