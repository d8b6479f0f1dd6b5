"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset on a local master a folder is made once; on a cluster
    no executor would see one, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quern.tables.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("quern.tables.dir", folder)
    return folder.rstrip("/")


#: Paths that this process has taken and not given back.
_TAKEN: list[str] = []


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing has used."""
    _TAKEN.append(f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}")
    return _TAKEN[-1]


def stored(rows: DataFrame, what: str) -> DataFrame:
    """``rows`` written once and read back, so that their lineage ends there."""
    path = new_path(rows.sparkSession, what)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def delete(spark: SparkSession, path: str) -> None:
    """Delete the table or folder at ``path``, if there is one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> int:
    """Delete all tables that were stored on the way to results, once these are written; how many there were. Frames
    made from them can't be read afterwards."""
    n = len(_TAKEN)
    while _TAKEN:
        delete(spark, _TAKEN.pop())
    return n
