"""Tables between steps: written to the folder that driver and executors share, and read again.

A table cuts lineage, so a lost executor costs its tasks and no more, and what several steps read is made
once. The tables of a session lie in one folder, which is deleted when the driver ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where it is unset as in tests, a temporary folder of our own. On a cluster
    it must be set: executors don't see the driver's temporary folders."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidepool-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(path: str) -> None:
    """Delete a folder, if it is there and can be."""
    try:
        fs, name = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        fs.delete_dir(name)
    except (OSError, ValueError):
        pass


def new_path(spark: SparkSession, label: str) -> str:
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = f"{work_dir(spark)}/tidepool/{key}-{uuid.uuid4().hex[:8]}"
        atexit.register(_delete, _OWN[key])
    return f"{_OWN[key]}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    path = new_path(df.sparkSession, label)
    df.write.option("parquet.block.size", 32 << 20).parquet(path)  # small row groups: writers hold one
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(*frames: DataFrame) -> None:
    """Delete tables that `stored` wrote and that nothing reads any more."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if any(path.split(":", 1)[-1].lstrip("/").startswith(own.split(":", 1)[-1].lstrip("/")) for own in _OWN.values()):
                _delete(path)
