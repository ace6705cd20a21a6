"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of local applications without a shared one.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the session's spark.checkpoint.dir.

    Where the setting is unset, a temporary folder serves in local mode; on a cluster that is an error.
    """
    folder, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="terracut-"))
    return f"{folder.rstrip('/')}/{app}/{name}-{uuid.uuid4().hex}"


def many(df: DataFrame) -> DataFrame:
    """df, which joins must not send through the driver to all executors: its rows grow with the input.

    Spark goes by the size of files. Packed or sorted pixels take less than a byte each there, and a hundred in memory.
    """
    return df.hint("merge")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to a shared folder and read back: computed once, and a reread if executors are lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
