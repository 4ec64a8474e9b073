"""Tables that a plan writes once and reads several times, in the folder that all machines share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

written: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one is set only where it is unset and all tasks run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="wordtide-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@atexit.register
def _remove_written() -> None:
    for spark, path in written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    path = f"{scratch_root(df.sparkSession).rstrip('/')}/wordtide-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written.append((df.sparkSession, path))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the table that ``stored`` wrote; nothing may read it afterwards."""
    remove(df.sparkSession, df.stored_at)
    written[:] = [x for x in written if x[1] != df.stored_at]
