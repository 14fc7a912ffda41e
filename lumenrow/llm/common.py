"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: How tables are written.  In folders of the scheme ``file`` Hadoop starts a ``chmod`` process for each file and folder that it makes, and while
#: one starts it shares all memory of the executor or driver, which counts twice then.  So no checksum files (pages have their own) and no markers.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
_OWN: dict[str, str] = {}
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()  # folders of the tables that ``cut`` has made


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a temporary one if all executors are on the driver's machine
    (local mode, tests); on a cluster others couldn't read it, so that is an error.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="lumenrow-"))


def written(df: DataFrame, path: str) -> None:
    """Write a table of the operators' own, with few files beside its parts."""
    df.write.options(**PLAIN).parquet(path)


def cut(df: DataFrame, name: str, *used: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends here and survives the loss of executors.

    ``used``: tables written by ``cut`` that nothing reads from now on; they're deleted.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    written(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    discard(*used)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` has written, by Spark's own file systems."""
    for table in tables:
        if path := _WRITTEN.pop(table, None):
            context = table.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
