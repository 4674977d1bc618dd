"""Reading tables, and writing the intermediate tables that cut a plan."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes from which a table of few files is spread.
SPREAD = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. One of fewer files than half of the cores, which that many tasks would read, is dealt to all cores; columns and filters still reach the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if 2 * len(df.inputFiles()) < cores and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= SPREAD:
        return df.repartition(cores)
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session. Only where that is unset (tests) is a local one made."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="lumbre-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_written: dict[int, list[str]] = {}


def _remove(owner: int, paths: list[str]) -> None:
    """At the end of the process that wrote them."""
    session = SparkSession.getActiveSession() if os.getpid() == owner else None
    if session is None:
        return
    try:
        for path in paths:
            place = session.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session has ended; what is left is for the folder's owner
        pass


def materialise(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that several branches of a plan, or lost executors, don't compute it again. The table is removed when the process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if os.getpid() not in _written:
        _written[os.getpid()] = []
        atexit.register(_remove, os.getpid(), _written[os.getpid()])
    _written[os.getpid()].append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialise`` wrote and nothing will read again, also not to compute a lost part of another plan."""
    for df in tables:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for path in {os.path.dirname(f) for f in df.inputFiles()}:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let the driver's JVM forget finished plans now, so that Spark deletes their shuffle files before the next large shuffle is written."""
    spark.sparkContext._jvm.System.gc()
