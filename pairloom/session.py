"""Sessions and the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "pairloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with what the engine relies on: adaptive execution and UTC."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's spark.checkpoint.dir; only where that is unset and all tasks run in this one process (tests) a temporary folder is made.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return str(own.get()).rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir isn't set: on a cluster it has to name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="pairloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


#: Rows and bytes of a batch that goes to a Python worker, at most.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends Python workers batches of at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES``; lower settings stay.

    A worker holds a batch several times over (as it was read, as Python objects, as the result), and keeps much of what it once held; the JVM
    buffers it outside its heap.  Results don't depend on it.  The setting is read when a plan is made, so frames that are returned need it to stay.
    """
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name, most, number in (("maxRecordsPerBatch", BATCH_ROWS, int), ("maxBytesPerBatch", BATCH_BYTES, size)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < number(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Cuts lineage and keeps every row where a lost executor can't take it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pairloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialised_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of materialised frames that no plan will read again."""
    for df in frames:
        path = df.__dict__.pop("_materialised_at", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
