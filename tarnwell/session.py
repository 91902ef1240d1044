"""Session helpers: the shared scratch folder and tables written to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> None:
    """Settings that right results depend on.

    Spark 4.1 lets a union keep the partitioning of its children. Under adaptive execution their partitions can be
    coalesced differently, and an aggregate above then finds rows of one key in two partitions: fused lists came out
    with a record once per channel. So unions are followed by a shuffle of their own.
    """
    if spark.conf.get("spark.sql.unionOutputPartitioning", None) != "false":
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is set instead, but only for a local master: the executors of a
    cluster would each write to a disk of their own.
    """
    prepare(spark)
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tarnwell-"))
    return sc.getCheckpointDir().rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/tarnwell-{label}-{uuid.uuid4().hex}"
    hadoop, fs = _hadoop_path(spark, path)
    fs.deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    The plan that reads it starts at the files, so a lost executor costs a re-read and never a
    recomputation of the iterations before. The folder is removed when the session's JVM ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tarnwell_path = path
    return back


def release(df: DataFrame | None) -> None:
    """Remove the files of a table that :func:`materialize` wrote and nothing reads any more."""
    path = getattr(df, "_tarnwell_path", None)
    if path:
        hadoop, fs = _hadoop_path(df.sparkSession, path)
        fs.delete(hadoop, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The content of a small file of any file system Spark knows; None where there is none."""
    hadoop, fs = _hadoop_path(spark, path)
    if not fs.exists(hadoop):
        return None
    stream = fs.open(hadoop)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that did not exist; False where another writer was first. Readers see all of it or nothing."""
    hadoop, fs = _hadoop_path(spark, path)
    pending, _ = _hadoop_path(spark, f"{path}.{uuid.uuid4().hex}.pending")
    out = fs.create(pending, False)
    try:
        out.write(bytearray(text.encode()))
        out.hsync()
    finally:
        out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        # Without overwriting, the rename fails if the name is taken.
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri()).rename(fs.makeQualified(pending), fs.makeQualified(hadoop), options)
    except Py4JJavaError:
        fs.delete(pending, False)
        if fs.exists(hadoop):
            return False
        raise
    return True


def names_in(spark: SparkSession, path: str) -> list[str]:
    hadoop, fs = _hadoop_path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop)) if fs.exists(hadoop) else []


def remove(spark: SparkSession, path: str) -> None:
    hadoop, fs = _hadoop_path(spark, path)
    fs.delete(hadoop, True)


def size_of(spark: SparkSession, path: str) -> int:
    hadoop, fs = _hadoop_path(spark, path)
    return fs.getContentSummary(hadoop).getLength() if fs.exists(hadoop) else 0
