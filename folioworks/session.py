"""Session helpers: table access and shared-folder materialisation."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "folioworks", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the session comes from spark-submit."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that setting is missing (local tests) a folder of our own is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; on a cluster it must name a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"folioworks-{os.getpid()}")
    os.makedirs(own, exist_ok=True)
    spark.sparkContext.setCheckpointDir(own)
    return own


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by a written table in the shared folder, and read it back.

    The files survive the loss of any executor, and both later reads see the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioworks/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once all that reads them has been written elsewhere."""
    for df in written:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Give every core some rows where a small table has fewer partitions than there are cores; larger tables are left as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)
