"""Session construction and shared storage locations.

On a cluster the session comes from the platform; everything here only
fills in settings that are still unset, so a cluster's own configuration
(shuffle partitions, checkpoint folder, memory) always wins.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings we rely on.  Applied with setIfMissing semantics.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "treeline") -> SparkSession:
    """Local / test session.  On a cluster use the platform's session."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("TREELINE_DRIVER_MEMORY", "8g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (distributed) folder there; we only create a
    folder of our own when the setting is absent, which is the local/test
    case.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not conf_dir:
        conf_dir = sc.getCheckpointDir()
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="treeline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(conf_dir)
    return conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique location below the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage: write ``df`` once as Parquet below the shared checkpoint
    folder and read it back.  (``Dataset.checkpoint`` would compute the
    plan twice unless it is also cached.)  The files survive executor loss."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    out.stage_path = path
    return out


def discard(*stages: DataFrame) -> None:
    """Delete materialised stages whose consumers have been written.  Only
    what :func:`materialize` returned is touched; the shuffle files of
    finished jobs go too (see :func:`release`)."""
    spark = None
    for df in stages:
        path = getattr(df, "stage_path", None)
        if path is None:
            raise ValueError("not a materialised stage")
        spark = df.sparkSession
        sc = spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    if spark is not None:
        release(spark)


def release(spark: SparkSession) -> None:
    """Run the driver's collector, so that Spark's cleaner drops the shuffle files of finished jobs."""
    spark.sparkContext._jvm.System.gc()


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists, on any Hadoop file system."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists and is a folder, on any Hadoop file system."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make the ``treeline`` package importable in executor Python workers
    (pandas UDFs, mapInPandas, stateful streaming, the repo_tree source).

    The package is zipped once per SparkContext into the driver's own temp
    folder; ``addPyFile`` serves it to the executors from there, so no folder
    has to be shared.
    """
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    zpath = os.path.join(tempfile.mkdtemp(prefix="treeline-package-"), "treeline.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.join("treeline", os.path.relpath(full, pkg)))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)


# Prefixes of the scratch folders this library creates below the checkpoint folder.
SCRATCH_PREFIXES = ("stage-", "catalog-", "t1-", "loc-history-stream-", "commit-dedup-stream-",
                    "activity-stream-", "index-stream-", "bench-index-", "catalog-stream-")


def cleanup_scratch(spark: SparkSession, older_than_seconds: float = 86400.0) -> list[str]:
    """Delete scratch folders (materialised stages, stream sinks, catalog
    copies made by registered queries) older than ``older_than_seconds``
    below the shared checkpoint folder.  Spark's own RDD checkpoint
    folders are left alone.  Returns the deleted paths."""
    import time

    root = ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    cutoff = (time.time() - older_than_seconds) * 1000
    gone = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith(SCRATCH_PREFIXES) and st.getModificationTime() < cutoff:
            fs.delete(st.getPath(), True)
            gone.append(st.getPath().toString())
    return gone
