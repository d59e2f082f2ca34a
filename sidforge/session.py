"""Session-level helpers: table access, the shared scratch folder, lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the one named in ``spark.checkpoint.dir``. Where that is unset, a local session gets a folder of its own, since
    all its threads see it; on a cluster it is an error, because a machine-local folder is not visible to the executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = getattr(scratch_root, "_own", None)
    if root is None:
        folder = tempfile.mkdtemp(prefix="sidforge-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = scratch_root._own = "file://" + folder
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder, below one folder per application."""
    folder = f"{scratch_root(spark)}/sidforge-{spark.sparkContext.applicationId}"
    if folder not in _cleaned:
        _cleaned.add(folder)
        atexit.register(_clean, spark, folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


_cleaned: set[str] = set()


def _clean(spark: SparkSession, folder: str) -> None:
    """Remove what the application left behind, if its session still runs at exit."""
    try:
        remove_path(spark, folder)
    except Exception:  # noqa: BLE001 - the session is gone, and with it the way to the file system
        pass


def materialize(df: DataFrame, label: str = "stage", path: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    A written table survives the loss of any executor, is compressed and column-pruned on reading, unlike a block cache.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    # the shuffle files of this one write go when it is done, not when the driver happens to collect its garbage
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path if it exists."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application."""
    context = spark.sparkContext
    if getattr(context, "_sidforge_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="sidforge-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = shutil.make_archive(os.path.join(folder, "sidforge"), "zip", root, "sidforge")
    context.addPyFile(archive)
    context._sidforge_shipped = True
