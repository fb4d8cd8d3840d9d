"""Session helpers.

On a cluster the session is created by the platform; these helpers only
fill in settings that are unset, so a cluster's own configuration wins.
"""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile

from pyspark.sql import SparkSession

# Settings we rely on. Applied only when the builder creates a new session.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "parityframe") -> SparkSession:
    """Return the active session or build a local one for tests/benchmarks."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("PF_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; we only pick a scratch folder
    when it is unset (local tests).
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if not conf_dir:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="pf-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of ours from whatever store it is in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_SHIPPING = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, as ``--py-files`` would: Python tasks
    import it, and on a cluster it is not on their path. Once per context, whichever of
    several threads asks first: a second file of that name is refused."""
    sc = spark.sparkContext
    with _SHIPPING:
        if getattr(sc, "_parityframe_shipped", False):
            return
        top = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(), "parityframe_package.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("parityframe", os.path.relpath(full, top)))
        sc.addPyFile(target)
        sc._parityframe_shipped = True


def checkpoint(df):
    """Reliable checkpoint into the shared folder (``spark.checkpoint.dir``),
    cutting lineage; resolves the folder first so a session created
    elsewhere works too."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
