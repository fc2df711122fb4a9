"""Session helpers: building a local session for tests/bench, and the shared scratch folder.

Library code never builds its own session; it takes the caller's.  The only
place where files are written on the library's own account is
``scratch_dir``, which is the cluster's ``spark.checkpoint.dir`` (a shared
folder).  A private folder is chosen only when that setting is unset, which
happens in local tests.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "haze") -> SparkSession:
    """A session configured the way the tests and the bench expect (UTC, AQE, no UI)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster; a private one only when unset in local mode.

    Off local mode an unset folder raises: a private folder would be a different disk on every executor.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="haze-ckpt-")
        spark.conf.set(CHECKPOINT_KEY, root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder, below one folder per application.

    Its files live as long as lazily read results may need them; ``clear_scratch`` removes them all.
    """
    return f"{checkpoint_root(spark)}/haze/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove everything this application wrote to the shared scratch folder; call it when its results are done with."""
    drop_scratch(spark, f"{checkpoint_root(spark)}/haze/{spark.sparkContext.applicationId}")


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a folder made by ``scratch_dir`` through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def written(df, name: str):
    """The rows of ``df``, written as Parquet to a fresh shared scratch folder and read back.

    Cuts the lineage with files that outlive any executor; downstream stages reread instead of
    recomputing.  Part counts follow the input.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors, so that Python workers can import it from any folder."""
    sc = spark.sparkContext
    if getattr(sc, "_haze_shipped", False):
        return
    top = Path(__file__).resolve().parent
    zipped = Path(tempfile.mkdtemp(prefix="haze-src-")) / "haze_src.zip"
    with zipfile.ZipFile(zipped, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(zipped))
    sc._haze_shipped = True
