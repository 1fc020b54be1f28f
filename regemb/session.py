"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "regemb") -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    On a cluster pass ``master=None`` and let spark-submit decide; the
    shuffle-partition count should then be sized to the data (AQE coalesces
    small partitions, so erring high is cheap).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster must name a folder that the driver and all executors share.
    Only a local session, whose tasks share the driver's disk, may leave it
    unset and gets a folder of its own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="regemb-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for an intermediate table."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


_scratch: list[str] = []


def drop_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables that this process has written so far.

    Results that still read them (DataFrames are lazy) must have been written
    or collected before.  Returns the number of paths that were there.
    """
    conf = spark._jsc.hadoopConfiguration()
    dropped = 0
    while _scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        dropped += bool(path.getFileSystem(conf).delete(path, True))
    return dropped


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back (cuts the lineage)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``regemb`` importable by the Python workers (``addPyFile``).

    Operators that run Python on executors (``mapInPandas`` kernels) need
    the package there.  On a cluster it is normally passed with
    ``spark-submit --py-files``; when the workers cannot import it, the
    package is zipped once per application into the shared checkpoint folder
    and added to the context.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _shipped:
        return
    import importlib.util
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    target = scratch_path(spark, "pyfiles")
    local = target[len("file:"):] if target.startswith("file:") else target
    if "://" in local:  # a remote shared folder: build locally, Spark uploads it
        local = tempfile.mkdtemp(prefix="regemb-pyfiles-")
    os.makedirs(local, exist_ok=True)
    path = os.path.join(local, "regemb.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _shipped.add(app)
    importlib.util.find_spec("regemb")  # the driver side already has it
