"""Session helpers.

On a cluster the session is built by the platform; ``get_spark`` only fills
in settings that are unset, so cluster-wide values (shuffle partitions, the
shared checkpoint folder) always win.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def get_spark(master: str | None = None, app: str = "flowlens", **conf) -> SparkSession:
    """Return the active session, or build a local one for tests/benchmarks."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    builder = builder.master(master or os.environ.get("FLOWLENS_MASTER", "local[8]"))
    for k, v in {**_LOCAL_DEFAULTS, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the platform (a shared file system); without
    it this is an error.  Only a local session (one machine, as in tests and
    the bench) gets a temporary folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="flowlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
        atexit.register(shutil.rmtree, d, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(d)
    return d


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder.

    Survives executor loss (unlike a local checkpoint), so long iterative
    jobs (epoch loops) do not recompute from the source scan.
    """
    checkpoint_dir(df.sparkSession)
    return _without_vast_estimate(df.checkpoint(eager=True))


def _without_vast_estimate(df: DataFrame) -> DataFrame:
    """``df`` (a checkpoint) without the size Spark estimated for its plan, if
    that is no long any more.

    A checkpoint keeps that estimate, and a join's is the product of its
    sides': from one round of a loop of joins and checkpoints to the next the
    number has several times as many digits, up to gigabytes in the driver.
    Rows, partitioning and order stay; Spark's default size takes its place.
    """
    plan = df._jdf.queryExecution().analyzed()
    if plan.stats().sizeInBytes() < 2 ** 63:
        return df
    spark = df.sparkSession
    jvm, none = spark.sparkContext._jvm, spark.sparkContext._jvm.scala.Option.empty()
    bare = plan.copy(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), False, none,
                     spark._jsparkSession, none, jvm.scala.Some(plan.constraints()))
    return type(df)(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, bare), spark)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``flowlens`` importable on the executors' Python workers (what
    ``spark-submit --py-files`` does): zip the package once per process and
    ``addPyFile`` it once per application."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile

    import flowlens
    root = os.path.dirname(os.path.abspath(flowlens.__file__))
    zpath = os.path.join(tempfile.mkdtemp(prefix="flowlens-pkg-"), "flowlens.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(zpath)
    # Python workers that the driver itself starts (a stateful processor's
    # schema is asked for there) know no added files, only this path
    path = sc.environment.get("PYTHONPATH", "")
    sc.environment["PYTHONPATH"] = os.pathsep.join(p for p in (path, zpath) if p)
    _SHIPPED.add(app)
