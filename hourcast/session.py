"""SparkSession defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings every job of this package relies on.  Cluster launchers may
# override any of them; nothing here is required for correctness.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


# Settings of the sessions that this package plans its own queries in.
# Constraint propagation infers filters from every alias of a wide projection;
# on the ~100-column project plans it costs minutes of planning for nothing.
# Scoring is CPU bound per row (trees x operations), so AQE may not merge
# small shuffle outputs below 128 KB per task.  Narrow rows that are shuffled
# become wide ones behind the exchange, so tasks get at most 16 MB of them: with
# 64 MB the sorts of a merge spill.
RUNTIME_CONF = {
    "spark.sql.constraintPropagation.enabled": "false",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def tune_session(spark: SparkSession) -> SparkSession:
    """A session of the same application with the caller's settings and ``RUNTIME_CONF``.

    Frames keep the settings of the session they were made in, so the caller's
    own session, and the plans made in it, stay as they are.
    """
    if all(spark.conf.get(k, None) == v for k, v in RUNTIME_CONF.items()):
        return spark
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if own.conf.isModifiable(k) and own.conf.get(k, None) != v:
            own.conf.set(k, v)
    for k, v in RUNTIME_CONF.items():
        own.conf.set(k, v)
    return own


def get_session(master: str | None = None, app: str = "hourcast", **conf: str) -> SparkSession:
    """Build (or reuse) a session with the package defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULT_CONF, **RUNTIME_CONF, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the launcher to shared storage and is only
    read here.  When unset, a fresh scratch folder is created and registered
    if all tasks run on this machine (a local master); anywhere else each
    executor would write to its own disk, so that is an error.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not (sc.master or "").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="hourcast-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediates."""
    base = checkpoint_dir(spark)
    return os.path.join(base, name)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the workers, once an application, where their search path lacks it."""
    package, app = Path(__file__).parent, spark.sparkContext.applicationId
    if app in _SHIPPED or str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    packed = Path(tempfile.mkdtemp(prefix="hourcast-")) / "hourcast-core.zip"
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(packed))
    _SHIPPED.add(app)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a written intermediate that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Remove ``path`` when the application ends (a result may still read it until then)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def content_key(spark: SparkSession, paths: list[str]) -> str:
    """Names, sizes and modification times of the files under ``paths``, as one text."""
    jvm, out = spark.sparkContext._jvm, []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(p):
            files = fs.listFiles(p, True)
            while files.hasNext():
                st = files.next()
                out.append(f"{st.getPath()}:{st.getLen()}:{st.getModificationTime()}")
    return "\n".join(sorted(out))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check on any Hadoop filesystem (local, HDFS, object stores)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))
