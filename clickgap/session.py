"""Session helpers: a local session for tests/bench, and the checkpoint dir.

On a cluster the session is supplied by the caller; nothing here changes
its settings. ``checkpoint_dir`` reads ``spark.checkpoint.dir`` and only
falls back to a fresh scratch directory for local-mode sessions.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "clickgap") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint directory of this session.

    Uses ``spark.checkpoint.dir`` when the cluster names one. Only a
    local-mode session without it gets a fresh scratch directory; on a
    cluster a missing setting is an error (a machine-local folder would
    not survive executor loss).
    """
    try:
        sc = spark.sparkContext
    except Exception:   # remote (Connect) session: the server's setting applies
        return spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for this cluster")
        conf_dir = tempfile.mkdtemp(prefix="clickgap-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path below the checkpoint directory; what is written there goes
    when the application ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialize(df):
    """Write ``df`` as Parquet below the session's checkpoint directory and
    continue from the written copy.

    Used at stage boundaries: the plan below becomes a scan of the written
    files with column pruning, pushed-down filters and file statistics, and
    the stage is not recomputed after an executor loss. The files go when
    the application ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark) -> None:
    """Make ``clickgap`` importable in Python workers (as ``--py-files``
    would): zip the package's sources once per application and add the
    zip with ``addPyFile``. Needed before any ``applyInPandas`` whose
    function lives in this package."""
    import zipfile

    try:
        sc = spark.sparkContext
    except Exception:   # remote session: the server ships its own files
        return
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    path = os.path.join(tempfile.mkdtemp(prefix="clickgap-py-"), "clickgap.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(app)
