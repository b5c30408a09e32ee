"""Session settings every job in the package relies on.

Calendar parts must be taken in UTC, AQE must be on so that small sides of
joins are broadcast on *measured* runtime sizes and skewed shuffle partitions
are split, and lineage must be cut in a shared, reliable checkpoint folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings the library depends on for correct results (UTC calendar parts) and
# for scale (AQE coalescing, skew-join splitting, runtime broadcast decisions).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows can hold long texts: bound what a Python worker gets at once by size.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "hourglass") -> SparkSession:
    """Create (or reuse) a session with the settings above.

    On a cluster ``master`` is left to ``spark-submit``; tests pass
    ``local[N]``.  The web UI stays off: it is a server and not needed.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = b.config("spark.ui.enabled", "false")
    for k, v in REQUIRED_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime-settable part of ``REQUIRED_CONF`` to a given session.

    Raises when the session time zone cannot be set to UTC: every calendar
    result would be silently wrong otherwise.
    """
    for k, v in REQUIRED_CONF.items():
        if spark.conf.isModifiable(k):
            spark.conf.set(k, v)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        raise RuntimeError("spark.sql.session.timeZone must be UTC")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``hourglass`` importable in the Python workers (once per context).

    The pandas functions of the model fits refer to module-level helpers,
    which workers import by name.  When the package was not shipped with
    ``--py-files`` or installed, it is zipped on the driver and handed to
    ``SparkContext.addPyFile``, which distributes it like ``--py-files``.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="hourglass-pyfiles-"), "hourglass.zip")
    with zipfile.ZipFile(out, "w") as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder for intermediates, setting one only when unset.

    ``spark.checkpoint.dir`` is read from the session and used as is.  When
    nothing is configured, a scratch folder is taken on a local master (unit
    tests on one machine); on any other master this raises, because executors
    would write to their own disks.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder shared by all executors (master {sc.master})")
        configured = tempfile.mkdtemp(prefix="hourglass-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_dir(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder; nothing is created yet."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str = "table") -> DataFrame:
    """Write ``df`` as parquet in the shared folder and return the written table.

    For results that several later branches read: the plan below is cut, a
    lost executor does not replay it, and later readers keep column pruning
    and vectorized scans (a row-format checkpoint would lose both).
    """
    path = scratch_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete the files of ``materialize`` results that no plan reads any more."""
    for df in tables:
        spark = df.sparkSession
        base = ensure_checkpoint_dir(spark).rstrip("/").split(":", 1)[-1].lstrip("/")
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if base in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
