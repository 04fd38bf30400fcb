"""Session, table and store helpers.

Everything here reads its settings from the running session, so the same code
runs under ``local[8]`` in tests and on a cluster whose operators pass their own
``spark.sql.shuffle.partitions``, ``spark.checkpoint.dir`` and so on.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

DEFAULT_SF_DIR = "/root/testdata/sf0.01"


def get_spark(master: str | None = None, app: str = "tessera", partitions: int | None = None) -> SparkSession:
    """Return the active session, or build a local one tuned for tests.

    On a cluster the session already exists (spark-submit) and is returned as is.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "16g"))
        .config("spark.sql.ansi.enabled", os.environ.get("TESSERA_ANSI", "false"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession | None = None) -> None:
    """Make this package importable by the Python workers, once per context.

    Operators that run Python in tasks (models, vector blocks, stream state)
    are pickled by reference to ``tessera`` modules, so executors must be able
    to import the package. Unless it is installed there, it is zipped and
    added with ``addPyFile`` (Spark copies it to every executor).
    """
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="tessera-", suffix=".zip")   # staged on the driver for addPyFile
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for dirpath, dirnames, files in os.walk(pkg):
            dirnames[:] = [d for d in dirnames if d != "__pycache__"]
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(key)


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and stores.

    Uses ``spark.checkpoint.dir`` of the session (the cluster names a shared
    folder there). Where it is unset, a local master gets a scratch folder; on
    a cluster a machine-local folder would be lost to the others, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    scratch = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir() or scratch


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint root."""
    return f"{checkpoint_root(spark).rstrip('/')}/tessera/{name}-{uuid.uuid4().hex[:12]}"


def pinned(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what follows never computes it again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The parquet table at ``path``, or nothing where the path does not exist; any other fault is raised."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register the driver tables as temp views (the table-question catalog)."""
    for name in names:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)
