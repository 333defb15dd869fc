"""Session helpers: table reading, durable checkpoints, checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table of a data directory (file or folder)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(app: str = "lithoframe", cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.worker.faulthandler.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only where it is unset (tests, a laptop) one of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lithoframe-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def local_folder(spark: SparkSession) -> str:
    """The shared folder as a path that files can be opened under; it has to be mounted, as SEG-Y files are read and written through it."""
    named = shared_dir(spark)
    scheme, colon, rest = named.partition(":")
    if colon and scheme != "file":
        raise ValueError(f"SEG-Y files need a mounted folder, not {named}")
    return "/" + rest.lstrip("/") if colon else named


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to a table in the shared folder and read back, so losing executors loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/lithoframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a side whose row count was found to be at most `rows`; otherwise leave the join to Catalyst.

    The count stops after rows + 1 rows, so a large side costs little more than a peek.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def finite(c):
    """True for a double that is neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def data_dir(sf: str = "sf0.001") -> str:
    return os.path.join(os.environ.get("LITHOFRAME_DATA", "/root/testdata"), sf)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever they run.

    Spark serves the archive to every executor; the driver keeps it in its own temporary folder.
    """
    sc = spark.sparkContext
    if getattr(sc, "_lithoframe_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lithoframe-")) / "lithoframe.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._lithoframe_shipped = True


def shipped(query):
    """The query, run after ship()."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
