"""Session construction and lineage cutting shared by every module."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tabulon", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, ANSI arithmetic and adaptive execution."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in which intermediate tables survive a lost executor.

    ``spark.checkpoint.dir`` names it. Where that is unset a local master gets a temporary folder; a cluster must set it.
    """
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tabulon-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return context.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that later failures do not recompute what stands before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """``df`` dealt evenly to tasks of at most about ``rows`` rows, and to all cores if it has rows enough.

    Files are split by bytes, so a small compressed table is one task's, however much is made of each of its rows. ``df`` is counted for it, so it should be cheap.
    The number is fixed, which keeps adaptive execution from joining the tasks again.
    """
    n = df.count()
    return df.repartition(max(1, min(n, df.sparkSession.sparkContext.defaultParallelism), -(-n // rows)))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever file system holds it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def ship_code(spark: SparkSession) -> None:
    """Makes this package importable in the executors' Python workers, once per application."""
    context = spark.sparkContext
    if getattr(context, "_tabulon_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tabulon-code-")) / "tabulon_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._tabulon_shipped = True
