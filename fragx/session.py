"""Session defaults and the checkpoint folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "fragx", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are written for.

    AQE coalesces small shuffle partitions, splits skewed ones and turns a
    sort-merge join into a broadcast join once the measured side is small.
    Settings of spark-submit and of a running session win: a default is set
    only where there is none. ``conf`` is set in any case.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    given = {k.replace("__", "."): v for k, v in conf.items()}
    submitted = dict(SparkConf().getAll())
    for key, value in {**{k: v for k, v in DEFAULTS.items() if k not in submitted}, **given}.items():
        if key in given or SparkSession.getActiveSession() is None:
            builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Give the Python workers this package, once per application, wherever it was started from.

    The archive is made on the driver; Spark's file server hands it out.
    """
    sc = spark.sparkContext
    if getattr(sc, "_fragx_shipped", False):
        return spark
    home = Path(__file__).resolve().parent
    if not home.is_dir():  # imported from such an archive already
        return spark
    folder = tempfile.mkdtemp(prefix="fragx-")  # the file server reads it as long as the driver lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "fragx.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(home.rglob("*.py")):
            out.write(source, source.relative_to(home.parent))
    sc.addPyFile(str(archive))
    sc._fragx_shipped = True
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that driver and executors share: the session's own setting, never a local default."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if not current:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            current = str(Path(tempfile.gettempdir()) / f"fragx-checkpoints-{sc.applicationId}")
        sc.setCheckpointDir(current)
        current = sc.getCheckpointDir()
    return current


def materialize(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back: for a small result that several branches of a plan use.

    The checkpoint lies in the shared folder, so lost executors do not force
    the inputs to be read again, and branches do not repeat the work.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
