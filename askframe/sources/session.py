"""What the Python workers and multi-step jobs need from the session."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (as ``--py-files`` would)."""
    sc = spark.sparkContext
    if getattr(sc, "_askframe_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="askframe-")) / "askframe"
    archive = shutil.make_archive(str(target), "zip", PACKAGE.parent, PACKAGE.name)
    sc.addPyFile(archive)
    sc._askframe_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and tables between jobs that every executor can reach.

    Taken from ``spark.checkpoint.dir``. Only a local session without that setting gets a
    temporary folder of its own.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_askframe_dir", None)
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc._askframe_dir = tempfile.mkdtemp(prefix="askframe-shared-")
    return sc._askframe_dir
