"""Gives Spark's Python workers this package, on executors that have no installed copy, and jobs a folder that all share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the application's Python files, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    # The driver serves the zip from where it lies, so it stays until the driver ends.
    made = tempfile.mkdtemp(prefix="factloom-package-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    path = Path(made).resolve() / "factloom-package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(top.rglob("*.py")):
            out.write(source, source.relative_to(top.parent))
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir, or in local mode a temporary folder where it is unset."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="factloom-")
        sc.setCheckpointDir(known)
    return f"{known}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Computes df once, into the folder that all executors share, and cuts its lineage."""
    fresh_folder(df.sparkSession, "")
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir"))
    return df.checkpoint(eager=True)
