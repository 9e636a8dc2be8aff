"""A session with the settings the engine relies on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(app: str = "swimlane", master: str | None = None, **extra: str) -> SparkSession:
    """A session whose workers find this package; on a cluster leave ``master`` to spark-submit.  Dots in extra settings are written as double underscores."""
    b = SparkSession.builder.appName(app).config(map=SETTINGS | {k.replace("__", "."): v for k, v in extra.items()})
    return importable((b.master(master) if master else b).getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); only in local mode, as in tests, one of our own where none is set."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="swimlane-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, whatever their working directory.

    On a cluster that folder must be a shared one, or the package installed on every machine.
    """
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    there = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in there and root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([*there, root])
    return spark
