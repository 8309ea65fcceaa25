"""Sessions, and code for their workers."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build(name: str = "webstrata", master: str | None = None, **confs: str) -> SparkSession:
    """A session with adaptive plans and UTC; anything given overrides."""
    b = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        b = b.master(master)
    for k, v in confs.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the workers, once for each context; they need no copy of the repository."""
    sc = spark.sparkContext
    if getattr(sc, "_webstrata_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="webstrata-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # served from there as long as the session lives
    path = f"{folder}/webstrata.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path(root.name) / f.relative_to(root))
    sc.addPyFile(path)
    sc._webstrata_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where it is unset a folder of this machine is made, but only for a session that runs
    in one process; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()
