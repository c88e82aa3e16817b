"""Getting this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Have Python workers find the package: nothing if PYTHONPATH has it, else it is sent along once, through Spark's own file server."""
    app = spark.sparkContext.applicationId
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _done or ROOT.parent in known:
        return
    path = Path(tempfile.mkdtemp(prefix="waylark-")) / "waylark.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(ROOT.rglob("*.py")):
            z.write(f, f.relative_to(ROOT.parent))
    spark.sparkContext.addPyFile(os.fspath(path))
    _done.add(app)
