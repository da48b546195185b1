"""The package on the workers' path, for sessions that were started without it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession, root: str) -> None:
    """Send the package's sources to the executors, once per application, unless PYTHONPATH names their folder."""
    sc = spark.sparkContext
    named = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if os.path.realpath(root) in named or sc.applicationId in _sent:
        return
    folder = tempfile.mkdtemp(prefix="lavra-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves the file to executors until then
    path = Path(folder, "lavra-sources.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(Path(root, "lavra").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(path))
    _sent.add(sc.applicationId)
