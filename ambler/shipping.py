"""Makes the package importable in executors' Python."""

from __future__ import annotations

import atexit
import pathlib
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each context. The driver serves the
    archive while it runs, so executors that come later get it too."""
    context = spark.sparkContext
    if getattr(context, "_ambler_shipped", False):
        return
    top = pathlib.Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="ambler-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    packed = pathlib.Path(folder, "ambler_package.zip")
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(str(packed))
    context._ambler_shipped = True
