"""Make this package importable for the Python workers of any cluster."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each Spark context.

    Functions given to mapInArrow or pandas_udf are pickled by reference, so the
    workers must be able to import their module. Spark's own file server carries the
    archive; nothing depends on a shared working directory.
    """
    sc = spark.sparkContext
    if getattr(sc, "_kursbuch_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="kursbuch-")) / "kursbuch_pkg.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._kursbuch_shipped = True
