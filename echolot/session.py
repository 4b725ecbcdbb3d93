"""Session factory: one place that sizes Spark for the machine it runs on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def get_spark(app: str = "echolot", cores: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, Arrow transfer and UTC; on a cluster, spark-submit's own settings win.

    Nothing is created at import time.  ``cores`` only matters for a local master.
    """
    n = cores or os.cpu_count() or 4
    b = SparkSession.builder.appName(app).master(f"local[{n}]")
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": str(2 * n),
        "spark.ui.enabled": "false",
    } | {k: str(v) for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Lets Python workers import this package: as a zip that the driver serves, unless they find it by PYTHONPATH or their folder anyway."""
    root = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    known = {Path(p).resolve() for p in (*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()) if p}
    if root in known or context.applicationId in _shipped:
        return
    path = Path(tempfile.mkdtemp(prefix="echolot-"), "echolot.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((root / "echolot").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
