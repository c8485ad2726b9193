"""Give the executors this package, where their Python path lacks it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows of an Arrow batch, where the session has Spark's own default (10,000): texts are long.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS = {"10000": "1000"}


def ship(spark: SparkSession) -> SparkSession:
    """Add the package to the session's files, once per application, and keep Arrow batches of texts small."""
    sc = spark.sparkContext
    if (rows := spark.conf.get(BATCH)) in ROWS:
        spark.conf.set(BATCH, ROWS[rows])
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        to = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="spark-docloom-")), "docloom.zip")
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        sc.addPyFile(to)
        _shipped.add(sc.applicationId)
    return spark
