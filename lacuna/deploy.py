"""Readies a session for Python workers: sends them the package, which need not be on their path, and bounds their batches."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()
#: Rows of an Arrow batch to a Python worker, where the session has Spark's default of 10,000: texts are
#: long, and a worker holds a batch several times over.
BATCH_ROWS, _DEFAULT = 1000, "10000"
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package's sources to the application, once; Spark serves them to each executor. Bounds Arrow batches."""
    sc = spark.sparkContext
    if spark.conf.get(_SETTING, _DEFAULT) == _DEFAULT:
        spark.conf.set(_SETTING, str(BATCH_ROWS))
    if sc.applicationId not in _sent:
        home = Path(__file__).resolve().parent
        if home.suffix != ".zip" and home.is_dir():
            path = Path(tempfile.mkdtemp(prefix="lacuna-code-")) / "lacuna.zip"
            with zipfile.ZipFile(path, "w") as z:
                for p in sorted(home.rglob("*.py")):
                    z.write(p, p.relative_to(home.parent))
            sc.addPyFile(str(path))
        _sent.add(sc.applicationId)
    return spark
