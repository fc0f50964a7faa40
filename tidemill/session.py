"""Sessions: settings that the engine expects, and code for the workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ARROW_BATCH, ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"
_shipped: set[str] = set()


def session(app: str = "tidemill", cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with UTC time, adaptive plans and Arrow transfer."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the workers once per application, wherever it was imported from.

    Arrow batches get ARROW_ROWS rows unless the session or the application sets a number: texts are
    wide rows, and a worker holds several batches at a time.
    """
    if ARROW_BATCH not in spark.conf.getAll and not spark.sparkContext.getConf().contains(ARROW_BATCH):
        spark.conf.set(ARROW_BATCH, ARROW_ROWS)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent
        out = Path(tempfile.mkdtemp(prefix="tidemill-code-")) / "tidemill_code.zip"
        with zipfile.ZipFile(out, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(out))
        _shipped.add(app)
    return spark
