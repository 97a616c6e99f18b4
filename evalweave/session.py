"""Sessions: makes the package importable in Python workers, and builds local sessions for tests and benchmarks."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ensure_shipped(spark: SparkSession) -> SparkSession:
    """Gives the package to the session's Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="evalweave-py-")) / "evalweave_pkg.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir; a temporary one only where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        at = tempfile.mkdtemp(prefix="evalweave-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def local_session(cpus: int | str = "*", memory: str = "8g", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine with the settings the engine expects (UTC, adaptive execution, Arrow)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("evalweave")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ensure_shipped(spark)
