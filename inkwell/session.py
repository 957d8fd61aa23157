"""Sessions, and the package on their executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def local_session(name: str = "inkwell", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for one machine, with the settings that results rely on."""
    build = SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.sql.shuffle.partitions", str(partitions))
    build = build.config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    return build.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application; Spark serves the archive from the driver."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="inkwell-code-")) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED.add(app)
    return spark
