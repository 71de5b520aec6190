"""Sessions, tables and shipping the package to executors."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a local session (tests) without one gets its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or (spark.sparkContext.getCheckpointDir() or "")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="parlance-")
        atexit.register(shutil.rmtree, at, True)
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Gives the package to the executors, once an application, so that it need not be installed there.

    The archive goes to the shared folder.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top, buffer = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    at = f"{shared_dir(spark)}/parlance_{uuid.uuid4().hex}.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(buffer.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(at)
    _shipped.add(app)


def session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    n = 8 if cpus == "*" else int(cpus)
    b = SparkSession.builder.master(f"local[{cpus}]").appName("parlance")
    fixed = {"spark.sql.shuffle.partitions": str(n), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    for k, v in (fixed | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
