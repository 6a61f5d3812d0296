"""Written tables in the folder that a cluster's machines share, and the package for their Python workers."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_cleared: set[str] = set()
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per application: they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="lumensift-code-")) / "lumensift_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(top.rglob("*.py")):
            z.write(source, str(source.relative_to(top.parent)))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where none is set and all runs in one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="lumensift-")
    return _own[app]


def _clear(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before the process does
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def settled(df: DataFrame) -> DataFrame:
    """df as a written table, so that a loop's plan doesn't grow with its rounds; it goes when the driver ends."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    folder = f"{shared_folder(spark).rstrip('/')}/lumensift-tables/{app}"
    if app not in _cleared:
        _cleared.add(app)
        atexit.register(_clear, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
