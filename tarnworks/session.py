"""Session helpers: shared scratch tables, package shipping and test sessions."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def local_session(name: str = "tarnworks", cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and bench.py; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where it is unset (tests)."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tarnworks-")
        spark.sparkContext.setCheckpointDir(f"file://{_OWN[app]}")
    return f"file://{_OWN[app]}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it again, which cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarnworks/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash = path  # type: ignore[attr-defined]
    atexit.register(_forget, spark, path)
    return out


def unstash(df: DataFrame) -> None:
    """Deletes the table behind a stashed frame that is no longer read."""
    if path := getattr(df, "_stash", None):
        _forget(df.sparkSession, path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may have ended; scratch is then removed with its folder
        pass


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of df."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, so that they need no path of their own."""
    app = spark.sparkContext.applicationId
    if _OWN.get(f"{app}/shipped"):
        return
    _OWN[f"{app}/shipped"] = "yes"
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="tarnworks-code-"), "tarnworks_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(target)
