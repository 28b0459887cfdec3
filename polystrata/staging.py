"""Tables written to the cluster's shared folder, which cuts lineage without losing anything when an executor is lost."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parents[1]
#: Folders that this application made and has not deleted, in order.
_folders: dict[str, None] = {}


def on_one_machine(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors reach.

    Only where the session names none and runs on this machine alone (tests) a
    folder of this machine is made and set as the checkpoint folder; on a
    cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not on_one_machine(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="polystrata-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system; a missing one is no error."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name under shared_dir(), deleted when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _folders[path] = None

    def clean() -> None:
        try:
            if path in _folders:
                remove_dir(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone by then
            pass

    atexit.register(clean)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read again."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the folder of a written table that nothing reads any more."""
    path = getattr(df, "folder", None)
    if path in _folders:
        del _folders[path]
        remove_dir(df.sparkSession, path)


def written_alone(make: Callable[[], DataFrame], name: str, also: DataFrame | None = None) -> DataFrame:
    """written(make()); all folders that came up meanwhile are deleted, and the one of `also`: only the result stays."""
    before = set(_folders)
    out = written(make(), name)
    for path in [x for x in _folders if x not in before and x != out.folder]:
        del _folders[path]
        remove_dir(out.sparkSession, path)
    if also is not None:
        forget(also)
    return out


def ship(spark: SparkSession | None) -> None:
    """Send this package to the executors; on one machine only where PYTHONPATH doesn't hold its root already."""
    if spark is None:
        return
    here = on_one_machine(spark) and str(_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if here or getattr(spark.sparkContext, "_polystrata_shipped", False):
        return
    spark.sparkContext._polystrata_shipped = True
    target = Path(tempfile.mkdtemp(prefix="polystrata-zip-")) / "polystrata_pkg.zip"  # the driver serves it until the application ends
    atexit.register(shutil.rmtree, target.parent, True)
    with zipfile.ZipFile(target, "w") as z:
        for p in (_ROOT / "polystrata").rglob("*.py"):
            z.write(p, str(p.relative_to(_ROOT)))
    spark.sparkContext.addPyFile(str(target))
