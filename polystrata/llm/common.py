"""What the operators share: written tables, the package on the executors, paths for byte ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..staging import forget, new_dir, remove_dir, shared_dir, ship, written, written_alone

__all__ = ["forget", "local_path", "new_dir", "remove_dir", "shared_dir", "ship", "table", "written", "written_alone"]


def local_path(uri: str) -> str:
    """Path of a mounted shared folder for plain file calls; other schemes are refused."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"a mounted folder is needed for byte-range files, not {uri}")
    return uri


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
