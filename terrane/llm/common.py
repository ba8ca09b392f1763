"""What the operators share: tables in the shared folder, connected components, and broadcasts that need no package on executors."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import components, forest
from ..sources.tables import discard, fresh_path, remove, shared_dir
from ..sources.tables import staged as stage

__all__ = ["components", "discard", "forest", "fresh_path", "opened", "release", "remove", "sent", "shared_dir", "stage", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Have the shuffle files of ended queries deleted: executors keep them until the driver's garbage is collected."""
    spark.sparkContext._jvm.System.gc()


def sent(spark: SparkSession, value):
    """A broadcast of value as bytes that carry its classes by value."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(broadcast):
    """The value of a broadcast by `sent`, on an executor."""
    import pickle

    return pickle.loads(broadcast.value)
