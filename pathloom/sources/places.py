"""The shared folder of driver and executors, and tables that are written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a session on one machine may name none (tests): a temporary folder is made and set. On a cluster,
    where executors couldn't read such a folder, that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if context.getCheckpointDir() is None:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="pathloom-"))
    return context.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path of its own below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again."""
    return _written(df, scratch(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """Settled tables of one job; each can be dropped once what is made of it has been settled too."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.made = spark, scratch(spark, name), 0
        self.paths: dict[str, list[str]] = {}

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it again; earlier tables of that name stay until they are dropped."""
        self.made += 1
        path = f"{self.root}/{name}-{self.made}"
        self.paths.setdefault(name, []).append(path)
        return _written(df, path)

    def replace(self, df: DataFrame, name: str) -> DataFrame:
        """Settle ``df``, then drop the earlier tables of that name, of which it may be made."""
        earlier = self.paths.pop(name, [])
        out = self.settle(df, name)
        self._delete(earlier)
        return out

    def drop(self, *names: str) -> None:
        """Delete all tables of these names; nothing may read them any more."""
        self._delete([path for name in names for path in self.paths.pop(name, [])])

    def _delete(self, paths: list[str]) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for path in paths:
            place = hadoop.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
