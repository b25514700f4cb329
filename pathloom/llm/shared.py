"""Places and settings that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.sources.places import Rounds, scratch, settle, shared_dir

__all__ = ["Rounds", "arrow_rows", "modest", "scratch", "settle", "shared_dir"]


def arrow_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows, so that a batch of long texts still fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: Rows of a few numbers up to which a side is broadcast: a few megabytes.
MODEST_ROWS = 200_000


def modest(settled: DataFrame) -> DataFrame:
    """A settled table of narrow rows, marked for broadcast if it has at most MODEST_ROWS; beyond it the join shuffles."""
    return F.broadcast(settled) if settled.limit(MODEST_ROWS + 1).count() <= MODEST_ROWS else settled
