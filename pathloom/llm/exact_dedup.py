"""Exact dedup by a persistent digest index, bucketed and sorted by digest. Native: DataFrame operations only.

Texts are equal when identical after lower-casing A-Z; their SHA-256 stands for them. The index is a table
at a path of its own, ``CLUSTERED BY (digest) SORTED BY (digest)``. New data is reduced to one row per
digest before anything is joined, so a text with any number of copies is one row; that row meets the index
in a sort-merge anti-join, for which the index is read by bucket without a shuffle, and what the anti-join
leaves is appended. The groups read their keeper from the index, again by bucket, and the rows then take
their group's keeper by a join. Groups with more than one in MOST_HOT of the call's rows, of which there are
fewer than MOST_HOT, are broadcast, so the rows of a large group stay where they are.

Defined results
* null text counts as empty. Empty table: empty result, nothing appended.
* of equal texts the row with the largest doc_id stays; a null doc_id is smaller than any. Of repeated rows
  with that doc_id one stays.
* a text that the index has already keeps its indexed doc_id; no new row of it stays. group_size counts the
  rows of the call.
* other columns are not read; join the decisions by doc_id or use ``unique``.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import shared

#: Fixed value: the layout of an index; one of another layout is refused.
FORMAT = 2
#: Fewer groups than this can each hold more than the same fraction of the rows.
MOST_HOT = 1000


def normalised(text: str = "text") -> Column:
    """The text with A-Z in lower case; null counts as empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


class DigestIndex:
    """Digests that have been seen, with the doc_id that stays for each.

    ``path`` keeps the index beyond a session: opening it again finds the same digests. The number of buckets
    is fixed when the index is made (``buckets``, or the session's shuffle partitions) and stored beside the
    data; it is read on opening, whatever the session's settings are by then, and another ``buckets`` is an error.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.name = f"digests_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        self.buckets = self._stored_buckets(buckets)
        if buckets not in (None, self.buckets):
            raise ValueError(f"the index at {path} has {self.buckets} buckets, not {buckets}")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, call STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}/digests'"
        )

    def _stored_buckets(self, buckets: int | None) -> int:
        """The number of buckets that the index has; of a new one it is stored first."""
        place = f"{self.path}/format"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            n = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self.spark.range(1).select(F.lit(n).alias("buckets"), F.lit(FORMAT).alias("format")).write.parquet(place)
        stored = self.spark.read.parquet(place).first()
        if stored["format"] != FORMAT:
            raise ValueError(f"the index at {self.path} has format {stored['format']}, not {FORMAT}")
        return stored["buckets"]

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, docs: DataFrame, call: str | None = None) -> DataFrame:
        """Index the texts of ``docs``; a row per document: doc_id, digest, row, keep_id, group_size, kept.

        ``call`` names the call: one that failed half-way and is run again under its name gives what it would
        have given the first time, whether or not it had appended its digests.
        """
        again, call = call is not None, call or uuid.uuid4().hex
        seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"), F.monotonically_increasing_id().alias("row"))
        seen = shared.settle(seen, "digests")
        order = F.coalesce("doc_id", F.lit(-(1 << 63)))
        batch = seen.groupBy("digest").agg(F.max("doc_id").alias("new_id"), F.max_by("row", order).alias("new_row"), F.count("*").alias("group_size"))
        batch = shared.settle(batch, "groups")
        if not again or self.rows().filter(F.col("call") == call).isEmpty():
            fresh = batch.join(self.rows().hint("merge"), "digest", "left_anti")
            self._append(fresh.select("digest", F.col("new_id").alias("keep_id"), F.lit(call).alias("call")))
        mine = F.col("call") == call
        groups = batch.join(self.rows().hint("merge"), "digest").select("digest", "keep_id", "group_size", F.when(mine, F.col("new_row")).alias("keep_row"))
        groups = shared.settle(groups, "verdicts")
        hot = groups.filter(F.col("group_size") * MOST_HOT > seen.count())
        rare = groups.join(F.broadcast(hot), "digest", "left_anti")
        rest = seen.join(F.broadcast(hot), "digest", "left_anti").join(rare, "digest")
        told = seen.join(F.broadcast(hot), "digest").unionByName(rest)
        return told.select("doc_id", "digest", "row", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"))

    def _append(self, fresh: DataFrame) -> None:
        """One file for each bucket and call."""
        dealt = fresh.repartition(self.buckets, "digest")
        dealt.write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def unique(docs: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns; their texts are added to the index at ``path``.

    Only ids with a row that goes are looked at closely; a modest number of them is broadcast, so that the
    texts needn't be shuffled.
    """
    index = DigestIndex(docs.sparkSession, path, buckets)
    key = lambda: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))  # noqa: E731  a null id is a key of its own
    judged = shared.settle(index.add(docs).select(key().alias("_id"), F.col("digest").alias("_digest"), "kept"), "judged")
    doubtful = shared.modest(shared.settle(judged.filter("not kept").select("_id").distinct(), "doubtful"))
    kept = judged.filter("kept").join(doubtful, "_id", "left_semi").select("_id", "_digest")
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key().alias("_id"))
    sure = marked.join(doubtful, "_id", "left_anti").select("_row")
    # repeated rows of the keeper meet in one partition of the same join
    some = marked.join(doubtful, "_id", "left_semi").withColumn("_digest", digest("_row.text"))
    mine = some.join(kept, ["_id", "_digest"], "left_semi").dropDuplicates(["_id", "_digest"]).select("_row")
    return sure.unionByName(mine).select(*[F.col("_row")[c].alias(c) for c in docs.columns])
