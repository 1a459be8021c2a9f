"""Exact dedup against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest: (digest, keep_id). A batch is reduced to one row per digest before
it meets the index, the sort-merge anti-join with the index shuffles only that reduced side, and digests not yet known are
appended, a sorted file per bucket. So a batch costs its own size plus one read of the index, whatever was indexed before.
Only DataFrame functions are used.

Defined cases: a null text counts as empty and all empty texts are equal. Of equal texts in a batch, the row with the largest
doc_id stays (a null id is smaller than any other); if the index knows the digest from an earlier batch, none of the batch stays.
Rows that repeat doc_id and text are the same document: all are marked alike, and `drop_copies` returns one of them.
Other columns are neither read nor changed.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.common import lower_az, stage
from cuelake.sources.scratch import scratch_path


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(lower_az(F.coalesce(text, F.lit(""))), 256))


@dataclass(frozen=True)
class DigestIndex:
    """A digest index at a path. `buckets` is fixed when the index is made; open it again with the same number."""

    spark: SparkSession
    path: str
    buckets: int

    @property
    def table(self) -> str:
        return "digest_index_" + hashlib.md5(self.path.encode()).hexdigest()[:16]

    def open(self) -> DigestIndex:
        """Make the table known to this session; files already at the path stay and are used."""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
                       f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        return self

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def append(self, rows: DataFrame) -> None:
        rows.select("digest", "keep_id").write.insertInto(self.table)


def new_index(spark: SparkSession, path: str | None = None, buckets: int | None = None) -> DigestIndex:
    """An index with as many buckets as the session has shuffle partitions, in the shared folder unless a path is given."""
    return DigestIndex(spark, path or scratch_path(spark, "digest-index"),
                       buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))).open()


def mark_copies(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Index a batch and tell for each of its rows (doc_id, digest) which document stays: keep_id, group_size, kept, known.

    Runs jobs: the digests are staged, new ones are appended to the index.
    """
    marks = stage(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_digest(F.col("text")).alias("digest")), "digests")
    groups = stage(marks.groupBy("digest").agg(F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("group_size")), "digest-groups")
    index.append(groups.hint("merge").join(index.rows(), "digest", "left_anti").select("digest", F.col("last_id").alias("keep_id")))
    decided = stage(groups.hint("merge").join(index.rows(), "digest")
                    .withColumn("known", ~F.col("keep_id").eqNullSafe(F.col("last_id"))).drop("last_id"), "digest-decided")
    return (marks.join(decided.hint("merge"), "digest")
            .withColumn("kept", ~F.col("known") & F.col("doc_id").eqNullSafe(F.col("keep_id")))
            .select("doc_id", "digest", "keep_id", "group_size", "kept", "known"))


def drop_copies(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of a batch that stay, with all their columns."""
    kept = stage(mark_copies(docs, index).where("kept").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("rows")), "digest-kept")

    def mine(side: DataFrame) -> Column:
        return docs["doc_id"].eqNullSafe(side["doc_id"]) & (text_digest(docs["text"]) == side["digest"])

    one, more = kept.where("rows = 1"), kept.where("rows > 1")
    return docs.join(one, mine(one), "left_semi").unionByName(docs.join(more, mine(more), "left_semi").dropDuplicates(["doc_id", "text"]))
