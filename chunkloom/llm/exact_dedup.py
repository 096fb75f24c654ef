"""Exact dedup against a persistent digest index.

Texts are equal when they agree after every run of ASCII white space is made
one space. The SHA-256 of that form is the key. ``DigestIndex`` keeps one row a
digest in files bucketed and sorted by digest; a batch is reduced to one row a
digest first (map-side combine), held against the index by a sort-merge anti-join,
and only digests not yet seen are appended.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_RE, drop_scratch, fresh_name, kept, numbered, scratch_path, without_rows

#: Digests that a bucket should hold (about 60 MB).
BUCKET_ROWS = 1_000_000


def normalised(text):
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RE, " ")


class DigestIndex:
    """Rows ``(digest, keep_id, batch)`` in a folder, bucketed and sorted by digest.

    ``path`` is where the index lies, in any store that Spark writes to; it is opened again
    by any later session, as the folder itself tells its buckets and the type of its ids. A
    session knows it as an outside table. A new index gets ``buckets`` buckets, or as many
    as ``expected`` digests need, at least those of a shuffle. Of one index one batch at a
    time may be judged.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", buckets: int | None = None, expected: int = 0):
        self.spark, self.path = spark, path.rstrip("/")
        told = self._told()
        if not told:
            least = int(spark.conf.get("spark.sql.shuffle.partitions"))
            told = {"buckets": buckets or max(least, -(-expected // BUCKET_ROWS)), "id_type": id_type}
            one = spark.range(1).select(*[F.lit(v).alias(k) for k, v in told.items()])
            one.coalesce(1).write.mode("overwrite").json(f"{self.path}/told")
        self.buckets, self.id_type = int(told["buckets"]), told["id_type"]
        # a name of the path, so that the table of a session is always of this folder
        self.name = f"digest_index_{hashlib.md5(self.path.encode()).hexdigest()[:16]}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id {self.id_type}, batch STRING) USING parquet"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'"
        )

    def _told(self) -> dict | None:
        from pyspark.errors import AnalysisException

        try:
            rows = self.spark.read.schema("buckets int, id_type string").json(f"{self.path}/told").collect()
        except AnalysisException:  # no such folder
            return None
        return rows[0].asDict() if rows else None

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, batch: DataFrame, batch_id: str) -> DataFrame:
        """Rows of ``batch`` (one a digest) whose digest no other batch has brought: a
        sort-merge anti-join, for which only the batch is shuffled."""
        others = self.table().where(F.col("batch") != batch_id).select("digest")
        return batch.join(others.hint("merge"), "digest", "left_anti")

    def _append(self, fresh: DataFrame, batch_id: str) -> None:
        """Add digests, those not yet there from an earlier try at the same batch."""
        mine = self.table().where(F.col("batch") == batch_id).select("digest")
        rows = fresh.join(mine.hint("merge"), "digest", "left_anti")
        rows = rows.select("digest", F.col("first.doc_id").alias("keep_id"), F.lit(batch_id).alias("batch"))
        writer = rows.repartition(self.buckets, "digest").write.format("parquet").mode("append")
        writer.bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def drop(self) -> None:
        """Forget the table and delete the folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        drop_scratch(self.spark, self.path)

    def dedup(
        self,
        docs: DataFrame,
        id_col: str = "doc_id",
        text_col: str = "text",
        row_col: str | None = None,
        batch_id: str | None = None,
    ) -> DataFrame:
        """Judge a batch and append what is new.

        Returns a row for every input row: ``doc_id, keep_id, group_size, kept,
        text_sha256, row_id``. ``keep_id`` is the id of the row that stays: of an
        earlier batch if the index knew the text, else the smallest id of the
        batch (of rows that repeat that id too, the first read). ``group_size``
        counts the batch's rows of that text. Null text equals empty text; a null
        id sorts last, so it stays only where no row of the group has an id. Other
        columns are never looked at, so their names can't clash. ``row_id`` is
        ``row_col``, else it numbers the rows of the batch as read. An empty batch
        gives no rows.

        ``batch_id`` names the batch: given again after a failure, with the same rows, it
        gives the same result and appends nothing twice. Without it a batch is always new.
        """
        batch_id = batch_id or uuid.uuid4().hex
        digests, _ = kept(
            docs.select(
                F.col(id_col).alias("doc_id"),
                F.unhex(F.sha2(F.encode(normalised(F.col(text_col)), "UTF-8"), 256)).alias("digest"),
                (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row_id"),
            ),
            "digests",
        )
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row_id")))
        batch, batch_path = kept(
            digests.groupBy("digest").agg(first.alias("first"), F.count("*").alias("group_size")), "batch"
        )
        fresh, _ = kept(self.unseen(batch, batch_id), "fresh")
        others = self.table().where(F.col("batch") != batch_id).select("digest", "keep_id")
        known, _ = kept(batch.select("digest", "group_size").join(others.hint("merge"), "digest"), "known")
        self._append(fresh, batch_id)
        drop_scratch(self.spark, batch_path)
        groups = fresh.select("digest", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row_id").alias("keep_row")).unionByName(
            known.withColumn("keep_row", F.lit(None).cast("long"))
        )
        # both sides are shuffled by digest, so that AQE can split the rows of a hot text
        return digests.join(groups, "digest").select(
            "doc_id",
            "keep_id",
            "group_size",
            F.coalesce(F.col("row_id") == F.col("keep_row"), F.lit(False)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
            "row_id",
        )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
    index: str | None = None,
    batch_id: str | None = None,
) -> DataFrame:
    """``DigestIndex.dedup`` of one batch against the index at ``index``; without one,
    against a new index, which is deleted when the batch is judged."""
    spark = docs.sparkSession
    there = DigestIndex(spark, index or scratch_path(spark, "index"), docs.schema[id_col].dataType.simpleString())
    judged = there.dedup(docs, id_col, text_col, row_col, batch_id)
    if not index:
        there.drop()
    return judged


def distinct_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: str | None = None, batch_id: str | None = None
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns and no others.

    Both passes number the rows alike, see ``numbered``; texts are not shuffled but for
    those of the rows that go and few others.
    """
    row = fresh_name(docs, "row")
    marked = numbered(docs, row)
    gone, _ = kept(exact_dedup(marked, id_col, text_col, row, index, batch_id).where("not kept").select("row_id"), "gone")
    return without_rows(marked, row, gone).select(*[f"`{c}`" for c in docs.columns])
