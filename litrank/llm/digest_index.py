"""Exact deduplication against a persistent digest index (native: DataFrame functions only).

The index is a table bucketed and sorted by the digest of the normalised text. New data is
reduced to one row per digest (with map-side combine, so that a group of copies never meets
in one task), sort-merge anti-joined with the index, and what remains is appended.

Defined results
    * A null text counts as the empty text; all empty or blank texts are copies of each other.
    * Of equal texts in one batch, the row with the most code points in its original text
      stays, then the one with the smallest ``doc_id``; a null ``doc_id`` comes after all
      others. A text that the index holds already stays with the row of the earlier batch.
    * Rows repeated with the same ``doc_id`` and text are reported once for each row, and are
      ``kept`` together; ``group_size`` counts rows of the batch.
    * Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litrank.llm.stages import join_groups, shuffle_width, stored
from litrank.session import scratch_path

# The characters of [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


class DigestIndex:
    """A bucketed table ``(digest, keep_id, n_chars, batch)`` of the texts seen so far.

    ``buckets`` is fixed when the table is made; size it for the corpus to come (about 128 MB
    a bucket). By default it is the session's number of shuffle partitions.
    """

    def __init__(self, spark: SparkSession, table: str | None = None, path: str | None = None,
                 buckets: int | None = None):
        self.spark = spark
        self.table = table or f"digest_index_{uuid.uuid4().hex[:12]}"
        self.buckets = buckets or shuffle_width(spark)
        if not spark.catalog.tableExists(self.table):
            empty = spark.createDataFrame([], "digest binary, keep_id bigint, n_chars int, batch string")
            self._writer(empty).option("path", path or scratch_path(spark, self.table)) \
                .saveAsTable(self.table)

    def _writer(self, df: DataFrame):
        return df.write.format("parquet").mode("append") \
            .bucketBy(self.buckets, "digest").sortBy("digest")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Deduplicate ``docs`` and append what is new. A batch added again (after a failed
        run, say) finds its own rows in the index and changes nothing.

        Returns one row per row of ``docs``: doc_id, keep_id, group_size, kept, digest.
        """
        batch = batch or uuid.uuid4().hex
        text = F.coalesce(F.col("text"), F.lit(""))
        rows = stored(docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.length(text).alias("n_chars"),
            F.unhex(F.sha2(F.translate(text, BLANKS, ""), 256)).alias("digest")), "digests")
        best = F.min(F.struct((-F.col("n_chars")).alias("neg"), F.col("doc_id").isNull().alias("no_id"),
                              F.col("doc_id")))
        groups = rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size"))
        groups = stored(groups.select("digest", F.col("best.doc_id").alias("best_id"),
                                      (-F.col("best.neg")).alias("n_chars"), "group_size"), "groups")
        fresh = groups.hint("merge").join(self.read().hint("merge").select("digest"), "digest", "left_anti")
        self._writer(fresh.select("digest", F.col("best_id").alias("keep_id"),
                                  F.col("n_chars").cast("int").alias("n_chars"),
                                  F.lit(batch).alias("batch"))
                     .repartition(self.buckets, "digest")).saveAsTable(self.table)
        kept = stored(groups.hint("merge").join(self.read().hint("merge").select("digest", "keep_id", "batch"), "digest")
                      .select("digest", "keep_id", "group_size", F.col("n_chars").alias("best_chars"),
                              (F.col("batch") == batch).alias("new")), "kept")
        joined = join_groups(rows, kept, "digest", "group_size", rows.count())
        return joined.select(
            "doc_id", "keep_id", "group_size",
            (F.col("new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
             & (F.col("n_chars") == F.col("best_chars"))).alias("kept"), "digest")


def keep_first_copies(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``add`` marked as kept; of rows that repeat a ``doc_id`` and its
    text, one. Rows are dropped by an anti-join, so that few copies need no shuffle of texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select("*", F.col("doc_id").cast("bigint").alias(_ID),
                        F.unhex(F.sha2(F.translate(text, BLANKS, ""), 256)).alias(_DIGEST),
                        F.length(text).alias(_LENGTH))
    pair = [F.col("doc_id").alias("id"), F.col("digest").alias("key")]
    best = marks.where("kept").groupBy(*pair).agg(F.count("*").alias("n"))
    gone = marks.where(~F.col("kept")).select(*pair).distinct() \
        .join(best.select(F.col("id").alias("i"), F.col("key").alias("k")),
              F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left_anti")
    left = _without(named, gone)
    # Rows of one id and digest of which some are kept: equal rows, or texts that differ in blanks.
    mixed = marks.groupBy(*pair).agg(F.count("*").alias("n"), F.max("kept").alias("any")) \
        .where("n > 1 AND any").select("id", "key")
    mixed = stored(mixed, "repeated")
    if not mixed.isEmpty():
        # The longest row, then the last text, by an aggregation that combines in the map tasks: a
        # million equal rows without an id become one row a task.
        whole = F.struct(*(F.col(f"`{c}`") for c in left.columns))
        order = F.struct(F.col(_LENGTH), F.col("text"))
        some = _with(left, mixed).groupBy(_ID, _DIGEST).agg(F.max_by(whole, order).alias(_ROW)).select(f"{_ROW}.*")
        left = _without(left, mixed).unionByName(some)
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


_ID, _DIGEST, _LENGTH, _ROW = "__digest_id", "__digest", "__digest_length", "__digest_row"


def _without(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    return rows.join(pairs, rows[_ID].eqNullSafe(pairs["id"]) & (rows[_DIGEST] == pairs["key"]), "left_anti")


def _with(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    return rows.join(pairs, rows[_ID].eqNullSafe(pairs["id"]) & (rows[_DIGEST] == pairs["key"]), "left_semi")
