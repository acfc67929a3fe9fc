"""Incremental work over arriving dump files: scoring (B3) and linking (the
J8 step of B4) as Structured Streaming queries.

The reference scores every dump file it finds and upserts the scores, file by
file. Here new JSON-lines files in the dump folder are a Structured Streaming
file source; each micro-batch is deduplicated (the last file wins), scored
with the lexicon (T7 -> T8 -> T9) and appended to a score log partitioned by
batch id. A batch that is retried overwrites only its own partition, so the
log is exactly-once. The current score table is the log read with
last-batch-wins per pmid (the K5 upsert, done at read time); ``compact``
folds the log into one version when it grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litrank import schemas
from litrank.operators.sentiment import sentiment_lexicon
from litrank.session import materialize
from litrank.sources.readers import dedup_articles


def dump_stream(spark: SparkSession, dump_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of the dump folder with each line's file path."""
    r = (spark.readStream.schema(schemas.DUMP).option("mode", "PERMISSIVE")
         .option("columnNameOfCorruptRecord", "_corrupt_record"))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.json(dump_dir).withColumn("file_path", F.col("_metadata.file_path"))


def score_batch(batch: DataFrame, lexicon: DataFrame, stopwords) -> DataFrame:
    """One micro-batch -> (pmid, sentiment_score), one row per doi."""
    good = batch.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    arts = dedup_articles(good, key="doi", keep="last")
    s = sentiment_lexicon(arts, lexicon, stopwords, id_col="doi", text_col="abstract")
    return s.select(F.col("doi").alias("pmid"), "sentiment_score")


def start_scoring(spark: SparkSession, dump_dir: str, log_dir: str, checkpoint_location: str,
                  lexicon: DataFrame, stopwords, available_now: bool = True,
                  max_files_per_trigger: int | None = None):
    """Start the stream; returns the StreamingQuery.

    ``available_now`` processes every file present and stops (batch-like runs);
    otherwise the query keeps polling the folder.
    """
    words = stopwords

    def write(batch: DataFrame, batch_id: int) -> None:
        scores = score_batch(batch, lexicon, words).withColumn("batch_id", F.lit(batch_id).cast("long"))
        (scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(log_dir))

    w = (dump_stream(spark, dump_dir, max_files_per_trigger).writeStream
         .foreachBatch(write).option("checkpointLocation", checkpoint_location))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def current_scores(spark: SparkSession, log_dir: str, base: DataFrame | None = None) -> DataFrame:
    """The score table now: base rows replaced by the latest logged score.

    One aggregation with ``max_by`` on the batch id, combined map-side."""
    log = spark.read.parquet(log_dir).select("pmid", "sentiment_score", F.col("batch_id").cast("long"))
    if base is not None:
        log = base.select("pmid", "sentiment_score", F.lit(-1).cast("long").alias("batch_id")).unionByName(log)
    latest = log.groupBy("pmid").agg(F.max_by("sentiment_score", "batch_id").alias("sentiment_score"))
    return latest


def compact(spark: SparkSession, log_dir: str, out_dir: str, base: DataFrame | None = None) -> str:
    """Write the current table as one new version (never in place)."""
    current_scores(spark, log_dir, base).write.mode("errorifexists").parquet(out_dir)
    return out_dir


def new_articles(stream: DataFrame) -> DataFrame:
    """Readable articles of the stream whose id no earlier row had, in this or any earlier micro-batch
    (S4): the ids live in the query's state store, partitioned by id and restored from its checkpoint.
    The state grows with the number of ids; on a cluster keep it in RocksDB
    (``spark.sql.streaming.stateStore.providerClass``)."""
    good = stream.where(F.col("_corrupt_record").isNull() & F.col("doi").isNotNull()).drop("_corrupt_record")
    return good.dropDuplicates(["doi"])


def start_linking(spark: SparkSession, dump_dir: str, items: DataFrame, links_log_dir: str,
                  checkpoint_location: str, db_name: str, available_now: bool = True,
                  max_files_per_trigger: int | None = None, phrase: bool = False,
                  titles: DataFrame | None = None, missing_log_dir: str | None = None):
    """B4's linking step over arriving dump files: the new articles of every micro-batch are tagged
    against the whole catalog (J8) and their links appended to a link log partitioned by batch id (a
    retried batch rewrites only its own partition). An id that arrives again, in the same or a later
    batch, is not linked again. With ``titles`` and ``missing_log_dir`` the linked ids without
    metadata (J7) are logged the same way, each once. Returns the StreamingQuery."""
    from litrank.operators.containment import link_items
    from litrank.operators.links import articles_missing_info

    def log(rows: DataFrame, batch_id: int, path: str) -> None:
        (rows.withColumn("batch_id", F.lit(batch_id).cast("long"))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("batch_id").parquet(path))

    def write(batch: DataFrame, batch_id: int) -> None:
        # stored: the batch's state is read and written once, J8 reads its rows twice
        arts = materialize(batch.select("doi", "title", "abstract", F.lit(db_name).alias("db_name")))
        links, _ = link_items(arts, items, phrase=phrase)
        log(links, batch_id, links_log_dir)
        if missing_log_dir:
            log(articles_missing_info(links, titles, distinct=True), batch_id, missing_log_dir)

    w = (new_articles(dump_stream(spark, dump_dir, max_files_per_trigger)).writeStream
         .foreachBatch(write).option("checkpointLocation", checkpoint_location))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
