"""Lexicon sentiment (T9), cleaning (T7/T8 applied to a frame) and the
per-item mean (A4 lives in aggregates).

The reference scores each abstract with a third-party library row by row.
Here the lexicon is an input table (word, polarity) and scoring is a Spark
job: words are exploded in the scan stage, probed against the broadcast
lexicon (size-checked, salted beyond the bound) and averaged per article with
map-side partial aggregation, so only one partial row per article leaves a
task. Articles without a lexicon word score 0.0.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litrank.functions.text import clean_text, remove_stopwords, split_words
from litrank.operators.joins import DEFAULT_MAX_BROADCAST_ROWS, broadcastable, join_small
from litrank.session import materialize

# Polarities are summed as decimals of this scale: the sum is exact, so the mean does not depend
# on summation order (partitioning, retries, engine), and 10^27 units cannot overflow.
POLARITY_TYPE = "decimal(38,10)"


# Stop words of a table that are filtered in place: beyond these bounds the words are joined.
MAX_PLACED_WORDS = 10_000
MAX_PLACED_BYTES = 2 ** 20


def exact_mean(c):
    """Mean of a double column, summed exactly at 1e-10 resolution; null when no value (callers
    coalesce)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.sum(col.try_cast("decimal(28,10)")).cast("double") / F.count(col).cast("double")


def stopword_table(spark, stopwords) -> DataFrame | None:
    """A one-column table (word) from a list or a DataFrame; null words are left out."""
    if stopwords is None:
        return None
    if not isinstance(stopwords, DataFrame):
        stopwords = spark.createDataFrame([(w,) for w in stopwords], "word string")
    return stopwords.select(F.col(stopwords.columns[0]).alias("word")).where("word is not null").distinct()


def clean_frame(articles: DataFrame, stopwords: Iterable[str] | DataFrame | None,
                id_col: str = "doi", text_col: str = "abstract",
                max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """(id, cleaned): T7 then T8, one row per input row.

    A plain list, and a table measured to hold at most MAX_PLACED_WORDS words
    and MAX_PLACED_BYTES, is filtered in place, in the scan of the articles. A larger table is
    anti-joined with the words of each distinct (id, text), which keep their
    positions and are put together again. ``max_broadcast_rows <= 0`` always joins.
    """
    words = None
    if stopwords is None or not isinstance(stopwords, DataFrame):
        words = [w for w in stopwords or () if w is not None]
    else:
        stop = materialize(stopword_table(articles.sparkSession, stopwords))
        if broadcastable(stop, min(MAX_PLACED_WORDS, max_broadcast_rows), MAX_PLACED_BYTES):
            words = [r.word for r in stop.collect()]
    if words is not None:
        return articles.select(id_col, remove_stopwords(clean_text(text_col), words).alias("cleaned"))
    texts = articles.groupBy(F.col(id_col).alias("_id"), clean_text(text_col).alias("_text")) \
        .agg(F.count(F.lit(1)).alias("_copies"))
    texts = texts.select("_id", F.xxhash64("_text").alias("_key"), "_copies", split_words("_text").alias("_words"))
    words = texts.select("_id", "_key", F.posexplode("_words").alias("_pos", "word"))
    words = join_small(words, stop, ["word"], "left_anti", max_rows=max_broadcast_rows,
                       salt_from=["_id", "_pos"])
    kept = words.groupBy("_id", "_key").agg(F.array_sort(F.collect_list(F.struct("_pos", "word"))).alias("_w"))
    kept = kept.select(F.col("_id").alias("_i"), F.col("_key").alias("_k"),
                       F.array_join(F.col("_w.word"), " ").alias("cleaned"))
    out = texts.join(kept, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")), "left")
    return out.select(F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))), "_id", "cleaned") \
        .select(F.col("_id").alias(id_col), F.coalesce("cleaned", F.lit("")).alias("cleaned"))


def sentiment_lexicon(articles: DataFrame, lexicon: DataFrame,
                      stopwords: Iterable[str] | DataFrame | None = None,
                      id_col: str = "doi", text_col: str = "abstract",
                      max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """(id, sentiment_score) = mean polarity of the article's lexicon words.

    Every occurrence counts. Each input row is scored on its own; the result
    has one row per input id (callers deduplicate articles first, S4).
    """
    words = articles.select(id_col, F.explode_outer(split_words(clean_text(text_col))).alias("word"))
    lex = lexicon.select("word", F.col("polarity").cast("double").alias("polarity"))
    stop = stopword_table(articles.sparkSession, stopwords)
    if stop is not None:      # a stop word scores nothing: it need not be taken out of every article
        lex = lex.join(stop, "word", "left_anti")
    scored = join_small(words, lex, ["word"], "left", max_rows=max_broadcast_rows,
                        salt_from=[id_col])
    return scored.groupBy(id_col).agg(
        F.coalesce(exact_mean("polarity"), F.lit(0.0)).alias("sentiment_score"))
