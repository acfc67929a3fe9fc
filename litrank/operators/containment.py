"""Token containment join: keyword matching (T4, T5), hit union (T6) and
dictionary tagging (J8).

An article matches a keyword in a field when every token of the keyword is a
token of that field. Of the tokens a query (or an item name) asks for, only one
is joined, its anchor: the token that is rarest in the corpus by a count over
all articles (J8), or the longest one (T5, where a pass to count tokens would
cost as much as the match itself). The rows of an article's field that hold an
anchor are its candidates, and each candidate is verified against the field's
whole token array:

    anchors(key, token, need)      one row per query: its anchor, all its tokens
    occurrences(id, field, token)  exploded in the scan, never written
    anchors x occurrences on token -> verify need within the field's tokens

With anchors within the broadcast bound all of it is one scan of the corpus:
explode, hash join and verification are fused, and only matches are shuffled.
Beyond the bound the occurrences move without their texts, a common anchor is
salted by its measured share, and the candidates fetch their fields by id.

A keyword without any token matches every article (``all([])`` is true); such
queries are joined to the ids alone, on a constant token.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litrank.functions.text import match_all_tokens, token_parts, tokenize
from litrank.operators.joins import DEFAULT_MAX_BROADCAST_ROWS, broadcastable, join_small, salted_join
from litrank.session import materialize

DEFAULT_FIELDS = ("title", "doi", "abstract")
SENTINEL = ""
# Salts of a join on anchors too many to broadcast.
MOST_SALTS = 1024
# Distinct anchors that are written into the plan as one array.
FEW_ANCHORS = 512


def match_fields(articles: DataFrame, fields: Sequence[str] | None) -> list[str]:
    """Fields to match: the given ones (default title, doi, abstract) minus
    ``date``, which the reference never tokenises."""
    chosen = list(fields) if fields is not None else list(DEFAULT_FIELDS)
    return [f for f in chosen if f != "date"]


def token_pairs(articles: DataFrame, id_col: str, fields: Sequence[str],
                carry: Sequence[str] = (), sentinel: bool = True) -> DataFrame:
    """(id, *carry, field, token): distinct tokens of each article field."""
    per_field = []
    for f in fields:
        toks = F.array_distinct(tokenize(F.col(f).cast("string")))
        if sentinel:
            toks = F.concat(F.array(F.lit(SENTINEL)), toks)
        per_field.append(F.struct(F.lit(f).alias("field"), toks.alias("tokens")))
    keep = [id_col, *carry]
    fielded = articles.select(*keep, F.explode(F.array(*per_field)).alias("_f"))
    return fielded.select(*keep, F.col("_f.field").alias("field"),
                          F.explode("_f.tokens").alias("token"))


def wanted_tokens(queries: DataFrame, key_cols: Sequence[str], keywords_col: str) -> DataFrame:
    """(*key, need) for a table of queries: the distinct tokens of all keywords of a query (an
    ARRAY<STRING>), which must all lie inside one field. Queries without keywords are dropped."""
    words = F.transform(F.col(keywords_col), lambda k: tokenize(k))
    return queries.where(F.size(keywords_col) > 0) \
        .select(*key_cols, F.array_distinct(F.flatten(words)).alias("need"))


def field_text(field: Column, fields: Sequence[str]) -> Column:
    return F.coalesce(*[F.when(field == f, F.col(f).cast("string")) for f in fields])


def field_tokens(articles: DataFrame, keep: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(*keep, field, tokens): the tokens of each article field, in order."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), tokenize(F.col(f).cast("string")).alias("tokens"))
                     for f in fields])
    return articles.select(*keep, F.inline(each))


def token_counts(articles: DataFrame, fields: Sequence[str], tokens: DataFrame,
                 max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """(token, n): occurrences in the articles' fields of the distinct ``tokens``. One scan with
    partial sums in its tasks; tokens that do not occur have no row."""
    every = F.concat(*[token_parts(F.col(f).cast("string")) for f in fields])
    seen = articles.select(F.explode(every).alias("token"))
    if broadcastable(tokens, max_broadcast_rows):
        return seen.join(F.broadcast(tokens), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return seen.where("token <> ''").groupBy("token").agg(F.count(F.lit(1)).alias("n")).join(tokens, "token", "left_semi")


def rarest_anchors(wanted: DataFrame, key_cols: Sequence[str], counts: DataFrame) -> DataFrame:
    """(*key, token, n, need): the rarest of each query's tokens, ties by the token. Queries with a
    token that never occurs match nothing and are dropped."""
    key = list(key_cols)
    each = wanted.select(*key, "need", F.explode("need").alias("token")).join(counts, "token", "left")
    least = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("a")
    return each.groupBy(*key, "need").agg(least) \
        .select(*key, F.col("a.token").alias("token"), F.col("a.n").alias("n"), "need").where("n > 0")


def longest_anchors(wanted: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """(*key, token, need): the longest of each query's tokens, ties by the token."""
    longest = F.array_max(F.transform("need", lambda t: F.struct(F.length(t).alias("l"), t.alias("t"))))
    return wanted.where(F.size("need") > 0).select(*key_cols, longest["t"].alias("token"), "need")


def contains(tokens: Column, need: Column, phrase: bool) -> Column:
    """Does the token array hold all needed tokens; with ``phrase`` as one contiguous run?"""
    if not phrase:
        return F.size(F.array_except(need, tokens)) == 0
    run = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    return run(tokens).contains(run(need))


def anchor_candidates(articles: DataFrame, anchors: DataFrame, id_col: str, key_cols: Sequence[str],
                      fields: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """(*key, id, *carry, field, tokens, need): one row for each field that holds an anchor. The
    anchors are broadcast; the token array is carried next to the exploded token, which is free
    as the join follows in the same stage. A field's tokens are cut to those of at most
    ``FEW_ANCHORS`` distinct anchors, known to the plan, before they are exploded."""
    few = [r.token for r in anchors.select("token").distinct().limit(FEW_ANCHORS + 1).collect()]
    tokens = F.array_distinct("tokens")
    if len(few) <= FEW_ANCHORS:
        tokens = F.array_intersect("tokens", F.lit(few) if few else F.array().cast("array<string>"))
    fielded = field_tokens(articles, [id_col, *carry], fields)
    return fielded.withColumn("token", F.explode(tokens)) \
        .join(F.broadcast(anchors.select(*key_cols, "token", "need")), "token").drop("token")


def anchored_matches(articles: DataFrame, anchors: DataFrame, id_col: str, key_cols: Sequence[str],
                     fields: Sequence[str], carry: Sequence[str] = (), phrase: bool = False,
                     max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Distinct (*key, id, *carry) of the articles with a field that holds what a query needs.
    ``anchors`` should be a stored table: its size is measured here."""
    key, keep = list(key_cols), [id_col, *carry]
    good = contains(F.col("tokens"), F.col("need"), phrase)
    if broadcastable(anchors, max_broadcast_rows):
        found = anchor_candidates(articles, anchors, id_col, key, fields, carry)
        return found.where(good).select(*key, *keep).distinct()
    pairs = field_tokens(articles, [id_col], fields).select(id_col, "field", F.explode("tokens").alias("token"))
    salts = 32
    if "n" in anchors.columns:       # spread the most frequent anchor like the average partition
        most, total = anchors.agg(F.max("n"), F.sum("n")).first()
        tasks = int(articles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salts = max(1, min(MOST_SALTS, -(-(most or 0) * tasks // max(total or 1, 1))))
    cand = salted_join(pairs, anchors.select(*key, "token"), ["token"], salt_buckets=salts,
                       salt_from=[id_col, "field"]).select(*key, id_col, "field").distinct()
    cand = materialize(cand)
    fielded = articles.join(cand, id_col).withColumn("tokens", tokenize(field_text(F.col("field"), fields)))
    return fielded.join(anchors.select(*key, "need"), key).where(good).select(*key, *keep).distinct()


def match_batch(articles: DataFrame, queries: DataFrame, id_col: str = "doi",
                fields: Sequence[str] | None = None, query_key: str = "query_id",
                query_col: str = "query", keywords_col: str | None = None,
                max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                counts: DataFrame | None = None) -> DataFrame:
    """T5: keyword matching for a whole table of queries -> (query_id, id).

    Each query is one keyword (its text), as the service sends it; pass
    ``keywords_col`` (ARRAY<STRING>) for several AND-ed keywords per query, and ``counts``
    (``token_counts``, stored) to anchor queries at their rarest instead of their longest token.
    Result rows are distinct.
    """
    flds = match_fields(articles, fields)
    if not flds:
        raise ValueError("no field to match")
    kw = F.col(keywords_col) if keywords_col else F.array(F.col(query_col))
    wanted = materialize(wanted_tokens(queries.select(query_key, kw.alias("_keywords")), [query_key], "_keywords"))
    anchors = longest_anchors(wanted, [query_key]) if counts is None else \
        materialize(rarest_anchors(wanted, [query_key], counts))
    arts = articles.where(F.col(id_col).isNotNull())
    found = anchored_matches(arts, anchors, id_col, [query_key], flds, max_broadcast_rows=max_broadcast_rows)
    every = wanted.where(F.size("need") == 0).select(query_key, F.lit(SENTINEL).alias("token"))
    if every.isEmpty():
        return found
    ids = arts.select(id_col, F.lit(SENTINEL).alias("token"))
    return found.unionByName(join_small(ids, every, ["token"], max_rows=max_broadcast_rows, salt_from=[id_col])
                             .select(query_key, id_col)).distinct()


def match_keywords(articles: DataFrame, keywords: Sequence[str | Sequence[str]], id_col: str = "doi",
                    fields: Sequence[str] | None = None) -> DataFrame:
    """T4: articles matching every keyword inside one field (OR over fields); an element
    that is a list of keywords asks for one of them.

    A filter in the scan: returns the matching article rows. An empty keyword list is an error, as
    in the reference.
    """
    if not keywords:
        raise ValueError("match_keywords needs at least one keyword")
    hit = F.lit(False)
    for f in match_fields(articles, fields):
        words = tokenize(F.col(f).cast("string"))
        every = F.lit(True)
        for group in keywords:
            any_of = F.lit(False)
            for k in ([group] if isinstance(group, str) else group):
                any_of = any_of | match_all_tokens(words, tokenize(F.lit(k)))
            every = every & any_of
        hit = hit | every
    return articles.where(F.col(id_col).isNotNull() & hit)


def union_hits(*hits: DataFrame) -> DataFrame:
    """Set union of (query_id, id) hit lists from several sources."""
    if not hits:
        raise ValueError("union_hits needs at least one hit list")
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    return out.distinct()


def link_items(articles: DataFrame, items: DataFrame, id_col: str = "doi",
               db_col: str = "db_name", fields: Sequence[str] | None = None,
               phrase: bool = False,
               max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS):
    """Dictionary tagging. Returns ``(links, empty_items)``.

    ``items`` has (item_id, name, item_type). An item is linked to every
    article whose field holds all tokens of its name (``phrase=True``: the
    normalised name as a contiguous run of tokens). Links are
    (pmid, db_name, item_id, item_type), stored once, as both results read
    them. Items whose name has no token, or that match nothing, are
    ``empty_items`` (item_id, item_type), never linked to everything.
    """
    flds = match_fields(articles, fields)
    key = ["item_id", "item_type"]
    arts = articles.where(F.col(id_col).isNotNull())
    carry = [db_col] if db_col in articles.columns else []
    anchors = item_anchors(arts, items, flds, phrase, max_broadcast_rows)
    found = anchored_matches(arts, anchors, id_col, key, flds, carry, phrase, max_broadcast_rows)
    links = materialize(found.select(
        F.col(id_col).cast("string").alias("pmid"),
        (F.col(db_col) if carry else F.lit(None).cast("string")).alias("db_name"), "item_id", "item_type"))
    empty = items.select(*key).join(links.select(*key).distinct(), key, "left_anti")
    return links, empty


def item_anchors(articles: DataFrame, items: DataFrame, fields: Sequence[str], phrase: bool = False,
                 max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """(item_id, item_type, token, n, need), stored: each name's rarest token, and its distinct
    tokens (with ``phrase`` all of them, in order)."""
    key = ["item_id", "item_type"]
    tokens = tokenize("name")
    named = materialize(items.select(*key, (tokens if phrase else F.array_distinct(tokens)).alias("need"))
                        .where(F.size("need") > 0).distinct())
    distinct = materialize(named.select(F.explode("need").alias("token")).distinct())
    counts = token_counts(articles, fields, distinct, max_broadcast_rows)
    return materialize(rarest_anchors(named, key, counts))


__all__ = ["token_pairs", "wanted_tokens", "token_counts", "anchored_matches", "match_batch",
           "match_keywords", "union_hits", "link_items", "build_token_index", "match_index"]


# ------------------------------------------------------------ stored token index
# Token buckets of the stored index: size them so one bucket holds about 1 GB
# of pairs at the target scale (1024 buckets ~ 1 TB of pairs).
INDEX_BUCKETS = 1024
# Writing tasks one token bucket may be spread over.
INDEX_SPREAD = 64


def token_bucket(col, buckets: int = INDEX_BUCKETS):
    """Hash bucket of a token: the partition column of the stored index."""
    c = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def build_token_index(articles: DataFrame, path: str, id_col: str = "doi",
                      fields: Sequence[str] | None = None, buckets: int = INDEX_BUCKETS) -> str:
    """Write the corpus's (id, field, token) pairs once, partitioned by token
    bucket. Lookups then read only the buckets of their tokens instead of
    tokenising the whole corpus per query batch (the reference keeps its
    tokenised corpus in memory for the same reason)."""
    flds = match_fields(articles, fields)
    pairs = token_pairs(articles.where(F.col(id_col).isNotNull()), id_col, flds)
    # A bucket holding a very common token must not become one writing task:
    # rows are spread over (bucket, hash of the article id) so one bucket is
    # written by up to INDEX_SPREAD tasks, each producing its own file.
    spread = F.pmod(F.xxhash64(id_col), F.lit(INDEX_SPREAD))
    (pairs.withColumn("tb", token_bucket("token", buckets))
          .repartition(F.col("tb"), spread).sortWithinPartitions("tb", "token")
          .write.mode("errorifexists").partitionBy("tb").parquet(path))
    return path


def match_index(index: DataFrame, queries: DataFrame, id_col: str = "doi",
                fields: Sequence[str] | None = None, query_key: str = "query_id",
                query_col: str = "query", keywords_col: str | None = None,
                buckets: int = INDEX_BUCKETS,
                max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """T5 over a stored token index: same result as ``match_batch``.

    Each query token carries its bucket, so that the equi-joins on (tb, token)
    with a broadcast side let dynamic partition pruning skip the other buckets.
    The anchors are joined first; the rest of a query's tokens is looked up for
    the candidates alone.
    """
    flds = list(fields) if fields is not None else list(DEFAULT_FIELDS)
    flds = [f for f in flds if f != "date"]
    kw = F.col(keywords_col) if keywords_col else F.array(F.col(query_col))
    wanted = wanted_tokens(queries.select(query_key, kw.alias("_keywords")), [query_key], "_keywords")
    empty = F.size("need") == 0
    wanted = materialize(wanted.withColumn("need", F.when(empty, F.array(F.lit(SENTINEL))).otherwise(F.col("need"))))
    anchors = longest_anchors(wanted, [query_key]).withColumn("tb", token_bucket("token", buckets))
    pairs = index.where(F.col("field").isin(flds))
    at = ["tb", "token"]
    cand = join_small(pairs, anchors.select(query_key, *at, F.size("need").alias("n_need")), at,
                      max_rows=max_broadcast_rows, salt_from=[id_col, "field"])
    cand = materialize(cand.select(query_key, id_col, "field", "n_need").distinct())
    rest = anchors.select(query_key, F.explode(F.array_except("need", F.array("token"))).alias("token")) \
        .withColumn("tb", token_bucket("token", buckets))
    asked = materialize(cand.join(rest, query_key))
    if asked.isEmpty():
        return cand.select(query_key, id_col).distinct()
    seen = join_small(pairs, asked, [*at, id_col, "field"], max_rows=max_broadcast_rows, salt_from=[id_col, "field"])
    full = seen.groupBy(query_key, id_col, "field", "n_need").agg(F.count_distinct("token").alias("n")) \
        .where("n = n_need - 1")
    alone = cand.where("n_need = 1")
    return full.select(query_key, id_col).unionByName(alone.select(query_key, id_col)).distinct()
