"""The registered queries of this package: each applies one operator to its whole table.

``QUERIES`` maps a name to a function of (spark, sf_dir); ``ORACLES`` holds DuckDB SQL where SQL
can express the result. The tokenizer files are parameters of the operators; the queries take
those of the installed ``public_tokenizers`` package.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from litrank.llm import (bpe_exchange, conversation_repair, embedding_graph, language_mixture, merge_counts, pii_crf,
                         suffix_tree, token_files, toxicity, whitening)
from litrank.llm.digest_index import DigestIndex
from litrank.llm.ngram_join import ngram_jaccard_join
from litrank.llm.packing import pack_documents
from litrank.session import scratch_path

BPE_JSON = "byte_bpe_50k.json"
BPE_RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_robust_pruned_graph(spark, sf_dir):
    return embedding_graph.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op2_sum_of_squares_packing(spark, sf_dir):
    pieces = pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_JSON))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def _id_hash(buckets):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(buckets))


def op3_language_mixture(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = language_mixture.fit(docs.where(_id_hash(4) != 2).select("text", "lang"))
    return language_mixture.predict(docs.select("doc_id", "text"), model) \
        .select("doc_id", F.coalesce(_id_hash(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "mixture")


def op4_subword_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    learn = labels.where(_id_hash(5) != 0)
    model = toxicity.fit(docs, learn)
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(_id_hash(5) == 0, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op5_ngram_jaccard_join(spark, sf_dir):
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), n=4, percent=85, count_links=True) \
        .select("doc_id", "n_shingles", "component_id", "n_links")


def op6_bpe_exchange(spark, sf_dir):
    ranks = public_tokenizers.path(BPE_RANKS)
    encoded = bpe_exchange.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe_exchange.decode(encoded, ranks).select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_digest_index_dedup(spark, sf_dir):
    marks = DigestIndex(spark).add(_table(spark, sf_dir, "documents"))
    return marks.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_pii_semi_markov(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii_crf.find_spans(docs, pii_crf.fit(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                        F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


def op9_suffix_tree(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (_id_hash(10) != 0).alias("learn"))
    tree = suffix_tree.fit(docs.where("learn"))
    return suffix_tree.score(docs, tree).select(
        "doc_id", F.coalesce(_id_hash(10) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
        "train_tokens", "base_score", "score")


def op10_token_files(spark, sf_dir):
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path, public_tokenizers.path(BPE_JSON))
    return token_files.read_token_files(spark, path)


def op11_rank_synchronous_counts(spark, sf_dir):
    return merge_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_JSON), limit=512)


def op12_conversation_repair(spark, sf_dir):
    return conversation_repair.repair(conversation_repair.damage(_table(spark, sf_dir, "conversations")))


def op13_jacobi_davidson_whitening(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(rows, whitening.fit(rows, components=4))


QUERIES = {f.__name__: f for f in (
    op1_robust_pruned_graph,
    op2_sum_of_squares_packing,
    op3_language_mixture,
    op4_subword_toxicity,
    op5_ngram_jaccard_join,
    op6_bpe_exchange,
    op7_digest_index_dedup,
    op8_pii_semi_markov,
    op9_suffix_tree,
    op10_token_files,
    op11_rank_synchronous_counts,
    op12_conversation_repair,
    op13_jacobi_davidson_whitening,
)}

ORACLES = {
    "op1_robust_pruned_graph": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] e FROM embeddings),
        n AS (
            SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) l FROM v
            WHERE label IS NOT NULL AND len(e) > 0 AND list_count(e) = len(e)
              AND len(list_filter(e, lambda x: NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
        p AS (
            SELECT a.vec_id a, b.vec_id b FROM n a JOIN n b
              ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
            WHERE list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.98),
        r AS (
            SELECT vec_id node, vec_id root FROM v
            UNION
            SELECT p.b, r.root FROM r JOIN p ON r.node = p.a),
        c AS (SELECT node, min(root) component_id FROM r GROUP BY node),
        k AS (SELECT a, count(*) n FROM p GROUP BY a)
        SELECT v.vec_id, coalesce(k.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
        FROM v JOIN c ON c.node = v.vec_id LEFT JOIN k ON k.a = v.vec_id""",
    "op5_ngram_jaccard_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') w
            FROM documents),
        s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4
                THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) g
            FROM d),
        i AS (SELECT doc_id, len(g) n, unnest(g) t FROM s),
        o AS (
            SELECT a.doc_id a, b.doc_id b, any_value(a.n) na, any_value(b.n) nb, count(*) c
            FROM i a JOIN i b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        p AS (SELECT a, b FROM o WHERE 100 * c >= 85 * (na + nb - c)),
        r AS (
            SELECT doc_id node, doc_id root FROM s
            UNION
            SELECT p.b, r.root FROM r JOIN p ON r.node = p.a)
        SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, c.component_id, coalesce(k.n, 0) AS n_links
        FROM s JOIN (SELECT node, min(root) component_id FROM r GROUP BY node) c ON c.node = s.doc_id
        LEFT JOIN (SELECT a, count(*) n FROM p GROUP BY a) k ON k.a = s.doc_id""",
    "op7_digest_index_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) h
            FROM documents),
        g AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) k,
                   count(*) OVER (PARTITION BY h) c
            FROM d)
        SELECT doc_id, k AS keep_id, c AS group_size, doc_id = k AS kept, h AS text_sha256 FROM g""",
    "op12_conversation_repair": r"""
        WITH RECURSIVE crc_table AS (
            SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
                lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) t),
        keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text,
                   coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') k
            FROM conversations),
        hashed AS (
            SELECT conv_id, turn, role, text, xor(list_reduce(
                list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 side
            FROM keyed, crc_table),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN side = 4 THEN 'user' ELSE role END role,
                   CASE side WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END text,
                   unnest(CASE side WHEN 3 THEN [1, 2] ELSE [1] END) copy
            FROM hashed WHERE side <> 0),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) i,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) seen,
                   regexp_replace(text, '[\x20\x09-\x0D]+$', '') shown
            FROM damaged),
        faulty AS (
            SELECT *, CASE WHEN shown = '' THEN 'b' WHEN seen > 1 THEN 'd'
                           WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END fault,
                   role[1] c, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] pair
            FROM placed),
        -- best path to each grammar state: cost, audit, repaired lines; null where there is none
        walk AS (
            SELECT conv_id, 0::BIGINT i, {'p': 0, 'a': '', 'r': []::VARCHAR[]} s0,
                   NULL::STRUCT(p INTEGER, a VARCHAR, r VARCHAR[]) s1, NULL::STRUCT(p INTEGER, a VARCHAR, r VARCHAR[]) s2,
                   NULL::STRUCT(p INTEGER, a VARCHAR, r VARCHAR[]) s3
            FROM (SELECT DISTINCT conv_id FROM faulty)
            UNION ALL
            SELECT conv_id, i,
                CASE WHEN s0 IS NOT NULL THEN {'p': s0.p + 2, 'a': s0.a || 'D', 'r': s0.r} END,
                list_min(list_filter([
                    CASE WHEN s1 IS NOT NULL THEN {'p': s1.p + 2, 'a': s1.a || 'D', 'r': s1.r} END,
                    CASE WHEN s0 IS NOT NULL AND c = 's' AND fault IN ('', 't')
                        THEN {'p': s0.p + pay, 'a': s0.a || 'K', 'r': list_append(s0.r, line)} END], lambda x: x IS NOT NULL)),
                list_min(list_filter([
                    CASE WHEN u2 IS NOT NULL THEN {'p': u2.p + 2, 'a': u2.a || 'D', 'r': u2.r} END,
                    CASE WHEN before_u IS NOT NULL AND fault IN ('', 't') AND c = 'u'
                        THEN {'p': before_u.p + pay, 'a': before_u.a || 'K', 'r': list_append(before_u.r, line)} END,
                    CASE WHEN before_u IS NOT NULL AND fault IN ('', 't')
                        THEN {'p': before_u.p + pay + 1, 'a': before_u.a || 'R', 'r': list_append(before_u.r, 'user:' || text)} END],
                    lambda x: x IS NOT NULL)),
                list_min(list_filter([
                    CASE WHEN u3 IS NOT NULL THEN {'p': u3.p + 2, 'a': u3.a || 'D', 'r': u3.r} END,
                    CASE WHEN u2 IS NOT NULL AND fault IN ('', 't') AND c = 'a'
                        THEN {'p': u2.p + pay, 'a': u2.a || 'K', 'r': list_append(u2.r, line)} END,
                    CASE WHEN u2 IS NOT NULL AND fault IN ('', 't')
                        THEN {'p': u2.p + pay + 1, 'a': u2.a || 'R', 'r': list_append(u2.r, 'assistant:' || text)} END],
                    lambda x: x IS NOT NULL))
            FROM (
                SELECT *, list_min(list_filter([s0, s1, u3], lambda x: x IS NOT NULL)) before_u
                FROM (
                    SELECT w.conv_id, f.i, w.s0, w.s1, f.c, f.fault, f.text, f.role || ':' || f.text line,
                           CASE f.fault WHEN 't' THEN 5 ELSE 0 END pay,
                           -- states 2 and 3 after Inserts before this row
                           list_min(list_filter([s2] || list_transform(list_filter([s0, s1, s3], lambda x: x IS NOT NULL),
                               lambda x: {'p': x.p + 5, 'a': x.a || 'I', 'r': list_append(x.r, 'user:')}),
                               lambda x: x IS NOT NULL)) u2,
                           list_min(list_filter([s3] || list_transform(list_filter([s2], lambda x: x IS NOT NULL),
                               lambda x: {'p': x.p + 5, 'a': x.a || 'I', 'r': list_append(x.r, 'assistant:')})
                               || list_transform(list_filter([s0, s1], lambda x: x IS NOT NULL),
                               lambda x: {'p': x.p + 10, 'a': x.a || 'II', 'r': x.r || ['user:', 'assistant:']}),
                               lambda x: x IS NOT NULL)) u3
                    FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1))),
        best AS (
            SELECT conv_id, list_min(list_filter([s0, s3,
                CASE WHEN s2 IS NOT NULL THEN {'p': s2.p + 5, 'a': s2.a || 'I', 'r': list_append(s2.r, 'assistant:')} END,
                CASE WHEN s1 IS NOT NULL THEN {'p': s1.p + 10, 'a': s1.a || 'II', 'r': s1.r || ['user:', 'assistant:']} END],
                lambda x: x IS NOT NULL)) b
            FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
        counted AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) gaps,
                   count(*) FILTER (fault = 'b') blank, count(*) FILTER (fault = 'd') duplicate,
                   count(*) FILTER (fault = 't') truncated,
                   count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) illegal
            FROM faulty GROUP BY conv_id)
        SELECT o.conv_id, coalesce(n.gaps, 0)::BIGINT AS gaps, coalesce(n.blank, 0) AS blank,
               coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated,
               coalesce(n.illegal, 0) AS illegal, coalesce(b.p, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit,
               sha256(coalesce(array_to_string(b.r, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o
        LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN counted n ON n.conv_id IS NOT DISTINCT FROM o.conv_id""",
}
