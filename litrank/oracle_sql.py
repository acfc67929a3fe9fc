"""
FIXTURES.md), not from the Spark plans. Shared SQL macros live here.

Regex classes: RE2 has no Unicode ``\\s``; the whitespace class below is the
same set Python's ``str.isspace`` uses, and the Spark side uses the same class.
"""

from __future__ import annotations

from litrank.constants import QUERY_PUNCTUATION
from litrank.fixtures import FIXTURES, ctes

WS = r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"
PUNCT_SQL = QUERY_PUNCTUATION.replace("'", "''")
SPACES = " " * len(QUERY_PUNCTUATION)


def norm(x: str) -> str:
    """T1 in DuckDB SQL."""
    t = f"translate(lower({x}), '{PUNCT_SQL}', '{SPACES}')"
    t = f"regexp_replace({t}, '^{WS}+|{WS}+$', '', 'g')"
    return f"regexp_replace({t}, ' +', ' ', 'g')"


def tok(x: str) -> str:
    """T2 in DuckDB SQL (null -> empty list)."""
    return f"list_filter(regexp_split_to_array({norm(f'coalesce({x}, {chr(39)}{chr(39)})')}, '{WS}+'), lambda t: t <> '')"


def r6(x: str) -> str:
    """Output rounding as Spark's ``round(double, 6)`` does it: the double's
    decimal text rounded half-up (DuckDB's own round works on the binary
    value and differs on decimal ties such as 0.0640625)."""
    return f"(CAST(round(CAST(CAST(CAST({x} AS DOUBLE) AS VARCHAR) AS DECIMAL(38,18)), 6) AS DOUBLE) + 0.0)"


def mean(x: str) -> str:
    return f"avg(CAST({x} AS DOUBLE))"


# B1 core as one SQL text; fields matched on the titles corpus: title and id.
def ranking_core(queries_view: str = "queries") -> str:
    flags = queries_view != "queries"
    pre = ctes("titles", "links", "sentiments", "drugs", "targets", queries_view, "rules")
    if flags:
        pre = pre.replace(f"{queries_view} AS (", "queries AS (", 1)
    keep = "(NOT q.do_filter OR s.precision > s.p90)" if flags else "s.precision > s.p90"
    top = "(NOT do_filter OR rank <= 50)" if flags else "rank <= 50"
    return pre + f""",
hits AS (
  SELECT DISTINCT q.query_id, t.pmid FROM queries q, titles t
  WHERE list_has_all({tok('t.title')}, {tok('q.query')})
     OR list_has_all({tok('t.pmid')}, {tok('q.query')})
),""" + ranking_tail(keep, top, "q.do_filter" if flags else "true AS do_filter")


def ranking_tail(keep: str, top: str, flag: str) -> str:
    """Q to ranked items, over the CTEs queries, hits, links, sentiments, drugs, targets, rules."""
    return f"""
qsize AS (SELECT query_id, count(*) AS n_query FROM hits GROUP BY query_id),
lq AS (SELECT h.query_id, l.pmid, l.item_id, l.item_type FROM links l JOIN hits h ON l.pmid = h.pmid),
tp AS (SELECT query_id, item_type, item_id, count(pmid) AS n_hit_item FROM lq GROUP BY ALL),
sent AS (
  SELECT d.query_id, d.item_type, d.item_id, coalesce({mean('s.sentiment_score')}, 0.0) AS sentiment
  FROM (SELECT DISTINCT query_id, item_type, item_id, pmid FROM lq) d
  LEFT JOIN sentiments s ON d.pmid = s.pmid GROUP BY ALL
),
counters AS (SELECT item_id, count(pmid) AS counter FROM links GROUP BY item_id),
catalog AS (
  SELECT item_id, name, 'drug' AS item_type FROM drugs
  UNION ALL SELECT item_id, name, 'target' FROM targets
),
base AS (
  SELECT tp.query_id, tp.item_type, tp.item_id, c.name, tp.n_hit_item,
         counters.counter AS n_item, qsize.n_query, sent.sentiment,
         CAST(tp.n_hit_item AS DOUBLE) / CAST(counters.counter AS DOUBLE) AS precision,
         CAST(tp.n_hit_item AS DOUBLE) / CAST(qsize.n_query AS DOUBLE) AS recall
  FROM tp JOIN sent USING (query_id, item_type, item_id)
  JOIN catalog c ON c.item_id = tp.item_id AND c.item_type = tp.item_type
  JOIN counters ON counters.item_id = tp.item_id
  JOIN qsize ON qsize.query_id = tp.query_id
),
metrics AS (
  SELECT *, (CAST(1.25 AS DOUBLE) * precision * recall) / (CAST(0.25 AS DOUBLE) * (precision + recall)) AS f_0_5
  FROM base
),
scored0 AS (SELECT *, (CAST(4.0 AS DOUBLE) * f_0_5 + sentiment) / CAST(5.0 AS DOUBLE) AS score0 FROM metrics),
overrides AS (
  SELECT m.query_id, m.item_id, max(r.score) AS oscore
  FROM scored0 m JOIN queries q ON q.query_id = m.query_id
  JOIN rules r ON r.item_name = m.name AND contains(lower(q.query), lower(r.trigger))
  WHERE m.item_type = 'drug' GROUP BY ALL
),
scored AS (
  SELECT s.*, coalesce(o.oscore, s.score0) AS ranking_score,
         quantile_cont(s.precision, 0.9) OVER (PARTITION BY s.query_id, s.item_type) AS p90
  FROM scored0 s LEFT JOIN overrides o ON o.query_id = s.query_id AND o.item_id = s.item_id
),
kept AS (
  SELECT s.*, {flag},
         row_number() OVER (PARTITION BY s.query_id, s.item_type
                            ORDER BY s.ranking_score DESC NULLS LAST, s.item_id) AS rank
  FROM scored s JOIN queries q ON q.query_id = s.query_id WHERE {keep}
),
result AS (SELECT * FROM kept WHERE {top})
"""


RANKED = f"""
SELECT query_id, item_type, item_id, name, CAST(n_hit_item AS BIGINT) AS n_hit_item,
       CAST(n_item AS BIGINT) AS n_item, {r6('precision')} AS precision, {r6('recall')} AS recall,
       {r6('f_0_5')} AS f_0_5, {r6('sentiment')} AS sentiment, {r6('ranking_score')} AS ranking_score,
       {r6('p90')} AS p90, CAST(rank AS BIGINT) AS rank
FROM result"""


ORACLES: dict[str, str] = {
    "b1_rank_items": ranking_core() + RANKED,
}


# ---------------------------------------------------------------- text
STOP_LIST = "sw.words"
STOP_JOIN = ", (SELECT list(word) AS words FROM stopwords) sw"


def clean(x: str) -> str:
    """T7 in DuckDB SQL."""
    t = f"lower(coalesce({x}, ''))"
    t = f"regexp_replace({t}, '^(@[\\p{{L}}\\p{{N}}_]+)', '')"
    t = f"regexp_replace({t}, '^(rt @)', '')"
    t = f"regexp_replace({t}, '[^a-zA-Z0-9]', ' ', 'g')"
    t = f"regexp_replace({t}, 'https.*$', '')"
    t = f"regexp_replace({t}, 'amp', '', 'g')"
    return f"trim({t})"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, ' +'), lambda t: t <> '')"


def destop(x: str) -> str:
    """T8 in DuckDB SQL: drop stop words, keep order and repeats."""
    return f"array_to_string(list_filter({words(x)}, lambda t: NOT list_contains({STOP_LIST}, t)), ' ')"


ORACLES.update({
    "t1_normalize_query": ctes("articles") + f"SELECT doi, {norm('abstract')} AS normalized FROM articles",
    "t2_tokenize": ctes("articles") + f"""
SELECT doi, CAST(len({tok('abstract')}) AS INTEGER) AS n_tokens,
       array_to_string({tok('abstract')}, '|') AS tokens FROM articles""",
    "t3_match_all_tokens": ctes("articles") + f"""
SELECT doi, list_has_all({tok('abstract')}, {tok("'The of'")}) AS matches FROM articles""",
    "t4_match_keywords": ctes("articles") + f""",
atok AS (SELECT doi, db_name, {tok('title')} AS tt, {tok('doi')} AS td, {tok('abstract')} AS ta FROM articles)
SELECT doi, db_name FROM atok
WHERE list_has_all(tt, {tok("'The of'")}) OR list_has_all(td, {tok("'The of'")})
   OR list_has_all(ta, {tok("'The of'")})""",
    "t5_match_batch": ctes("titles", "queries") + f"""
SELECT DISTINCT q.query_id, t.pmid FROM queries q, titles t
WHERE list_has_all({tok('t.title')}, {tok('q.query')}) OR list_has_all({tok('t.pmid')}, {tok('q.query')})""",
    "t6_union_hits": ctes("titles", "articles", "queries") + f""",
q AS (SELECT query_id, query FROM queries UNION ALL SELECT CAST(4 AS BIGINT), 'the of')
SELECT q.query_id, t.pmid FROM q, titles t
WHERE list_has_all({tok('t.title')}, {tok('q.query')}) OR list_has_all({tok('t.pmid')}, {tok('q.query')})
UNION
SELECT q.query_id, a.doi FROM (SELECT query_id, {tok('query')} AS qt FROM q) q,
  (SELECT doi, {tok('title')} AS tt, {tok('doi')} AS td, {tok('abstract')} AS ta FROM articles) a
WHERE list_has_all(a.tt, q.qt) OR list_has_all(a.td, q.qt) OR list_has_all(a.ta, q.qt)""",
    "t7_clean_text": ctes("articles") + f"SELECT doi, {clean('abstract')} AS cleaned FROM articles",
    "t8_remove_stopwords": ctes("articles", "stopwords") + f"""
SELECT doi, {destop(clean('abstract'))} AS cleaned FROM articles{STOP_JOIN}""",
    "t9_sentiment_lexicon": ctes("articles", "stopwords", "lexicon") + f""",
w AS (SELECT doi, unnest({words(destop(clean('abstract')))}) AS word FROM articles{STOP_JOIN})
SELECT a.doi, {r6('coalesce(' + mean('l.polarity') + ', 0.0)')} AS sentiment_score
FROM articles a LEFT JOIN w ON w.doi = a.doi LEFT JOIN lexicon l ON l.word = w.word
GROUP BY a.doi""",
})


# ------------------------------------------------- joins, predicates, aggregates
def url_sql(db: str, pid: str, url: str) -> str:
    return (f"coalesce({url}, CASE WHEN {db} = 'PubMed' THEN 'https://pubmed.ncbi.nlm.nih.gov/' || {pid} || '/' "
            f"WHEN {db} IN ('Crossref', 'Xrxiv') THEN 'https://www.doi.org/' || {pid} END)")


def has_pdf_sql(p: str) -> str:
    return f"({p} IS NOT NULL AND {p} <> 'NULL')"


def pdf_url_sql(p: str) -> str:
    return f"CASE WHEN {has_pdf_sql(p)} THEN 'https://www.ncbi.nlm.nih.gov/pmc/articles/' || {p} || '/pdf' ELSE '' END"


def info_cols(t: str = "t") -> str:
    """J4 columns of a LEFT JOIN titles {t}: defaults when unmatched."""
    m = f"({t}.pmid IS NOT NULL)"
    return (f"CASE WHEN {m} THEN {t}.title ELSE '' END AS title, "
            f"CASE WHEN {m} THEN {t}.db_name ELSE '' END AS db_name, "
            f"CASE WHEN {m} THEN {url_sql(t + '.db_name', t + '.pmid', t + '.url')} ELSE '' END AS url, "
            f"CASE WHEN {m} THEN {has_pdf_sql(t + '.pmcid')} ELSE false END AS has_pdf, "
            f"CASE WHEN {m} THEN {pdf_url_sql(t + '.pmcid')} ELSE '' END AS pdf_url")


def j8_sql(db: str | None = None) -> str:
    """J8 by brute force over pre-tokenised articles and names."""
    dbcol = f"'{db}'" if db else "a.db_name"
    conds = " OR ".join(f"list_has_all(a.{f}, d.nt)" for f in ("tt", "td", "ta"))
    return ctes("articles", "dictionary") + f""",
atok AS (SELECT doi, db_name, {tok('title')} AS tt, {tok('doi')} AS td, {tok('abstract')} AS ta FROM articles),
dt AS (SELECT item_id, item_type, {tok('name')} AS nt FROM dictionary),
j8 AS (SELECT a.doi AS pmid, {dbcol} AS db_name, d.item_id, d.item_type FROM atok a, dt d
       WHERE len(d.nt) > 0 AND ({conds}))
"""


def j8_phrase_sql() -> str:
    """Names as contiguous runs of tokens: substrings between single spaces."""
    run = lambda x: f"concat(' ', array_to_string({x}, ' '), ' ')"
    conds = " OR ".join(f"contains({run('a.' + f)}, {run('d.nt')})" for f in ("tt", "td", "ta"))
    return j8_sql() + f"""
SELECT a.doi AS pmid, a.db_name, d.item_id, d.item_type FROM atok a, dt d WHERE len(d.nt) > 0 AND ({conds})"""


CORE = ranking_core()
M_OUT = ", ".join(f"{r6(c)} AS {c}" for c in ("precision", "recall", "f_0_5", "sentiment"))

ORACLES.update({
    "j1_restrict_links": CORE + "SELECT query_id, pmid, item_id, item_type FROM lq",
    "j2_attach_names": CORE + """
SELECT tp.query_id, tp.item_type, tp.item_id, c.name, tp.n_hit_item
FROM tp JOIN catalog c ON c.item_id = tp.item_id AND c.item_type = tp.item_type""",
    "j3_attach_totals": CORE + """
SELECT tp.query_id, tp.item_type, tp.item_id, tp.n_hit_item, c.counter AS n_item
FROM tp JOIN counters c ON c.item_id = tp.item_id""",
    "j4_attach_article_info": ctes("links", "titles_known") + f"""
SELECT l.pmid, l.item_id, l.item_type, {info_cols('t')}
FROM links l LEFT JOIN titles_known t ON t.pmid = l.pmid""",
    "j5_attach_sentiment": CORE + """
SELECT d.query_id, d.item_type, d.item_id, d.pmid, d.n_links, s.sentiment_score
FROM (SELECT query_id, item_type, item_id, pmid, count(pmid) AS n_links FROM lq GROUP BY ALL) d
LEFT JOIN sentiments s ON s.pmid = d.pmid""",
    "j6_items_to_collect": ctes("drugs", "targets", "dictionary", "links_db", "useless") + """,
items AS (SELECT item_id, name, 'drug' AS item_type FROM drugs
          UNION ALL SELECT item_id, name, 'target' FROM targets
          UNION ALL SELECT item_id, name, item_type FROM dictionary)
SELECT * FROM items
WHERE item_id NOT IN (SELECT item_id FROM links_db WHERE db_name = 'PubMed')
  AND item_id NOT IN (SELECT item_id FROM useless WHERE db_name = 'PubMed')""",
    "j7_articles_missing_info": ctes("links_db", "titles_known") + """
SELECT pmid FROM links_db WHERE pmid NOT IN (SELECT pmid FROM titles_known)""",
    "j8_link_items": j8_sql() + "SELECT * FROM j8",
    "j8_link_items_phrase": j8_phrase_sql(),
    "j9_lookup_popular": ctes("titles", "queries") + f"""
SELECT DISTINCT q.query_id, t.pmid FROM queries q, titles t
WHERE list_has_all({tok('t.title')}, {tok('q.query')}) OR list_has_all({tok('t.pmid')}, {tok('q.query')})""",
    "j10_orphan_links": ctes("links", "drugs", "targets") + """,
catalog AS (SELECT item_id, 'drug' AS item_type FROM drugs UNION ALL SELECT item_id, 'target' FROM targets)
SELECT l.* FROM links l ANTI JOIN catalog c ON c.item_id = l.item_id AND c.item_type = l.item_type""",
    "p1_links_where": CORE + """
SELECT * FROM links WHERE pmid IN (SELECT pmid FROM hits) AND item_type = 'target'""",
    "p2_titles_where": CORE + """
SELECT pmid, db_name, url, title, pmcid FROM titles WHERE pmid IN (SELECT pmid FROM hits)""",
    "p3_sentiments_where": CORE + """
SELECT pmid, sentiment_score FROM sentiments WHERE pmid IN (SELECT pmid FROM hits)""",
    "p4_split_by_type": ctes("links") + "SELECT * FROM links WHERE item_type = 'target'",
    "p5_drop_unusable_links": ctes("links", "drug_catalog") + """
SELECT * FROM links WHERE item_id NOT IN (
  SELECT drugbank_id FROM drug_catalog
  WHERE type IS DISTINCT FROM 'SmallMoleculeDrug' OR state IS DISTINCT FROM 'solid')""",
    "p6_db_filter": ctes("links_db") + "SELECT * FROM links_db WHERE db_name = 'Crossref'",
    "p7_article_url": ctes("titles") + f"SELECT pmid, {url_sql('db_name', 'pmid', 'url')} AS url FROM titles",
    "p8_pdf_fields": ctes("titles") + f"""
SELECT pmid, {has_pdf_sql('pmcid')} AS has_pdf, {pdf_url_sql('pmcid')} AS pdf_url FROM titles""",
    "a1_item_counters": ctes("links") + """
SELECT item_id, min(item_type) AS item_type, count(pmid) AS counter FROM links GROUP BY item_id""",
    "a2_items_in_query": CORE + "SELECT * FROM tp",
    "a4_mean_sentiment": CORE + f"SELECT query_id, item_type, item_id, {r6('sentiment')} AS sentiment FROM sent",
    "a5_query_size": CORE + "SELECT * FROM qsize",
    "a6_precision_p90": CORE + f"""
SELECT query_id, item_type, {r6('quantile_cont(precision, 0.9)')} AS p90, {r6('quantile_cont(recall, 0.9)')} AS r90
FROM metrics GROUP BY ALL""",
    "a7_known_items": ctes("links_db") + "SELECT DISTINCT item_id FROM links_db WHERE db_name = 'Xrxiv'",
    "a8_unique_articles": ctes("links_db") + "SELECT DISTINCT pmid FROM links_db WHERE db_name = 'PubMed'",
    "m1_confusion": CORE + """
SELECT query_id, item_type, item_id, n_hit_item AS tp, n_item - n_hit_item AS fp,
       n_query - n_hit_item AS fn FROM base""",
    "m6_item_metrics": CORE + f"""
SELECT query_id, item_type, item_id, name, n_hit_item, n_item, n_query, {M_OUT},
       {r6('score0')} AS ranking_score FROM scored0""",
    "r1_apply_overrides": CORE + f"""
SELECT query_id, item_type, item_id, name, {r6('ranking_score')} AS ranking_score FROM scored""",
    "r2_filter_above_p90": CORE + f"""
SELECT query_id, item_type, item_id, {r6('precision')} AS precision, {r6('p90')} AS p90
FROM scored WHERE precision > p90""",
    "r3_top_k_by_score": CORE + f""",
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, item_type
                                    ORDER BY ranking_score DESC NULLS LAST, item_id) AS rank FROM scored)
SELECT query_id, item_type, item_id, {r6('ranking_score')} AS ranking_score, rank FROM rk WHERE rank <= 50""",
    "r6_sort_for_display": CORE + f"""
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY {r6('f_0_5')} DESC, item_id) AS position, item_id,
       {r6('f_0_5')} AS f_0_5
FROM result WHERE item_type = 'drug'""",
})


def metrics_json(n_hit: str = "n_hit_item") -> str:
    """The text of an item's JSON entry without its articles, as json.dumps writes it (names are ASCII)."""
    return (f"""to_json(coalesce(name, item_id))::VARCHAR || ': {{"counter": ' || {n_hit} || ', "item_pmids": [], "metrics": """
            f"""{{"(Search + {{}}) Publications": ' || {n_hit} || ', "{{}} Publications": ' || n_item || """
            """', "Precision": ' || precision || ', "Recall": ' || recall || ', "F-0.5": ' || f_0_5 || """
            """', "sentiment": ' || sentiment || ', "ranking_score": ' || ranking_score || '}}'""")


def trim_sql(group: list[str], budget: int) -> str:
    """R5 over CTEs ``info`` (group, item_id, pmid, article fields) and ``items`` (group, item_id,
    name, metrics); defines ``kept``. Starts with a comma. The bytes of a round are those of its whole
    JSON text: entries and articles with ", " between them, and two braces."""
    g = ", ".join(group)
    gi = ", ".join(group + ["item_id"])
    using = ", ".join(group)
    return f""",
sized AS (
  SELECT *, strlen(CAST(to_json(struct_pack(pmid := pmid, title := title, db_name := db_name, url := url,
                                             has_pdf := has_pdf, pdf_url := pdf_url)) AS VARCHAR)) + 11 AS bytes,
         row_number() OVER (PARTITION BY {gi} ORDER BY pmid) AS rank,
         count(*) OVER (PARTITION BY {gi}) AS n
  FROM info
),
shell AS (SELECT {g}, 2 + sum(strlen({metrics_json()})) + 2 * (count(*) - 1) AS shell FROM items GROUP BY ALL),
-- the loop: each round leaves the first quarter of every list, until the answer fits or all lists are empty
loops AS (SELECT unnest(range(0, 31)) AS r),
left_list AS (
  SELECT {gi}, r, sum(bytes) + 2 * (count(*) - 1) AS b FROM sized, loops
  WHERE rank <= n // CAST(pow(4, r) AS BIGINT) GROUP BY ALL),
left_over AS (
  SELECT g.*, r, coalesce(sum(b), 0) AS b FROM (SELECT DISTINCT {g} FROM sized) g CROSS JOIN loops
  LEFT JOIN left_list USING ({using}, r) GROUP BY ALL),
ends AS (
  SELECT {g}, r, b = 0 AS empty, b + coalesce(s.shell, 0) <= {budget} AS fits
  FROM left_over LEFT JOIN shell s USING ({using})),
choice AS (SELECT {g}, min(r) AS trim_round, NOT arg_min(fits, r) AS over_budget FROM ends WHERE fits OR empty GROUP BY ALL),
trimmed AS (SELECT sized.*, c.trim_round, c.over_budget FROM sized JOIN choice c USING ({using})
         WHERE rank <= n // CAST(pow(4, c.trim_round) AS BIGINT))
"""


def r5_sql(budget: int = 300_000) -> str:
    kind = "CASE WHEN c.name IS NULL THEN 'orphan' ELSE {t}.item_type END AS item_type"
    return CORE + f""",
held AS (
  SELECT tp.query_id, {kind.format(t='tp')}, tp.item_id, c.name, tp.n_hit_item, counters.counter AS n_item, sent.sentiment,
         CAST(tp.n_hit_item AS DOUBLE) / CAST(counters.counter AS DOUBLE) AS precision,
         CAST(tp.n_hit_item AS DOUBLE) / CAST(qsize.n_query AS DOUBLE) AS recall
  FROM tp JOIN sent USING (query_id, item_type, item_id) JOIN counters USING (item_id) JOIN qsize USING (query_id)
  LEFT JOIN catalog c ON c.item_id = tp.item_id AND c.item_type = tp.item_type),
measured AS (
  SELECT *, (CAST(1.25 AS DOUBLE) * precision * recall) / (CAST(0.25 AS DOUBLE) * (precision + recall)) AS f_0_5 FROM held),
items AS (SELECT *, (CAST(4.0 AS DOUBLE) * f_0_5 + sentiment) / CAST(5.0 AS DOUBLE) AS ranking_score FROM measured),
info AS (SELECT l.query_id, {kind.format(t='l')}, l.item_id, l.pmid, {info_cols('t')} FROM lq l
         LEFT JOIN catalog c ON c.item_id = l.item_id AND c.item_type = l.item_type
         LEFT JOIN titles t ON t.pmid = l.pmid)""" + trim_sql(["query_id", "item_type"], budget) + """
SELECT query_id, item_type, item_id, pmid, CAST(rank AS BIGINT) AS rank, CAST(trim_round AS BIGINT) AS trim_round, over_budget
FROM trimmed
UNION ALL SELECT query_id, item_type, NULL, NULL, NULL, CAST(trim_round AS BIGINT), over_budget FROM choice"""


def a3_whole_sql() -> str:
    return ranking_core("queries_whole") + f"""
SELECT lq.query_id, lq.item_type, lq.item_id, lq.pmid, {info_cols('t')}
FROM lq JOIN result i ON i.query_id = lq.query_id AND i.item_type = lq.item_type AND i.item_id = lq.item_id
JOIN queries q ON q.query_id = lq.query_id AND NOT q.do_filter AND q.with_articles
LEFT JOIN titles t ON t.pmid = lq.pmid"""


def a3_sql(budget: int = 2621440) -> str:
    return CORE + f""",
items AS (SELECT * FROM result),
info AS (SELECT lq.query_id, lq.item_type, lq.item_id, lq.pmid, {info_cols('t')}
         FROM lq JOIN items i ON i.query_id = lq.query_id AND i.item_type = lq.item_type AND i.item_id = lq.item_id
         LEFT JOIN titles t ON t.pmid = lq.pmid)""" + trim_sql(["query_id", "item_type"], budget) + """
SELECT query_id, item_type, item_id, CAST(count(*) AS INTEGER) AS n_articles,
       string_agg(pmid, ',' ORDER BY pmid) AS pmids, CAST(count(*) FILTER (WHERE has_pdf) AS INTEGER) AS n_pdf
FROM trimmed GROUP BY ALL"""


ORACLES.update({
    "r4_skip_filter_when_empty": ranking_core("queries_flags") + f"""
SELECT query_id, item_type, item_id, {M_OUT}, {r6('ranking_score')} AS ranking_score FROM result""",
    "r5_trim_to_budget": r5_sql(),
})


# --------------------------------------------------------- sources and sinks
def t9_scores(src: str) -> str:
    """T9 over a CTE ``src(doi, abstract)``: (doi, sentiment_score), unrounded."""
    return f"""(SELECT a.doi, coalesce({mean('l.polarity')}, 0.0) AS sentiment_score
  FROM {src} a LEFT JOIN (SELECT doi, unnest({words(destop(clean('abstract')))}) AS word
                          FROM {src}{STOP_JOIN}) w ON w.doi = a.doi
  LEFT JOIN lexicon l ON l.word = w.word GROUP BY a.doi)"""


def popular_rows(qview: str) -> str:
    return f"""(SELECT {norm('q.query')} AS query, h.pmid FROM {qview} q LEFT JOIN (
  SELECT DISTINCT q2.query_id, t.pmid FROM {qview} q2, titles t
  WHERE list_has_all({tok('t.title')}, {tok('q2.query')}) OR list_has_all({tok('t.pmid')}, {tok('q2.query')})
) h ON h.query_id = q.query_id)"""


S1_SQL = ctes("drug_catalog", "target_catalog") + """
SELECT drugbank_id AS item_id, name, 'drug' AS item_type FROM drug_catalog
WHERE type = 'SmallMoleculeDrug' AND state = 'solid'
UNION ALL SELECT uniprot_id, name, 'target' FROM target_catalog"""

ORACLES.update({
    "s1_read_catalog": S1_SQL,
    "s1_read_catalog_by_name": ctes("drug_catalog") + """
SELECT drugbank_id AS item_id, 'the "' || name || '", so called' AS name, 'drug' AS item_type FROM drug_catalog
WHERE type = 'SmallMoleculeDrug' AND state = 'solid'
UNION ALL SELECT 'U' || drugbank_id, 'the "' || name || '", so called', 'drug' FROM drug_catalog""",
    "s2_make_items": S1_SQL,
    "s3_read_dumps": ctes("articles") + """
SELECT doi, title, abstract, false AS corrupt FROM articles
UNION ALL SELECT NULL, NULL, NULL, true FROM benchmark""",
    "s4_dedup_articles": ctes("articles") + """
SELECT doi, CASE WHEN db_name = 'PubMed' THEN '[' || title || ']' ELSE title END AS title, abstract FROM articles""",
    "s5_flatten_esummary": ctes("titles") + """
SELECT pmid, title, CASE WHEN pmcid IN ('NULL', '') THEN NULL ELSE pmcid END AS pmcid FROM titles""",
    "s6_flatten_crossref": ctes("titles") + """
SELECT pmid AS doi, CASE WHEN pmcid IS NULL THEN NULL ELSE title END AS title, url FROM titles""",
    "s7_flatten_pubmed_xml": """
SELECT CAST(o_orderkey AS VARCHAR) AS pmid, o_orderpriority AS title,
       CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus || chr(10) || o_orderpriority END AS abstract
FROM orders""",
    "s8_scan_table": ctes("titles") + "SELECT * FROM titles",
    "k1_write_hits": ORACLES["t5_match_batch"],
    "k2_upsert_titles": ctes("titles") + """
SELECT * FROM titles WHERE pmid NOT IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus IN ('O', 'P'))
UNION ALL
SELECT CAST(o_orderkey AS VARCHAR), CASE o_orderkey%3 WHEN 0 THEN 'PubMed' WHEN 1 THEN 'Crossref' ELSE 'Xrxiv' END,
       NULL, CASE WHEN o_orderstatus = 'O' THEN lower('old ' || o_orderpriority) ELSE o_orderpriority END, NULL
FROM orders WHERE o_orderstatus IN ('O', 'P')""",
    "k3_append_links": j8_sql() + """,
links_db AS (""" + FIXTURES["links_db"] + """)
SELECT pmid, db_name, item_id, item_type FROM links_db
UNION ALL
SELECT * FROM (SELECT DISTINCT * FROM (SELECT * FROM j8 UNION ALL SELECT * FROM links_db WHERE db_name = 'Xrxiv')) n
WHERE NOT EXISTS (SELECT 1 FROM links_db b WHERE b.pmid = n.pmid AND b.db_name = n.db_name
                  AND b.item_id = n.item_id AND b.item_type = n.item_type)""",
    "k4_replace_counters": ORACLES["a1_item_counters"],
    "k5_upsert_sentiments": ctes("articles", "sentiments", "lexicon", "stopwords") + f""",
new AS (SELECT doi AS pmid, sentiment_score FROM {t9_scores('articles')})
SELECT pmid, {r6('sentiment_score')} AS sentiment_score FROM sentiments WHERE pmid NOT IN (SELECT pmid FROM new)
UNION ALL SELECT pmid, {r6('sentiment_score')} FROM new""",
    "k6_upsert_popular_queries": ctes("titles", "queries", "popular") + f""",
base AS {popular_rows('popular')}, new AS {popular_rows('queries')}
SELECT DISTINCT * FROM (SELECT * FROM base WHERE query NOT IN (SELECT query FROM new)
                        UNION ALL SELECT * FROM new)""",
    "k7_append_dump": ctes("articles") + """
SELECT doi, title, abstract, CASE WHEN db_name = 'PubMed' THEN '2024-01-01' ELSE '2024-01-02' END AS dump_date
FROM articles""",
    "b2_precompute_popular": ctes("titles", "popular") + f"SELECT DISTINCT * FROM {popular_rows('popular')}",
    "b3_score_corpus": ctes("articles", "sentiments", "lexicon", "stopwords") + f""",
latest AS (SELECT doi, CASE WHEN db_name = 'PubMed' THEN 'the is ' || abstract ELSE abstract END AS abstract
           FROM articles),
new AS (SELECT doi AS pmid, sentiment_score FROM {t9_scores('latest')})
SELECT pmid, {r6('sentiment_score')} AS sentiment_score FROM sentiments WHERE pmid NOT IN (SELECT pmid FROM new)
UNION ALL SELECT pmid, {r6('sentiment_score')} FROM new""",
})


def b4_sql() -> str:
    return j8_sql("Xrxiv").replace("WITH ", "WITH " + ctes("links_db")[5:].rstrip() + ",\n", 1) + """,
alll AS (SELECT pmid, db_name, item_id, item_type FROM links_db UNION ALL SELECT * FROM j8)
SELECT item_id, min(item_type) AS item_type, count(pmid) AS counter FROM alll GROUP BY item_id"""


def o1_sql() -> str:
    return ranking_core("queries_flags") + """,
chosen AS (SELECT query_id, item_type, name, arg_max(n_hit_item, item_id) AS counter
           FROM result GROUP BY ALL),
per_q AS (
  SELECT query_id,
         count(*) FILTER (WHERE item_type = 'drug') AS n_drugs,
         count(*) FILTER (WHERE item_type = 'target') AS n_targets,
         coalesce(string_agg(name, '|' ORDER BY name) FILTER (WHERE item_type = 'drug'), '') AS drug_names,
         sum(counter) AS counters
  FROM chosen GROUP BY query_id)
SELECT q.query_id, CAST(coalesce(p.n_drugs, 0) AS INTEGER) AS n_drugs,
       CAST(coalesce(p.n_targets, 0) AS INTEGER) AS n_targets, coalesce(p.drug_names, '') AS drug_names,
       CAST(coalesce(p.counters, 0) AS BIGINT) AS counters,
       CAST(CASE WHEN q.with_articles THEN coalesce(p.counters, 0) ELSE 0 END AS BIGINT) AS n_pmids,
       (q.with_articles AND p.query_id IS NOT NULL) AS with_pmids
FROM queries q LEFT JOIN per_q p ON p.query_id = q.query_id"""


def b4_part(select: str) -> str:
    return j8_sql("Xrxiv").replace(
        "WITH ", "WITH " + ctes("links_db", "titles_known", "useless")[5:].rstrip() + ",\n", 1) \
        .replace("FROM atok a, dt d", "FROM atok a, (SELECT * FROM dt WHERE item_id NOT IN "
                 "(SELECT item_id FROM links_db WHERE db_name = 'Xrxiv') AND item_id NOT IN "
                 "(SELECT item_id FROM useless WHERE db_name = 'Xrxiv')) d") + """,
alll AS (SELECT pmid, db_name, item_id, item_type FROM links_db UNION ALL SELECT * FROM j8),
allt AS (SELECT pmid, db_name, url, title, pmcid FROM titles_known
         WHERE pmid NOT IN (SELECT pmid FROM j8)
         UNION ALL SELECT doi, 'Xrxiv', NULL, title, NULL FROM articles WHERE doi IN (SELECT pmid FROM j8))
""" + select


def o1_entries_sql(budget: int = 2621440) -> str:
    return ranking_core("queries_flags") + f""",
ranked AS (SELECT r.*, row_number() OVER (PARTITION BY r.query_id, r.item_type
                                          ORDER BY r.ranking_score DESC NULLS LAST, r.item_id) AS place FROM result r),
asked AS (SELECT query_id FROM queries WHERE do_filter AND with_articles),
named AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY query_id, item_type, name ORDER BY item_id DESC) = 1),
items AS (SELECT * FROM named WHERE query_id IN (SELECT query_id FROM asked)),
info AS (SELECT lq.query_id, lq.item_type, lq.item_id, lq.pmid, {info_cols('t')}
         FROM lq JOIN items i ON i.query_id = lq.query_id AND i.item_type = lq.item_type AND i.item_id = lq.item_id
         LEFT JOIN titles t ON t.pmid = lq.pmid)""" + trim_sql(["query_id", "item_type"], budget) + f""",
lists AS (SELECT query_id, item_type, item_id,
                 string_agg(concat_ws('|', pmid, title, db_name, url, CAST(has_pdf AS VARCHAR), pdf_url), ';'
                            ORDER BY pmid, title, db_name, url, has_pdf, pdf_url) AS articles
          FROM trimmed GROUP BY ALL)
SELECT n.query_id, n.item_type,
       row_number() OVER (PARTITION BY n.query_id, n.item_type ORDER BY n.place, n.name) AS position,
       n.name, CAST(n.n_hit_item AS BIGINT) AS counter, {r6('n.precision')} AS precision, {r6('n.recall')} AS recall,
       {r6('n.f_0_5')} AS f_0_5, {r6('n.sentiment')} AS sentiment, {r6('n.ranking_score')} AS ranking_score,
       coalesce(l.articles, '') AS articles
FROM named n LEFT JOIN lists l ON l.query_id = n.query_id AND l.item_type = n.item_type AND l.item_id = n.item_id"""


def o1_items_sql() -> str:
    return ranking_core("queries_flags") + f"""
SELECT query_id, item_type, name, CAST(n_hit_item AS BIGINT) AS counter, {r6('precision')} AS precision,
       {r6('recall')} AS recall, {r6('f_0_5')} AS f_0_5, {r6('sentiment')} AS sentiment,
       {r6('ranking_score')} AS ranking_score
FROM result WHERE query_id IN (SELECT query_id FROM queries WHERE NOT do_filter)
QUALIFY row_number() OVER (PARTITION BY query_id, item_type, name ORDER BY item_id DESC) = 1"""


ORACLES.update({
    "o1_result_entries": o1_entries_sql(), "o1_item_json": o1_items_sql(),
    "b4_ingest": b4_sql(), "o1_to_result_json": o1_sql(),
    "b4_ingest_links": b4_part("SELECT * FROM alll"),
    "b4_ingest_titles": b4_part("SELECT * FROM allt"),
    "b4_ingest_useless": b4_part("""SELECT db_name, item_id FROM useless UNION
SELECT 'Xrxiv', item_id FROM dictionary WHERE item_id NOT IN (SELECT item_id FROM j8)"""),
    "b4_ingest_missing_info": b4_part("""SELECT pmid FROM alll
WHERE db_name = 'Xrxiv' AND pmid NOT IN (SELECT pmid FROM allt)"""),
    "t5_match_repeated_ids": ctes("titles", "queries") + f"""
, c AS (SELECT pmid, CASE WHEN CAST(pmid AS BIGINT) % 3 = 0 THEN replace(title, 'specified', '') ELSE title END t FROM titles)
SELECT q.query_id, c.pmid FROM queries q, c
WHERE list_has_all({tok('c.t')}, {tok('q.query')}) OR list_has_all({tok('c.pmid')}, {tok('q.query')})""",
})


ORACLES.update({
    "a3_collect_articles": a3_sql(),
    "a3_unfiltered_articles": a3_whole_sql(),
    "m2_precision": CORE + f"SELECT query_id, item_type, item_id, {r6('precision')} AS precision FROM scored0",
    "m3_recall": CORE + f"SELECT query_id, item_type, item_id, {r6('recall')} AS recall FROM scored0",
    "m4_f_beta": CORE + f"SELECT query_id, item_type, item_id, {r6('f_0_5')} AS f_0_5 FROM scored0",
    "m5_ranking_score": CORE + f"SELECT query_id, item_type, item_id, {r6('score0')} AS ranking_score FROM scored0",
})


def documents_sql() -> str:
    """B1 over documents, with the links that J8 finds in them and the sentiments of T9."""
    pre = ctes("articles", "dictionary", "words", "lexicon", "stopwords", "queries_docs", "rules") \
        .replace("queries_docs AS (", "queries AS (", 1)
    conds = " OR ".join(f"list_has_all(a.{f}, d.nt)" for f in ("tt", "td", "ta"))
    asked = " OR ".join(f"list_has_all(a.{f}, q.nt)" for f in ("tt", "td", "ta"))
    return pre + f""",
atok AS (SELECT doi, {tok('title')} AS tt, {tok('doi')} AS td, {tok('abstract')} AS ta FROM articles),
dt AS (SELECT item_id, item_type, {tok('name')} AS nt FROM (SELECT * FROM dictionary UNION ALL SELECT * FROM words)),
links AS (SELECT a.doi AS pmid, d.item_id, d.item_type FROM atok a, dt d WHERE len(d.nt) > 0 AND ({conds})),
sentiments AS (SELECT doi AS pmid, sentiment_score FROM {t9_scores('articles')}),
drugs AS (SELECT item_id, name FROM dictionary), targets AS (SELECT item_id, name FROM words),
qt AS (SELECT query_id, {tok('query')} AS nt FROM queries),
hits AS (SELECT q.query_id, a.doi AS pmid FROM qt q, atok a WHERE {asked}),""" + ranking_tail(
        "s.precision > s.p90", "rank <= 50", "true AS do_filter") + RANKED


ORACLES["b1_documents"] = documents_sql()
ORACLES["b1_cached_queries"] = ORACLES["b1_rank_items"]
ORACLES["a1_counters_by_deltas"] = ORACLES["a1_item_counters"]
ORACLES["k2_titles_versions"] = ORACLES["k2_upsert_titles"]
ORACLES["j1_bucketed_links"] = ORACLES["j1_restrict_links"]
ORACLES["t5_match_index"] = ORACLES["t5_match_batch"]
ORACLES["s5_flatten_esummary_xml"] = ORACLES["s5_flatten_esummary"]
