"""Stand-in inputs over the driver tables (see FIXTURES.md).

Each fixture is one SQL text that runs unchanged in Spark and in DuckDB. Spark
registers them as temp views over the parquet tables; the DuckDB oracle inlines
the same texts as CTEs. Fixtures derive every row from the driver tables, so
their size grows with the scale factor; the few literal tables (queries,
lexicon, stop words, override rules) are parameters of the operators.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

_SRC3 = "CASE {k}%3 WHEN 0 THEN 'PubMed' WHEN 1 THEN 'Crossref' ELSE 'Xrxiv' END"

FIXTURES: dict[str, str] = {
    # text corpus: one article per document, its first line as title
    "articles": f"""
SELECT CAST(doc_id AS STRING) doi, split_part(text, chr(10), 1) title, text abstract,
       {_SRC3.format(k='doc_id')} db_name
FROM documents""",
    # article metadata of all orders; the titles corpus of queries
    "titles": f"""
SELECT CAST(o_orderkey AS STRING) pmid,
       {_SRC3.format(k='o_orderkey')} db_name,
       CASE WHEN o_orderkey%5=0 THEN concat('https://example.org/',CAST(o_orderkey AS STRING)) END url,
       o_orderpriority title,
       CASE o_orderkey%4 WHEN 0 THEN concat('PMC',CAST(o_orderkey AS STRING)) WHEN 1 THEN 'NULL' END pmcid
FROM orders""",
    # metadata as far as it is known: orders with status P have none
    "titles_known": f"""
SELECT CAST(o_orderkey AS STRING) pmid,
       {_SRC3.format(k='o_orderkey')} db_name,
       CASE WHEN o_orderkey%5=0 THEN concat('https://example.org/',CAST(o_orderkey AS STRING)) END url,
       o_orderpriority title,
       CASE o_orderkey%4 WHEN 0 THEN concat('PMC',CAST(o_orderkey AS STRING)) WHEN 1 THEN 'NULL' END pmcid
FROM orders WHERE o_orderstatus<>'P'""",
    # raw drug catalog as the CSV holds it (S1, S2, P5). STANDARD and ECONOMY
    # parts are small-molecule drugs, PROMO parts have no type, p_size <= 40 is solid
    "drug_catalog": """
SELECT concat('D',CAST(p_partkey AS STRING)) drugbank_id, p_name name,
       CASE WHEN p_type IN ('STANDARD','ECONOMY') THEN 'SmallMoleculeDrug'
            WHEN p_type='PROMO' THEN NULL ELSE 'BiotechDrug' END type,
       CASE WHEN p_size<=40 THEN 'solid' ELSE 'liquid' END state
FROM part""",
    # raw target catalog
    "target_catalog": """
SELECT concat('T',CAST(s_suppkey AS STRING)) uniprot_id, s_name name FROM supplier""",
    # filtered drug catalog
    "drugs": """
SELECT concat('D',CAST(p_partkey AS STRING)) item_id, p_name name, p_type type, p_size
FROM part WHERE p_type IN ('STANDARD','ECONOMY') AND p_size<=40""",
    # targets (J2)
    "targets": """
SELECT concat('T',CAST(s_suppkey AS STRING)) item_id, s_name name FROM supplier""",
    # article-item links, with real duplicates
    "links": """
SELECT CAST(l_orderkey AS STRING) pmid, concat('D',CAST(l_partkey AS STRING)) item_id, 'drug' item_type
FROM lineitem
UNION ALL
SELECT CAST(l_orderkey AS STRING), concat('T',CAST(l_suppkey AS STRING)), 'target' FROM lineitem""",
    # links with their source, as the link table stores it
    "links_db": f"""
SELECT CAST(l_orderkey AS STRING) pmid, {_SRC3.format(k='l_orderkey')} db_name,
       concat('D',CAST(l_partkey AS STRING)) item_id, 'drug' item_type
FROM lineitem
UNION ALL
SELECT CAST(l_orderkey AS STRING), {_SRC3.format(k='l_orderkey')},
       concat('T',CAST(l_suppkey AS STRING)), 'target' FROM lineitem""",
    # sentiments: +0.5 / -0.5 / unscored, so averages are exact in any order
    "sentiments": """
SELECT CAST(o_orderkey AS STRING) pmid,
       CASE o_orderstatus WHEN 'F' THEN CAST(0.5 AS DOUBLE) ELSE CAST(-0.5 AS DOUBLE) END sentiment_score
FROM orders WHERE o_orderstatus IN ('F','P')""",
    # dictionary for J8: whole benchmark passages, normalised by T1 inside the operator
    "dictionary": """
SELECT concat('B',CAST(item_id AS STRING)) item_id, text name,
       'drug' item_type FROM benchmark""",
    # a second dictionary of common words, so that items have many articles
    "words": """
SELECT concat('W',word) item_id, word name, 'target' item_type
FROM (VALUES ('a'),('an'),('and'),('of'),('to'),('in'),('it'),('that'),('with'),
             ('le'),('la'),('de'),('en'),('et'),('der'),('die'),('und')) w(word)""",
    # a batch of queries matched on whole documents
    "queries_docs": """
SELECT CAST(query_id AS BIGINT) query_id, query
FROM (VALUES (1,'On is'),(2,'de la'),(3,'the, for')) q(query_id, query)""",
    # items known to have no article in a source (J6), derived from the data
    "useless": """
SELECT 'PubMed' db_name, concat('B',CAST(item_id AS STRING)) item_id FROM benchmark WHERE length(text) > 200""",
    # a batch of queries, matched on titles (o_orderpriority)
    "queries": """
SELECT CAST(query_id AS BIGINT) query_id, query, true do_filter, false with_articles
FROM (VALUES (1,'1-urgent'),(2,'4-not specified'),(3,'2-high')) q(query_id, query)""",
    # the same batch, one query asking for all items unfiltered (R4) and two for
    # article lists
    "queries_flags": """
SELECT CAST(query_id AS BIGINT) query_id, query, do_filter, with_articles
FROM (VALUES (1,'1-urgent',true,true),(2,'4-not specified',false,false),(3,'2-high',true,true),
             (4,'no such words',true,true)) q(query_id, query, do_filter, with_articles)""",
    # a query that wants everything: no filter, all articles (A3, O1)
    "queries_whole": """
SELECT CAST(query_id AS BIGINT) query_id, query, do_filter, with_articles
FROM (VALUES (1,'1-urgent',true,true),(2,'4-not specified',false,true))
     q(query_id, query, do_filter, with_articles)""",
    # frequent queries whose hits are cached
    "popular": """
SELECT CAST(query_id AS BIGINT) query_id, query
FROM (VALUES (10,'1-URGENT'),(11,'5-low'),(12,'3-medium')) p(query_id, query)""",
    # lexicon for T9
    "lexicon": """
SELECT word, CAST(polarity AS DOUBLE) polarity
FROM (VALUES ('the',0.125),('on',-0.5),('is',0.25),('for',-0.25)) x(word, polarity)""",
    # stop words for T8
    "stopwords": """
SELECT word FROM (VALUES ('a'),('an'),('and'),('of'),('to'),('in'),('it'),('that'),('with'),
                         ('le'),('la'),('de'),('en'),('et'),('der'),('die'),('und')) s(word)""",
    # override rules for R1 over the fixture names
    "rules": """
SELECT trigger, item_name, CAST(score AS DOUBLE) score
FROM (VALUES ('urgent','small ring',1.0),('urgent','blue bolt',1.0),('high','red widget',1.0),
             ('covid','small ring',1.0)) r(trigger, item_name, score)""",
}


def _clean(sql: str) -> str:
    return re.sub(r"\s+", " ", sql).strip()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TABLE_CACHE: dict[tuple, DataFrame] = {}


def _cached_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One scan definition per (session, directory, table): the Parquet footer
    is read once per session, not once per query."""
    key = (id(spark), spark.sparkContext.applicationId, sf_dir, name)
    df = _TABLE_CACHE.get(key)
    if df is None:
        df = read_table(spark, sf_dir, name)
        _TABLE_CACHE[key] = df
    return df


def register_tables(spark: SparkSession, sf_dir: str, names=None) -> None:
    """Register the driver parquet tables as temp views."""
    for t in names or TABLES:
        _cached_table(spark, sf_dir, t).createOrReplaceTempView(t)


def tables_of(sql: str) -> list[str]:
    """Driver tables a fixture text reads."""
    words = set(re.findall(r"[A-Za-z_]+", sql))
    return [t for t in TABLES if t in words]


class Fixtures:
    """Fixture DataFrames created on first use; only the driver tables a
    fixture reads are registered."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._df = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._df:
            sql = _clean(FIXTURES[name])
            register_tables(self.spark, self.sf_dir, tables_of(sql))
            df = self.spark.sql(sql)
            df.createOrReplaceTempView(name)
            self._df[name] = df
        return self._df[name]


def load(spark: SparkSession, sf_dir: str) -> Fixtures:
    """Fixture views for ``sf_dir``, built lazily."""
    return Fixtures(spark, sf_dir)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register_tables(spark, sf_dir, [name])
    return _cached_table(spark, sf_dir, name)


def ctes(*names: str) -> str:
    """``WITH`` prefix that defines the named fixtures for an oracle query."""
    parts = [f"{n} AS ({_clean(FIXTURES[n])})" for n in names]
    return "WITH " + ",\n".join(parts) + "\n"
