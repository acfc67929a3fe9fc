
from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()

ARTICLE_TITLES = T.StructType([
    T.StructField("pmid", S), T.StructField("db_name", S), T.StructField("url", S),
    T.StructField("title", S), T.StructField("pmcid", S)])

ARTICLE_ITEMS = T.StructType([
    T.StructField("pmid", S), T.StructField("db_name", S), T.StructField("item_id", S),
    T.StructField("item_type", S)])

# The popular-query cache in long form: one row per (query, pmid); a query
# cached with no hit has one row with a null pmid.
POPULAR_QUERIES = T.StructType([T.StructField("query", S), T.StructField("pmid", S)])

ITEM_COUNTER = T.StructType([
    T.StructField("item_id", S), T.StructField("item_type", S),
    T.StructField("counter", T.LongType())])

ARTICLE_SENTIMENTS = T.StructType([
    T.StructField("pmid", S), T.StructField("sentiment_score", T.DoubleType())])

DRUG_CATALOG = T.StructType([
    T.StructField("drugbank_id", S), T.StructField("name", S), T.StructField("type", S),
    T.StructField("state", S)])

TARGET_CATALOG = T.StructType([T.StructField("uniprot_id", S), T.StructField("name", S)])

# Dump lines: doi read as text keeps leading zeros (D2); bad lines are kept in
# _corrupt_record instead of failing the file.
DUMP = T.StructType([
    T.StructField("title", S), T.StructField("doi", S), T.StructField("abstract", S),
    T.StructField("_corrupt_record", S)])

USELESS_ITEMS = T.StructType([T.StructField("db_name", S), T.StructField("item_id", S)])

QUERIES = T.StructType([
    T.StructField("query_id", T.LongType()), T.StructField("query", S),
    T.StructField("do_filter", T.BooleanType()), T.StructField("with_articles", T.BooleanType())])

OVERRIDE_RULES = T.StructType([
    T.StructField("trigger", S), T.StructField("item_name", S),
    T.StructField("score", T.DoubleType())])

ESUMMARY_DOC = "struct<uid:string,title:string,articleids:array<struct<idtype:string,value:string>>>"
CROSSREF = ("struct<message:struct<items:array<struct<DOI:string,title:array<string>,"
            "URL:string>>>>")
PUBMED_XML = T.StructType([
    T.StructField("MedlineCitation", T.StructType([
        T.StructField("PMID", S),
        T.StructField("Article", T.StructType([
            T.StructField("ArticleTitle", S),
            T.StructField("Abstract", T.StructType([
                T.StructField("AbstractText", T.ArrayType(S))]))]))]))])
