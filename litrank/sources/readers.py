"""Scans and sources.

Every reader takes an explicit schema: no inference pass over 100 TB, ids stay
strings. Dumps and saved API responses are parsed with built-in JSON/XML
expressions in the scan stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litrank import schemas
from litrank.constants import DRUG_STATE, DRUG_TYPE


def _drug_filter(df: DataFrame) -> DataFrame:
    if "type" not in df.columns:
        return df
    return df.where((F.col("type") == DRUG_TYPE) & (F.col("state") == DRUG_STATE))


def read_catalog(spark: SparkSession, path: str, id_col: str, item_type: str,
                 name_col: str = "name") -> DataFrame:
    """Catalog CSV -> (item_id, name, item_type). Ids are strings.

    Columns are found by their names in the header, in any order and with others
    between them; quotes are doubled inside quoted values, which may span lines.
    Drugs keep only small-molecule solids, and only if a ``type`` column exists.
    """
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    df = _drug_filter(df)
    return df.select(F.col(id_col).cast("string").alias("item_id"), F.col(name_col).alias("name"),
                     F.lit(item_type).alias("item_type"))


def make_items(drugs_raw: DataFrame, targets_raw: DataFrame) -> DataFrame:
    """Both catalogs as one (item_id, name, item_type) list, drugs filtered."""
    d = _drug_filter(drugs_raw).select(F.col("drugbank_id").cast("string").alias("item_id"), "name",
                                       F.lit("drug").alias("item_type"))
    t = targets_raw.select(F.col("uniprot_id").cast("string").alias("item_id"), "name",
                           F.lit("target").alias("item_type"))
    return d.unionByName(t)


def read_dumps(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """S3: every JSONL file under ``path``, by column name, with its file path.

    Malformed lines land in ``_corrupt_record`` (the reference would fail the
    whole file).
    """
    sch = schema or schemas.DUMP
    df = (spark.read.schema(sch).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    return df.withColumn("file_path", F.col("_metadata.file_path"))


def dedup_articles(df: DataFrame, key: str = "doi", file_col: str = "file_path",
                   keep: str = "first") -> DataFrame:
    """One row per ``key``: the first over files in name order (``keep='last'``:
    the last, as an insert-or-replace over the files would leave).

    Inside one file Spark has no line number, so rows are ordered by content
    (title, abstract, then the rest). One aggregation with ``min_by`` /
    ``max_by``: partial results are combined map-side, so a key repeated in a
    third of the rows is still reduced in every task before the shuffle.
    """
    cols = [c for c in df.columns if c != key]
    order_cols = ([file_col] if file_col in df.columns else []) + \
        [c for c in ("title", "abstract") if c in df.columns] + \
        [c for c in cols if c not in (file_col, "title", "abstract")]
    rec = F.struct(*[F.col(c) for c in cols])
    order = F.struct(*[F.col(c) for c in order_cols])
    pick = F.min_by(rec, order) if keep == "first" else F.max_by(rec, order)
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(pick.alias("_r"))
    return out.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Saved responses, one JSON document per line, as (value, file_path)."""
    return spark.read.text(path).withColumn("file_path", F.col("_metadata.file_path"))


def flatten_esummary(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """Esummary responses -> (pmid, title, pmcid).

    ``result`` is a map from id to document plus the key ``uids``; pmcid is the
    first article id of type ``pmc``; "NULL", "" and missing become null.
    """
    docs = raw.select(F.from_json(value_col, "struct<result:map<string,string>>").alias("_j"))
    docs = docs.select(F.explode("_j.result").alias("pmid", "_doc")).where(F.col("pmid") != "uids")
    parsed = docs.select("pmid", F.from_json("_doc", schemas.ESUMMARY_DOC).alias("_d"))
    pmc = F.get(F.filter("_d.articleids", lambda a: a["idtype"] == "pmc"), 0)["value"]
    pmc = F.when(pmc.isin("NULL", ""), F.lit(None)).otherwise(pmc)
    return parsed.select("pmid", F.col("_d.title").alias("title"), pmc.alias("pmcid"))


def corrupt_responses(raw: DataFrame, value_col: str = "value", kind: str = "esummary") -> DataFrame:
    """The saved responses that cannot be read (not JSON, cut short, or without their
    result list), with all their columns, so that a lost response leaves a trace."""
    if kind == "esummary":
        found = F.from_json(value_col, "struct<result:map<string,string>>")["result"]
    elif kind == "crossref":
        found = F.from_json(value_col, schemas.CROSSREF)["message"]["items"]
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return raw.where(found.isNull())


def flatten_crossref(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """Crossref works responses -> (doi, title, url); title is the first
    title or null."""
    j = raw.select(F.from_json(value_col, schemas.CROSSREF).alias("_j"))
    it = j.select(F.explode("_j.message.items").alias("_i"))
    return it.select(F.col("_i.DOI").alias("doi"), F.get(F.col("_i.title"), 0).alias("title"),
                     F.col("_i.URL").alias("url"))


def flatten_pubmed_xml(spark: SparkSession, path: str) -> DataFrame:
    """Efetch XML -> (pmid, title, abstract). Abstract parts are joined with
    a newline; no abstract gives "". The id comes from the record itself."""
    df = (spark.read.format("xml").option("rowTag", "PubmedArticle")
          .schema(schemas.PUBMED_XML).load(path))
    parts = F.col("MedlineCitation.Article.Abstract.AbstractText")
    return df.select(F.col("MedlineCitation.PMID").alias("pmid"),
                     F.col("MedlineCitation.Article.ArticleTitle").alias("title"),
                     F.coalesce(F.array_join(parts, "\n"), F.lit("")).alias("abstract"))


def scan_table(spark: SparkSession, path: str) -> DataFrame:
    """Full-table read of a stored table."""
    return spark.read.parquet(path)


ESUMMARY_XML_ITEM = "struct<_Name:string,_VALUE:string,Item:array<struct<_Name:string,_VALUE:string>>>"


def flatten_esummary_xml(spark: SparkSession, path: str) -> DataFrame:
    """S5, XML form: ``DocSum`` records -> (pmid, title, pmcid).

    ``Id`` is the pmid, the ``Item`` named ``Title`` the title, and the ``pmc``
    entry inside the ``ArticleIds`` list the pmcid ("NULL", "" and missing
    become null).
    """
    df = (spark.read.format("xml").option("rowTag", "DocSum")
          .schema(f"Id string, Item array<{ESUMMARY_XML_ITEM}>").load(path))

    def named(arr, name):
        return F.get(F.filter(arr, lambda x: x["_Name"] == name), 0)

    title = named(F.col("Item"), "Title")["_VALUE"]
    pmc = named(named(F.col("Item"), "ArticleIds")["Item"], "pmc")["_VALUE"]
    pmc = F.when(pmc.isin("NULL", ""), F.lit(None)).otherwise(pmc)
    return df.select(F.col("Id").alias("pmid"), title.alias("title"), pmc.alias("pmcid"))
