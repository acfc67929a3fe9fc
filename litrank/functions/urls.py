"""Article link expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litrank.constants import (CROSSREF, DOI_URL, MISSING_PMCID, PMC_PDF_URL, PUBMED,
                               PUBMED_URL, XRXIV)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _template(t: str, key: str, value: Column) -> Column:
    before, after = t.split("{" + key + "}")
    return F.concat(F.lit(before), value, F.lit(after))


def article_url(db_name, article_id, url) -> Column:
    """The stored url, else the source's template. Unknown source: null."""
    aid = _c(article_id).cast("string")
    db = _c(db_name)
    templ = (F.when(db == F.lit(PUBMED), _template(PUBMED_URL, "id", aid))
             .when(db.isin(CROSSREF, XRXIV), _template(DOI_URL, "id", aid)))
    return F.coalesce(_c(url), templ)


def has_pdf(pmcid) -> Column:
    """A pmcid that is present and not the text 'NULL'."""
    p = _c(pmcid)
    return p.isNotNull() & (p != F.lit(MISSING_PMCID))


def pdf_url(pmcid) -> Column:
    """The PMC pdf link when ``has_pdf``, else ""."""
    return F.when(has_pdf(pmcid), _template(PMC_PDF_URL, "pmcid", _c(pmcid))).otherwise(F.lit(""))
