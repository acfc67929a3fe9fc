"""Fixed values that must equal the reference's for equal results.

Kept together in one place, in the order the reference states them.
"""

# --- fixed values -------------------------------------------------------------
# Query normalisation (T1) replaces exactly these 29 punctuation characters
# with a space; the hyphen and the round brackets are kept.
QUERY_PUNCTUATION = "!\"#$%&'*+,./:;<=>?@[\\]^_`{|}~"

# Drug catalog filter (S1, S2, P5): only this type and state are kept.
DRUG_TYPE = "SmallMoleculeDrug"
DRUG_STATE = "solid"

# Article URL templates per source (P7) and the PDF link template.
PUBMED = "PubMed"
CROSSREF = "Crossref"
XRXIV = "Xrxiv"
PUBMED_URL = "https://pubmed.ncbi.nlm.nih.gov/{id}/"
DOI_URL = "https://www.doi.org/{id}"
PMC_PDF_URL = "https://www.ncbi.nlm.nih.gov/pmc/articles/{pmcid}/pdf"
MISSING_PMCID = "NULL"

# Metrics (M4, M5): F-beta with beta = 0.5, ranking score = (4 F + sentiment) / 5.
F_BETA = 0.5
RANK_F_WEIGHT = 4.0
RANK_DENOMINATOR = 5.0

# Ranking (R2, R3): keep precision above the 0.90 quantile, then the top 50.
PRECISION_QUANTILE = 0.9
RECALL_QUANTILE = 0.9
TOP_K = 50

# Response budget (R5): 2.5 MiB per item type, every article list cut to a
# quarter per round.
BUDGET_BYTES = int(2.5 * 2 ** 20)
TRIM_FACTOR = 4

# Score override (R1): a drug whose name is one of the names gets ranking
# score 1.0 when the lowered query contains one of the triggers.
OVERRIDE_TRIGGERS = ["covid", "omicron", "delta", "sars-cov", "corona"]
OVERRIDE_NAMES = ["Favipiravir", "Ivermectin"]
OVERRIDE_SCORE = 1.0

# Result JSON keys (O1). The two publication keys keep the unformatted "{}"
# exactly as the reference emits them.
KEY_HIT_PUBS = "(Search + {}) Publications"
KEY_ITEM_PUBS = "{} Publications"
KEY_PRECISION = "Precision"
KEY_RECALL = "Recall"
KEY_F = "F-0.5"
KEY_SENTIMENT = "sentiment"
KEY_SCORE = "ranking_score"
# ------------------------------------------------------------------------------
