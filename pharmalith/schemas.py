"""Schemas of the stored relations and the fixed values of the results."""

from __future__ import annotations

from pyspark.sql.types import StringType, StructField, StructType

# Reimbursement classes, status texts and lists, placeholder ingredient, study texts.
CLASS_A = "A"
CLASS_H = "H"
CLASS_DEFAULT = "C"
STATUS_WITHDRAWN = "Ritirato / Non Disponibile"
STATUS_PARTIAL = "Parzialmente Carente (alcune confezioni disponibili, altre no)"
STATUS_AVAILABLE = "Disponibile"
LIST_AVAILABLE = "confezioni_attive"
LIST_SHORT = "confezioni_carenti_o_ritirate"
LIST_INGREDIENTS = "principi_attivi_rilevati"
PLACEHOLDER_INGREDIENT = "n.d."
COUNTRY = "Italy"
RECRUITING = "RECRUITING"
STUDY_URL = "https://clinicaltrials.gov/study/"
NO_TITLE = "N/A"
NO_STUDY_STATUS = "N/A"
NO_SITE_STATUS = "UNKNOWN"
NO_CITY = "N/D"

# Texts that delimited files use for a missing value.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

SHORTAGES = "codice_aic bigint, data_inizio string, motivazioni string, `classe_di_rimborsabilità` string"


def _strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


DRUGS = _strings("drugbank_id", "name", "type", "state", "smiles")
INTERACTIONS = _strings("source_drug_id", "target_drug_id", "description")
SYNONYMS = _strings("drugbank_id", "synonym")
ATC_CODES = _strings("drugbank_id", "atc_code")
