"""The lookups as calls with plain arguments: one request, a small DataFrame back.

Every call makes a one-row request table and runs the batch operator on it; for more than
a handful of requests, call the operator with a table of them.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pharmalith.operators import adverse, drugs, packs, trials
from pharmalith.schemas import COUNTRY
from pharmalith.sources.landed_json import Studies
from pharmalith.sources.tables import read_drug_relations


@dataclass(frozen=True)
class Tools:
    """Lookups over the register tables, the drug relations, studies and reports.

    ``register`` holds the tables of the register build, ``relations`` the four drug
    relations. Parts that are not needed may be left out.
    """

    spark: SparkSession
    register: Mapping[str, DataFrame] = field(default_factory=dict)
    relations: Mapping[str, DataFrame] = field(default_factory=dict)
    studies: Studies | None = None
    reports: DataFrame | None = None
    # Whether the register tables are stored in buckets of the pack key.
    colocated: bool = False

    @classmethod
    def open(cls, spark: SparkSession, register_folder: str, drug_folder: str, tables, **landed) -> Tools:
        """Over the Parquet files of both builds; ``tables`` names the register tables there."""
        folder = register_folder.rstrip("/")
        register = {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in tables}
        return cls(spark, register, read_drug_relations(spark, drug_folder), **landed)

    def _ask(self, **arguments) -> DataFrame:
        columns = [F.lit(v).cast(kind).alias(name) for name, (v, kind) in arguments.items()]
        return self.spark.range(1).select(F.col("id").alias("request_id"), *columns)

    def _found(self, name: str) -> DataFrame:
        r = self.register
        found = packs.status_of_name(name, r["farmaci_anagrafica"], r.get("classe_a"), r.get("classe_h"), r.get("farmaci_carenti"), colocated=self.colocated)
        return found.select(F.lit(name).alias("nome_ricercato"), "*")

    def get_drug_commercial_status(self, name: str) -> DataFrame:
        """Status and counts of the packs whose name contains ``name``; no row if none does."""
        return packs.status_summary(self._found(name), ["nome_ricercato"])

    def get_status_packs(self, name: str, short: bool | None = None) -> DataFrame:
        """The packs behind a status: all, only the short ones, or only the others."""
        found = self._found(name)
        return found if short is None else found.filter(F.col("is_carente") == short)

    def get_status_ingredients(self, name: str) -> DataFrame:
        """Names of the ingredients of those packs, in order."""
        found = packs.match_contains(
            self._ask(nome_ricercato=(name, "string")), "nome_ricercato", self.register["farmaci_anagrafica"],
            "denominazione",
        )
        names = packs.status_ingredients(found, self.register["principi_attivi"], ["request_id"])
        return names.select("principio_attivo").orderBy("principio_attivo")

    def find_generics(self, query: str) -> DataFrame:
        """Equivalent drugs for a brand or an ingredient, cheapest first."""
        r = self.register
        found = packs.generics(
            self._ask(name=(query, "string")),
            r["farmaci_anagrafica"],
            r["principi_attivi"],
            r["farmaci_equivalenti"],
        )
        return packs.cheapest_first(found).select("codice_aic", "denominazione_farmaco", "azienda", "prezzo_pubblico")

    def get_active_ingredients_by_aic(self, codice_aic: int) -> DataFrame:
        """Ingredients of one pack; the key is filtered in the scan."""
        table = self.register["principi_attivi"]
        return table.filter(F.col("codice_aic") == codice_aic).select("principio_attivo", "quantita", "unita_misura")

    def resolve_drug_entity(self, name: str, priority: str = "synonym") -> DataFrame:
        """Drug record for a synonym or a name."""
        asked = self._ask(query=(name, "string"))
        return drugs.resolve(asked, self.relations["drugs"], self.relations["synonyms"], priority=priority).select(
            *drugs.INFO
        )

    def get_drug_by_atc(self, atc_code: str) -> DataFrame:
        """Drug record for an ATC code."""
        asked = self._ask(query=(atc_code, "string"))
        return drugs.by_atc(asked, self.relations["drugs"], self.relations["atc_codes"]).select(*drugs.INFO)

    def check_drug_interactions(self, drug_ids: list[str]) -> DataFrame:
        """Interactions among the listed drugs."""
        return drugs.interactions_of_list(drug_ids, self.relations["interactions"], self.relations["drugs"])

    def get_molecule_smiles(self, drug_name: str) -> DataFrame:
        """SMILES text of a drug, with a flag whether there is one."""
        return drugs.smiles_of(self._ask(query=(drug_name, "string")), self.relations["drugs"]).select("smiles", "found")

    def get_adverse_events(self, substance: str, k: int = 5) -> DataFrame:
        """Most reported reactions of a substance."""
        top = adverse.top_reactions(self._ask(substance=(substance, "string")), self.reports, k)
        return top.select("term", "count").orderBy("rank")

    def find_clinical_trials(
        self,
        intervention: str | None = None,
        condition: str | None = None,
        n: int = 3,
        country: str = COUNTRY,
        match: str = "contains",
    ) -> DataFrame:
        """Latest recruiting studies in the country, one row per study and recruiting city."""
        if not intervention and not condition:
            raise ValueError("name an intervention or a condition")
        s = self.studies
        asked = self._ask(intervention=(intervention, "string"), condition=(condition, "string"))
        hits = trials.matching_studies(
            asked, s.studies, s.conditions, s.interventions, s.sites, country, match=match
        )
        top = trials.latest(hits, s.studies, n)
        cities = trials.recruiting_cities(top, s.sites, country)
        return top.join(cities, ["request_id", "nct_id"], "left").select(
            "rank", "nct_id", "title", "status", "url", "city"
        ).orderBy("rank", "city")
