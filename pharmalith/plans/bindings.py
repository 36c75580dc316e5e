"""Drug-shaped views over the supplied tables.

Each view is one SQL text that Spark and the checking database both run; ``{part}`` and
the like stand for the supplied tables.
"""

from __future__ import annotations

import re
import string
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from pharmalith.operators.drugs import dedup_drugs

BINDINGS = {
    "v_farmaci_anagrafica": """
        select p_partkey as codice_aic, upper(concat(p_name, ' ', p_type)) as denominazione,
               p_brand as ragione_sociale,
               concat(substr(p_type, 1, 1), cast(p_size as string)) as codice_atc
        from {part}""",
    "v_classe_a": "select p_partkey as codice_aic from {part} where p_size <= 15",
    "v_classe_h": "select p_partkey as codice_aic from {part} where p_size between 12 and 25",
    "v_farmaci_carenti": """
        select l_partkey as codice_aic, cast(cast(l_shipdate as date) as string) as data_inizio,
               concat('reason ', l_linestatus) as motivazioni,
               case when l_returnflag = 'R' then 'Cnn' when l_returnflag = 'A' then 'A' end
                   as classe_di_rimborsabilita
        from {lineitem} join {part} on l_partkey = p_partkey where p_type = 'PROMO' or p_size > 40""",
    "v_principi_attivi": """
        select l_partkey as codice_aic,
               case when l_suppkey % 17 = 0 then null when l_suppkey % 10 = 3 then 'n.d.' else s_name end
                   as principio_attivo,
               l_quantity as quantita, case when l_linenumber = 1 then null else l_returnflag end as unita_misura
        from {lineitem} join {supplier} on l_suppkey = s_suppkey""",
    "v_farmaci_equivalenti": """
        select l_partkey as codice_aic, s_name as principio_attivo, upper(p_name) as farmaco, p_brand as ditta,
               case when l_linenumber = 1 then null else l_extendedprice end as prezzo_riferimento_ssn
        from {lineitem} join {part} on l_partkey = p_partkey join {supplier} on l_suppkey = s_suppkey""",
    "v_drugs_raw": """
        select concat('DB', cast(c_custkey as string)) as drugbank_id, c_name as name,
               case when c_mktsegment = 'HOUSEHOLD' then 'biotech' else 'small molecule' end as type,
               case when c_nationkey % 3 = 0 then null else 'solid' end as state,
               case when c_acctbal > 0 then concat('C', cast(c_nationkey as string)) end as smiles
        from {customer}
        union all
        select concat('DB', cast(o_custkey * 2 as string)), concat('stub ', o_orderpriority),
               cast(null as string), cast(null as string), cast(null as string)
        from {orders} where o_orderstatus = 'P'""",
    "v_interactions_raw": """
        select concat('DB', cast(o_custkey as string)) as source_drug_id,
               concat('DB', cast(l_suppkey as string)) as target_drug_id,
               concat('risk ', o_orderpriority) as description
        from {orders} join {lineitem} on l_orderkey = o_orderkey""",
    "v_synonyms_raw": """
        select concat('DB', cast(p_partkey as string)) as drugbank_id,
               case when p_size = 50 then null when p_size = 49 then '' else p_name end as synonym
        from {part}""",
    "v_atc_codes_raw": """
        select concat('DB', cast(p_partkey as string)) as drugbank_id,
               concat(substr(p_type, 1, 1), cast(p_size as string)) as atc_code
        from {part}""",
    "v_studies": """
        select concat('NCT', cast(o_orderkey as string)) as nct_id,
               concat('Study ', cast(o_orderkey as string)) as brief_title,
               case o_orderstatus when 'O' then 'RECRUITING' when 'F' then 'COMPLETED'
                   else 'ACTIVE_NOT_RECRUITING' end as overall_status,
               o_orderpriority as condition_name, o_orderdate as last_update
        from {orders}""",
    "v_study_locations": """
        select concat('NCT', cast(l_orderkey as string)) as nct_id, s_name as city,
               n_name as country,
               case when l_returnflag = 'N' then null when l_linestatus = 'O' then 'RECRUITING'
                   else 'COMPLETED' end as status
        from {lineitem} join {supplier} on l_suppkey = s_suppkey join {nation} on s_nationkey = n_nationkey""",
    "v_study_interventions": """
        select concat('NCT', cast(l_orderkey as string)) as nct_id, p_name as intervention
        from {lineitem} join {part} on l_partkey = p_partkey""",
    # Requests: one row per question a user would ask one at a time.
    "r_brands": "select min(p_partkey) as request_id, p_name as name from {part} group by p_name",
    "r_packs": "select p_partkey as request_id, p_partkey as codice_aic from {part}",
    "r_names": """
        select concat('part ', cast(p_partkey as string)) as request_id, upper(p_name) as query from {part}
        union all
        select concat('customer ', cast(c_custkey as string)), upper(c_name) from {customer}
        union all
        select concat('supplier ', cast(s_suppkey as string)), s_name from {supplier}
        union all
        select concat('priority ', o_orderpriority), concat('STUB ', o_orderpriority)
        from {orders} group by o_orderpriority""",
    "r_atc": """
        select p_partkey as request_id, lower(concat(substr(p_type, 1, 1), cast(p_size as string)))
            as query
        from {part}
        union all
        select -1 - r_regionkey, r_name from {region}""",
    "r_drug_lists": """
        select c_nationkey as request_id, concat('DB', cast(c_custkey as string)) as drugbank_id
        from {customer}""",
    "r_conditions": """
        select concat('condition ', o_orderpriority) as request_id, cast(null as string) as intervention,
               lower(o_orderpriority) as condition
        from {orders} group by o_orderpriority
        union all
        select concat('intervention ', p_name), upper(p_name), cast(null as string) from {part} group by p_name
        union all
        select concat('both ', p_name, ' ', p_type), p_name, case when p_type = 'SMALL' then '1' else 'high' end
        from {part} group by p_name, p_type
        union all
        select concat('nothing ', r_name), cast(null as string), '' from {region}""",
}

# The stored relations, as the checking database derives them from the raw views.
DERIVED = {
    "drugs": (
        ("v_drugs_raw",),
        """select drugbank_id, name, type, state, smiles from (
               select *, row_number() over (partition by drugbank_id
                   order by type desc nulls last, smiles desc nulls last, state desc nulls last, name desc) as rn
               from v_drugs_raw) where rn = 1""",
    ),
    "interactions": (("v_interactions_raw",), "select distinct * from v_interactions_raw"),
    "synonyms": (
        ("v_synonyms_raw",),
        "select distinct * from v_synonyms_raw where synonym is not null and synonym <> ''",
    ),
    "atc_codes": (("v_atc_codes_raw",), "select distinct * from v_atc_codes_raw"),
}


def _tables_in(sql: str) -> list[str]:
    return sorted({field for _, field, _, _ in string.Formatter().parse(sql) if field})


def with_views(sql: str) -> str:
    """Prefix a checking query with the views it names, as common table expressions."""
    words = set(re.findall(r"\w+", sql))
    ctes: dict[str, str] = {}

    def add(name: str) -> None:
        if name in ctes:
            return
        if name in DERIVED:
            needs, text = DERIVED[name]
            for n in needs:
                add(n)
            ctes[name] = text
        else:
            text = BINDINGS[name]
            ctes[name] = text.format(**{t: t for t in _tables_in(text)})

    for name in [*BINDINGS, *DERIVED]:
        if name in words:
            add(name)
    if not ctes:
        return sql
    listed = "with " + ",\n".join(f"{n} as ({t})" for n, t in ctes.items())
    own = sql.strip()
    # A query that starts with its own list of expressions continues this one.
    return f"{listed},\n{own[5:]}" if own.lower().startswith("with ") else f"{listed}\n{own}"


class Tables:
    """The supplied tables of one folder and the views bound to them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._read: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._read[name]

    def view(self, name: str) -> DataFrame:
        return self.sql(BINDINGS[name])

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{t: self.table(t) for t in _tables_in(text)})

    @cached_property
    def drugs(self) -> DataFrame:
        return dedup_drugs(self.view("v_drugs_raw"))

    @cached_property
    def interactions(self) -> DataFrame:
        return self.view("v_interactions_raw").distinct()

    @cached_property
    def synonyms(self) -> DataFrame:
        return self.view("v_synonyms_raw").filter("synonym is not null and synonym <> ''").distinct()

    @cached_property
    def atc_codes(self) -> DataFrame:
        return self.view("v_atc_codes_raw").distinct()
