"""Registered queries that read landed files.

The files are derived from the supplied tables by Spark jobs, in the formats the sources
have to cope with, and land in the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pharmalith.operators import adverse, trials
from pharmalith.operators.drugs import dedup_drugs
from pharmalith.plans.queries_trials import ADVERSE_ORACLE, adverse_requests, reports
from pharmalith.plans.registry import query
from pharmalith.session import scratch_path, through_storage
from pharmalith.sources import charsets, delimited, drug_xml, landed_json, tables
from pharmalith.sources.delimited import Layout, TableSpec


def land(
    t, lines: DataFrame, head: list[str], folder: str, tail: list[str] = (), single_byte: bool = False, everywhere: bool = False
) -> str:
    """Write one-column ``lines`` as text files, ``head`` in the first (or at the head of each, ``everywhere``) and ``tail`` in the last."""
    path = f"{scratch_path(t.spark, 'landed')}/{folder}"
    column = lines.columns[0]
    if everywhere:
        # The head joins the lines of each task and is sorted before them.
        files = lines.withColumn("_file", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
        n = lines.rdd.getNumPartitions()
        heads = t.spark.range(n).select(F.explode(F.array(*map(F.lit, head))).alias(column), F.col("id").cast("int").alias("_file"), (F.monotonically_increasing_id() - (1 << 60)).alias("_row"))
        files.unionByName(heads).repartitionById(n, "_file").sortWithinPartitions("_row").select(column).write.text(path)
        return path
    for part, first in ((head, True), (tail, False)):
        if part:
            extra = t.spark.range(0, 1, 1, 1).select(F.explode(F.array(*map(F.lit, part))).alias(column))
            lines = extra.union(lines) if first else lines.union(extra)
    if single_byte:
        lines = lines.select(F.encode(column, "ISO-8859-1").cast("string").alias(column))
    lines.write.text(path)
    return path


# Packs as a register file: rows of size 50 have two fields too many, rows of size 1 stop
# after the name, and every name is quoted because of the separator in it.
_PACK_LINES = '''
    select concat_ws(';', concat('00', cast(p_partkey as string)),
                     concat('"', p_name, '; ""', p_type, '"""'),
                     case when p_size > 1 then p_brand end,
                     case when p_size > 1 then concat('tè ', p_size) end,
                     case when p_size = 50 then 'x;y' end) as line
    from {part}'''
_PACK_HEAD = ['Codice AIC;  Denominazione ;"Ragione.Sociale";Nota (qualità)']
_PACK_ROWS = """
    select p_partkey as codice_aic, concat(p_name, '; "', p_type, '"') as denominazione,
           case when p_size > 1 then p_brand end as ragione_sociale,
           case when p_size > 1 then concat('tè ', p_size) end as nota_qualità
    from part where p_size < 50"""


def _pack_file(t, single_byte: bool = False) -> str:
    return land(t, t.sql(_PACK_LINES), _PACK_HEAD, "confezioni", single_byte=single_byte)


@query(oracle=_PACK_ROWS)
def src_csv_bad_lines(t):
    """A ragged file: long lines dropped, short lines filled."""
    return delimited.clean_table(delimited.read_delimited(t.spark, _pack_file(t)).rows)


@query(oracle="select count(*) as n_rejects, count(distinct p_partkey) as n_lines from part where p_size = 50")
def src_csv_rejects(t):
    """The long lines of that file."""
    rejected = delimited.read_delimited(t.spark, _pack_file(t)).rejects
    return rejected.agg(F.count(F.lit(1)).alias("n_rejects"), F.count_distinct("line").alias("n_lines"))


@query(oracle=_PACK_ROWS)
def src_csv_single_byte(t):
    """The same file in a single-byte charset that the reader has to find out."""
    return delimited.clean_table(delimited.read_delimited(t.spark, _pack_file(t, single_byte=True)).rows)


@query(
    oracle="""
    select 'confezioni' as folder, 'UTF-8' as charset, count(*) + 1 as n_lines from part
    union all select 'classe', 'ISO-8859-1', count(*) + 1 from part"""
)
def src_charset(t):
    """Charset of landed files, one folder in each of two charsets."""
    single = land(t, t.sql(_PACK_LINES), _PACK_HEAD, "classe", single_byte=True)
    found = delimited.detect_charsets(t.spark, [_pack_file(t), single], threshold=None)
    name = F.element_at(F.split("file", "/"), -2)
    # A file of a few short lines may be plain ASCII, so a folder takes its widest charset.
    return found.groupBy(name.alias("folder")).agg(
        F.min("charset").alias("charset"), F.sum("n_lines").alias("n_lines")
    )


# What only some charsets have, to tell them apart.
_SIGNS = {"UTF-8": " è già", "ISO-8859-1": " è già", "windows-1252": " l’unità – 5 €", "UTF-16LE": " Ω"}


def _write_encoded(lines: DataFrame, charset: str, path: str) -> None:
    """One-column ``lines`` as text files in a charset."""
    text = F.col(lines.columns[0])
    if charset in charsets.UTF16:
        lines.select(F.encode(text, charset).cast("string")).write.options(encoding=charset, lineSep="\n").text(path)
    elif charset == "UTF-8":
        lines.write.text(path)
    else:
        # One character per byte: what the charset has for a byte becomes the character of that number.
        bytes_ = F.translate(text, charsets.alphabet(charset), "".join(map(chr, range(128, 256))))
        lines.select(F.encode(bytes_, "ISO-8859-1").cast("string")).write.text(path)


@query(
    oracle="""
    select charset, charset as found, c_custkey as codice_aic, concat('qualità più ', c_name, sign) as nota
    from customer cross join (values ('UTF-8', ' è già'), ('ISO-8859-1', ' è già'), ('windows-1252', ' l’unità – 5 €'), ('UTF-16LE', ' Ω')) as s(charset, sign)"""
)
def src_charset_many(t):
    """Files in four charsets, told apart by their bytes and read as one table."""
    root = scratch_path(t.spark, "charsets")
    for charset, sign in _SIGNS.items():
        lines = t.sql(f"select concat_ws(';', c_custkey, concat('qualità più ', c_name, '{sign}'), '{charset}') as line from {{customer}}")
        head = t.spark.range(0, 1, 1, 1).select(F.lit("AIC;Nota;Scritto").alias("line"))
        _write_encoded(head.union(lines), charset, f"{root}/{charset}")
    folders = [f"{root}/{charset}" for charset in _SIGNS]
    folder = F.element_at(F.split("file", "/"), -2).alias("scritto")
    # A file of a few short lines may hold nothing that tells; a folder takes what most of its lines say.
    files = delimited.detect_charsets(t.spark, folders, threshold=None).select(folder, "charset", "n_lines")
    found = files.groupBy("scritto").agg(F.max_by("charset", "n_lines").alias("found"))
    rows = delimited.clean_table(delimited.read_delimited(t.spark, folders).rows)
    return rows.join(found, "scritto").select(F.col("scritto").alias("charset"), "found", "codice_aic", "nota")


@query(oracle="select p_partkey as codice_aic, p_name as farmaco, p_brand as ditta from part")
def src_csv_header_repair(t):
    """A list with a quoted, padded header and rows wider than it."""
    lines = t.sql("select concat_ws(';', p_partkey, p_name, concat('\"', p_brand, '\"'), p_type) as line from {part}")
    path = land(t, lines, ['" Codice AIC ";"Farmaco"; Ditta'], "classe_a")
    landed = delimited.read_delimited(t.spark, path, Layout(repair_header=True))
    return delimited.clean_table(landed.rows)


@query(
    oracle="""
    select l_partkey as codice_aic, cast(cast(l_shipdate as date) as varchar) as data_inizio,
           concat('perché ', l_linestatus) as motivazioni,
           case when l_returnflag = 'R' then null else l_returnflag end as classe_di_rimborsabilità
    from lineitem"""
)
def src_csv_preamble(t):
    """The shortage list: two lines above the header, missing values as text."""
    lines = t.sql(
        """select concat_ws(';', l_partkey, cast(l_shipdate as date), concat('perché ', l_linestatus),
                            case when l_returnflag = 'R' then 'N/A' else l_returnflag end) as line
           from {lineitem}"""
    )
    head = ["Elenco dei medicinali carenti;;;", "", "AIC;Data inizio;Motivazioni;Classe di rimborsabilità"]
    path = land(t, lines, head, "elenco_carenti")
    spec = delimited.REGISTER["farmaci_carenti"]
    return delimited.clean_table(delimited.read_delimited(t.spark, path, spec.layout).rows, spec)


@query(
    oracle="""
    select 'comma' as file, s_suppkey as codice_aic, s_name as ditta, s_acctbal as saldo from supplier
    union all select 'semicolon', s_suppkey, s_name, s_acctbal from supplier"""
)
def src_sep_sniff(t):
    """The same rows with two separators, found from the header."""
    parts = []
    for name, sep in (("comma", ","), ("semicolon", ";")):
        lines = t.sql(f"select concat_ws('{sep}', s_suppkey, s_name, s_acctbal) as line from {{supplier}}")
        path = land(t, lines, [sep.join(["codice", "Ditta", "Saldo"])], name)
        landed = delimited.read_delimited(t.spark, path, Layout(sep=None))
        rows = delimited.clean_table(landed.rows, TableSpec(numbers=("saldo",)))
        parts.append(rows.select(F.lit(name).alias("file"), *rows.columns))
    return parts[0].unionByName(parts[1])


@query(
    oracle="""
    select c_custkey as codice_aic, c_name as principio_attivo, c_mktsegment as "Unnamed: 2",
           c_acctbal as differenza_prezzo from customer"""
)
def clean_headers(t):
    """Header names with case, spaces, signs, no name at all, and a synonym of the key."""
    lines = t.sql("select concat_ws(';', c_custkey, c_name, c_mktsegment, c_acctbal) as line from {customer}")
    path = land(t, lines, [" AIC ;PRINCIPIO -- attivo;;_Differenza/Prezzo (€)_"], "clienti")
    landed = delimited.read_delimited(t.spark, path)
    return delimited.clean_table(landed.rows, TableSpec(transform=delimited.clean_prices))


@query(
    oracle="""
    select l_orderkey as codice_aic, l_linenumber::varchar as riga,
           case when l_discount = 0 then null when l_discount >= 0.09 then null else l_extendedprice end
               as prezzo_riferimento_ssn,
           case when l_linenumber = 1 then null else l_quantity end as differenza,
           l_tax::varchar as nota
    from lineitem"""
)
def clean_prices(t):
    """Prices with currency sign, decimal comma, thousands point, blanks and text."""
    lines = t.sql(
        """select concat_ws(';', l_orderkey, l_linenumber,
                  case when l_discount = 0 then 'n.d.'
                       when l_discount >= 0.09 then concat('1.', replace(l_extendedprice, '.', ','))
                       else concat(' € ', replace(l_extendedprice, '.', ','), ' ') end,
                  case when l_linenumber = 1 then ' ' else cast(l_quantity as string) end,
                  l_tax) as line
           from {lineitem}"""
    )
    path = land(t, lines, ["AIC;Riga;Prezzo riferimento SSN;Differenza;Nota"], "equivalenti")
    spec = delimited.REGISTER["farmaci_equivalenti"]
    return delimited.clean_table(delimited.read_delimited(t.spark, path, spec.layout).rows, spec)


# Orders as a register file with notes of several lines, quotes and separators inside; every ninth row has a field too many.
@query(
    oracle="""
    select o_orderkey as codice_aic,
           concat('order ', o_orderkey, chr(10), 'by "', o_orderpriority, '"; paid',
                  case when o_orderstatus = 'O' then concat(chr(10), chr(10), 'open') else '' end) as nota,
           o_orderstatus as stato
    from orders where o_orderkey % 9 <> 0
    union all select -count(*), 'rejects', null from orders where o_orderkey % 9 = 0"""
)
def src_csv_spanning(t):
    """Values with line breaks, quotes and separators in them, read by split; and the number of lines left out."""
    note = """concat('order ', o_orderkey, chr(10), 'by ""', o_orderpriority, '""; paid',
                     case when o_orderstatus = 'O' then concat(chr(10), chr(10), 'open') else '' end)"""
    lines = t.sql(
        f"""select concat_ws(';', o_orderkey, concat('"', {note}, '"'), o_orderstatus, case when o_orderkey % 9 = 0 then 'x' end) as line
            from {{orders}}"""
    )
    path = land(t, lines, ['AIC;"Nota";Stato'], "note")
    landed = delimited.read_delimited(t.spark, path, Layout(quoted_newlines=True))
    rows = delimited.clean_table(landed.rows)
    lost = landed.rejects.agg((-F.count(F.lit(1))).alias("codice_aic"))
    return rows.unionByName(lost.select("codice_aic", F.lit("rejects").alias("nota"), F.lit(None).cast("string").alias("stato")))


# One record per order. Orders of one customer share an id, so records repeat; the nested
# drug names another customer; status P has no primary mark, status F no calculated values.
_XML_LINES = """
    select concat(
        '<drug type="', case when o_orderstatus = 'O' then 'small molecule' else 'biotech' end, '" created="2005">',
        '\\n <drugbank-id', case when o_orderstatus = 'P' then '' else ' primary="true"' end, '>DB', o_custkey,
        '</drugbank-id><drugbank-id>ALT', o_orderkey, '</drugbank-id>',
        '<name>Drug &amp; ', o_custkey, '</name><state>', case when o_orderstatus = 'P' then '' else 'solid' end,
        '</state><synonyms><synonym language="english">', o_orderpriority, '</synonym><synonym/></synonyms>',
        '<atc-codes><atc-code code="', substr(o_orderpriority, 1, 1), '"><level code="Z">z</level></atc-code>',
        '<atc-code code=""/></atc-codes>',
        '<pathways><pathway><drugs><drug><drugbank-id>DB', o_custkey + 1, '</drugbank-id><name>stub</name></drug>',
        '<drug><drugbank-id>DB-1</drugbank-id></drug></drugs></pathway></pathways>',
        '<drug-interactions><drug-interaction><drugbank-id>DB', o_orderkey, '</drugbank-id><name>n</name>',
        '<description>risk &lt; ', o_orderpriority, '</description></drug-interaction>',
        '<drug-interaction><description>any</description></drug-interaction></drug-interactions>',
        case when o_orderstatus = 'F' then '' else concat(
            '<calculated-properties><property><kind>logP</kind><value>1</value></property>',
            '<property><kind>SMILES</kind><value/></property><property><kind>SMILES</kind><value>C', o_custkey,
            '</value></property></calculated-properties>') end,
        case when o_orderkey = 3 then '</broken></drug>' else '</drug>' end) as line
    from {orders}"""
_XML_HEAD = ['<?xml version="1.0" encoding="UTF-8"?>', '<drugbank xmlns="http://www.drugbank.ca" version="5.1">']
_XML_GOOD = "orders where o_orderkey <> 3"


def _xml_file(t) -> str:
    return land(t, t.sql(_XML_LINES), _XML_HEAD, "full", tail=["</drugbank>"])


def _records(t):
    return drug_xml.read_records(t.spark, _xml_file(t))


_XML_DRUGS = f"""
    select concat('DB', o_custkey) as drugbank_id, concat('Drug & ', o_custkey) as name,
           case when o_orderstatus = 'O' then 'small molecule' else 'biotech' end as type,
           case when o_orderstatus = 'P' then '' else 'solid' end as state,
           case when o_orderstatus <> 'F' then concat('C', o_custkey) end as smiles from {_XML_GOOD}
    union all
    select concat('DB', o_custkey + 1), 'stub', null, null, null from {_XML_GOOD}"""


@query(oracle=_XML_DRUGS)
def xml_records(t):
    """All drug elements of the document, top-level and nested."""
    return drug_xml.drug_rows(_records(t))


@query(
    oracle=f"""
    select drugbank_id, name, type, state, smiles from (
        select *, row_number() over (partition by drugbank_id
            order by type desc nulls last, smiles desc nulls last, state desc nulls last, name desc) as rn
        from ({_XML_DRUGS})) where rn = 1"""
)
def xml_drugs(t):
    """The drug relation of the document."""
    return dedup_drugs(drug_xml.drug_rows(_records(t)))


@query(
    oracle=f"""
    select distinct concat('DB', o_custkey) as source_drug_id, concat('DB', o_orderkey) as target_drug_id,
           concat('risk < ', o_orderpriority) as description from {_XML_GOOD}
    union select concat('DB', o_custkey), null, 'any' from {_XML_GOOD}"""
)
def xml_interactions(t):
    return drug_xml.interaction_rows(_records(t)).distinct()


@query(oracle=f"select distinct concat('DB', o_custkey) as drugbank_id, o_orderpriority as synonym from {_XML_GOOD}")
def xml_synonyms(t):
    return drug_xml.synonym_rows(_records(t)).distinct()


@query(
    oracle=f"""
    select distinct concat('DB', o_custkey) as drugbank_id, substr(o_orderpriority, 1, 1) as atc_code
    from {_XML_GOOD}"""
)
def xml_atc(t):
    return drug_xml.atc_rows(_records(t)).distinct()


@query(oracle="select count(*) as n_rejects from orders where o_orderkey = 3")
def xml_rejects(t):
    """Records that are not well-formed."""
    return _records(t).rejects.agg(F.count(F.lit(1)).alias("n_rejects"))


# The same document without any attribute: a record is told from a nested drug by its depth alone.
_XML_PLAIN_LINES = """
    select concat(
        '<drug>', chr(10), '<drugbank-id>DB', o_custkey, '</drugbank-id><drugbank-id>ALT', o_orderkey, '</drugbank-id>',
        '<name>Drug &amp; ', o_custkey, '</name><state>', o_orderstatus, '</state>',
        '<pathways><pathway><drugs><drug><drugbank-id>DB', o_custkey + 1, '</drugbank-id><name>stub</name></drug>', chr(10),
        '<drug/></drugs></pathway></pathways>',
        '<drug-interactions><drug-interaction><drugbank-id>DB', o_orderkey, '</drugbank-id></drug-interaction></drug-interactions>',
        '</drug>') as line
    from {orders}"""
_XML_PLAIN_HEAD = ['<?xml version="1.0" encoding="UTF-8"?>', '<drugbank version="5.1">']


@query(
    oracle="""
    select concat('DB', o_custkey) as drugbank_id, concat('Drug & ', o_custkey) as name, null::varchar as type,
           o_orderstatus as state, null::varchar as smiles from orders
    union all select concat('DB', o_custkey + 1), 'stub', null, null, null from orders"""
)
def xml_records_plain(t):
    """All drug elements of a document whose tags carry no attributes."""
    path = land(t, t.sql(_XML_PLAIN_LINES), _XML_PLAIN_HEAD, "plain", tail=["</drugbank>"])
    return drug_xml.drug_rows(drug_xml.read_records(t.spark, path))


# Records that are damaged by the last digit of the order: an end tag too many, one too few, a stray sign, a torn record.
_XML_DAMAGED_LINES = """
    select concat(
        '<drug type="small molecule"><drugbank-id primary="true">DB', o_orderkey, '</drugbank-id>',
        case o_orderkey % 10 when 1 then '</broken>' when 2 then '<note>' else '' end,
        '<name>Drug ', case when o_orderkey % 10 = 3 then 'A & B < C' else 'A &amp; B &lt; C' end, '</name>',
        '<synonyms><synonym>', o_orderpriority, '</synonym><synonym>second</synonym></synonyms>',
        case when o_orderkey % 10 = 4 then '<atc-codes><atc-code code="' else concat('<atc-codes><atc-code code="', o_orderstatus, '"/></atc-codes>') end,
        '</drug>') as line
    from {orders}"""


@query(
    oracle="""
    select 'drug' as kind, concat('DB', o_orderkey) as drugbank_id, 'Drug A & B < C' as value from orders
    union all select 'synonym', concat('DB', o_orderkey), o_orderpriority from orders
    union all select 'synonym', concat('DB', o_orderkey), 'second' from orders
    union all select 'atc', concat('DB', o_orderkey), o_orderstatus from orders where o_orderkey % 10 <> 4
    union all select 'reject', null, case o_orderkey % 10 when 1 then 'unexpected </broken>' when 2 then 'unclosed <note>'
        when 3 then 'stray &; broken tag' else 'broken tag; unclosed <atc-codes>' end
        from orders where o_orderkey % 10 between 1 and 4"""
)
def xml_recovered(t):
    """The sound elements of a document with damaged records, and what is wrong with each."""
    path = land(t, t.sql(_XML_DAMAGED_LINES), _XML_HEAD, "damaged", tail=["</drugbank>"])
    found = drug_xml.read_records(t.spark, path, recover=True)
    parts = (
        drug_xml.drug_rows(found).select(F.lit("drug").alias("kind"), "drugbank_id", F.col("name").alias("value")),
        drug_xml.synonym_rows(found).select(F.lit("synonym"), "drugbank_id", "synonym"),
        drug_xml.atc_rows(found).select(F.lit("atc"), "drugbank_id", "atc_code"),
        found.rejects.filter("recovered").select(F.lit("reject"), F.lit(None).cast("string"), "damage"),
    )
    return reduce(DataFrame.union, parts)


@query(
    oracle="""
    select 'drugs' as relation, count(*) as n_rows, count(*) as n_written from drugs
    union all select 'interactions', count(*), count(*) from interactions
    union all select 'synonyms', count(*), count(*) from synonyms
    union all select 'atc_codes', count(*), count(*) from atc_codes"""
)
def sink_roundtrip(t):
    """The four drug relations written and read again, with the count each write reports."""
    relations = {
        "drugs": t.drugs, "interactions": t.interactions, "synonyms": t.synonyms, "atc_codes": t.atc_codes
    }
    folder = scratch_path(t.spark, "relations")
    written = tables.write_relations(relations, folder)
    stored = tables.read_drug_relations(t.spark, folder)
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(n).alias("relation"), "n_rows", F.lit(written[n]).cast("bigint").alias("n_written")
        )
        for n, df in stored.items()
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


# Study documents, one page per order with a complete, a bare and a nameless study in it.
_STUDY_DOCS = """
    select named_struct(
        'studies', array(
            named_struct('protocolSection', named_struct(
                'identificationModule', named_struct(
                    'nctId', concat('NCT', o_orderkey),
                    'briefTitle', case when o_orderstatus = 'O' then concat('Brief ', o_orderkey) else '' end,
                    'officialTitle', case when o_orderstatus <> 'P' then concat('Official ', o_orderkey) end),
                'statusModule', named_struct('overallStatus', case when o_orderstatus = 'O' then 'RECRUITING' end,
                    'lastUpdatePostDateStruct', named_struct('date', cast(cast(o_orderdate as date) as string))),
                'contactsLocationsModule', named_struct('locations', array(
                    named_struct('city', concat('City ', o_custkey), 'country', 'Italy', 'status', 'RECRUITING'),
                    null,
                    named_struct('city', cast(null as string), 'country', 'Italy', 'status', cast(null as string)),
                    named_struct('city', 'Wien', 'country', 'Austria', 'status', 'COMPLETED'))),
                'conditionsModule', named_struct('conditions', array(o_orderpriority, 'any condition')),
                'armsInterventionsModule', named_struct('interventions', array(
                    named_struct('name', concat('Drug ', o_orderstatus)))))),
            named_struct('protocolSection', named_struct(
                'identificationModule', named_struct('nctId', concat('BARE', o_orderkey),
                    'briefTitle', cast(null as string), 'officialTitle', cast(null as string)),
                'statusModule', null, 'contactsLocationsModule', null, 'conditionsModule', null,
                'armsInterventionsModule', null)))) as page
    from {orders}"""


def _study_pages(t) -> str:
    path = scratch_path(t.spark, "studies")
    t.sql(_STUDY_DOCS).select("page.*").write.json(path)
    return path


def _study_files(t):
    return landed_json.read_studies(t.spark, _study_pages(t))


@query(
    oracle="""
    select concat('NCT', o_orderkey) as nct_id,
           case when o_orderstatus = 'O' then concat('Brief ', o_orderkey)
                when o_orderstatus <> 'P' then concat('Official ', o_orderkey) else 'N/A' end as title,
           case when o_orderstatus = 'O' then 'RECRUITING' else 'N/A' end as status,
           cast(cast(o_orderdate as date) as varchar) as last_update from orders
    union all select concat('BARE', o_orderkey), 'N/A', 'N/A', null from orders"""
)
def json_studies(t):
    """Studies of landed pages with title and status fallbacks."""
    s = _study_files(t).studies
    return s.select(
        "nct_id",
        trials.study_title(F.col("brief_title"), F.col("official_title")).alias("title"),
        F.coalesce("overall_status", F.lit(trials.NO_STUDY_STATUS)).alias("status"),
        "last_update",
    )


@query(
    oracle="""
    with hit as (
        select o_orderpriority as request_id, concat('NCT', o_orderkey) as nct_id, o_custkey,
               concat('Brief ', o_orderkey) as title, cast(cast(o_orderdate as date) as varchar) as last_update
        from orders where o_orderstatus = 'O'),
    ranked as (select *, row_number() over (partition by request_id order by last_update desc, nct_id) as rank
               from hit)
    select request_id, rank, nct_id, title, concat('https://clinicaltrials.gov/study/', nct_id) as url,
           concat('City ', o_custkey) as city
    from ranked where rank <= 3"""
)
def json_trials_recruiting(t):
    """The three latest recruiting studies in Italy per condition, with their cities."""
    s = _study_files(t)
    asked = t.sql(
        """select o_orderpriority as request_id, 'drug o' as intervention, upper(o_orderpriority) as condition
           from {orders} group by o_orderpriority"""
    )
    hits = trials.matching_studies(asked, s.studies, s.conditions, s.interventions, s.sites)
    # A few rows per request that took a whole search: stored, as two steps read them.
    top = through_storage(trials.latest(hits, s.studies, 3), "latest-studies")
    cities = trials.recruiting_cities(top, s.sites)
    return top.join(cities, ["request_id", "nct_id"], "left").select(
        "request_id", "rank", "nct_id", "title", "url", "city"
    )


@query(
    oracle="""
    select state, cast(count(*) as bigint) as n_pages, cast(sum(n) as bigint) as n_entries, cast(sum(reject) as bigint) as n_rejects from (
        select case when o_orderkey % 10 = 1 then 'damaged' when o_orderkey % 10 = 2 then 'error' when o_orderkey % 10 = 3 then 'empty'
                    when o_orderkey % 10 = 4 then 'partial' else 'rows' end as state,
               case when o_orderkey % 10 between 1 and 3 then 0 when o_orderkey % 10 = 4 then 1 else 2 end as n,
               case when o_orderkey % 10 in (1, 2, 4) then 1 else 0 end as reject from orders) group by state
    union all select 'studies', count(*), count(*), 0 from (
        select 1 from orders where o_orderkey % 10 in (0, 4, 5, 6, 7, 8, 9)
        union all select 1 from orders where o_orderkey % 10 in (0, 5, 6, 7, 8, 9))"""
)
def json_rejects(t):
    """Landed pages by what they held: torn, error, empty and ill-formed pages beside whole ones; and the studies they gave."""
    pages = t.sql(
        """with s as (select o_orderkey, concat('{{"protocolSection":{{"identificationModule":{{"nctId":"N', o_orderkey, '"}}}}}}') as study from {orders})
           select case o_orderkey % 10
                  when 1 then concat('{{"studies":[', study, ',{{"protoc')
                  when 2 then concat('{{"error":{{"code":"E', o_orderkey, '"}}}}')
                  when 3 then '{{"studies":[]}}'
                  when 4 then concat('{{"studies":[', study, '],"protocolSection":"text"}}')
                  else concat('{{"studies":[', study, ',', study, ']}}') end as line from s"""
    )
    path = f"{scratch_path(t.spark, 'pages')}/studies"
    pages.write.text(path)
    read = landed_json.read_studies(t.spark, path)
    by_state = read.pages.groupBy("state").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("n_entries").alias("n_entries"))
    lost = read.rejects.filter("length(page) > 0").groupBy("state").agg(F.count(F.lit(1)).alias("n_rejects"))
    states = by_state.join(lost, "state", "left").select("state", "n_pages", "n_entries", F.coalesce("n_rejects", F.lit(0)).cast("bigint").alias("n_rejects"))
    total = F.count(F.lit(1))
    return states.unionByName(read.studies.agg(total.alias("n_pages"), total.alias("n_entries")).select(F.lit("studies").alias("state"), "*", F.lit(0).cast("bigint").alias("n_rejects")))


@query(oracle=ADVERSE_ORACLE)
def json_adverse_topk(t):
    """Most reported reactions from landed report pages, error pages among them."""
    path = scratch_path(t.spark, "reports")
    pages = reports(t).select(
        F.array(
            F.struct(
                F.col("report_id").cast("string").alias("safetyreportid"),
                F.struct(
                    F.transform(
                        "substances", lambda s: F.struct(F.struct(s.alias("activesubstancename")).alias("activesubstance"))
                    ).alias("drug"),
                    F.transform("reactions", lambda r: F.struct(r.alias("reactionmeddrapt"))).alias("reaction"),
                ).alias("patient"),
            )
        ).alias("results")
    )
    errors = t.table("region").select(F.struct(F.col("r_name").alias("message")).alias("error"))
    pages.write.json(f"{path}/pages")
    errors.write.json(f"{path}/errors")
    landed = landed_json.read_reports(t.spark, [f"{path}/pages", f"{path}/errors"])
    return adverse.top_reactions(adverse_requests(t), landed, 5)
