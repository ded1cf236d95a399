"""Domain tables derived from the given tables.

Each table is one SELECT in the dialect Spark and DuckDB share, so both sides of a check
start from the same rows; the operators under test never appear here. ``{name}`` stands for a
given table or an earlier domain table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

GIVEN = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
         "embeddings", "pages", "benchmark", "labels", "conversations"]

_FAMILY = "Müller|Schäfer|Weiß|Krause|Röcher|Becker|Jäger|Köhler|Vogtland|Brandt|Engelmann|Sommer"
_TRADE = ("Kältetechnik|Druckluft|Zimmerei|Malerbetrieb|Elektro|Sanitär|Gerüstbau|Fensterbau|Architekt|"
          "Estrich|Trockenbau|Messtechnik")
_LEGAL = "GmbH|GmbH & Co. KG|AG|e.K."
_PRODUCT = "Kunststofftechnik|Metallbau|Logistik|Papierwerk|Gießerei"


def _pick(words: str, index: str) -> str:
    return f"split_part('{words}', '|', cast({index} + 1 as int))"


def vendor(vid: str) -> str:
    return (f"{_pick(_FAMILY, f'({vid}) % 12')} || ' ' || {_pick(_TRADE, f'((({vid}) - ({vid}) % 12) / 12) % 12')}"
            f" || ' ' || {_pick(_LEGAL, f'({vid}) % 4')}")


def de_money(x: str) -> str:
    """German grouped amount of a DECIMAL(18,2) below one billion."""
    whole = f"cast(floor(abs({x})) as bigint)"
    cents = f"lpad(cast(cast(round((abs({x}) - floor(abs({x}))) * 100, 0) as int) as varchar(20)), 2, '0')"
    low = f"lpad(cast({whole} % 1000 as varchar(20)), 3, '0')"
    mid = f"lpad(cast(cast(floor({whole} / 1000) as bigint) % 1000 as varchar(20)), 3, '0')"
    thousands = f"cast(cast(floor({whole} / 1000) as bigint) as varchar(20))"
    millions = f"cast(cast(floor({whole} / 1000000) as bigint) as varchar(20))"
    return (f"(case when {x} < 0 then '-' else '' end || case when {whole} >= 1000000 then {millions} || '.' || {mid} || '.' || {low} "
            f"when {whole} >= 1000 then {thousands} || '.' || {low} else cast({whole} as varchar(20)) end || ',' || {cents})")


def de_date(x: str) -> str:
    return (f"lpad(cast(extract(day from {x}) as varchar(4)), 2, '0') || '.' || "
            f"lpad(cast(extract(month from {x}) as varchar(4)), 2, '0') || '.' || cast(extract(year from {x}) as varchar(4))")


TABLES: dict[str, str] = {}

TABLES["projects"] = f"""
select c_custkey as project_id,
  case when c_custkey % 19 = 7 then cast(null as varchar(80))
       else {_pick(_FAMILY, 'c_custkey % 12')} || ' ' || {_pick(_PRODUCT, 'c_nationkey % 5')} || ' GmbH' end as client_name,
  case when c_custkey % 19 = 7 or c_custkey % 6 = 1 then cast(null as varchar(80))
       else 'Industriestraße ' || cast(c_custkey % 90 + 1 as varchar(20)) || ', ' || cast(10000 + c_custkey % 80000 as varchar(20)) || ' Bad ' || {_pick(_FAMILY, 'c_nationkey % 12')} || 'hausen' end as client_address,
  case when c_custkey % 5 = 4 then cast(null as date) else date '1995-03-01' + cast(c_custkey % 200 as int) end as bewilligungszeitraum_start,
  case when c_custkey % 7 = 6 then cast(null as date) else date '2000-03-01' + cast(c_custkey % 300 as int) end as bewilligungszeitraum_end,
  case when c_custkey % 8 = 3 then cast(null as date) else date '1995-06-01' + cast(c_custkey % 400 as int) end as antragstellung,
  case when c_custkey % 4 = 1 then date '1995-04-01' + cast(c_custkey % 300 as int) else cast(null as date) end as aavm_genehmigung,
  case when c_custkey % 3 = 2 then cast(null as date) else date '1996-01-05' + cast(c_custkey % 365 as int) end as bescheid_eingegangen,
  case when c_custkey % 9 = 5 then cast(null as date) else date '1995-08-01' + cast(c_custkey % 500 as int) end as bescheid_datiert,
  case when c_custkey % 10 = 0 then cast(null as varchar(20)) else 'K-' || cast(c_custkey as varchar(20)) end as kennung,
  case when c_custkey % 6 = 5 then cast(null as decimal(18,2)) else cast(abs(c_acctbal) * 50 as decimal(18,2)) end as foerderbetrag,
  case when c_custkey % 11 = 2 then cast(null as decimal(5,4)) else cast(0.30 + 0.05 * cast(c_custkey % 3 as decimal(4,0)) as decimal(5,4)) end as kostendeckel_foerderanteil,
  case when c_custkey % 3 = 0 then cast(null as decimal(18,2)) else cast(c_custkey % 1000 as decimal(18,2)) end as agvo_referenzkosten
from {{customer}}"""

TABLES["invoice_positions"] = """
select l_orderkey as invoice_id,
  cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) as bigint) as pos_seq,
  cast(l_linenumber as varchar(10)) as pos,
  p_name || ' ' || p_brand || ' T-' || cast(l_partkey as varchar(20)) || '.' || cast(p_size as varchar(10)) as description,
  cast(l_quantity as decimal(18,2)) as qty,
  cast(round(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2))), 2) as decimal(18,2)) as line_total_net,
  l_partkey as part_id
from {lineitem} join {part} on l_partkey = p_partkey"""

TABLES["line_sums"] = """
select invoice_id as sum_invoice_id, cast(sum(line_total_net) as decimal(18,2)) as line_sum, count(*) as n_lines
from {invoice_positions} group by invoice_id"""

_INV = f"""
select o_orderkey as invoice_id, o_custkey as project_id, o_orderkey as seq,
  cast((o_custkey * 3 + o_orderkey % 6) % 144 as int) as vid,
  case when o_orderkey % 11 = 3 then 'PlanWegweiser Nord GmbH'
       when o_orderkey % 13 = 5 then coalesce(client_name, 'Krause Metallbau GmbH')
       when o_orderkey % 7 = 2 then replace(replace({vendor('(o_custkey * 3 + o_orderkey % 6) % 144')}, 'technik', 'tecnik'), 'Müller', 'Mueller')
       else {vendor('(o_custkey * 3 + o_orderkey % 6) % 144')} end as vendor_name,
  case when o_orderkey % 10 = 9 then cast(null as varchar(80)) when o_orderkey % 10 = 8 then 'Fremd Handels AG' when o_orderkey % 10 = 7 then '[KUNDE] GmbH' else client_name end as recipient_name,
  case when o_orderkey % 4 = 1 then cast(null as varchar(80)) else client_address end as recipient_address,
  'RE-' || lpad(cast(o_orderkey as varchar(20)), 6, '0') as invoice_number,
  cast(o_orderdate as date) as invoice_date,
  case when o_orderkey % 4 = 0 then cast(null as date) else cast(o_orderdate as date) - cast(o_orderkey % 60 as int) end as order_date,
  case when o_orderkey % 17 = 0 then 'gutschrift' when o_orderstatus = 'F' then 'schlussrechnung'
       when o_orderstatus = 'P' and o_orderkey % 2 = 0 then 'anzahlung' when o_orderstatus = 'P' then 'teilrechnung' else 'rechnung' end as invoice_type,
  cast(case when o_orderkey % 97 = 0 then 0
       when o_orderkey % 17 = 0 then -abs(coalesce(line_sum, 0))
       when o_orderkey % 2 = 0 then coalesce(line_sum, 0)
       else cast(o_totalprice as decimal(18,2)) end as decimal(18,2)) as netto,
  cast(case when o_orderkey % 5 = 0 then null when o_orderkey % 5 = 1 then 7 else 19 end as decimal(5,2)) as mwst_pct,
  coalesce(n_lines, 0) as n_lines
from {{orders}} join {{projects}} on o_custkey = project_id left join {{line_sums}} on o_orderkey = sum_invoice_id"""

TABLES["invoice_base"] = _INV

TABLES["invoices"] = """
select invoice_id, project_id, seq, vid,
  replace(vendor_name, ' ', '-') || '-Sr-' || invoice_number || '.pdf' as source_name,
  vendor_name, recipient_name, recipient_address, invoice_number, invoice_date, order_date, invoice_type,
  case when invoice_id % 6 = 1 then 'Energieberatung und Statik' when invoice_id % 6 = 2 then 'Bauleitung' when invoice_id % 6 = 3 then cast(null as varchar(40)) else 'Montage Anlage' end as subject,
  netto, mwst_pct,
  case when mwst_pct is null or invoice_id % 8 = 4 then cast(null as decimal(18,2))
       else cast(round(netto * mwst_pct * 0.01, 2) + case when invoice_id % 9 = 0 then 0.10 else 0 end as decimal(18,2)) end as mwst_amount,
  case when invoice_id % 8 = 4 then cast(null as decimal(18,2))
       when mwst_pct is null then netto + case when invoice_id % 3 = 0 then 5 else 0 end
       else cast(netto + round(netto * mwst_pct * 0.01, 2) as decimal(18,2)) end as brutto,
  case when mwst_pct is null and invoice_id % 2 = 0 then 'tax_free' when mwst_pct is null and invoice_id % 3 = 0 then 'reverse_charge' when mwst_pct is null then 'unclear' when mwst_pct = 7 then 'reduced' else 'standard' end as vat_status,
  cast(case when invoice_id % 3 = 0 then 3 when invoice_id % 3 = 1 then 2 else null end as decimal(5,2)) as skonto_pct,
  case when invoice_type = 'schlussrechnung' and invoice_id % 2 = 0 then cast(netto + 1000 as decimal(18,2)) else cast(null as decimal(18,2)) end as cumulative_netto,
  case when invoice_type = 'schlussrechnung' and invoice_id % 4 <> 1 then cast(1000 - case when invoice_id % 10 = 0 then 10 else 0 end as decimal(18,2)) else cast(null as decimal(18,2)) end as deducted_advances_netto,
  case when invoice_id % 6 = 0 then 'vision+llm' when invoice_id % 16 = 5 then 'zugferd-xml' else 'pdfplumber+llm' end as extraction_method,
  case when invoice_id % 14 = 1 then true when invoice_id % 14 = 2 then false else cast(null as boolean) end as recipient_local_ok,
  n_lines
from {invoice_base}"""

_BAL = "cast(abs(c_acctbal) as decimal(18,2))"


_KV = vendor("(c_custkey * 3 + k) % 144")
_ESTIMATE = "'SOLL: SCHÄTZUNG lt. Stellungnahme vom 01.02.1996'"
_OWN_BLOCK = "k = 6 and c_custkey % 2 = 0"

# @sequence(a,b) is one row per integer: explode on one side, unnest on the other.
TABLES["vendor_blocks"] = f"""
select c_custkey as project_id, cast(k as bigint) as block_seq,
  case when {_OWN_BLOCK} then 'Planwegweiser Nord' when k = 6 then 'Eigenleistung' when k = 5 then 'Eigenerklärung' else {_KV} end as vendor,
  case when {_OWN_BLOCK} then 'SOLL: Planwegweiser Nord Angebot 6 vom 01.02.1996' when k >= 5 then {_ESTIMATE}
       else 'SOLL: ' || {_KV} || ' Angebot ' || cast(c_custkey as varchar(20)) || ' vom 01.02.1996' end as header,
  cast(case when k = 5 then 0 when k = 3 then 1 else 0.8125 end as decimal(38,20)) as anteil_ik,
  cast(case when k = 5 then 1 when k = 3 then 0 else 0.1875 end as decimal(38,20)) as anteil_nk,
  cast(case when k = 5 then 0 else round({_BAL} * 0.8125 + 16000 * k, 2) end as decimal(18,2)) as beantragt_ik,
  case when c_custkey % 10 = 4 then cast(null as decimal(18,2)) else cast(round({_BAL} * 0.1875 + 3000 * k, 2) as decimal(18,2)) end as beantragt_nk,
  cast({_BAL} + 20000 * k as decimal(18,2)) as gesamt,
  case when k = 2 then cast({_BAL} + 19000 * k as decimal(18,2)) else cast(null as decimal(18,2)) end as sonderpreis,
  k = 5 as statement
from (select c_custkey, c_acctbal, @sequence(0,6) as k from {{customer}})"""

TABLES["offers"] = f"""
select o_custkey * 10 + o_orderkey % 6 as offer_id, o_custkey as project_id, cast(o_orderkey % 6 as bigint) as seq,
  case when o_orderkey % 6 = 5 then 'Pfeiffer Hydraulik KG' else {vendor('(o_custkey * 3 + o_orderkey % 6) % 144')} end as vendor_name,
  case when o_orderkey % 6 = 2 then 'Kurzname ' || cast(o_custkey as varchar(20)) else cast(null as varchar(20)) end as vendor_short,
  'A-' || cast(o_custkey as varchar(20)) || '-' || cast(o_orderkey % 6 as varchar(20)) as offer_number,
  min(cast(o_orderdate as date)) as offer_date,
  case when o_orderkey % 6 = 1 then 'Kälteanlage' else cast(null as varchar(20)) end as title,
  case when o_orderkey % 6 = 4 then 'statement' else 'offer' end as kind,
  case when o_orderkey % 6 = 4 then cast(null as decimal(18,2)) when o_custkey % 5 = 0 then cast(max(o_totalprice) as decimal(18,2)) else cast(coalesce(sum(line_sum), 0) as decimal(18,2)) end as nettosumme,
  case when o_orderkey % 6 = 1 then cast(round(coalesce(sum(line_sum), 0) * 0.95, 2) as decimal(18,2)) when o_orderkey % 6 = 3 and o_custkey % 3 = 0 then cast(-50 as decimal(18,2)) else cast(null as decimal(18,2)) end as sonderpreis,
  case when o_orderkey % 6 = 2 then cast(120 as decimal(18,2)) when o_orderkey % 6 = 0 then cast(-75 as decimal(18,2)) else cast(null as decimal(18,2)) end as preisnachlass
from {{orders}} left join {{line_sums}} on o_orderkey = sum_invoice_id
group by o_custkey, o_orderkey % 6"""

TABLES["offer_lines"] = """
select o_custkey * 10 + o_orderkey % 6 as offer_id, part_id, min(pos) as pos, min(description) as description,
  sum(qty) as qty, sum(line_total_net) as total, count(*) as n
from {invoice_positions} join {orders} on invoice_id = o_orderkey
group by o_custkey * 10 + o_orderkey % 6, part_id"""

TABLES["offer_positions"] = """
select offer_id, cast(row_number() over (partition by offer_id order by part_id) as bigint) as pos_seq,
  case when part_id % 31 = 3 then 'Rabatt' else pos end as pos,
  case when part_id % 7 = 1 then cast(null as varchar(20)) else 'T-' || cast(part_id as varchar(20)) || '.1' end as artikelnummer,
  case when part_id % 31 = 3 then 'Nachlass auf ' || description when part_id % 23 = 2 then description || ' inkl. Montage' else description end as description,
  cast(qty as decimal(18,2)) as qty,
  case when part_id % 31 = 3 then cast(-75 as decimal(18,2)) when part_id % 23 = 2 then cast(0 as decimal(18,2))
       when part_id % 29 = 4 then cast(null as decimal(18,2))
       when part_id % 4 = 0 then cast(total + 100 as decimal(18,2)) else cast(total as decimal(18,2)) end as line_total_net,
  part_id % 29 = 4 or part_id % 23 = 2 or part_id % 13 = 6 as optional,
  case when part_id % 23 = 2 then 'inklusive' when part_id % 13 = 6 then 'Option' else cast(null as varchar(20)) end as optional_reason,
  case when part_id % 31 = 3 then 'nachlass' when part_id % 3 = 0 then 'nebenkosten' else 'investitionskosten' end as kategorie,
  part_id
from {offer_lines}"""

TABLES["invoice_scans"] = """
select *, cast(0 as bigint) as copy_no, seq * 4 as scan_seq, invoice_id as original_id from {invoices}
union all
select invoice_id + 100000000, project_id, seq, vid, 'scan_' || source_name, vendor_name, recipient_name, recipient_address,
  case when invoice_id % 3 = 0 then replace(invoice_number, '-', ' / ') when invoice_id % 3 = 1 then substr(invoice_number, 4) else 'X' || invoice_number end,
  case when invoice_id % 4 = 3 then invoice_date + 1 else invoice_date end, order_date, invoice_type, subject, netto, mwst_pct, mwst_amount, brutto, vat_status,
  skonto_pct, cumulative_netto, deducted_advances_netto, 'vision+llm', recipient_local_ok, n_lines, cast(1 as bigint), seq * 4 + 2, invoice_id
from {invoices}
union all
select invoice_id + 200000000, project_id, seq, vid, 'abschlag_' || source_name, vendor_name, recipient_name, recipient_address,
  'T-' || cast(invoice_id % 977 as varchar(20)), invoice_date + 40, order_date, invoice_type, subject, netto, mwst_pct, mwst_amount, brutto, vat_status,
  skonto_pct, cumulative_netto, deducted_advances_netto, extraction_method, recipient_local_ok, n_lines, cast(2 as bigint), seq * 4 + 3, invoice_id
from {invoices}"""

TABLES["scan_positions"] = """
select invoice_id, pos_seq, line_total_net from {invoice_positions}
union all
select invoice_id + 100000000, pos_seq, line_total_net from {invoice_positions}
union all
select invoice_id + 200000000, pos_seq, cast(line_total_net + 1 as decimal(18,2)) from {invoice_positions}"""

TABLES["payment_proofs"] = """
select project_id, invoice_id * 3 as proof_seq, cast('Auftraggeber' as varchar(20)) as payer_name,
  case when invoice_id % 6 = 5 then cast(null as varchar(40)) else replace(vendor_name, 'ä', 'ae') end as payee_name,
  case when invoice_id % 12 = 7 then cast(null as decimal(18,2))
       when skonto_pct is not null and invoice_id % 4 = 1 then cast(round(coalesce(brutto, netto) * (100 - skonto_pct) * 0.01, 2) as decimal(18,2))
       when invoice_id % 9 = 8 then cast(coalesce(brutto, netto) + 17 as decimal(18,2)) else coalesce(brutto, netto) end as amount,
  case when invoice_id % 10 = 6 then cast(null as date) else invoice_date + 14 end as payment_date,
  case when invoice_id % 3 = 1 then cast(null as varchar(60)) when invoice_id % 3 = 2 then 'Abschlag Bauvorhaben' else 'Rechnung ' || replace(invoice_number, '-', '/') || ' vielen Dank' end as verwendungszweck,
  'zahlung_' || cast(invoice_id as varchar(20)) || '.png' as source_path
from {invoices}
union all
select project_id, invoice_id * 3 + 1, 'Auftraggeber', vendor_name, cast(1000 as decimal(18,2)), invoice_date + 3, cast(null as varchar(60)), 'teil_' || cast(invoice_id as varchar(20)) || '.png'
from {invoices} where invoice_type = 'anzahlung'"""

TABLES["funding_meta"] = """
select c_custkey as project_id,
  case when c_custkey % 4 = 0 then 'eh' when c_custkey % 4 = 3 then 'unclear' else 'em' end as program_type,
  case when c_custkey % 9 = 0 then cast(null as varchar(20)) else '94' || lpad(cast(c_custkey as varchar(20)), 6, '0') end as vorgangsnummer,
  case when c_custkey % 8 = 0 then cast(null as date) else date '1995-05-01' + cast(c_custkey % 300 as int) end as antrag_date,
  case when c_custkey % 7 = 0 then cast(null as date) else date '1995-09-01' + cast(c_custkey % 300 as int) end as bescheid_date,
  case when c_custkey % 3 = 0 then 'privat' when c_custkey % 3 = 1 then 'unternehmen' else 'unclear' end as client_basis,
  case when c_custkey % 11 = 0 then cast(null as decimal(18,2)) else cast(60000 as decimal(18,2)) end as geplante_kosten_massnahmen,
  cast(2500 as decimal(18,2)) as geplante_kosten_baubegleitung,
  case when c_custkey % 6 = 0 then cast(null as decimal(5,2)) else cast(15 + c_custkey % 3 * 5 as decimal(5,2)) end as foerdersatz_pct,
  case when c_custkey % 5 = 0 then '15 % + 5 % iSFP-Bonus' else cast(null as varchar(40)) end as foerdersatz_zusammensetzung,
  case when c_custkey % 4 = 2 then cast(null as decimal(18,2)) else cast(60000 + c_custkey % 2 * 60000 as decimal(18,2)) end as foerderfaehige_kosten_cap,
  cast(case when c_custkey % 10 = 3 then null else 50 end as decimal(5,2)) as baubegleitung_foerdersatz_pct,
  cast(case when c_custkey % 10 = 4 then null else 5000 end as decimal(18,2)) as baubegleitung_kosten_cap
from {customer}"""

TABLES["approval_letters"] = f"""
select o_custkey as project_id, o_orderkey as letter_id, client_name as empfaenger_name, client_address as empfaenger_adresse,
  date '1995-03-01' + cast(o_orderkey % 90 as int) as bewilligungszeitraum_start,
  date '2001-03-01' + cast(o_orderkey % 90 as int) as bewilligungszeitraum_end,
  case when o_orderkey % 3 = 0 then cast(null as decimal(18,2)) else cast(o_totalprice as decimal(18,2)) end as foerderbetrag,
  cast(case when o_orderkey % 5 = 0 then null else 30 + o_orderkey % 20 end as decimal(5,2)) as foerderanteil_pct,
  cast(o_orderdate as date) as bescheid_datum, cast(o_orderdate as date) - 90 as antrag_datum,
  'BG-' || cast(o_orderkey as varchar(20)) as kennung,
  'Bescheid vom ' || {de_date('cast(o_orderdate as date)')} as bescheid_datum_quote,
  case when o_orderkey % 4 = 0 then cast(null as varchar(60)) else 'Ihr Antrag vom ' || {de_date('cast(o_orderdate as date) - 90')} end as antrag_datum_quote,
  case when o_orderkey % 6 = 0 then 'Kennung: BG-999999999' else 'Kennung: BG-' || cast(o_orderkey as varchar(20)) end as kennung_quote,
  'Zuwendung in Höhe von ' || {de_money('cast(o_totalprice as decimal(18,2))')} || ' €' as foerderbetrag_quote
from {{orders}} join {{projects}} on o_custkey = project_id"""

TABLES["letter_pages"] = f"""
select letter_id, 1 as page_no, 'Zuwendungsbescheid' || chr(10) || 'Bescheid vom ' || {de_date('bescheid_datum')} || chr(10)
  || 'Kennung: ' || kennung as text from {{approval_letters}}
union all
select letter_id, 2 as page_no, 'Ihr Antrag vom ' || {de_date('antrag_datum')} || ' wird bewilligt.' || chr(10)
  || 'Zuwendung in Höhe von ' || coalesce({de_money('foerderbetrag')}, '0,00') || ' €' as text from {{approval_letters}}"""

TABLES["invoice_pages"] = f"""
select invoice_id as doc_id, 1 as page_no,
  case when invoice_id % 6 = 0 and invoice_id % 5 = 0 then ' ' else
  vendor_name || chr(10) || 'An: ' || coalesce(recipient_name, '') || chr(10) || coalesce(recipient_address, '') || chr(10)
  || 'Rechnung Nr. ' || invoice_number || chr(10) || 'Datum: ' || {de_date('invoice_date')} || chr(10)
  || case when order_date is null then '' else 'Auftrag vom ' || {de_date('order_date')} end end as text
from {{invoices}}
union all
select invoice_id, 2,
  case when invoice_id % 6 = 0 and invoice_id % 5 = 0 then '' else
  'Summe netto ' || case when invoice_id % 10 = 3 then replace({de_money('netto')}, '.', '') else {de_money('netto')} end || ' €' || chr(10)
  || 'MwSt ' || coalesce({de_money('mwst_amount')}, '') || ' €' || chr(10)
  || case when invoice_id % 12 = 9 then '' else 'Gesamtbetrag ' || coalesce({de_money('brutto')}, '') || ' €' end end
from {{invoices}}"""

TABLES["evidence_fields"] = f"""
select invoice_id as doc_id, 'vendor_name' as field, 'text' as kind, vendor_name as value,
  case when invoice_id % 5 = 0 then cast(null as varchar(80)) else vendor_name end as quote from {{invoices}}
union all
select invoice_id, 'invoice_number', 'text', invoice_number, case when invoice_id % 8 = 1 then 'Rechnung Nr. 999999999' else 'Rechnung Nr. ' || invoice_number end from {{invoices}}
union all
select invoice_id, 'invoice_date', 'date', cast(invoice_date as varchar(20)), case when invoice_id % 7 = 0 then 'Rechnung Nr. ' || invoice_number else 'Datum: ' || {de_date('invoice_date')} end from {{invoices}}
union all
select invoice_id, 'order_date', 'date', cast(order_date as varchar(20)), 'Auftrag vom ' || {de_date('order_date')} from {{invoices}}
union all
select invoice_id, 'netto', 'amount', cast(netto as varchar(30)), 'Summe netto ' || {de_money('netto')} from {{invoices}}
union all
select invoice_id, 'brutto', 'amount', cast(brutto as varchar(30)), 'Gesamtbetrag ' || {de_money('brutto')} || ' €' from {{invoices}}"""

TABLES["manifest"] = f"""
select o_custkey as project_id,
  case when o_orderkey % 5 = 1 then 'Zahlungsnachweise' when o_orderkey % 5 = 2 then 'geprüfte Rechnungen' when o_orderkey % 5 = 3 then 'Angebote' else 'projekt' || cast(o_custkey as varchar(20)) end as parent_name,
  {_pick('Rechnung_|Angebot_|img|Zuwendungsbescheid_|tpb1_|begptvn_|Auftragsbestätigung |1. AR |Kontoauszug|scan|RG-|Stellungnahme_|Förderantrag|Leasing ', 'o_orderkey % 14')} || cast(o_orderkey as varchar(20)) || case when o_orderkey % 15 = 7 then '.png' when o_orderkey % 29 = 8 then '.xlsx' else '.pdf' end as name,
  {_pick('|Unsere RECHNUNG 4711|Angebot Nr. 12|laut Auftragsbestätigung 5 Rechnung|Kaufvertrag|Bewilligung der Mittel|Kontoauszug Mai|BZA-ID 77|Seite ohne Inhalt', 'o_orderkey % 9')} as first_page_text,
  o_orderkey as file_id
from {{orders}}"""

TABLES["sheet_rows"] = f"""
select c_custkey as sheet_id, cast(block_seq * 1000 as bigint) as row_no, header as a, cast(null as varchar(80)) as b,
  cast(null as decimal(18,2)) as c, cast(null as decimal(18,2)) as d, cast(null as decimal(18,2)) as e
from {{customer}} join {{vendor_blocks}} on c_custkey = project_id
union all
select project_id, block_seq * 1000 + 1, 'Position', 'Beschreibung', null, null, null from {{vendor_blocks}}
union all
select o.project_id, o.seq * 1000 + 1 + p.pos_seq, p.pos, p.description, p.line_total_net,
  case when p.kategorie = 'investitionskosten' then p.line_total_net end, case when p.kategorie = 'nebenkosten' then p.line_total_net end
from {{offer_positions}} p join {{offers}} o on p.offer_id = o.offer_id
union all
select project_id, block_seq * 1000 + 900, 'Σ 1…9', 'Gesamtpreis', case when project_id % 3 = 0 then gesamt end, case when project_id % 3 = 0 then beantragt_ik end, case when project_id % 3 = 0 then beantragt_nk end
from {{vendor_blocks}} where block_seq < 4
union all
select project_id, block_seq * 1000 + 901, '', 'Nettosumme lt. Dokument', gesamt, null, null from {{vendor_blocks}} where block_seq = 1
union all
select project_id, block_seq * 1000 + 902, '', 'Sonderpreis Pos.1 – Pos.9', sonderpreis, null, null from {{vendor_blocks}} where sonderpreis is not null"""

TABLES["sheet_texts"] = f"""
select project_id as doc_id, block_seq,
  header || chr(10) || 'Position Beschreibung Gesamt IK NK' || chr(10)
  || '1      Anlage ' || vendor || '   ' || {de_money('gesamt')} || ' €  ' || {de_money('beantragt_ik')} || ' €  ' || coalesce({de_money('beantragt_nk')}, '0,00') || ' €' || chr(10)
  || '       mit Zubehör' || chr(10)
  || case when block_seq % 3 = 1 then '2.1    Optionale Messung   1,250.00 €  1,000.00 €  250.00 €' || chr(10) else '' end
  || 'Σ Gesamtpreis Pos.1   ' || {de_money('gesamt')} || ' €  ' || case when project_id % 3 = 0 then '1,00' else {de_money('beantragt_ik')} end || ' €  ' || {de_money('gesamt - beantragt_ik')} || ' €' || chr(10)
  || case when sonderpreis is null then '' else 'Sonderpreis Pos.1 – Pos.2   ' || {de_money('sonderpreis')} || ' €' || chr(10) end
  || case when project_id % 4 = 1 then '' else '100,00 %   81,25 %   18,75 %' || chr(10) end as block_text
from {{vendor_blocks}}"""

TABLES["audit_events"] = """
select cast(user_id as varchar(20)) || '-' || cast(cast(extract(day from ts) as int) as varchar(4)) as job, ts, event_id as line_no,
  case when user_id % 2 = 0 then 'vne' else 'beg' end as procedure,
  case when event_type = 'signup' and event_id % 3 = 0 then 'created' when event_type = 'signup' then 'feedback' when event_type = 'view' and event_id % 4 = 0 then 'finished' when event_type = 'view' then 'file'
       when event_type = 'click' then 'progress' when event_type = 'purchase' then 'output' when event_id % 2 = 0 then 'flag' else 'error' end as event,
  props as message, 'datei_' || cast(event_id % 7 as varchar(4)) || '.pdf' as file,
  case when event_id % 5 = 0 then 'fehler' when event_id % 5 = 1 then 'hinweis' else 'ok' end as status,
  event_id % 2 = 0 as verified
from {events}"""

TABLES["group_offer_lines"] = """
select o.project_id, o.seq as group_seq, p.pos_seq as line_seq, p.pos, p.artikelnummer, p.description, p.qty, p.line_total_net, p.optional
from {offer_positions} p join {offers} o on p.offer_id = o.offer_id"""

TABLES["group_invoice_lines"] = """
select i.project_id, i.invoice_id % 6 as group_seq, i.invoice_id, i.invoice_number, p.pos_seq, p.pos, p.description, p.qty, p.line_total_net
from {invoice_positions} p join {invoices} i on p.invoice_id = i.invoice_id
union all
select project_id, group_seq, 300000000 + project_id * 10 + group_seq, 'RG-' || cast(project_id as varchar(20)), cast(1 as bigint), '1', 'Gesamtauftrag pauschal', cast(1 as decimal(18,2)),
  cast(case when project_id % 3 = 0 then sum(case when not optional then line_total_net end) else sum(line_total_net) end as decimal(18,2))
from {group_offer_lines} group by project_id, group_seq
having sum(case when not optional then line_total_net end) is not null"""

TABLES["offer_groups"] = """
select project_id, seq as group_seq, vendor_name as group_label, case when seq = 3 then cast(1000 as decimal(18,2)) else cast(null as decimal(18,2)) end as group_sonderpreis from {offers}"""

# Bytes of a generated method up to which Java compiles it. The long expressions of the tables above make larger ones, which
# would be interpreted row by row; with this limit Spark splits them.
_METHOD_BYTES = "8000"

_NAME = re.compile(r"\{(\w+)\}")
_SEQUENCE = re.compile(r"@sequence\((\d+),(\d+)\)")
# One of several selects from a single table: key, other columns, table, condition.
_BRANCH = re.compile(r"select (\*|\w+[^,]*), (.*?)\s+from \{(\w+)\}(?: where (.*))?", re.S)


def _closure(names: list[str]) -> list[str]:
    """Domain tables needed for ``names``, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in GIVEN or name in ordered:
            return
        for dep in _NAME.findall(TABLES[name]):
            visit(dep)
        ordered.append(name)

    for n in names:
        visit(n)
    return ordered


def _in_one_pass(spark: SparkSession, name: str, frames: dict[str, DataFrame]) -> DataFrame | None:
    """A union of selects from one table: the table's rows are read once and each becomes one row per select whose condition it
    meets, instead of the whole table being worked out again for every select. A first column that all selects share stays a
    plain column, so rows that lie together by it go on lying together. Columns are chosen one by one: unused ones are not made."""
    branches = [_BRANCH.fullmatch(b.strip()) for b in TABLES[name].split("union all")]
    if len(branches) < 2 or not all(branches) or len({b[3] for b in branches}) > 1:
        return None
    source = frames[branches[0][3]]
    schema = spark.sql(TABLES[name], **{branches[0][3]: source}).schema
    lists = [", ".join(source.columns) if b[1] == "*" else b[1] for b in branches]
    cells = [f"struct({first}, {b[2]})" for first, b in zip(lists, branches)]
    names = [source.select(F.expr(c).alias("s")).schema["s"].dataType.names for c in cells]

    def column(i: int) -> Column:
        parts = [F.expr(c).getField(n[i]).cast(schema[i].dataType) for c, n in zip(cells, names)]
        if i == 0 and len({t.split(",")[0].split(" as ")[0] for t in lists}) == 1:
            return parts[0].alias(schema.names[i])
        chosen = F.when(F.col("_select") == 0, parts[0])
        for k, part in enumerate(parts[1:-1], 1):
            chosen = chosen.when(F.col("_select") == k, part)
        return chosen.otherwise(parts[-1]).alias(schema.names[i])

    wanted = [F.lit(k) if b[4] is None else F.when(F.expr(b[4]), k) for k, b in enumerate(branches)]
    rows = source.withColumn("_select", F.explode(F.array_compact(F.array(*wanted))))
    return rows.select(*[column(i) for i in range(len(schema))]).hint("merge")


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame] | DataFrame:
    """Given or domain tables as DataFrames, in the order asked for."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", _METHOD_BYTES)
    frames: dict[str, DataFrame] = {}
    wanted = list(names)
    needed = _closure(wanted)
    given = {d for n in needed for d in _NAME.findall(TABLES[n]) if d in GIVEN} | {n for n in wanted if n in GIVEN}
    for g in given:
        frames[g] = spark.read.parquet(f"{sf_dir}/{g}.parquet")
    for n in needed:
        deps = {d: frames[d] for d in _NAME.findall(TABLES[n])}
        if _SEQUENCE.search(TABLES[n]):  # few bytes that become many rows: a file's rows are dealt before, not left in one task
            deps = {d: df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), df.columns[0]) for d, df in deps.items()}
        one_pass = _in_one_pass(spark, n, deps)
        if one_pass is not None:
            frames[n] = one_pass
            continue
        frames[n] = spark.sql(_SEQUENCE.sub(r"explode(sequence(\1, \2))", TABLES[n]), **deps)
        if _SEQUENCE.search(TABLES[n]):  # estimated as large as before explode: not to be broadcast
            frames[n] = frames[n].hint("merge")
    picked = [frames[n] for n in wanted]
    return picked[0] if len(picked) == 1 else picked


def sql(body: str, *names: str) -> str:
    """``body`` with the domain tables it names as common table expressions (DuckDB side)."""
    def duck(name: str) -> str:
        return _SEQUENCE.sub(r"unnest(range(\1, \2 + 1))", _NAME.sub(lambda m: m.group(1), TABLES[name]))

    ctes = [f"{n} as ({duck(n)})" for n in _closure(list(names))]
    body = body.strip()
    if body.lower().startswith("with "):
        extra = body[5:]
        return "with " + ", ".join([*ctes, extra]) if ctes else body
    return ("with " + ", ".join(ctes) + " " if ctes else "") + body
