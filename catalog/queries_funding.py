"""Funding computations of both programmes and the composed reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import duck
from catalog.domain import load, sql
from catalog.queries_checks import AMOUNT_CHECK, EVIDENCE, POSITION_CHECK, RECIPIENT, evidence_rows
from catalog.queries_documents import supplied_labels
from catalog.queries_matching import FOLDED, MATCHED, recursive
from catalog.registry import query
from costproof.operators import building_grant as building, classify, industry_grant as industry, matching, payments
from costproof.plans import building_report, industry_report, offer_report

RULES = """rules as (select i.*, antragstellung, aavm_genehmigung, coalesce(aavm_genehmigung, bescheid_datiert) as rechnung_untergrenze, order_date >= antragstellung as auftrag_ok,
  invoice_date >= coalesce(aavm_genehmigung, bescheid_datiert) as rechnung_ok, coalesce(order_date >= antragstellung, true) and coalesce(invoice_date >= coalesce(aavm_genehmigung, bescheid_datiert), true) as fundable
  from invoices i left join projects p on p.project_id = i.project_id)"""


@query("date_rules", sql(f"with {RULES} select invoice_id, auftrag_ok, rechnung_ok, fundable, rechnung_untergrenze from rules", "invoices", "projects"))
def date_rules(spark, d):
    return industry.date_rules(*load(spark, d, "invoices", "projects")).select("invoice_id", "auftrag_ok", "rechnung_ok", "fundable", "rechnung_untergrenze")


@query("window_check", sql("""
select invoice_id, case when bewilligungszeitraum_start is not null and bewilligungszeitraum_end is not null then invoice_date between bewilligungszeitraum_start and bewilligungszeitraum_end end as window_ok
from invoices i join projects p on p.project_id = i.project_id""", "invoices", "projects"))
def window_check(spark, d):
    return industry.window_check(*load(spark, d, "invoices", "projects")).select("invoice_id", "window_ok")


@query("after_skonto", sql("""
select invoice_id, cast(round_even(netto * (1 - cast(coalesce(skonto_pct, 0) * 0.01 as decimal(5,4))), 2) as decimal(18,2)) as netto_after_skonto from invoices""", "invoices"))
def after_skonto(spark, d):
    rate = (F.coalesce("skonto_pct", F.lit(0)) / 100).cast("decimal(5,4)")
    return load(spark, d, "invoices").select("invoice_id", industry.after_skonto(F.col("netto"), rate).alias("netto_after_skonto"))


ROWS = f"""{MATCHED}, {RULES},
vne_rows as (select a.*, r.fundable, netto = 0 as unusable, netto as netto_after_skonto, b.anteil_ik, b.anteil_nk from allocated a join (select invoice_id as rid, fundable from rules) r on rid = a.invoice_id
  left join vendor_blocks b on b.project_id = a.project_id and b.block_seq = a.block_seq),
splits as (select project_id, invoice_id, 'EK' as category, 1.0 as anteil, netto as amount from vne_rows where not unusable and fundable and own_company
  union all select project_id, invoice_id, 'IK', anteil_ik, cast(round_even(netto * cast(anteil_ik as decimal(6,4)), 2) as decimal(18,2)) from vne_rows where not unusable and fundable and not own_company and anteil_ik > 0
  union all select project_id, invoice_id, 'NK', anteil_nk, cast(round_even(netto * cast(anteil_nk as decimal(6,4)), 2) as decimal(18,2)) from vne_rows where not unusable and fundable and not own_company and anteil_nk > 0)"""
RT = ("invoices", "vendor_blocks", "projects")


def vne_rows(spark, d):
    """Allocated invoices without the duplicate rule, which has a query of its own."""
    invoices, blocks, projects = load(spark, d, *RT)
    rows = matching.statement_fallback(matching.match_vendor(invoices, blocks), blocks)
    rows = industry.date_rules(rows, projects).withColumns({"unusable": F.col("netto") == 0, "netto_after_skonto": industry.after_skonto(F.col("netto"), F.lit(0))})
    shares = blocks.select("project_id", "block_seq", "anteil_ik", "anteil_nk")
    return rows.join(shares, ["project_id", "block_seq"], "left"), blocks, projects


@query("split_invoices", sql(f"with {ROWS} select project_id, invoice_id, category, cast(anteil as decimal(20,8)) as anteil, amount from splits", *RT))
def split_invoices(spark, d):
    return industry.split_invoices(vne_rows(spark, d)[0]).withColumn("anteil", F.col("anteil").cast("decimal(20,8)"))


@query("vendor_summary", sql(f"""
with {ROWS} select s.project_id, s.block_seq, vendor, gesamt, sonderpreis, inv as invoiced_netto, inv - coalesce(sonderpreis, gesamt) as variance
from (select project_id, block_seq, sum(netto) as inv from vne_rows where not unusable and block_seq is not null group by 1, 2) s join vendor_blocks b on b.project_id = s.project_id and b.block_seq = s.block_seq""", *RT))
def vendor_summary(spark, d):
    rows, blocks, _ = vne_rows(spark, d)
    return industry.vendor_summary(rows, blocks)


CHAIN = """usable as (select * from vne_rows where not unusable and block_seq is not null),
advances as (select project_id, block_seq, sum(case when invoice_type in ('anzahlung','teilrechnung','gutschrift') then netto end) as s from usable group by 1, 2),
chain as (select u.project_id, u.invoice_id, coalesce(s, 0) as advances, deducted_advances_netto, abs(coalesce(s, 0) - deducted_advances_netto) <= 0.02 as chain_ok,
  case when abs(coalesce(s, 0) - deducted_advances_netto) > 0.02 then 'Anzahlungskette: Σ Anzahlungen/Abschläge ' || coalesce(cast(s as varchar), '0') || ' ≠ lt. Schlussrechnung abgezogene ' || cast(deducted_advances_netto as varchar) end as chain_flag
  from usable u join advances a on a.project_id = u.project_id and a.block_seq = u.block_seq where invoice_type = 'schlussrechnung' and deducted_advances_netto is not null)"""


@query("advance_chain_check", sql(f"with {ROWS}, {CHAIN} select * from chain", *RT))
def advance_chain_check(spark, d):
    return industry.advance_chain_check(vne_rows(spark, d)[0])


TOTALS = """requested as (select coalesce(v.project_id, o.project_id) as project_id, v.ik as beantragt_ik, v.nk as beantragt_nk, o.ek as beantragt_ek
  from (select project_id, coalesce(sum(beantragt_ik), 0) as ik, coalesce(sum(beantragt_nk), 0) as nk from vendor_blocks where not regexp_matches(vendor, '(?i)plan\\s*wegweiser') group by 1) v
  full join (select project_id, sum(netto) as ek from vne_rows where own_company and not unusable group by 1) o on o.project_id = v.project_id),
sums as (select project_id, coalesce(sum(case when category = 'IK' then amount end), 0) as ik, coalesce(sum(case when category = 'NK' then amount end), 0) as nk, coalesce(sum(case when category = 'EK' then amount end), 0) as ek from splits group by 1),
totals as (select p.project_id, coalesce(ik, 0) as sum_ik, coalesce(nk, 0) as sum_nk, coalesce(ek, 0) as sum_ek, coalesce(ik, 0) + coalesce(nk, 0) + coalesce(ek, 0) as sum_total, beantragt_ik, beantragt_nk, beantragt_ek
  from projects p left join sums s on s.project_id = p.project_id left join requested r on r.project_id = p.project_id)"""


@query("requested_totals", sql(f"with {ROWS}, {TOTALS} select * from requested", *RT))
def requested_totals(spark, d):
    rows, blocks, _ = vne_rows(spark, d)
    return industry.requested_totals(blocks, rows)


def _totals(spark, d):
    rows, blocks, projects = vne_rows(spark, d)
    return industry.eligible_totals(industry.split_invoices(rows), industry.requested_totals(blocks, rows), projects), projects


@query("eligible_totals", sql(f"""
with {ROWS}, {TOTALS} select *, case when beantragt_ik is not null then least(beantragt_ik, sum_ik) end as ansetzbar_ik, case when beantragt_nk is not null then least(beantragt_nk, sum_nk) end as ansetzbar_nk,
  case when beantragt_ek is not null then least(beantragt_ek, sum_ek) end as ansetzbar_ek, least(beantragt_ik, sum_ik) as ansetzbar_sheet_ik, least(beantragt_nk, sum_nk) as ansetzbar_sheet_nk, least(beantragt_ek, sum_ek) as ansetzbar_sheet_ek from totals""", *RT))
def eligible_totals(spark, d):
    return _totals(spark, d)[0]


_EXTRA = "case when foerderbetrag is not null or kostendeckel_foerderanteil is not null or agvo_referenzkosten is not null then sum_total - coalesce(agvo_referenzkosten, 0) end"
_MAX = f"cast(round_even(({_EXTRA}) * kostendeckel_foerderanteil, 2) as decimal(28,2))"


@query("funding_chain", sql(f"""
with {ROWS}, {TOTALS} select t.project_id, sum_total, {_EXTRA} as mehrkosten, {_MAX} as max_foerderbetrag, case when foerderbetrag is not null and {_MAX} is not null then least({_MAX}, foerderbetrag) end as foerderbetrag_tatsaechlich
from totals t join projects p on p.project_id = t.project_id""", *RT))
def funding_chain(spark, d):
    return industry.funding_chain(*_totals(spark, d)).select("project_id", "sum_total", "mehrkosten", "max_foerderbetrag", "foerderbetrag_tatsaechlich")


@query("filing_deadlines", sql("""
select project_id, cast(m + cast(case dayofweek(m) when 4 then 4 when 5 then 4 when 6 then 3 else 2 end as int) as date) as frist_aenderungsanzeige, cast(bewilligungszeitraum_end + interval 3 month as date) as frist_verwendungsnachweis
from (select *, cast(bescheid_eingegangen + interval 1 month as date) as m from projects)""", "projects"))
def filing_deadlines(spark, d):
    return industry.filing_deadlines(load(spark, d, "projects")).select("project_id", "frist_aenderungsanzeige", "frist_verwendungsnachweis")


@query("net_recheck", sql("""
select invoice_id, n as netto_aus_brutto, abs(n - netto) > 0.02 as netto_weicht_ab from (select *, cast(case when brutto is null then netto else round(cast(brutto as double) / (1 + coalesce(mwst_pct, 19) / 100), 2) end as decimal(18,2)) as n from invoices)""", "invoices"))
def net_recheck(spark, d):
    return industry.net_recheck(load(spark, d, "invoices")).select("invoice_id", "netto_aus_brutto", "netto_weicht_ab")


LAST = "last_letter as (select * from approval_letters qualify row_number() over (partition by project_id order by bescheid_datum desc, letter_id desc) = 1)"


@query("merge_config", sql(f"""
with {LAST}
select coalesce(p.project_id, l.project_id) as project_id, coalesce(client_name, empfaenger_name) as client_name, case when client_name is null then empfaenger_adresse else client_address end as client_address,
  coalesce(p.bewilligungszeitraum_start, l.bewilligungszeitraum_start) as bewilligungszeitraum_start, coalesce(p.bewilligungszeitraum_end, l.bewilligungszeitraum_end) as bewilligungszeitraum_end,
  coalesce(p.foerderbetrag, l.foerderbetrag) as foerderbetrag, coalesce(kostendeckel_foerderanteil, cast(foerderanteil_pct * 0.01 as decimal(5,4))) as kostendeckel_foerderanteil,
  coalesce(bescheid_datiert, bescheid_datum) as bescheid_datiert, coalesce(antragstellung, antrag_datum) as antragstellung, coalesce(p.kennung, l.kennung) as kennung,
  concat_ws('; ', case when client_name is null and empfaenger_name is not null then 'Kunde: ' || empfaenger_name end,
   case when p.bewilligungszeitraum_start is null then 'Zeitraum von ' || {duck.de_date('l.bewilligungszeitraum_start')} end, case when p.bewilligungszeitraum_end is null then 'Zeitraum bis ' || {duck.de_date('l.bewilligungszeitraum_end')} end,
   case when p.foerderbetrag is null then 'Förderbetrag ' || {duck.format_de('l.foerderbetrag')} || ' €' end, case when kostendeckel_foerderanteil is null then 'Förderanteil ' || {duck.format_de('foerderanteil_pct')} || ' %' end,
   case when bescheid_datiert is null then 'Bescheid datiert ' || {duck.de_date('bescheid_datum')} || case when letter_id % 5 = 0 then ' — UNBELEGT (ohne Zitat), bitte im Bescheid prüfen' else '' end end,
   case when antragstellung is null then 'Antragstellung ' || {duck.de_date('antrag_datum')} end, case when p.kennung is null then 'Kennung ' || l.kennung end) as adopted
from projects p full join last_letter l on l.project_id = p.project_id""", "projects", "approval_letters"))
def merge_config(spark, d):
    projects, letters = load(spark, d, "projects", "approval_letters")
    proof = letters.select("letter_id", F.when(F.col("letter_id") % 5 == 0, "unquoted").otherwise("verified").alias("bescheid_datum_status"), F.lit("verified").alias("antrag_datum_status"))
    df = industry.merge_config(projects, letters, proof)
    return df.select("project_id", "client_name", "client_address", "bewilligungszeitraum_start", "bewilligungszeitraum_end", "foerderbetrag", "kostendeckel_foerderanteil",
                     "bescheid_datiert", "antragstellung", "kennung", F.array_join("adopted", "; ").alias("adopted"))


@query("form_prefill", sql(rf"""
with {LAST}
select project_id, empfaenger_name as kunde_name, case when empfaenger_name is not null then empfaenger_adresse end as kunde_adresse, {duck.de_date('antrag_datum')} as antragstellung, {duck.de_date('bescheid_datum')} as bescheid_datiert,
  {duck.de_date('bewilligungszeitraum_start')} as zeitraum_von, {duck.de_date('bewilligungszeitraum_end')} as zeitraum_bis, {duck.format_de('foerderbetrag')} as foerderbetrag, cast(cast(foerderanteil_pct as int) as varchar) as foerderanteil, kennung from last_letter""", "approval_letters"))
def form_prefill(spark, d):
    return industry.form_prefill(load(spark, d, "approval_letters"))


@query("missing_config_flags", sql("""
select project_id, concat_ws(' | ', case when client_name is null then 'Kunde nicht angegeben — Adressprüfung entfällt' end, case when bewilligungszeitraum_start is null or bewilligungszeitraum_end is null then 'Bewilligungszeitraum unvollständig — Zeitraum-Prüfung entfällt' end,
  case when foerderbetrag is null and kostendeckel_foerderanteil is null and agvo_referenzkosten is null then 'Bescheid-Werte nicht angegeben — Förderbetrag-Block bleibt leer' end,
  case when antragstellung is null then 'Antragstellung nicht angegeben — Prüfung ''Auftrag erteilt ≥ Antragstellung'' entfällt' end, case when bescheid_datiert is null then 'Zuwendungsbescheid-Datum nicht angegeben — Prüfung ''Rechnungsdatum ≥ Bescheid'' entfällt' end) as flags from projects""", "projects"))
def missing_config_flags(spark, d):
    return industry.missing_config_flags(load(spark, d, "projects")).select("project_id", F.array_join("config_flags", " | ").alias("flags"))


_LEGAL = r"\b(gmbh|mbh|ag|kg|ug|ohg|co|cokg|se|e\.?k\.?|inc|ltd|haftungsbeschränkt)\b\.?"


def _clean_sql(x: str) -> str:
    inner = rf"""regexp_replace(regexp_replace(regexp_replace({x}, '[\\/:*?"<>|]', '-', 'g'), '\s+', ' ', 'g'), '^[ .\-_]+|[ .\-_]+$', '', 'g')"""
    return rf"coalesce(nullif(regexp_replace(left({inner}, 60), '[ .\-_]+$', ''), ''), 'UNKLAR')"


_VENDOR_SQL = _clean_sql(rf"regexp_replace(regexp_replace(regexp_replace(vendor_name, '(?i){_LEGAL}', ' ', 'g'), '\s*&[\s.]*$', ' '), '\s*&\s*\.', ' ', 'g')")


@query("plan_renames", sql(f"""
with parts as (select project_id, invoice_id, scan_seq, source_name, invoice_id % 21 = 0 as vf, invoice_id % 9 = 0 as dv, invoice_id % 15 = 0 as dn, netto = 0 as dead,
   case when netto = 0 then 'UNKLAR_UNKLAR_UNKLAR' else case when invoice_id % 9 = 0 then 'UNKLAR' else {_VENDOR_SQL} end || '_' || case when invoice_id % 15 = 0 then 'UNKLAR' else {_clean_sql(r"regexp_replace(invoice_number, '\s+', '', 'g')")} end || '_' || case when invoice_date between date '1995-06-01' and date '2001-12-31' then cast(invoice_date as varchar) else 'UNKLAR' end end as stem from invoice_scans),
named as (select *, row_number() over (partition by project_id, lower(stem || '.pdf') order by scan_seq) as n from parts)
select project_id, invoice_id, source_name as old_name, stem || case when n > 1 then '_' || cast(n as varchar) else '' end || '.pdf' as new_name,
  concat_ws('; ', case when contains(stem, 'UNKLAR') then 'Feld nicht belegt → UNKLAR, Dateiname von Hand prüfen' || case when dv or dn then ' (' || concat_ws(', ', case when dv then 'vendor_name' end, case when dn then 'invoice_number' end) || ')' else '' end end,
   case when vf then 'Rechnungssteller aus dem alten Dateinamen (Briefkopf nicht lesbar)' end, case when n > 1 then 'gleicher Name wie eine andere Datei — Duplikat?' end) as note from named""", "invoice_scans"))
def plan_renames(spark, d):
    scans = load(spark, d, "invoice_scans")
    key = F.col("invoice_id")
    rows = scans.drop("seq").withColumnRenamed("scan_seq", "seq").withColumns({
        "unusable": F.col("netto") == 0, "vendor_from_filename": key % 21 == 0,
        "vendor_name_status": F.when(key % 9 == 0, "unquoted"), "invoice_number_status": F.when(key % 15 == 0, "quote-not-found"), "invoice_date_status": F.lit("verified")})
    return industry.plan_renames(rows, "2000-06-15")


@query("industry_report", recursive(sql(f"""
with {ROWS}, {CHAIN}, {POSITION_CHECK}, {AMOUNT_CHECK}, {RECIPIENT}, {EVIDENCE},
st as (select doc_id, max(case when field = 'invoice_date' then status end) as ds, max(case when field = 'order_date' then status end) as os, max(case when field = 'invoice_number' then status end) as ns from evidence group by 1),
flagged as (select v.project_id, v.invoice_id, v.netto, v.match_kind, v.block_seq, concat_ws(' | ',
  case when v.netto = 0 then 'Extraktion unbrauchbar (Netto = 0 €) — Rechnung manuell erfassen' end, case when not amount_passed then 'Betragsprüfung: ' || amount_message end, case when not pc.passed then 'Positions-Kreuzsumme: ' || pc.message end,
  case when match_kind = 'statement' then 'kein Angebot — Aufteilung lt. Schätzung — prüfen' when match_kind = 'none' then 'kein Angebot in der Kostenaufstellung — manuell kategorisieren' end,
  case when p.bewilligungszeitraum_start is not null and p.bewilligungszeitraum_end is not null and not (v.invoice_date between p.bewilligungszeitraum_start and p.bewilligungszeitraum_end) then 'Rechnungsdatum außerhalb des Bewilligungszeitraums' end,
  case when not ru.auftrag_ok then 'NICHT FÖRDERFÄHIG: Auftrag erteilt am ' || {duck.de_date('v.order_date')} || ' liegt VOR der Antragstellung (' || {duck.de_date('p.antragstellung')} || ')' end,
  case when not ru.rechnung_ok then 'NICHT FÖRDERFÄHIG: Rechnungsdatum ' || {duck.de_date('v.invoice_date')} || ' liegt VOR ' || case when p.aavm_genehmigung is not null then 'AavM-Genehmigung' else 'Zuwendungsbescheid' end || ' (' || {duck.de_date('ru.rechnung_untergrenze')} || ')' end,
  case ds when 'value-not-in-quote' then 'Rechnungsdatum unbelegt (Wert nicht im Zitat) — im Beleg prüfen' when 'quote-not-found' then 'Rechnungsdatum unbelegt (Zitat nicht im Text) — im Beleg prüfen' end,
  case os when 'value-not-in-quote' then 'Auftragsdatum unbelegt (Wert nicht im Zitat) — im Beleg prüfen' when 'quote-not-found' then 'Auftragsdatum unbelegt (Zitat nicht im Text) — im Beleg prüfen' end,
  case ns when 'value-not-in-quote' then 'Rechnungsnummer unbelegt (Wert nicht im Zitat) — im Beleg prüfen' when 'quote-not-found' then 'Rechnungsnummer unbelegt (Zitat nicht im Text) — im Beleg prüfen' end,
  case when rc.has_client and not rc.recipient_ok then 'Rechnungsempfänger ' || coalesce('''' || v.recipient_name || '''', 'None') || ' ≠ Antragsteller' end, case when rc.has_client and rc.recipient_ok is null then 'kein Rechnungsempfänger erkennbar — Adresse manuell prüfen' end, ch.chain_flag) as flags
 from vne_rows v join projects p on p.project_id = v.project_id join rules ru on ru.invoice_id = v.invoice_id join position_check pc on pc.invoice_id = v.invoice_id join amount_check ac on ac.invoice_id = v.invoice_id
 join recipient rc on rc.invoice_id = v.invoice_id left join st on st.doc_id = v.invoice_id left join chain ch on ch.invoice_id = v.invoice_id)
select f.project_id, f.invoice_id, netto, match_kind, block_seq, coalesce(ik, 0) as ik_amount, coalesce(nk, 0) as nk_amount, coalesce(ek, 0) as ek_amount, flags
from flagged f left join (select invoice_id, sum(case when category = 'IK' then amount end) as ik, sum(case when category = 'NK' then amount end) as nk, sum(case when category = 'EK' then amount end) as ek from splits group by 1) s on s.invoice_id = f.invoice_id""",
    "invoices", "invoice_positions", "vendor_blocks", "projects", "evidence_fields", "invoice_pages")))
def industry_report_query(spark, d):
    invoices, lines, blocks, projects = load(spark, d, "invoices", "invoice_positions", "vendor_blocks", "projects")
    report = industry_report.industry_report(invoices, lines, blocks, projects, evidence_rows(spark, d)[0])
    return report.rows.select("project_id", "invoice_id", "netto", "match_kind", "block_seq", "ik_amount", "nk_amount", "ek_amount", F.array_join("flags", " | ").alias("flags"))


# --- programme B ------------------------------------------------------------------------------


@query("payment_candidates", sql(f"""
with v as (select distinct project_id, {duck.vset('vendor_name')} as vt from invoices), p as (select distinct project_id, {duck.vset('payee_name')} as pt from payment_proofs)
select v.project_id, 'payee' as via, array_to_string(vt, ' ') as vendor, array_to_string(pt, ' ') as payee, cast(null as varchar) as number, cast(null as bigint) as proof_seq from v join p on p.project_id = v.project_id
  where length(list_filter(pt, lambda t: length(list_filter(vt, lambda u: t = u or (length(t) >= 5 and length(u) >= 5 and levenshtein(t, u) <= 1))) > 0)) > 0
union all select i.project_id, 'number', null, null, number, proof_seq from (select distinct project_id, {duck.alnum('invoice_number')} as number from invoices) i join payment_proofs q on q.project_id = i.project_id
  where length(number) >= 4 and contains({duck.alnum('verwendungszweck')}, number)""", "invoices", "payment_proofs"))
def payment_candidates(spark, d):
    return payments.payment_candidates(*load(spark, d, "invoices", "payment_proofs"))


@query("payment_rule", sql("""
select i.invoice_id, proof_seq, case when abs(amount - t) <= 0.02 then 1 when abs(amount - t * (100 - skonto_pct) * 0.01) <= 0.05 then 2 end as tier
from (select *, coalesce(brutto, netto) as t from invoices) i join payment_proofs p on p.project_id = i.project_id""", "invoices", "payment_proofs"))
def payment_rule(spark, d):
    invoices, proofs = load(spark, d, "invoices", "payment_proofs")
    target = F.coalesce("brutto", "netto")
    own = invoices.join(proofs.select("project_id", "proof_seq", "amount"), "project_id")  # the rule for every proof of the project
    rule = payments.payment_rule(F.col("amount"), target, target * (F.lit(100) - F.col("skonto_pct")) / 100)
    return own.select("invoice_id", "proof_seq", rule.alias("tier"))


_HIT = "length(list_filter(p.ts, lambda t: length(list_filter(m.s.ts, lambda u: t = u or (length(t) >= 5 and length(u) >= 5 and levenshtein(t, u) <= 1))) > 0)) > 0"
_NUMBERED = "coalesce(length(m.s.num) >= 4 and contains(p.zweck, m.s.num), false)"
PAYMENTS = f"""plist as (select project_id, list({{'seq': proof_seq, 'ts': {duck.vset('payee_name')}, 'amount': amount, 'd': payment_date, 'zweck': {duck.alnum('verwendungszweck')}}} order by proof_seq) as ps from payment_proofs group by 1),
members as (select project_id, row_number() over (partition by project_id order by invoice_date, invoice_number, seq) as k,
   {{'id': invoice_id, 'ts': {duck.vset('vendor_name')}, 'num': {duck.alnum('invoice_number')}, 'target': coalesce(brutto, netto), 'pct': skonto_pct, 'cum': cumulative_netto,
     'cumt': case when mwst_pct is not null then cast(round_even(cumulative_netto * (100 + mwst_pct) * 0.01, 2) as decimal(18,2)) else cumulative_netto end}} as s from invoices),
pay as (select project_id, cast(0 as bigint) as k, cast([] as bigint[]) as used, cast(null as bigint) as invoice_id, cast(null as varchar) as kind, cast([] as bigint[]) as takes from (select distinct project_id from members)
  union all select project_id, k, used || takes, invoice_id, kind, takes from (select project_id, k, used, id as invoice_id, kind,
     case kind when 'exact' then [exact.seq] when 'less' then [less.seq] when 'sum' then list_transform(cands, lambda p: p.seq) when 'tied' then [tied.seq] else cast([] as bigint[]) end as takes
   from (select *, case when exact is not null then 'exact' when less is not null then 'less' when cum is not null and length(cands) >= 2 then 'sum' when tied is not null then 'tied' else 'none' end as kind
   from (select project_id, k, used, m.s.id as id, m.s.cum as cum, cands, list_filter(cands, lambda p: coalesce(abs(p.amount - m.s.target) <= 0.02, false))[1] as exact,
        list_filter(cands, lambda p: coalesce(abs(p.amount - m.s.target * (100 - m.s.pct) * 0.01) <= 0.05, false))[1] as less, list_filter(cands, lambda p: {_NUMBERED})[1] as tied
     from (select y.project_id, m.k, y.used, m.s, list_filter(coalesce(l.ps, []), lambda p: not list_contains(y.used, p.seq) and ({_HIT} or {_NUMBERED})) as cands
       from pay y join members m on m.project_id = y.project_id and m.k = y.k + 1 left join plist l on l.project_id = y.project_id) m)))),
paid as (select y.project_id, y.invoice_id, y.kind, y.takes, sum(amount) as total, max(payment_date) as paid_date from pay y left join payment_proofs p on p.project_id = y.project_id and list_contains(y.takes, p.proof_seq) where y.k > 0 group by 1, 2, 3, 4),
results as (select p.project_id, p.invoice_id, s.cumt, s.pct, kind, length(takes) as n, array_to_string(list_sort(takes), ',') as used, case when kind = 'sum' then coalesce(total, 0) else total end as total, paid_date,
   kind = 'sum' and (abs(coalesce(total, 0) - s.target) <= 0.05 or abs(coalesce(total, 0) - s.cumt) <= 0.05) as fits from paid p join members m on m.project_id = p.project_id and m.s.id = p.invoice_id)"""
_WHEN = f"case when paid_date is not null then 'am ' || {duck.de_date('paid_date')} || ' bezahlt' else 'bezahlt (Datum fehlt auf dem Nachweis)' end"


@query("reconcile_payments", recursive(sql(f"""
with {PAYMENTS}
select project_id, invoice_id, case kind when 'exact' then 'paid' when 'less' then 'paid_skonto' when 'sum' then case when fits then 'paid' else 'amount_mismatch' end when 'tied' then 'amount_mismatch' else 'no_proof' end as status,
  total as bezahlt, paid_date, case when kind = 'less' then pct end as skonto_pct_taken, n as n_proofs, used,
  case kind when 'exact' then {_WHEN} when 'less' then {_WHEN} || ', ' || {duck.format_de('pct')} || ' % Skonto'
    when 'sum' then 'Σ aus ' || cast(n as varchar) || ' Zahlungen' || case when fits then '' else ' = ' || {duck.format_de('total')} || ' — weicht von Gesamt-Brutto ' || {duck.format_de('cumt')} || ' ab, prüfen' end
    when 'tied' then 'Zahlungsnachweis zur Re-Nr. gefunden, Betrag ' || coalesce({duck.format_de('total')}, '—') || ' weder Brutto noch Skonto-Betrag — prüfen' else 'kein Zahlungsnachweis' end as note from results""", "invoices", "payment_proofs")))
def reconcile_payments(spark, d):
    rows, uses = payments.reconcile_payments(*load(spark, d, "invoices", "payment_proofs"))
    used = uses.groupBy("project_id", "invoice_id").agg(F.array_join(F.array_sort(F.collect_list("proof_seq")), ",").alias("used"))
    return rows.join(used, ["project_id", "invoice_id"], "left").withColumn("used", F.coalesce("used", F.lit("")))


GROSS = f"""gross as (select f.*, client_basis, n_folded > 0 or (invoice_type = 'schlussrechnung' and cumulative_netto is not null) as cum from fold_result f join funding_meta m on m.project_id = f.project_id),
gross_rows as (select *, case when not cum then coalesce(brutto, netto) when mwst_pct is not null then cast(round_even(cumulative_netto * (100 + mwst_pct) * 0.01, 2) as decimal(18,2)) end as re_betrag,
  concat_ws(' | ', case when client_basis = 'unternehmen' then 'förderfähig auf Netto-Basis (Unternehmen)' end, case when not cum and brutto is null then 'Netto ausgewiesen' end,
    case when cum and mwst_pct is not null then 'Gesamt-Brutto abgeleitet: ' || {duck.format_de('cumulative_netto')} || ' netto × ' || {duck.format_de('mwst_pct')} || ' % MwSt' end) as gross_notes,
  concat_ws(' | ', case when client_basis = 'unclear' then 'Kundenbasis (privat/Unternehmen) unklar — prüfen' end, case when not cum and brutto is null then 'Brutto fehlt auf der Rechnung' end,
    case when cum and mwst_pct is null then 'Gesamt-Brutto nicht ermittelbar (MwSt-Satz fehlt)' end) as gross_flags from gross)"""


def _gross(spark, d):
    invoices, meta = load(spark, d, "invoices", "funding_meta")
    folded = matching.fold_advances(invoices).join(meta.select("project_id", "client_basis"), "project_id")
    return building.invoice_gross(folded), meta


@query("invoice_gross", sql(f"with {FOLDED}, {GROSS} select invoice_id, re_betrag, gross_notes, gross_flags from gross_rows", "invoices", "funding_meta"))
def invoice_gross(spark, d):
    df, _ = _gross(spark, d)
    return df.select("invoice_id", "re_betrag", F.array_join("gross_notes", " | ").alias("gross_notes"), F.array_join("gross_flags", " | ").alias("gross_flags"))


LABELLED = r"""labelled as (select g.*, case when own then 'Energieberater' when pl and regexp_matches(t, '(?i)architekt|bauleit') then 'Architekt / Bauleiter' when pl then 'Fachplanung' when invoice_id % 3 <> 0 then 'Gewerk ' || cast(vid % 12 as varchar) end as trade,
  case when own or pl then 'baubegleitung' else 'massnahme' end as section from (select *, regexp_matches(vendor_name, '(?i)plan\s*wegweiser') as own, regexp_matches(t, '(?i)energieberat|architekt|statik|sigeko|bauleit|fachplan|ingenieurbüro') as pl
  from (select *, vendor_name || ' ' || coalesce(subject, '') as t from gross_rows)) g where not folded)"""


def _labelled(spark, d):
    """Kept rows with gross amount and section; half of each amount stands in for the eligible
    figure a reviewer fills in."""
    df, meta = _gross(spark, d)
    rows = classify.label_trade_section(df.where(~F.col("folded")), supplied_labels(df))
    rows = rows.withColumns({"bezahlt": F.col("re_betrag"), "foerderfaehig": F.bround(F.col("re_betrag") * F.lit("0.5").cast("decimal(3,2)"), 2).cast("decimal(18,2)")})
    return rows, meta


@query("order_by_trade", sql(f"""
with {FOLDED}, {GROSS}, {LABELLED}, firsts as (select project_id, section, trade, min({{'d': invoice_date, 'n': invoice_number, 's': seq}}) as f from labelled group by 1, 2, 3),
ranked as (select *, row_number() over (partition by project_id, section order by f) as trade_rank from firsts)
select l.invoice_id, l.section, l.trade, trade_rank from labelled l join ranked r on r.project_id = l.project_id and r.section = l.section and r.trade is not distinct from l.trade""", "invoices", "funding_meta"))
def order_by_trade(spark, d):
    return building.order_by_trade(_labelled(spark, d)[0]).select("invoice_id", "section", "trade", "trade_rank")


@query("section_totals", sql(f"""
with {FOLDED}, {GROSS}, {LABELLED} select project_id, section, sum(re_betrag) as sum_re_betrag, sum(re_betrag) as sum_bezahlt, sum(cast(round_even(re_betrag * 0.5, 2) as decimal(18,2))) as sum_foerderfaehig, case when grouping(section) = 0 then 'section' else 'project' end as level
from labelled group by grouping sets ((project_id, section), (project_id))""", "invoices", "funding_meta"))
def section_totals(spark, d):
    return building.section_totals(_labelled(spark, d)[0])


_SHORT = "regexp_replace({}, ',00$', '')"
_M = "case when foerdersatz_pct is not null and m is not null then cast(round(least(m, foerderfaehige_kosten_cap) * foerdersatz_pct * 0.01, 2) as decimal(28,2)) end"
_B = "case when baubegleitung_foerdersatz_pct is not null and b is not null then cast(round(least(b * baubegleitung_foerdersatz_pct * 0.01, baubegleitung_kosten_cap), 2) as decimal(28,2)) end"


@query("grant_amounts", sql(f"""
with {FOLDED}, {GROSS}, {LABELLED}, parts as (select project_id, max(case when section = 'massnahme' then s end) as m, max(case when section = 'baubegleitung' then s end) as b
  from (select project_id, section, coalesce(sum(cast(round_even(re_betrag * 0.5, 2) as decimal(18,2))), 0) as s from labelled group by 1, 2) group by 1)
select f.project_id, {_M} as foerderung_massnahmen, {_B} as foerderung_baubegleitung, coalesce({_M}, 0) + coalesce({_B}, 0) as foerderung_gesamt,
  case when foerdersatz_pct is null then 'Fördersatz fehlt' else 'Förderung ' || {_SHORT.format(duck.format_de('foerdersatz_pct'))} || '%' || case when foerderfaehige_kosten_cap is not null then ' auf ' || {_SHORT.format(duck.format_de('foerderfaehige_kosten_cap'))} || '€' else '' end || case when foerdersatz_zusammensetzung is not null then ' (' || foerdersatz_zusammensetzung || ')' else '' end end as text_massnahmen,
  case when baubegleitung_foerdersatz_pct is not null then 'Förderung ' || {_SHORT.format(duck.format_de('baubegleitung_foerdersatz_pct'))} || '%' || case when baubegleitung_kosten_cap is not null then ' bis ' || {_SHORT.format(duck.format_de('baubegleitung_kosten_cap'))} || '€' else '' end end as text_baubegleitung
from funding_meta f left join parts p on p.project_id = f.project_id""", "invoices", "funding_meta"))
def grant_amounts(spark, d):
    rows, meta = _labelled(spark, d)
    return building.grant_amounts(building.section_totals(rows), meta)


@query("service_period", sql("select project_id, min(invoice_date) as von, max(invoice_date) as bis from invoices group by 1", "invoices"))
def service_period(spark, d):
    return building.service_period(load(spark, d, "invoices"))


@query("building_report")
def building_report_query(spark, d):
    invoices, lines, proofs, meta, projects = load(spark, d, "invoices", "invoice_positions", "payment_proofs", "funding_meta", "projects")
    report = building_report.building_report(invoices, lines, proofs, meta, projects, supplied_labels(invoices), evidence_rows(spark, d)[0])
    return report.rows.select("project_id", "invoice_id", "section", "trade", "trade_rank", "re_betrag", "bezahlt", "row_status",
                              F.array_join("notes", " | ").alias("notes"), F.array_join("flags", " | ").alias("flags"))


@query("offer_report", sql("""
select o.offer_id, case when p.n is null then 0 else p.n end as n_positions, p.total as total from (select * from offers) o left join (select offer_id, count(*) as n, coalesce(sum(line_total_net), 0) as total
 from (select p.*, f.kind, f.d, f.r from offer_positions p join (select offer_id as oid, kind, abs(preisnachlass) as d, case when sonderpreis > 0 then nettosumme - sonderpreis end as r, case when preisnachlass is null and sonderpreis < 0 then -sonderpreis else abs(preisnachlass) end as dd from offers) f on f.oid = p.offer_id
   where not coalesce(f.kind <> 'statement' and line_total_net < 0 and not regexp_matches(trim(pos), '^[0-9]') and regexp_matches(pos || ' ' || description, '(?i)rabatt|nachlass|skonto') and (coalesce(abs(-line_total_net - dd) <= 0.02, false) or coalesce(abs(-line_total_net - r) <= 0.02, false)), false)) group by 1) p on p.offer_id = o.offer_id""", "offers", "offer_positions"))
def offer_report_query(spark, d):
    report = offer_report.offer_report(*load(spark, d, "offers", "offer_positions"))
    counts = report.table.groupBy("offer_id").agg(
        F.count_if(F.col("row_kind") == "position").alias("n_positions"), F.max(F.when(F.col("row_kind") == "total", F.col("line_total_net"))).alias("total"))
    return report.offers.select("offer_id").join(counts, "offer_id", "left").select("offer_id", F.coalesce("n_positions", F.lit(0)).alias("n_positions"), "total")
