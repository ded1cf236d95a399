"""Corrections, extraction quality, run reviews and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import duck
from catalog.domain import load, sql
from catalog.queries_checks import EVIDENCE, EVIDENCE_TABLES, evidence_rows
from catalog.queries_documents import class_sql
from catalog.queries_funding import vne_rows
from catalog.queries_matching import recursive
from catalog.registry import query
from costproof.operators import checks, classify, events as ev, quality

# --- corrections ----------------------------------------------------------------------------

SHEET = """orig as (select o.project_id as sheet_id, 'Block ' || cast(o.seq as varchar(10)) as block, p.pos_seq as seq, p.pos || '.' || cast(p.pos_seq as varchar(10)) as pos, p.description, p.line_total_net as gesamt,
  case when kategorie = 'investitionskosten' then p.line_total_net end as investitionskosten, case when kategorie = 'nebenkosten' then p.line_total_net end as nebenkosten from offer_positions p join offers o on o.offer_id = p.offer_id)"""


def _sheet(spark, d):
    positions, offers = load(spark, d, "offer_positions", "offers")
    def only(kind):
        return F.when(F.col("kategorie") == kind, F.col("line_total_net"))
    return positions.join(offers.select("offer_id", "project_id", "seq"), "offer_id").select(
        F.col("project_id").alias("sheet_id"), F.concat(F.lit("Block "), F.col("seq").cast("string")).alias("block"), F.col("pos_seq").alias("seq"),
        F.concat("pos", F.lit("."), F.col("pos_seq").cast("string")).alias("pos"), "description", F.col("line_total_net").alias("gesamt"),
        only("investitionskosten").alias("investitionskosten"), only("nebenkosten").alias("nebenkosten"))


def _corrected(sheet):
    """A reviewed copy: some lines gone, some renumbered, some amounts and names changed."""
    key = F.col("sheet_id") + F.col("seq")
    return sheet.select(
        "sheet_id", F.when((F.col("sheet_id") % 50 == 7) & (F.col("block") == "Block 1"), "Block neu").otherwise(F.col("block")).alias("block"), "seq",
        F.when(key % 9 == 4, F.concat(F.lit("N"), "pos")).otherwise(F.col("pos")).alias("pos"),
        F.when(key % 11 == 3, F.concat("description", F.lit(" neu"))).otherwise(F.col("description")).alias("description"),
        F.when(key % 13 == 5, (F.col("gesamt") + 1).cast("decimal(18,2)")).otherwise(F.col("gesamt")).alias("gesamt"), "investitionskosten", "nebenkosten")


@query("diff_cost_tables", sql(f"""
with {SHEET}, corr as (select sheet_id, case when sheet_id % 50 = 7 and block = 'Block 1' then 'Block neu' else block end as block, seq, case when (sheet_id + seq) % 9 = 4 then 'N' || pos else pos end as pos,
  case when (sheet_id + seq) % 11 = 3 then description || ' neu' else description end as description, case when (sheet_id + seq) % 13 = 5 then gesamt + 1 else gesamt end as gesamt, investitionskosten, nebenkosten from orig),
both_ as (select sheet_id, block from orig intersect select sheet_id, block from corr),
j as (select o.*, c.description as nd, c.gesamt as ng, c.pos is null as gone from orig o join both_ b on b.sheet_id = o.sheet_id and b.block = o.block left join corr c on c.sheet_id = o.sheet_id and c.block = o.block and c.pos = o.pos)
select sheet_id, block, 'position-removed' as scope, pos, null as field, description as original, null as corrected from j where gone
union all select sheet_id, block, 'position-field', pos, 'description', description, nd from j where not gone and description <> nd
union all select sheet_id, block, 'position-field', pos, 'gesamt', cast(gesamt as varchar), cast(ng as varchar) from j where not gone and gesamt is distinct from ng
union all select c.sheet_id, c.block, 'position-added', c.pos, null, null, c.description from corr c join both_ b on b.sheet_id = c.sheet_id and b.block = c.block where not exists (select 1 from orig o where o.sheet_id = c.sheet_id and o.block = c.block and o.pos = c.pos)
union all select sheet_id, block, 'block-removed', null, null, null, null from (select sheet_id, block from orig except select sheet_id, block from corr)
union all select sheet_id, block, 'block-added', null, null, null, null from (select sheet_id, block from corr except select sheet_id, block from orig)""", "offer_positions", "offers"))
def diff_cost_tables(spark, d):
    sheet = _sheet(spark, d)
    return quality.diff_cost_tables(sheet, _corrected(sheet))


# --- quality ------------------------------------------------------------------------------------


def _guesses(spark, d):
    fields = load(spark, d, "evidence_fields")
    wrong = F.col("doc_id") % 7 == 3
    guess = F.when(F.col("doc_id") % 19 == 4, F.lit(None)).when((F.col("kind") == "amount") & wrong, F.concat(F.col("value"), F.lit("9"))).when(
        (F.col("kind") == "text") & wrong, F.concat(F.col("value"), F.lit(" x"))).when(F.col("kind") == "text", F.upper(F.translate(F.col("value"), "-", " "))).otherwise(F.col("value"))
    return fields.select("doc_id", "field", guess.alias("value")), fields


_PLAIN = "trim(regexp_replace({}, '[^a-z0-9]+', ' ', 'g'))"
SCORED = f"""scored as (select doc_id, field, kind, value, got, case when kind = 'amount' then coalesce(abs(try_cast(got as decimal(18,2)) - try_cast(value as decimal(18,2))) <= 0.01, got is null and value is null)
   when kind = 'date' then got is not distinct from value else case when got is null or value is null then got is null and value is null else {_PLAIN.format(duck.fold('lower(got)'))} = {_PLAIN.format(duck.fold('lower(value)'))} end end as ok
 from (select *, case when doc_id % 19 = 4 then null when kind = 'amount' and doc_id % 7 = 3 then value || '9' when kind = 'text' and doc_id % 7 = 3 then value || ' x' when kind = 'text' then replace(value, '-', ' ') else value end as got from evidence_fields))"""


@query("score_fields", sql(f"with {SCORED} select doc_id, field, ok from scored", "evidence_fields"))
def score_fields(spark, d):
    return quality.score_fields(*_guesses(spark, d)).select("doc_id", "field", "ok")


@query("field_accuracy", sql(f"with {SCORED} select field, count(*) as total, count(*) filter (ok) as correct, round(avg(cast(ok as int)), 9) as accuracy from scored group by 1", "evidence_fields"))
def field_accuracy(spark, d):
    return quality.field_accuracy(quality.score_fields(*_guesses(spark, d))).withColumn("accuracy", F.round("accuracy", 9))


def _line_items(spark, d):
    lines = load(spark, d, "invoice_positions")
    truth = lines.select(F.col("invoice_id").alias("doc_id"), F.col("pos_seq").alias("idx"), "pos", "description", F.col("line_total_net").alias("amount"))
    key = F.col("doc_id") + F.col("idx")
    predicted = truth.select(
        "doc_id", (F.lit(100) - F.col("idx")).alias("idx"), F.when(key % 4 == 0, "").otherwise(F.col("pos")).alias("pos"), F.when(key % 5 == 1, "red widget").otherwise(F.col("description")).alias("description"),
        F.when(key % 6 == 2, (F.col("amount") + 3).cast("decimal(18,2)")).otherwise(F.col("amount")).alias("amount"))
    return predicted, truth


def _words(x: str) -> str:
    plain = _PLAIN.format(duck.fold(f"lower(coalesce({x}, ''))"))
    return f"list_distinct(list_filter(string_split({plain}, ' '), lambda w: w <> ''))"


_OVERLAP = "case when length(list_distinct({a} || {b})) = 0 then 1.0 else length(list_intersect({a}, {b})) / length(list_distinct({a} || {b})) end"
PAIRED = f"""truth as materialized (select invoice_id as doc_id, pos_seq as j, nullif(trim(pos), '') as pos, description, {_words('description')} as w, line_total_net as amount from invoice_positions),
predicted as materialized (select doc_id, 100 - j as i, case when (doc_id + j) % 4 <> 0 then pos end as pos, case when (doc_id + j) % 5 = 1 then {_words("'red widget'")} else w end as w, case when (doc_id + j) % 6 = 2 then amount + 3 else amount end as amount from truth),
edges as materialized (select *, row_number() over (partition by doc_id order by score desc, i desc, j desc) as k from (select p.doc_id, i, j, coalesce(abs(p.amount - t.amount) <= 0.01, p.amount is null and t.amount is null) as same, {_OVERLAP.format(a='p.w', b='t.w')} as likeness,
    round(case when coalesce(abs(p.amount - t.amount) <= 0.01, p.amount is null and t.amount is null) then 0.6 else 0 end + 0.3 * {_OVERLAP.format(a='p.w', b='t.w')} + case when p.pos = t.pos then 0.1 else 0 end, 9) as score
   from predicted p join truth t on t.doc_id = p.doc_id) where score >= 0.25),
walk as (select doc_id, cast(0 as bigint) as k, cast([] as bigint[]) as gone_i, cast([] as bigint[]) as gone_j, false as takes from (select distinct doc_id from edges)
  union all select doc_id, k, case when free then list_append(gone_i, i) else gone_i end, case when free then list_append(gone_j, j) else gone_j end, free
   from (select w.doc_id, e.k, gone_i, gone_j, e.i, e.j, not list_contains(gone_i, e.i) and not list_contains(gone_j, e.j) as free from walk w join edges e on e.doc_id = w.doc_id and e.k = w.k + 1)),
picked as (select e.* from walk w join edges e on e.doc_id = w.doc_id and e.k = w.k where takes)"""


@query("pair_line_items", recursive(sql(f"with {PAIRED} select doc_id, i, j, score from picked", "invoice_positions")))
def pair_line_items(spark, d):
    return quality.pair_line_items(*_line_items(spark, d))


@query("line_item_report", recursive(sql(f"""
with {PAIRED}, counts as (select count(*) as m, (select count(*) from truth) as t, (select count(*) from predicted) as p, count(*) filter (same) as a, sum(likeness) as o from picked),
shares as (select *, m / t as r, m / p as q from counts)
select m as matched, t - m as missing, p - m as spurious, a as amount_correct, round(r, 9) as recall, round(q, 9) as precision, round(a / m, 9) as amount_accuracy, round(o / m, 9) as description_similarity, round(5 * q * r / (4 * q + r), 9) as f_beta from shares""", "invoice_positions")))
def line_item_report(spark, d):
    predicted, truth = _line_items(spark, d)
    report = quality.line_item_report(quality.paired_line_item_counts(predicted, truth))
    return report.select("matched", "missing", "spurious", "amount_correct", *[F.round(c, 9).alias(c) for c in ("recall", "precision", "amount_accuracy", "description_similarity", "f_beta")])


_ST = ["verified", "value-not-in-quote", "quote-not-found", "unquoted", "absent", "unverifiable-scan", "xml", "unresolved", "from-filename"]
_TALLY = ", ".join(f"count(*) filter (status = '{s}') as {s.replace('-', '_')}" for s in _ST)


@query("evidence_tally", sql(f"with {EVIDENCE} select field, {_TALLY}, round(count(*) filter (status in ('verified', 'xml')) / count(*), 9) as proven_share from evidence group by 1", *EVIDENCE_TABLES))
def evidence_tally(spark, d):
    return quality.evidence_tally(evidence_rows(spark, d)[0]).withColumn("proven_share", F.round("proven_share", 9))


@query("pair_result_rows", recursive(sql(f"""
with items as materialized (select project_id, invoice_id as item, {_words('vendor_name')} as v, netto as n, brutto as b from invoices),
asked as materialized (select project_id, invoice_id as ord, {_words('vendor_name')} as w, case when invoice_id % 8 = 3 then netto + 9 else netto end as tn, netto as ts, case when invoice_id % 8 <> 3 then brutto end as tb, row_number() over (partition by project_id order by invoice_id) as k from invoices),
options as materialized (select project_id, k, list({{'s': score, 'item': item}} order by score desc, item) as o from (select a.project_id, k, item,
    round(case when tn is not null and (coalesce(abs(n - tn) <= 0.01, false) or coalesce(abs(n - ts) <= 0.01, false)) then 0.6 else 0 end + case when coalesce(abs(b - tb) <= 0.01, false) then 0.3 else 0 end + 0.1 * {_OVERLAP.format(a='v', b='w')}, 9) as score
   from asked a join items i on i.project_id = a.project_id) where score >= 0.3 group by 1, 2),
walk as (select distinct project_id, cast(0 as bigint) as k, cast([] as bigint[]) as used, cast(null as bigint) as ord, cast(null as bigint) as idx, cast(null as double) as score from items
  union all select project_id, k, case when best is null then used else list_append(used, best.item) end, ord, best.item, best.s
   from (select y.project_id, a.k, used, a.ord, list_filter(coalesce(o, []), lambda c: not list_contains(used, c.item))[1] as best from walk y join asked a on a.project_id = y.project_id and a.k = y.k + 1 left join options p on p.project_id = a.project_id and p.k = a.k))
select project_id, ord, idx, round(score, 6) as score from walk where idx is not null""", "invoices")))
def pair_result_rows(spark, d):
    invoices = load(spark, d, "invoices")
    extracted = invoices.select("project_id", F.col("invoice_id").alias("idx"), "vendor_name", "netto", "brutto")
    off = F.col("invoice_id") % 8 == 3
    truth = invoices.select("project_id", F.col("invoice_id").alias("ord"), F.col("vendor_name").alias("recipient"), F.when(off, (F.col("netto") + 9).cast("decimal(18,2)")).otherwise(F.col("netto")).alias("netto"),
                            F.col("netto").alias("netto_after_skonto"), F.when(off, F.lit(None)).otherwise(F.col("brutto")).alias("brutto"))
    return quality.pair_result_rows(extracted, truth).withColumn("score", F.round("score", 6))


@query("reconcile_vendor_sums", sql(f"""
with g as (select project_id, {duck.vset('vendor_name')} as made, sum(netto) as gs, bool_or(invoice_id % 17 = 2) as fl, min(invoice_id) as first from invoices group by 1, 2),
t as (select project_id, {duck.vset('vendor_name')} as want, sum(netto + case when invoice_id % 7 = 1 then 5 else 0 end) as ts from invoices group by 1, 2),
p as (select t.project_id, want, ts, first, gs, fl, {duck.overlap('made', 'want')} as o from t join g on g.project_id = t.project_id where {duck.overlap('made', 'want')} >= 0.34),
b as (select project_id, want, arg_max(gs, {{'o': o, 'm': -first}}) as gs, bool_or(fl) as fl from p group by 1, 2)
select t.project_id, array_to_string(t.want, ' ') as vendor, t.ts as truth_sum, gs as generated_sum, case when gs is null then 'missing' when abs(gs - t.ts) <= 0.02 then 'equal' when fl then 'flagged' else 'different' end as verdict
from t left join b on b.project_id = t.project_id and b.want = t.want""", "invoices"))
def reconcile_vendor_sums(spark, d):
    invoices = load(spark, d, "invoices")
    key = F.col("invoice_id")
    made = invoices.select("project_id", key.alias("seq"), "vendor_name", F.col("netto").alias("amount"), (key % 17 == 2).alias("flagged"))
    want = invoices.select("project_id", "vendor_name", (F.col("netto") + F.when(key % 7 == 1, 5).otherwise(0)).cast("decimal(18,2)").alias("amount"))
    return quality.reconcile_vendor_sums(made, want)


# --- reviews ------------------------------------------------------------------------------------


def _reviewed(spark, d):
    rows, _, _ = vne_rows(spark, d)
    flags = F.array_compact(F.array(F.when(F.col("match_kind") == "none", "kein Angebot"), F.when(~F.col("fundable"), "nicht förderfähig")))
    return rows.withColumn("flags", flags)


@query("review_status", sql(f"""
with {class_sql()}
select project_id, source_name as file, case when netto = 0 or invoice_date < date '1996-01-01' then 'hinweis' else 'ok' end as status, case when netto = 0 and invoice_date >= date '1996-01-01' then 'nicht verwertbar' when invoice_date < date '1996-01-01' then 'früh' else '' end as message from invoices
union all select project_id, offer_number || '.pdf', case when kind <> 'statement' and pass then 'ok' else 'hinweis' end,
  case when kind = 'statement' then 'Schätzung — Σ ' || {duck.format_de('f')} || ' € (manuell prüfen)' when pass then 'Kreuzsumme OK — Σ ' || {duck.format_de('m')} || ' €' else '⚠ Kreuzsumme weicht ab — im .xlsx rot markiert' end
  from (select o.*, coalesce(m, 0) as m, coalesce(f, 0) as f, coalesce(least(abs(coalesce(m, 0) - nettosumme), abs(coalesce(f, 0) - nettosumme)) <= 0.02, false) as pass from offers o left join (select offer_id as oid, sum(case when not optional then line_total_net end) as m, sum(line_total_net) as f from offer_positions group by 1) on oid = offer_id)
union all select project_id, name, 'hinweis', case when name like '%.xlsx' then 'Tabellen werden nicht mehr gelesen — die geprüfte Kostenaufstellung bitte als PDF hochladen (ignoriert)' else 'nicht Rechnung/Angebot — ignoriert' end
  from (select project_id, name from classified where doc_class not in ('invoice', 'offer') union all select project_id, name from manifest where file_id not in (select file_id from classified))""", "invoices", "offers", "offer_positions", "manifest"))
def review_status(spark, d):
    invoices, offers, positions, manifest = load(spark, d, "invoices", "offers", "offer_positions", "manifest")
    rows = invoices.select("project_id", "source_name", (F.col("netto") == 0).alias("unusable"), F.array_compact(F.array(F.when(F.col("invoice_date") < F.lit("1996-01-01").cast("date"), "früh"))).alias("flags"))
    names = offers.select("offer_id", F.concat("offer_number", F.lit(".pdf")).alias("source_name"))
    offer_checks = checks.offer_cross_sum(offers, positions).join(names, "offer_id")
    ignored = classify.ignored_documents(manifest, classify.classify_files(manifest), ["invoice", "offer"])
    return ev.review_status(rows, offer_checks, ignored)


@query("run_summary", sql("""
select project_id, count(*) as invoices, count(*) filter (netto = 0) as flagged, count(*) filter (n_lines = 0) as failed_cross_sums, 0 as duplicates, sum(netto) as sum_ik, 0 as sum_nk, 0 as sum_ek from invoices group by 1""", "invoices"))
def run_summary(spark, d):
    zero = F.lit(0).cast("decimal(18,2)")
    rows = load(spark, d, "invoices").withColumns({
        "flags": F.array_compact(F.array(F.when(F.col("netto") == 0, "leer"))), "position_passed": F.col("n_lines") > 0, "dup_verdict": F.lit("none"),
        "ik_amount": F.col("netto"), "nk_amount": zero, "ek_amount": zero})
    return ev.run_summary(rows)
