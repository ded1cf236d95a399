"""Vendor matching, folding, duplicates and position matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import duck
from catalog.domain import load, sql
from catalog.queries_documents import article_sql, desc_sql
from catalog.registry import query
from costproof.functions.text import numbers_similar as likeness
from costproof.functions.vendor import vendor_overlap as overlap, vendor_set
from costproof.operators import duplicates, matching, positions as pos_ops
from costproof.session import materialize

def recursive(text: str) -> str:
    """DuckDB wants RECURSIVE on the outermost WITH."""
    return "with recursive " + text[len("with "):] if text.startswith("with ") else text


OWN = r"regexp_matches(vendor_name, '(?i)plan\s*wegweiser')"

MATCHED = f"""names as (select distinct project_id, vendor_name from invoices where not {OWN}),
sides as (select project_id, block_seq, array_to_string({duck.tokens('vendor')}, '') as bc, list_sort(list_distinct({duck.vset('vendor')} || {duck.vset('header')})) as bt from vendor_blocks),
named as (select *, {duck.vset('vendor_name')} as nt, array_to_string({duck.tokens('vendor_name')}, '') as nc from names),
scored as (select n.project_id, vendor_name, block_seq, case when {duck.overlap('nt', 'bt')} > 0 then {duck.overlap('nt', 'bt')}
   when length(bc) >= 5 and length(nc) >= 5 and (contains(nc, bc) or contains(bc, nc)) then 0.5 else 0 end as score from named n join sides s on s.project_id = n.project_id where length(nt) > 0),
best as (select * from scored where score > 0 qualify row_number() over (partition by project_id, vendor_name order by score desc, block_seq) = 1),
matched as (select i.*, {OWN.replace('vendor_name', 'i.vendor_name')} as own_company, block_seq, score as match_score from invoices i left join best b on b.project_id = i.project_id and b.vendor_name = i.vendor_name),
statements as (select project_id, count(*) as n, min(block_seq) as sseq from vendor_blocks where statement or regexp_matches(header, '(?i)sch[äa]tzung|stellungnahme|eigenerkl') group by 1),
allocated as (select m.* exclude (block_seq), case when own_company then 'own' when block_seq is not null then 'vendor' when n = 1 then 'statement' else 'none' end as match_kind,
   case when own_company then null when block_seq is not null then block_seq when n = 1 then sseq end as block_seq from matched m left join statements s on s.project_id = m.project_id)"""


@query("vendor_overlap", sql(f"""
select invoice_id, block_seq, round({duck.overlap('a', 'b')}, 9) as score from (select invoice_id, block_seq, {duck.vset('vendor_name')} as a, {duck.vset('b.vendor')} as b
  from invoices i join vendor_blocks b on b.project_id = i.project_id)""", "invoices", "vendor_blocks"))
def vendor_overlap(spark, d):
    invoices, blocks = load(spark, d, "invoices", "vendor_blocks")
    left = invoices.select("project_id", "invoice_id", vendor_set(F.col("vendor_name")).alias("a"))
    right = blocks.select("project_id", "block_seq", vendor_set(F.col("vendor")).alias("b"))
    return left.join(right, "project_id").select("invoice_id", "block_seq", F.round(overlap(F.col("a"), F.col("b")), 9).alias("score"))


@query("match_vendor", sql(f"with {MATCHED} select invoice_id, own_company, block_seq, round(match_score, 9) as match_score from matched", "invoices", "vendor_blocks"))
def match_vendor(spark, d):
    df = matching.match_vendor(*load(spark, d, "invoices", "vendor_blocks"))
    return df.select("invoice_id", "own_company", "block_seq", F.round("match_score", 9).alias("match_score"))


@query("statement_fallback", sql(f"with {MATCHED} select invoice_id, match_kind, block_seq from allocated", "invoices", "vendor_blocks"))
def statement_fallback(spark, d):
    invoices, blocks = load(spark, d, "invoices", "vendor_blocks")
    return matching.statement_fallback(matching.match_vendor(invoices, blocks), blocks).select("invoice_id", "match_kind", "block_seq")


@query("fuzzy_vendor_join_global", sql(f"""
with l as (select distinct vendor_name as left_name, {duck.vset('vendor_name')} as a from invoices), r as (select distinct vendor as right_name, {duck.vset('vendor')} as b from vendor_blocks)
select left_name, right_name, round({duck.overlap('a', 'b')}, 9) as score from l join r on {duck.overlap('a', 'b')} > 0""", "invoices", "vendor_blocks"))
def fuzzy_vendor_join_global(spark, d):
    invoices, blocks = load(spark, d, "invoices", "vendor_blocks")
    df = matching.fuzzy_vendor_join_global(invoices, blocks, "vendor_name", "vendor")
    return df.withColumn("score", F.round("score", 9))


GROUPED = f"""labelled as (select project_id, block_seq, vendor as label, sonderpreis, {duck.vset('vendor')} as ts, row_number() over (partition by project_id order by block_seq) as k from vendor_blocks
   where not regexp_matches(vendor, '(?i)plan\\s*wegweiser') and not (statement or regexp_matches(header, '(?i)sch[äa]tzung|stellungnahme|eigenerkl'))),
walk as (select project_id, cast(0 as bigint) as k, cast([] as struct(g bigint, ts varchar[])[]) as founded, cast(null as bigint) as block_seq, cast(null as bigint) as group_seq from (select distinct project_id from labelled)
  union all select project_id, k, case when hit is null then list_append(founded, {{'g': block_seq, 'ts': ts}}) else founded end, block_seq, coalesce(hit, block_seq)
  from (select w.project_id, l.k, w.founded, l.block_seq, l.ts, list_filter(w.founded, lambda f: length(list_filter(f.ts, lambda t: length(list_filter(l.ts, lambda u: t = u or (length(t) >= 5 and length(u) >= 5 and levenshtein(t, u) <= 1))) > 0)) > 0)[1].g as hit
     from walk w join labelled l on l.project_id = w.project_id and l.k = w.k + 1)),
grouped as (select w.project_id, w.group_seq, w.block_seq, label, sonderpreis from walk w join labelled l on l.project_id = w.project_id and l.block_seq = w.block_seq),
groups as (select project_id, group_seq, count(*) as n_blocks, arg_min(label, block_seq) as group_label, case when count(*) = 1 then min(sonderpreis) end as group_sonderpreis from grouped group by 1, 2)"""


def grouped_blocks(spark, d):
    blocks = load(spark, d, "vendor_blocks").withColumnRenamed("vendor", "label")
    return matching.group_offer_blocks(blocks)


@query("group_offer_blocks", recursive(sql(f"with {GROUPED} select b.project_id, b.block_seq, b.group_seq, n_blocks, group_label, group_sonderpreis from grouped b join groups g on g.project_id = b.project_id and g.group_seq = b.group_seq", "vendor_blocks")))
def group_offer_blocks(spark, d):
    return grouped_blocks(spark, d).select("project_id", "block_seq", "group_seq", "n_blocks", "group_label", "group_sonderpreis")


@query("assign_invoices_to_groups", sql(f"""
with named as (select distinct project_id, vendor_name, {duck.vset('vendor_name')} as nt from invoices), labels as (select *, {duck.vset('group_label')} as lt from offer_groups),
best as (select n.project_id, vendor_name, group_seq, {duck.overlap('lt', 'nt')} as score from named n join labels l on l.project_id = n.project_id where {duck.overlap('lt', 'nt')} > 0
  qualify row_number() over (partition by n.project_id, vendor_name order by {duck.overlap('lt', 'nt')} desc, group_seq) = 1)
select invoice_id, group_seq, round(score, 9) as group_score from invoices i left join best b on b.project_id = i.project_id and b.vendor_name = i.vendor_name""", "invoices", "offer_groups"))
def assign_invoices_to_groups(spark, d):
    df = matching.assign_invoices_to_groups(*load(spark, d, "invoices", "offer_groups"))
    return df.select("invoice_id", "group_seq", F.round("group_score", 9).alias("group_score"))


FOLDED = f"""vsets as (select *, {duck.vset('vendor_name')} as ts from invoices), finals as (select * from vsets where invoice_type = 'schlussrechnung' and cumulative_netto is not null),
first_final as (select v.invoice_id, min(f.seq) as final_seq from vsets v join finals f on f.project_id = v.project_id where {duck.overlap('f.ts', 'v.ts')} > 0 group by 1),
folds as (select i.*, ff.final_seq, ff.final_seq is not null and (i.invoice_type in ('anzahlung','teilrechnung') or (i.invoice_type = 'gutschrift' and i.invoice_date <= f.invoice_date)) as folded
  from invoices i left join first_final ff on ff.invoice_id = i.invoice_id left join finals f on f.project_id = i.project_id and f.seq = ff.final_seq),
folded_counts as (select project_id, final_seq, count(*) as n from folds where folded group by 1, 2),
fold_result as (select f.* exclude (final_seq), f.final_seq, coalesce(n, 0) as n_folded from folds f left join folded_counts c on c.project_id = f.project_id and c.final_seq = f.seq)"""


@query("fold_advances", sql(f"with {FOLDED} select invoice_id, final_seq, folded, n_folded from fold_result", "invoices"))
def fold_advances(spark, d):
    return matching.fold_advances(load(spark, d, "invoices")).select("invoice_id", "final_seq", "folded", "n_folded")


@query("scope_check_inputs", sql(f"""
select invoice_id from invoices where netto <> 0 and not {OWN} and project_id in (select project_id from offers)""", "invoices", "offers"))
def scope_check_inputs(spark, d):
    invoices, offers = load(spark, d, "invoices", "offers")
    rows = duplicates.flag_unusable(invoices.withColumn("dup_verdict", F.lit("none")))
    return matching.scope_check_inputs(rows, offers)[0].select("invoice_id")


@query("scope_check_skipped", sql("select project_id from projects where project_id not in (select project_id from offers)", "projects", "offers"))
def scope_check_skipped(spark, d):
    projects, offers = load(spark, d, "projects", "offers")
    return matching.scope_check_skipped(projects, offers).select("project_id")


# --- duplicates -----------------------------------------------------------------------------


@query("numbers_similar", sql(rf"""
with s as (select original_id, invoice_number as n, {duck.digits('invoice_number')} as dg, regexp_replace(lower(invoice_number), '\s+', '', 'g') as q, copy_no from invoice_scans)
select a.original_id, b.copy_no, a.q = b.q or (length(a.dg) >= 5 and length(b.dg) >= 5 and (ends_with(a.dg, b.dg) or ends_with(b.dg, a.dg))) as same_number
from s a join s b on a.original_id = b.original_id and a.copy_no = 0 and b.copy_no > 0""", "invoice_scans"))
def numbers_similar(spark, d):
    scans = load(spark, d, "invoice_scans").select("original_id", "copy_no", "invoice_number")
    first = scans.where("copy_no = 0").select("original_id", F.col("invoice_number").alias("a"))
    others = scans.where("copy_no > 0").select("original_id", "copy_no", F.col("invoice_number").alias("b"))
    return first.join(others, "original_id").select("original_id", "copy_no", likeness(F.col("a"), F.col("b")).alias("same_number"))


_SIGNS = """(cast(f.q = m.s.q or (length(f.dg) >= 5 and length(m.s.dg) >= 5 and (ends_with(f.dg, m.s.dg) or ends_with(m.s.dg, f.dg))) as int) + cast(f.d = m.s.d as int) + cast(list_has_any(f.ts, m.s.ts) as int) + cast(coalesce(f.am = m.s.am, false) as int))"""
DUPLICATES = rf"""amts as (select invoice_id, array_to_string(list_sort(list(line_total_net)), ';') as am from scan_positions group by 1),
members as (select project_id, netto, scan_seq, row_number() over (partition by project_id, netto order by scan_seq) as k,
   {{'q': regexp_replace(lower(invoice_number), '\s+', '', 'g'), 'dg': {duck.digits('invoice_number')}, 'd': invoice_date, 'ts': {duck.vset('vendor_name')}, 'am': am, 'seq': scan_seq}} as s
   from invoice_scans i left join amts a on a.invoice_id = i.invoice_id where netto <> 0),
walk as (select project_id, netto, cast(0 as bigint) as k, cast([] as struct(q varchar, dg varchar, d date, ts varchar[], am varchar, seq bigint)[]) as booked, cast(null as bigint) as scan_seq, cast(null as varchar) as verdict, cast(null as bigint) as dup_of
     from (select distinct project_id, netto from members)
  union all select project_id, netto, k, case when v = 'duplicate' then booked else list_append(booked, s) end, scan_seq, v, case when v <> 'none' then hit.seq end
  from (select *, case when hit is null then 'none' when cast(hit.q = s.q or (length(hit.dg) >= 5 and length(s.dg) >= 5 and (ends_with(hit.dg, s.dg) or ends_with(s.dg, hit.dg))) as int) + cast(hit.d = s.d as int) + cast(list_has_any(hit.ts, s.ts) as int) + cast(coalesce(hit.am = s.am, false) as int) >= 2 then 'duplicate' else 'same-amount' end as v
    from (select w.project_id, w.netto, m.k, w.booked, m.scan_seq, m.s, list_filter(w.booked, lambda f: list_has_any(f.ts, m.s.ts) or {_SIGNS} >= 2)[1] as hit
      from walk w join members m on m.project_id = w.project_id and m.netto = w.netto and m.k = w.k + 1)))"""


def scans(spark, d):
    invoices, lines = load(spark, d, "invoice_scans", "scan_positions")
    return invoices.drop("seq").withColumnRenamed("scan_seq", "seq"), lines


@query("flag_duplicates", recursive(sql(f"""
with {DUPLICATES}
select invoice_id, coalesce(verdict, 'none') as dup_verdict, dup_of, coalesce(verdict, 'none') = 'duplicate' or i.netto = 0 as unusable
from invoice_scans i left join (select * from walk where k > 0) w on w.project_id = i.project_id and w.netto = i.netto and w.scan_seq = i.scan_seq""", "invoice_scans", "scan_positions")))
def flag_duplicates(spark, d):
    df = duplicates.flag_unusable(duplicates.flag_duplicates(*scans(spark, d)))
    return df.select("invoice_id", "dup_verdict", "dup_of", "unusable")


@query("dedupe_invoices", sql(f"""
with b as (select project_id, invoice_id, scan_seq as seq, netto, {duck.alnum('invoice_number')} as n, {duck.vset('vendor_name')} as ts,
   case when copy_no <> 1 and coalesce(c.s = netto, false) then 0 else 1 end as rc, case when extraction_method like 'vision%' then 1 else 0 end as rm
   from invoice_scans i left join (select invoice_id as iid, sum(line_total_net) as s from scan_positions group by 1) c on iid = i.invoice_id),
p1 as (select *, min(seq) over (partition by project_id, ts, n) as gs from b qualify row_number() over (partition by project_id, ts, n order by rc, rm, seq) = 1),
p2 as (select * from p1 qualify row_number() over (partition by project_id, n, netto order by rc, rm, gs) = 1)
select invoice_id, invoice_id in (select invoice_id from p2) as kept from b""", "invoice_scans", "scan_positions"))
def dedupe_invoices(spark, d):
    invoices, lines = scans(spark, d)
    sums = lines.groupBy("invoice_id").agg(F.sum("line_total_net").alias("s"))
    checked = invoices.join(sums, "invoice_id", "left").withColumn("position_passed", (F.col("copy_no") != 1) & F.coalesce(F.col("s") == F.col("netto"), F.lit(False)))
    kept, dropped = duplicates.dedupe_invoices(checked)
    return kept.select("invoice_id", F.lit(True).alias("kept")).unionByName(dropped.select("invoice_id", F.lit(False).alias("kept")))


# --- positions ------------------------------------------------------------------------------

_FRACTIONS = ["0.5", "0.333333333333", "0.25", "0.3", "0.4", "0.2", "0.1", "0.9", "0.8", "0.7"]


def _cover(a: str, b: str) -> str:
    return f"length(list_filter({a}, lambda t: length(list_filter({b}, lambda u: t = u or (length(t) >= 4 and length(u) >= 4 and (contains(u, t) or contains(t, u))))) > 0)) / length({a})"


_CLEAN = " or ".join(f"abs(ip / op - {f}) < 0.01" for f in _FRACTIONS)
PAIRS = f"""words_o as materialized (select description as od, {desc_sql('description')} as otk from (select distinct description from group_offer_lines)),
words_i as materialized (select description as id_, {desc_sql('description')} as itk, {article_sql('description')} as ia from (select distinct description from billed)),
o as materialized (select g.*, otk, {article_sql("coalesce(artikelnummer, '') || ' ' || description")} as oa, line_total_net as op from group_offer_lines g join words_o on od = description where line_total_net is not null and (not optional or line_total_net <> 0)),
i as materialized (select b.*, itk, ia, line_total_net as ip from billed b join words_i on id_ = description),
texts as materialized (select ot, it, round(case when length(ot) > 0 and length(it) > 0 then ({_cover('ot', 'it')} + {_cover('it', 'ot')}) / 2 * 0.3 else 0 end, 9) as likeness
   from (select distinct otk as ot, itk as it from o join i on i.project_id = o.project_id and i.group_seq = o.group_seq)),
pairs as (select i.project_id, i.group_seq, i.invoice_id, i.pos_seq, o.line_seq, round(case when list_has_any(oa, ia) then 0.35 else 0 end, 9) as article, likeness as description,
   round(case when op is null or op = 0 then 0 else greatest(case when abs(ip - op) / abs(op) <= 0.5 then 1 - 2 * abs(ip - op) / abs(op) else 0 end, case when ip > 0 and ip < op and ({_CLEAN}) then 0.6 else 0 end) * 0.25 end, 9) as price,
   case when o.qty = i.qty then 0.1 else 0 end as qty
   from i join o on o.project_id = i.project_id and o.group_seq = i.group_seq join texts on ot = otk and it = itk),
scored as materialized (select *, round(article + description + price + qty, 9) as score from pairs)"""
ALL_BILLED = "billed as (select * from group_invoice_lines)"


def sixth(value):
    """Six decimals of a figure as floating point, as the SQL side rounds them: halves by their binary value."""
    return F.round(value.cast("double") * 1e6) / 1e6


@query("score_positions", sql(f"""
with {ALL_BILLED}, {PAIRS}, firsts as (select project_id, group_seq, line_seq from o qualify line_seq = min(line_seq) over (partition by project_id, group_seq, list_sort(oa), otk, op, qty))
select s.project_id, s.group_seq, s.invoice_id, s.pos_seq, s.line_seq, round(article::double, 6) as article, round(description::double, 6) as description, round(price::double, 6) as price, round(qty::double, 6) as qty, round(score::double, 6) as score
from scored s join firsts f on f.project_id = s.project_id and f.group_seq = s.group_seq and f.line_seq = s.line_seq where article > 0 or description > 0""", "group_offer_lines", "group_invoice_lines"))
def score_positions(spark, d):
    """All pairs with a common article or word; equal offer lines are one, the first."""
    pairs = pos_ops.score_positions(*load(spark, d, "group_offer_lines", "group_invoice_lines"))
    return pairs.select("project_id", "group_seq", "invoice_id", "pos_seq", "line_seq", *[sixth(F.col(c)).alias(c) for c in ("article", "description", "price", "qty", "score")])


BEST = """best as (select * from scored where score >= 0.4 qualify row_number() over (partition by project_id, group_seq, invoice_id, pos_seq order by score desc, line_seq) = 1)"""


@query("propose_matches", sql(f"""
with {ALL_BILLED}, {PAIRS}, top as (select * from scored qualify row_number() over (partition by project_id, group_seq, invoice_id, pos_seq order by score desc, line_seq) = 1)
select b.project_id, b.group_seq, b.invoice_id, b.pos_seq, case when score >= 0.4 then line_seq end as line_seq, case when score >= 0.55 then 'high' when score >= 0.4 then 'medium' else 'none' end as confidence,
  round(coalesce(score, 0)::double, 6) as score, round(article::double, 6) as article, round(t.description::double, 6) as description, round(price::double, 6) as price, round(t.qty::double, 6) as qty
from billed b left join top t on t.project_id = b.project_id and t.group_seq = b.group_seq and t.invoice_id = b.invoice_id and t.pos_seq = b.pos_seq""", "group_offer_lines", "group_invoice_lines"))
def propose_matches(spark, d):
    df = pos_ops.propose_matches(*load(spark, d, "group_offer_lines", "group_invoice_lines"))
    rounded = lambda c, n: sixth(F.col(c)).alias(n)
    return df.select("project_id", "group_seq", "invoice_id", "pos_seq", "line_seq", "confidence", rounded("score", "score"), *[rounded(f"signals.{s}", s) for s in ("article", "description", "price", "qty")])


LUMPS = f"""sums as (select project_id, group_seq, sum(case when not optional then line_total_net end) as m, sum(line_total_net) as a from group_offer_lines where coalesce(line_total_net <> 0, false) group by 1, 2),
targets as (select s.*, group_sonderpreis as sp from sums s left join offer_groups g on g.project_id = s.project_id and g.group_seq = s.group_seq),
lump_lines as (select l.project_id, l.group_seq, invoice_id, pos_seq, line_total_net as x, case when m <> 0 and abs(line_total_net - m) <= 0.02 then m when a <> 0 and abs(line_total_net - a) <= 0.02 then a else sp end as t,
    coalesce(not (m <> 0 and abs(line_total_net - m) <= 0.02), true) and abs(line_total_net - a) <= 0.02 and a <> 0 as options
  from group_invoice_lines l join targets t on t.project_id = l.project_id and t.group_seq = l.group_seq
  where line_total_net <> 0 and ((m <> 0 and abs(line_total_net - m) <= 0.02) or (a <> 0 and abs(line_total_net - a) <= 0.02) or (m is not null and sp <> 0 and abs(line_total_net - sp) <= 0.02))),
lumps as (select l.project_id, l.group_seq, invoice_id, pos_seq, line_seq, cast(round_even(cast(o.line_total_net as double) * cast(x as double) / cast(t as double), 2) as decimal(18,2)) as amount,
    'Gesamtangebot pauschal abgerechnet — eine Rechnungszeile über ' || {duck.format_de('x')} || ' €' as note
  from lump_lines l join group_offer_lines o on o.project_id = l.project_id and o.group_seq = l.group_seq where coalesce(o.line_total_net <> 0, false) and (options or not optional))"""


@query("allocate_lump_sums", sql(f"with {LUMPS} select project_id, group_seq, invoice_id, pos_seq, line_seq, amount, note from lumps", "group_offer_lines", "group_invoice_lines", "offer_groups"))
def allocate_lump_sums(spark, d):
    df = pos_ops.allocate_lump_sums(*load(spark, d, "group_offer_lines", "group_invoice_lines", "offer_groups"))
    return df.drop("confidence", "source")


def second_source(invoice_lines):
    """Stands in for the supplied pair proposals: line 1 of the offer for two lines in three."""
    return invoice_lines.select(
        "project_id", "group_seq", "invoice_id", "pos_seq", F.when(F.col("pos_seq") % 3 != 0, F.lit(1).cast("bigint")).alias("second_line_seq"),
        F.lit("gleiche Leistung").alias("reason"), ((F.col("invoice_id") % 10) / 10).alias("certainty"))


MERGED = """merged as (select b.project_id, b.group_seq, b.invoice_id, b.pos_seq, t.line_seq as first_seq, case when score >= 0.55 then 'high' when score >= 0.4 then 'medium' else 'none' end as first_conf,
    case when b.pos_seq % 3 <> 0 then 1 end as second_seq, (b.invoice_id % 10) / 10 as certainty, b.line_total_net as amount from billed b left join best t on t.project_id = b.project_id and t.group_seq = b.group_seq and t.invoice_id = b.invoice_id and t.pos_seq = b.pos_seq),
resolved as (select *, coalesce((first_conf = 'none' or (first_conf = 'medium' and second_seq <> first_seq)) and second_seq is not null and certainty >= 0.55, false) as takes from merged),
final as (select project_id, group_seq, invoice_id, pos_seq, amount, case when takes then second_seq else first_seq end as line_seq, case when takes and first_conf = 'none' then 'medium' else first_conf end as confidence, case when takes then 'second' else 'signal' end as source,
   case when takes or first_conf = 'none' or (first_conf = 'medium' and coalesce(second_seq = first_seq, false)) then 'gleiche Leistung' else '' end as note from resolved)"""


@query("merge_second_source", sql(f"with {ALL_BILLED}, {PAIRS}, {BEST}, {MERGED} select project_id, group_seq, invoice_id, pos_seq, line_seq, confidence, source, note from final", "group_offer_lines", "group_invoice_lines"))
def merge_second_source(spark, d):
    offers, billed = load(spark, d, "group_offer_lines", "group_invoice_lines")
    billed = materialize(billed)  # read by the proposals and by the second opinion
    return pos_ops.merge_second_source(pos_ops.propose_matches(offers, billed), second_source(billed)).drop("signals", "score")


SINGLE = "billed as (select * from group_invoice_lines b where not exists (select 1 from lump_lines l where l.invoice_id = b.invoice_id and l.pos_seq = b.pos_seq and l.project_id = b.project_id and l.group_seq = b.group_seq))"
MATCHES = f"""{LUMPS}, {SINGLE}, {PAIRS}, {BEST}, {MERGED},
matches as (select project_id, group_seq, invoice_id, pos_seq, line_seq, amount, 'high' as confidence, 'lump' as source, note from lumps
  union all select project_id, group_seq, invoice_id, pos_seq, line_seq, amount, confidence, source, note from final)"""
_TABLES = ("group_offer_lines", "group_invoice_lines", "offer_groups")


def line_matches(offers, billed, groups):
    return pos_ops.match_lines(offers, billed, groups, second_source(billed))


def _lines(spark, d):
    """The tables of a comparison; lines are written once for all that read them."""
    offers, billed, groups = load(spark, d, *_TABLES)
    return offers, materialize(billed), groups


@query("match_lines", sql(f"with {MATCHES} select * from matches", *_TABLES))
def match_lines(spark, d):
    return line_matches(*_lines(spark, d))


@query("position_refs", sql(f"""
with {MATCHES} select m.project_id, m.group_seq, m.line_seq, m.amount, invoice_number || '#' || coalesce(nullif(b.pos, ''), cast(b.pos_seq as varchar)) as ref from matches m
join group_invoice_lines b on b.project_id = m.project_id and b.group_seq = m.group_seq and b.invoice_id = m.invoice_id and b.pos_seq = m.pos_seq""", *_TABLES))
def position_refs(spark, d):
    offers, billed, groups = _lines(spark, d)
    return pos_ops.position_refs(line_matches(offers, billed, groups), billed).select("project_id", "group_seq", "line_seq", "amount", "ref")


@query("position_comparison", sql(f"""
with {MATCHES}, agg as (select project_id, group_seq, line_seq, sum(amount) as inv, max(confidence) as conf, count(*) as n from matches where line_seq is not null group by 1, 2, 3),
lines as (select o.*, inv, conf, n, case when n is not null then inv - op end as variance from o left join agg a on a.project_id = o.project_id and a.group_seq = o.group_seq and a.line_seq = o.line_seq),
rows_ as (select project_id, group_seq, 'offer' as kind, line_seq, cast(null as bigint) as invoice_id, cast(null as bigint) as pos_seq, op as offered, inv as invoiced, variance, conf as confidence, coalesce(n, 0) as n_lines,
    case when n is null then case when optional then 'optional, nicht abgerufen' else 'FEHLT — keine Rechnungszeile zugeordnet' end end as hint, optional from lines
  union all select project_id, group_seq, 'extra', null, invoice_id, pos_seq, null, amount, null, null, 1, coalesce(nullif(note, ''), 'keine Angebotsposition zugeordnet'), null from matches where line_seq is null),
totals as (select project_id, group_seq, coalesce(sum(case when optional = false then offered end), 0) as offered, coalesce(sum(invoiced), 0) as invoiced, count(*) filter (kind = 'offer' and n_lines = 0 and not optional) as missing,
   count(*) filter (kind = 'offer' and n_lines > 0 and variance <> 0) as drifted, count(*) filter (kind = 'extra') as extra from rows_ group by 1, 2)
select project_id, group_seq, kind, line_seq, invoice_id, pos_seq, offered, invoiced, variance, confidence, n_lines, hint, cast(null as bigint) as missing, cast(null as bigint) as drifted, cast(null as bigint) as extra from rows_
union all select g.project_id, g.group_seq, 'sum', null, null, null, coalesce(offered, 0), coalesce(invoiced, 0), coalesce(invoiced, 0) - coalesce(offered, 0), null, null,
   case when g.group_sonderpreis is not null then 'Sonderpreis lt. Angebot: ' || {duck.format_de('group_sonderpreis')} || ' €' end, coalesce(missing, 0), coalesce(drifted, 0), coalesce(extra, 0) from offer_groups g left join totals t on t.project_id = g.project_id and t.group_seq = g.group_seq""", *_TABLES, "invoices"))
def position_comparison(spark, d):
    offers, billed, groups = _lines(spark, d)
    offers = materialize(offers)
    in_scope = load(spark, d, "invoices").withColumn("group_seq", F.col("invoice_id") % 6)
    df = pos_ops.position_comparison(offers, line_matches(offers, billed, groups), groups, in_scope)
    return df.select("project_id", "group_seq", "kind", "line_seq", "invoice_id", "pos_seq", "offered", "invoiced", "variance", "confidence", "n_lines", "hint",
                     *[F.col(c).cast("bigint").alias(c) for c in ("missing", "drifted", "extra")])


# --- totals -----------------------------------------------------------------------------------


@query("match_totals_to_blocks", sql("""
select offer_id from (select offer_id, project_id, coalesce(nettosumme, 0) as net from offers) o where not exists (select 1 from vendor_blocks b where b.project_id = o.project_id and abs(b.gesamt - net) <= 0.02)""", "offers", "vendor_blocks"))
def match_totals_to_blocks(spark, d):
    offers, blocks = load(spark, d, "offers", "vendor_blocks")
    return matching.match_totals_to_blocks(offers.withColumn("net_total", F.coalesce("nettosumme", F.lit(0)).cast("decimal(18,2)")), blocks).select("offer_id")


@query("compare_block_totals", sql("""
select coalesce(a.project_id, b.project_id) as sheet_id, coalesce(a.k, b.k) as block_no, a.t as left_total, b.t as right_total, a.t - b.t as delta
from (select project_id, seq as k, nettosumme as t from offers) a full join (select project_id, block_seq as k, gesamt as t from vendor_blocks) b on a.project_id = b.project_id and a.k = b.k""", "offers", "vendor_blocks"))
def compare_block_totals(spark, d):
    offers, blocks = load(spark, d, "offers", "vendor_blocks")
    left = offers.select(F.col("project_id").alias("sheet_id"), F.col("seq").alias("block_no"), F.col("nettosumme").alias("total"))
    right = blocks.select(F.col("project_id").alias("sheet_id"), F.col("block_seq").alias("block_no"), F.col("gesamt").alias("total"))
    return matching.compare_block_totals(left, right)
