"""Readers and sinks: what a line becomes, and what a row becomes as a line."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from catalog.domain import load, sql
from catalog.queries_funding import plan_renames
from catalog.queries_quality import diff_cost_tables
from catalog.registry import ORACLES, query
from costproof.session import ensure_checkpoint_dir
from costproof.sources import readers, sinks

# --- extracted records ------------------------------------------------------------------------

_BROKEN, _NAMELESS, _UNTOTALLED = "invoice_id % 13 = 4", "invoice_id % 11 = 3", "invoice_id % 17 = 5"
GOOD = f"good as (select * from invoices where not ({_BROKEN}) and not ({_NAMELESS}) and not ({_UNTOTALLED} and n_lines > 0))"


def _extractions(spark, d):
    """Invoices as JSON lines: some cut off, some without a vendor, some whose first line has no total."""
    invoices, lines = load(spark, d, "invoices", "invoice_positions")
    first = (F.col("pos_seq") == F.min("pos_seq").over(Window.partitionBy("invoice_id"))) & F.expr(_UNTOTALLED)
    total = F.when(~first, F.col("line_total_net")).alias("line_total_net")
    items = lines.select("invoice_id", "pos_seq", F.struct("pos", "description", "qty", total).alias("p")).groupBy("invoice_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos_seq", "p"))), lambda x: x["p"]).alias("positions"))
    df = invoices.join(items, "invoice_id", "left").withColumn("vendor_name", F.when(~F.expr(_NAMELESS), F.col("vendor_name")))
    line = F.to_json(F.struct("project_id", "invoice_id", "seq", "vendor_name", "invoice_number", "invoice_date", "netto", "positions"))
    return readers.judge_extractions(readers.parse_extractions(df.select(F.when(F.expr(_BROKEN), F.left(line, F.lit(30))).otherwise(line).alias("value")), "invoice"), "invoice")


@query("extracted_documents", sql(f"with {GOOD} select project_id, invoice_id, vendor_name, invoice_number, invoice_date, netto from good", "invoices"))
def extracted_documents(spark, d):
    return _extractions(spark, d)[0].select("project_id", "invoice_id", "vendor_name", "invoice_number", "invoice_date", "netto")


@query("extracted_positions", sql(f"""
with {GOOD} select g.invoice_id, row_number() over (partition by g.invoice_id order by p.pos_seq) as pos_seq, p.pos, p.description, p.qty, p.line_total_net from good g join invoice_positions p on p.invoice_id = g.invoice_id""", "invoices", "invoice_positions"))
def extracted_positions(spark, d):
    return _extractions(spark, d)[1].select("invoice_id", "pos_seq", "pos", "description", "qty", "line_total_net")


@query("rejected_extractions", sql(f"""
select case when not ({_BROKEN}) then invoice_id end as invoice_id, case when {_BROKEN} then 'unreadable record' when {_NAMELESS} then 'missing: vendor_name' else 'binding position without total' end as reason
from invoices where {_BROKEN} or {_NAMELESS} or ({_UNTOTALLED} and n_lines > 0)""", "invoices"))
def rejected_extractions(spark, d):
    rejected = _extractions(spark, d)[2]
    return rejected.select(F.when(F.col("reason") != "unreadable record", F.col("invoice_id")).alias("invoice_id"), "reason")


# --- settings and logs ------------------------------------------------------------------------


@query("project_settings", sql("""
select c_custkey as project_id, client_name, antragstellung, foerderbetrag from customer left join projects on project_id = c_custkey and project_id % 4 <> 1""", "projects"))
def project_settings(spark, d):
    settings = load(spark, d, "projects").where("project_id % 4 <> 1")
    ids = load(spark, d, "customer").select(F.col("c_custkey").alias("project_id"))
    return readers.complete_projects(settings, ids).select("project_id", "client_name", "antragstellung", "foerderbetrag")


@query("audit_lines", sql("""
select line_no, case when line_no % 97 <> 0 then job end as job, case when line_no % 97 <> 0 then event end as event, case when line_no % 97 <> 0 then ts end as ts, case when line_no % 97 <> 0 then verified end as verified,
  case when line_no % 97 <> 0 then message end as message from audit_events where line_no % 89 <> 0""", "audit_events"))
def audit_lines(spark, d):
    """Events as JSON lines; every 97th is none, every 89th is blank."""
    log = load(spark, d, "audit_events")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts")
    line = F.to_json(F.struct(stamp, "job", "procedure", "event", "message", "file", "status", "verified"))
    value = F.when(F.col("line_no") % 89 == 0, "  ").when(F.col("line_no") % 97 == 0, "no json").otherwise(line)
    return readers.parse_audit_lines(log.select(F.lit("log").alias("log_file"), "line_no", value.alias("value"))).select("line_no", "job", "event", "ts", "verified", "message")


# --- sinks --------------------------------------------------------------------------------------


def _pair(name: str, text: str = "{}") -> str:
    return f"case when {name} is not null then '\"{name}\":' || {text.format(name)} end"


@query("correction_lines", f"""
select '{{' || concat_ws(',', {", ".join([_pair("sheet_id"), *[_pair(c, "to_json({})") for c in ("block", "scope", "pos", "field", "original", "corrected")]])}) || '}}' as value from ({ORACLES["diff_cost_tables"]})""")
def correction_lines(spark, d):
    return sinks.correction_lines(diff_cost_tables(spark, d).select("sheet_id", "block", "scope", "pos", "field", "original", "corrected"))


@query("rename_lines", f"select old_name || ';' || new_name || ';' || case when contains(note, ';') then '\"' || note || '\"' else note end as value from ({ORACLES['plan_renames']})")
def rename_lines(spark, d):
    return sinks.rename_lines(plan_renames(spark, d))


@query("result_tables", sql("select project_id, invoice_id, case when invoice_id % 2 = 0 then netto else netto + 1 end as netto from invoices", "invoices"))
def result_tables(spark, d):
    """Invoices written twice under one path, the second time with other amounts, and read back."""
    invoices = load(spark, d, "invoices").select("project_id", "invoice_id", "netto")
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/results/{uuid.uuid4().hex}"
    sinks.write_result_tables({"invoices": invoices}, path, buckets=8)
    sinks.write_result_tables({"invoices": invoices.withColumn("netto", F.when(F.col("invoice_id") % 2 == 0, F.col("netto")).otherwise((F.col("netto") + 1).cast("decimal(18,2)")))}, path, buckets=8)
    return sinks.read_result_table(spark, path, "invoices")
