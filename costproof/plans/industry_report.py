"""Close-out report of programme A: every check, split and total, from invoices to grant."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from costproof.operators import checks, duplicates, evidence, industry_grant as industry, matching


@dataclass
class IndustryReport:
    rows: DataFrame
    splits: DataFrame
    vendors: DataFrame
    totals: DataFrame


def industry_report(invoices: DataFrame, positions: DataFrame, blocks: DataFrame, projects: DataFrame, evidence_rows: DataFrame) -> IndustryReport:
    """One row per invoice with amounts and flags, plus splits, vendor sums and project totals.
    ``seq`` is the processing order (invoice date, then file name). Lazy but for the duplicate
    rule; sort at the sink."""
    if "vendor_from_filename" not in invoices.columns:
        invoices = invoices.withColumn("vendor_from_filename", F.lit(False))
    rows = duplicates.flag_unusable(duplicates.flag_duplicates(invoices, positions))
    names = invoices.select("project_id", F.col("seq").alias("dup_of"), F.col("source_name").alias("dup_name"))
    rows = rows.join(names, ["project_id", "dup_of"], "left")
    rows = matching.statement_fallback(matching.match_vendor(rows, blocks), blocks)
    rows = industry.window_check(industry.date_rules(rows, projects), projects)
    rows = checks.recipient_check(checks.invoice_amount_check(rows), projects)
    sums = checks.invoice_position_check(invoices, positions).select(
        "invoice_id", F.col("passed").alias("position_passed"), F.col("message").alias("position_message"))
    statuses = evidence.evidence_wide(evidence_rows).withColumnRenamed("doc_id", "invoice_id")
    rows = rows.join(sums, "invoice_id", "left").join(statuses, "invoice_id", "left")
    shares = blocks.select("project_id", "block_seq", "anteil_ik", "anteil_nk")
    rows = rows.join(shares, ["project_id", "block_seq"], "left").withColumn("netto_after_skonto", industry.after_skonto(F.col("netto"), F.lit(0)))
    chain = industry.advance_chain_check(rows).select("invoice_id", "chain_flag")
    splits = industry.split_invoices(rows)
    zero = F.lit(0).cast("decimal(28,2)")
    amounts = splits.groupBy("invoice_id").agg(*[
        F.coalesce(F.sum(F.when(F.col("category") == c, F.col("amount"))), zero).alias(f"{c.lower()}_amount") for c in ("IK", "NK", "EK")])
    flagged = industry.invoice_flags(rows.join(chain, "invoice_id", "left")).join(amounts, "invoice_id", "left").withColumns(
        {f"{c}_amount": F.coalesce(f"{c}_amount", zero) for c in ("ik", "nk", "ek")})
    totals = industry.funding_chain(industry.eligible_totals(splits, industry.requested_totals(blocks, rows), projects), projects)
    return IndustryReport(flagged, splits, industry.vendor_summary(rows, blocks), totals)
