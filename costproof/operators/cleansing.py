"""Whole-table cleansing jobs on offers, offer lines and invoices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from costproof import fixed_values as fx
from costproof.functions.german import strip
from costproof.functions.text import vendor_from_filename
from costproof.functions.vendor import share_token, vendor_set


def normalize_discounts(offers: DataFrame) -> DataFrame:
    """Discounts positive; a non-positive special price is no price, and a negative one is
    the discount when none is stated."""
    special, discount = F.col("sonderpreis"), F.col("preisnachlass")
    moved = F.when(discount.isNull() & (special < 0), -special).otherwise(F.abs(discount))
    return offers.withColumns({
        "preisnachlass": moved.cast("decimal(18,2)"),
        "sonderpreis": F.when(special > 0, special),
    })


def unflag_inclusive(positions: DataFrame) -> DataFrame:
    """A free line marked as included is binding scope, not an option."""
    text = F.concat_ws(" ", F.col("description"), F.coalesce("optional_reason", F.lit("")))
    included = F.col("optional") & (F.col("line_total_net") == 0) & text.rlike(fx.INCLUSIVE_MARK)
    included = F.coalesce(included, F.lit(False))
    return positions.withColumns({
        "optional": F.col("optional") & ~included,
        "optional_reason": F.when(~included, F.col("optional_reason")),
    })


def drop_duplicate_discounts(positions: DataFrame, offers: DataFrame) -> DataFrame:
    """Drop unnumbered discount lines whose amount the offer's totals already carry."""
    totals = offers.select(
        "offer_id",
        F.when(F.col("kind") != "statement", F.col("preisnachlass")).alias("_discount"),
        F.when(F.col("kind") != "statement", F.col("nettosumme") - F.col("sonderpreis")).alias("_reduction"),
    )
    amount = -F.col("line_total_net")

    def stated(col: str) -> Column:
        return F.coalesce(F.abs(amount - F.col(col)) <= F.lit(fx.CENT_TOLERANCE).cast("decimal(18,2)"), F.lit(False))

    numbered = strip(F.col("pos")).rlike(r"^\d")
    labelled = F.concat_ws(" ", "pos", "description").rlike(fx.DISCOUNT_LABEL)
    repeated = (F.col("line_total_net") < 0) & ~numbered & labelled & (stated("_discount") | stated("_reduction"))
    return (
        positions.join(totals, "offer_id", "left")
        .where(~F.coalesce(repeated, F.lit(False)))
        .select(*positions.columns)
    )


def strip_placeholder_recipient(df: DataFrame, fields: list[str]) -> DataFrame:
    """Null out fields that only hold a masking placeholder."""
    return df.withColumns({f: F.when(~F.upper(f).contains("[KUNDE"), F.col(f)) for f in fields})


def fix_vendor_is_recipient(invoices: DataFrame, projects: DataFrame) -> DataFrame:
    """Where the vendor shares a token with the recipient or client, take the vendor from the
    file name, unless that is the recipient as well."""
    clients = projects.select("project_id", vendor_set(F.col("client_name")).alias("_client"))
    df = invoices.join(clients, "project_id", "left").withColumns({
        "_vendor": vendor_set(F.col("vendor_name")),
        "_recipient": vendor_set(F.col("recipient_name")),
        "_hint": vendor_from_filename(F.col("source_name")),
    }).withColumn("_hint_set", vendor_set(F.col("_hint")))

    def is_recipient(tokens: str) -> Column:
        return share_token(F.col(tokens), F.col("_recipient")) | share_token(F.col(tokens), F.col("_client"))

    replace = is_recipient("_vendor") & F.col("_hint").isNotNull() & ~is_recipient("_hint_set")
    return df.withColumns({
        "vendor_name": F.when(replace, F.col("_hint")).otherwise(F.col("vendor_name")),
        "vendor_from_filename": replace,
        "vendor_evidence_status": F.when(replace, F.lit("from-filename")),
    }).drop("_client", "_vendor", "_recipient", "_hint", "_hint_set")


def validate_fields(df: DataFrame, expected: dict) -> DataFrame:
    """Checks of regex-extracted fields against the expected company, address, date range and
    closing amount. Needs ``text`` and the struct ``fields`` of ``extract_fields_regex``."""
    from costproof.functions.german import de_date

    start, end = (F.lit(d).cast("date") for d in expected["date_range"])
    dates = F.transform(F.col("fields.dates"), de_date)
    amounts = F.col("fields.amounts")
    return df.withColumns({
        "company_valid": F.contains(F.col("text"), F.lit(expected["company"])),
        "address_valid": F.col("fields.address") == F.lit(expected["address"]),
        "date_range_valid": F.coalesce(F.exists(dates, lambda d: d.between(start, end)), F.lit(False)),
        "last_amount_valid": F.when(F.size(amounts) == 0, F.lit(False)).otherwise(
            F.try_element_at(amounts, F.lit(-1)) == F.lit(expected["last_amount"]).cast("decimal(18,2)")),
        "number_found": F.col("fields.invoice_number") != F.lit("Not Found"),
    })
