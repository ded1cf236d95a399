"""Explicit schemas of the JSON sources."""

from __future__ import annotations

from pyspark.sql.types import StructType

_POSITION = "pos string, artikelnummer string, description string, qty decimal(18,2), unit string, rabatt_pct decimal(5,2), unit_price_net decimal(18,2), line_total_net decimal(18,2), optional boolean, optional_reason string, kategorie string, source_page int"
_INVOICE_POSITION = "pos string, description string, qty decimal(18,2), unit string, unit_price_net decimal(18,2), line_total_net decimal(18,2), source_page int"

_INVOICE = f"""project_id bigint, invoice_id bigint, seq bigint, source_name string, vendor_name string, vendor_address string, recipient_name string, recipient_address string,
 invoice_number string, invoice_date date, order_ref string, order_date date, invoice_type string, subject string, netto decimal(18,2), mwst_pct decimal(5,2), mwst_amount decimal(18,2),
 brutto decimal(18,2), vat_status string, skonto_pct decimal(5,2), skonto_deadline date, cumulative_netto decimal(18,2), deducted_advances_netto decimal(18,2), extraction_method string,
 positions array<struct<{_INVOICE_POSITION.replace(' string', ':string').replace(' decimal', ':decimal').replace(' int', ':int')}>>"""

_OFFER = f"""project_id bigint, offer_id bigint, seq bigint, source_name string, vendor_name string, vendor_short string, offer_number string, offer_date date, title string, doc_type string,
 nettosumme decimal(18,2), mwst_pct decimal(5,2), mwst_amount decimal(18,2), endbetrag decimal(18,2), sonderpreis decimal(18,2), preisnachlass decimal(18,2),
 positions array<struct<{_POSITION.replace(' string', ':string').replace(' decimal', ':decimal').replace(' boolean', ':boolean').replace(' int', ':int')}>>"""

_EXTRACTIONS = {
    "invoice": (_INVOICE, ["invoice_id", "vendor_name", "invoice_number", "invoice_date", "netto"]),
    "offer": (_OFFER, ["offer_id", "vendor_name", "offer_number", "offer_date"]),
}

_PROJECT = (
    "project_id bigint, client_name string, client_address string, bewilligungszeitraum_start date, bewilligungszeitraum_end date, antragstellung date, aavm_genehmigung date, "
    "bescheid_eingegangen date, bescheid_datiert date, kennung string, passwort string, iban string, steuernummer string, foerderbetrag decimal(18,2), "
    "kostendeckel_foerderanteil decimal(5,4), agvo_referenzkosten decimal(18,2)")

_AUDIT = "ts string, job string, procedure string, event string, message string, file string, status string, verified boolean"


def extraction(kind: str) -> tuple[StructType, list[str]]:
    """Schema of an extracted record and its mandatory columns. Needs a running session."""
    ddl, required = _EXTRACTIONS[kind]
    return StructType.fromDDL(ddl), required


def project() -> StructType:
    return StructType.fromDDL(_PROJECT)


def audit() -> StructType:
    return StructType.fromDDL(_AUDIT)
