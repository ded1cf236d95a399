"""Cross-industry e-invoices (CII XML, two dialects) as invoice and position tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from costproof import fixed_values as fx

_PARTY = "struct<Name:string,PostalTradeAddress:struct<LineOne:string,PostcodeCode:string,CityName:string>>"
_AGREEMENT = f"struct<SellerTradeParty:{_PARTY},BuyerTradeParty:{_PARTY}>"
_SUMS = "struct<LineTotalAmount:string,ChargeTotalAmount:string,AllowanceTotalAmount:string,TaxBasisTotalAmount:string,TaxTotalAmount:string,GrandTotalAmount:string>"
_TAX = "array<struct<RateApplicablePercent:string,ApplicablePercent:string>>"
_ALLOWANCE = "array<struct<ChargeIndicator:struct<Indicator:string>,ActualAmount:string,Reason:string>>"
_SETTLEMENT = (f"struct<ApplicableTradeTax:{_TAX},SpecifiedTradeAllowanceCharge:{_ALLOWANCE},"
               f"SpecifiedTradeSettlementHeaderMonetarySummation:{_SUMS},SpecifiedTradeSettlementMonetarySummation:{_SUMS}>")
_QUANTITY = "struct<BilledQuantity:struct<_VALUE:string,_unitCode:string>>"
_LINE_SUM = "struct<SpecifiedTradeSettlementLineMonetarySummation:struct<LineTotalAmount:string>,SpecifiedTradeSettlementMonetarySummation:struct<LineTotalAmount:string>>"
_LINE = (f"array<struct<AssociatedDocumentLineDocument:struct<LineID:string>,SpecifiedTradeProduct:struct<Name:string>,SpecifiedLineTradeDelivery:{_QUANTITY},"
         f"SpecifiedSupplyChainTradeDelivery:{_QUANTITY},SpecifiedLineTradeSettlement:{_LINE_SUM},SpecifiedSupplyChainTradeSettlement:{_LINE_SUM}>>")
_DOCUMENT = "struct<ID:string,TypeCode:string,IssueDateTime:struct<DateTimeString:string>>"
_TRADE = (f"struct<IncludedSupplyChainTradeLineItem:{_LINE},ApplicableHeaderTradeAgreement:{_AGREEMENT},ApplicableSupplyChainTradeAgreement:{_AGREEMENT},"
          f"ApplicableHeaderTradeSettlement:{_SETTLEMENT},ApplicableSupplyChainTradeSettlement:{_SETTLEMENT}>")
CII_SCHEMA = (f"ExchangedDocument {_DOCUMENT}, HeaderExchangedDocument {_DOCUMENT}, SupplyChainTradeTransaction {_TRADE}, SpecifiedSupplyChainTradeTransaction {_TRADE}")


def _txt(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def _num(col: Column) -> Column:
    return F.trim(col).try_cast("decimal(18,2)")


def _address(party: Column) -> Column:
    postal = party["PostalTradeAddress"]
    town = F.nullif(F.concat_ws(" ", _txt(postal["PostcodeCode"]), _txt(postal["CityName"])), F.lit(""))
    return F.nullif(F.concat_ws(", ", _txt(postal["LineOne"]), town), F.lit(""))


def read_cii_invoices(docs: DataFrame, xml: str = "xml") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(invoices, positions, rejected) from e-invoice XML, whatever its namespace prefixes.

    Document allowances and charges become positions, and so does what the summation states
    beyond them, so positions add up to the net total. Without vendor, number, date or net total
    a document is rejected. ``docs``: doc_id and the XML text.
    """
    # inline parses a document once; a filter on its fields would otherwise parse it again for each of them.
    parsed = docs.select("doc_id", F.inline(F.array(F.from_xml(xml, CII_SCHEMA, {"ignoreNamespace": "true", "mode": "PERMISSIVE"}))))
    head = parsed.select(
        "doc_id", F.coalesce("ExchangedDocument", "HeaderExchangedDocument").alias("h"),
        F.coalesce("SupplyChainTradeTransaction", "SpecifiedSupplyChainTradeTransaction").alias("t")).select(
        "doc_id", "h", "t", F.coalesce("t.ApplicableHeaderTradeAgreement", "t.ApplicableSupplyChainTradeAgreement").alias("a"),
        F.coalesce("t.ApplicableHeaderTradeSettlement", "t.ApplicableSupplyChainTradeSettlement").alias("s")).withColumn(
        "sums", F.coalesce("s.SpecifiedTradeSettlementHeaderMonetarySummation", "s.SpecifiedTradeSettlementMonetarySummation"))
    digits = F.left(F.replace(F.trim("h.IssueDateTime.DateTimeString"), F.lit("-"), F.lit("")), F.lit(8))
    rates = F.filter(F.transform("s.ApplicableTradeTax", lambda t: _num(F.coalesce(t["RateApplicablePercent"], t["ApplicablePercent"]))), lambda r: r.isNotNull())
    codes = F.create_map(*[F.lit(v) for pair in fx.TYPE_CODES.items() for v in pair])
    # A stated basis of zero counts as not stated.
    net = F.coalesce(F.nullif(_num(F.col("sums.TaxBasisTotalAmount")), F.lit(0).cast("decimal(18,2)")), _num(F.col("sums.LineTotalAmount")))
    flat = head.select(
        "doc_id", _txt(F.col("a.SellerTradeParty.Name")).alias("vendor_name"), _address(F.col("a.SellerTradeParty")).alias("vendor_address"),
        _txt(F.col("a.BuyerTradeParty.Name")).alias("recipient_name"), _address(F.col("a.BuyerTradeParty")).alias("recipient_address"),
        _txt(F.col("h.ID")).alias("invoice_number"), F.when(digits.rlike(r"^\d{8}$"), F.try_to_date(digits, "yyyyMMdd")).alias("invoice_date"),
        F.coalesce(F.try_element_at(codes, F.coalesce(_txt(F.col("h.TypeCode")), F.lit("380"))), F.lit("rechnung")).alias("invoice_type"),
        net.alias("netto"), F.try_element_at(rates, F.lit(1)).cast("decimal(5,2)").alias("mwst_pct"),
        _num(F.col("sums.TaxTotalAmount")).alias("mwst_amount"), _num(F.col("sums.GrandTotalAmount")).alias("brutto"),
        F.col("t.IncludedSupplyChainTradeLineItem").alias("lines"), F.col("s.SpecifiedTradeAllowanceCharge").alias("charges"),
        (F.coalesce(_num(F.col("sums.ChargeTotalAmount")), F.lit(0)) - F.coalesce(_num(F.col("sums.AllowanceTotalAmount")), F.lit(0))).alias("stated_extra"))
    untaxed = (F.col("mwst_amount") == 0) & (F.col("brutto") == F.col("netto"))
    vat = F.when(F.col("mwst_pct") == 19, "standard").when(F.col("mwst_pct") == 7, "reduced").when(untaxed, "tax_free").otherwise("unclear")
    flat = flat.withColumn("vat_status", vat)
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in ("vendor_name", "invoice_number", "invoice_date", "netto")]))
    judged = flat.withColumn("missing", missing)
    good = judged.where(F.size("missing") == 0)
    rejected = judged.where(F.size("missing") > 0).select("doc_id", F.array_join("missing", ", ").alias("missing"))

    def row(pos: Column, name: Column, qty: Column, unit: Column, total: Column) -> Column:
        return F.struct(pos.alias("pos"), name.alias("description"), qty.alias("qty"), unit.alias("unit"), total.cast("decimal(18,2)").alias("line_total_net"))

    none_d, none_s = F.lit(None).cast("decimal(18,2)"), F.lit(None).cast("string")

    def line(l: Column) -> Column:
        quantity = F.coalesce(l["SpecifiedLineTradeDelivery"], l["SpecifiedSupplyChainTradeDelivery"])["BilledQuantity"]
        sums = F.coalesce(l["SpecifiedLineTradeSettlement"], l["SpecifiedSupplyChainTradeSettlement"])
        total = F.coalesce(sums["SpecifiedTradeSettlementLineMonetarySummation"]["LineTotalAmount"], sums["SpecifiedTradeSettlementMonetarySummation"]["LineTotalAmount"])
        return row(F.coalesce(_txt(l["AssociatedDocumentLineDocument"]["LineID"]), F.lit("")), F.coalesce(_txt(l["SpecifiedTradeProduct"]["Name"]), F.lit("(ohne Bezeichnung)")),
                   _num(quantity["_VALUE"]), quantity["_unitCode"], _num(total))

    def charge(c: Column) -> Column:
        plus = F.lower(F.coalesce(_txt(c["ChargeIndicator"]["Indicator"]), F.lit("false"))).isin("true", "1")
        amount = _num(c["ActualAmount"])
        name = F.coalesce(_txt(c["Reason"]), F.when(plus, "Zuschlag lt. E-Rechnung").otherwise("Nachlass lt. E-Rechnung"))
        return row(F.lit(""), name, none_d, none_s, F.when(plus, amount).otherwise(-amount))

    empty = F.slice(F.array(row(none_s, none_s, none_d, none_s, none_d)), 1, 0)
    billed = F.filter(F.coalesce(F.transform("lines", line), empty), lambda r: r["line_total_net"].isNotNull())
    extras = F.filter(F.coalesce(F.transform("charges", charge), empty), lambda r: F.coalesce(r["line_total_net"] != 0, F.lit(False)))
    covered = F.aggregate("_extras", F.lit(0).cast("decimal(28,2)"), lambda acc, r: (acc + r["line_total_net"]).cast("decimal(28,2)"))
    rest = F.col("stated_extra") - covered
    remainder = F.when(F.abs(rest) > F.lit("0.005").cast("decimal(5,4)"), F.array(row(
        F.lit(""), F.when(rest < 0, "Nachlass lt. E-Rechnung").otherwise("Zuschlag lt. E-Rechnung"), none_d, none_s, rest))).otherwise(empty)
    rows = good.withColumn("_billed", billed).withColumn("_extras", extras).withColumn("_all", F.concat("_billed", "_extras", remainder))
    positions = rows.select("doc_id", F.posexplode("_all").alias("at", "p")).select("doc_id", (F.col("at") + 1).cast("bigint").alias("pos_seq"), "p.*")
    return good.drop("lines", "charges", "stated_extra", "missing"), positions, rejected
