"""Per-document reconciliation: stated totals against sums, amounts against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from costproof import fixed_values as fx
from costproof.functions.vendor import share_token, vendor_set

MONEY = "decimal(18,2)"
TOLERANCE = F.lit


def _dec(value: str) -> Column:
    return F.lit(value).cast("decimal(18,4)")


def _text(col: Column) -> Column:
    return col.cast("string")


def flag_list(*flags: Column) -> Column:
    """The flags that apply, in the order given."""
    return F.array_compact(F.array(*flags))


def invoice_position_check(invoices: DataFrame, positions: DataFrame) -> DataFrame:
    """Sum of the line items against the stated net total, or the cumulative one if nearer.

    The lines are summed per invoice before the join, with partial sums on the map side, so
    one invoice with very many lines costs one row per input partition.
    """
    sums = positions.groupBy("invoice_id").agg(
        F.sum("line_total_net").alias("actual"), F.count(F.lit(1)).alias("n_positions")
    )
    df = invoices.select("project_id", "invoice_id", "netto", "brutto", "cumulative_netto").join(sums, "invoice_id", "left")
    actual = F.coalesce("actual", F.lit(0)).cast("decimal(28,2)")
    has_lines = F.col("n_positions").isNotNull()
    off_net, off_cumulative = F.abs(actual - F.col("netto")), F.abs(actual - F.col("cumulative_netto"))
    cumulative_nearer = F.coalesce(has_lines & (off_cumulative < off_net), F.lit(False))
    expected = F.when(cumulative_nearer, F.col("cumulative_netto")).otherwise(F.col("netto"))
    diff = F.abs(actual - expected)
    label = F.when(cumulative_nearer, "Gesamt-Netto (Schlussrechnung)").otherwise("Netto")
    passed = has_lines & (diff <= _dec(fx.CENT_TOLERANCE))
    gross = F.when(F.abs(actual - F.col("brutto")) <= _dec(fx.CENT_TOLERANCE),
                   " — Σ entspricht dem BRUTTO-Betrag: Positionen wurden brutto erfasst").otherwise("")
    message = (
        F.when(~has_lines, "keine Positionen extrahiert — Zeilensummen-Abgleich nicht möglich")
        .when(~passed, F.concat(F.lit("Σ Positionen = "), _text(actual), F.lit(" weicht von "), label,
                                F.lit(" lt. Dokument = "), _text(expected), F.lit(" um "), _text(diff), F.lit(" ab"), gross))
    )
    return df.select("project_id", "invoice_id", expected.alias("expected"), actual.alias("actual"),
                     passed.alias("passed"), message.alias("message"))


def offer_sums(positions: DataFrame) -> DataFrame:
    """Per offer the binding total and the total with priced options."""
    zero = F.lit(0).cast("decimal(28,2)")
    return positions.groupBy("offer_id").agg(
        F.coalesce(F.sum(F.when(~F.col("optional"), F.col("line_total_net"))), zero).alias("mandatory"),
        F.coalesce(F.sum("line_total_net"), zero).alias("with_optional"),
    )


def offer_totals(positions: DataFrame) -> DataFrame:
    return offer_sums(positions).select(
        "offer_id", F.col("with_optional").alias("positions_sum"), F.col("mandatory").alias("mandatory_positions_sum"))


def offer_cross_sum(offers: DataFrame, positions: DataFrame) -> DataFrame:
    """Stated net total of each offer against its lines; statements are not applicable."""
    df = offers.select("project_id", "offer_id", "kind", "nettosumme").join(offer_sums(positions), "offer_id", "left")
    zero = F.lit(0).cast("decimal(28,2)")
    mandatory, full = F.coalesce("mandatory", zero), F.coalesce("with_optional", zero)
    statement = F.col("kind") == "statement"
    expected = F.when(~statement, F.col("nettosumme"))
    has_optional = full != mandatory
    off_mandatory, off_full = F.abs(mandatory - expected), F.abs(full - expected)
    passed = F.coalesce(F.least(off_mandatory, off_full) <= _dec(fx.CENT_TOLERANCE), F.lit(False))
    message = (
        F.when(statement, F.concat(
            F.lit("Stellungnahme/Schätzung — kein Dokument-Gesamtbetrag zum Abgleich; Σ der gelisteten Positionen = "),
            _text(full), F.lit(" ist maßgeblich und manuell zu prüfen")))
        .when(expected.isNull(), "no Nettosumme found in document")
        .when(~passed & has_optional, F.concat(
            F.lit("Sigma(mandatory)="), _text(mandatory), F.lit(" (diff "), _text(off_mandatory),
            F.lit(") and Sigma(incl. optional)="), _text(full), F.lit(" (diff "), _text(off_full),
            F.lit(") both differ from Nettosumme="), _text(expected)))
        .when(~passed, F.concat(F.lit("Sigma(positions)="), _text(mandatory), F.lit(" differs from Nettosumme="),
                                _text(expected), F.lit(" by "), _text(off_mandatory)))
    )
    return df.select(
        "project_id", "offer_id", expected.alias("expected"),
        F.when(statement, full).otherwise(mandatory).alias("actual"),
        F.when(~statement & has_optional, full).alias("actual_incl_optional"),
        passed.alias("passed"), statement.alias("not_applicable"), message.alias("message"),
    )


def statement_cross_sum(offers: DataFrame, positions: DataFrame) -> DataFrame:
    return offer_cross_sum(offers.where(F.col("kind") == "statement"), positions)


def invoice_amount_check(invoices: DataFrame) -> DataFrame:
    """Net, VAT and gross against each other, sign against type, final against advances."""
    net, gross, vat, pct = (F.col(c) for c in ("netto", "brutto", "mwst_amount", "mwst_pct"))
    cumulative, advances = F.col("cumulative_netto"), F.col("deducted_advances_netto")
    tol = _dec(fx.CENT_TOLERANCE)
    untaxed = F.col("vat_status").isin("tax_free", "reverse_charge")
    credit = F.col("invoice_type") == "gutschrift"
    expected_vat = F.bround(net * pct / F.lit(100), 2)

    def when(cond: Column, *parts) -> Column:
        return F.when(cond, F.concat(*[F.lit(p) if isinstance(p, str) else _text(p) for p in parts]))

    problems = flag_list(
        when(untaxed & (F.abs(gross - net) > tol), "steuerfrei/§13b, aber Brutto ", gross, " ≠ Netto ", net),
        when(~untaxed & (F.abs(net + vat - gross) > tol), "Netto ", net, " + MwSt ", vat, " ≠ Brutto ", gross),
        when(~untaxed & (F.abs(expected_vat - vat) > _dec(fx.VAT_TOLERANCE)),
             "MwSt ", vat, " ≠ Netto × ", pct, " % = ", expected_vat.cast("decimal(18,2)")),
        when(~untaxed & gross.isNull() & vat.isNull() & (F.col("vat_status") != "unclear"),
             "weder Brutto noch MwSt-Betrag zum Gegenprüfen vorhanden"),
        when(credit & (net > 0), "Gutschrift mit positivem Netto ", net),
        when(~credit & (net < 0), "negatives Netto ", net, " ohne Gutschrift-Kennzeichnung"),
        when(F.abs(cumulative - advances - net) > tol, "Schlussrechnung: Gesamt ", cumulative, " − Abschläge ",
             advances, " ≠ Restbetrag ", net),
    )
    return invoices.withColumn("problems", problems).withColumns({
        "amount_passed": F.size("problems") == 0,
        "amount_message": F.when(F.size("problems") > 0, F.array_join("problems", "; ")),
    })


def adopt_retry(first: DataFrame, retry: DataFrame, key: str, check: str = "passed", method: str = "extraction_method") -> DataFrame:
    """The second reading of a document, if the first failed its check and the second passes."""
    second = retry.select(F.col(key), F.struct(*[c for c in first.columns if c != key]).alias("_retry"))
    df = first.join(second, key, "left")
    adopt = ~F.coalesce(F.col(check), F.lit(False)) & F.coalesce(F.col("_retry")[check], F.lit(False))
    df = df.withColumn("_adopt", adopt)
    columns = [F.when(F.col("_adopt"), F.col("_retry")[c]).otherwise(F.col(c)).alias(c) for c in first.columns if c not in (key, method)]
    return df.select(key, *columns,
                     F.when(F.col("_adopt"), F.concat(method, F.lit("+retry"))).otherwise(F.col(method)).alias(method))


def recipient_check(invoices: DataFrame, projects: DataFrame) -> DataFrame:
    """Whether the billed party is the client: the local check if there was one, else shared
    tokens; null without a client or a recipient."""
    clients = projects.select(
        "project_id", F.col("client_name").alias("_client_name"),
        vendor_set(F.concat_ws(" ", "client_name", "client_address")).alias("_want"),
    )
    recipient = F.when(F.col("recipient_address").isNull(), F.col("recipient_name")).otherwise(
        F.concat_ws(" ", F.coalesce("recipient_name", F.lit("")), "recipient_address"))
    df = invoices.join(clients, "project_id", "left")
    named = F.nullif(recipient, F.lit(""))
    by_tokens = F.when(named.isNotNull(), share_token(F.col("_want"), vendor_set(named)))
    has_client = F.col("_client_name").isNotNull()
    return df.withColumns({
        "has_client": has_client,
        "recipient_ok": F.when(has_client, F.coalesce("recipient_local_ok", by_tokens)),
    }).drop("_client_name", "_want")


def missing_program_fields(meta: DataFrame) -> DataFrame:
    """Programme parameters a funding computation cannot do without."""
    missing = flag_list(
        F.when(F.col("program_type") == "unclear", "Programmtyp (EH/EM)"),
        F.when(F.col("vorgangsnummer").isNull(), "Vorgangsnummer"),
        F.when(F.col("antrag_date").isNull(), "Antragsdatum"),
        F.when(F.col("client_basis") == "unclear", "Brutto/Netto-Basis (privat/Unternehmen)"),
        F.when(F.col("geplante_kosten_massnahmen").isNull(), "geplante förderfähige Kosten"),
        F.when(F.col("foerdersatz_pct").isNull(), "Fördersatz"),
    )
    return meta.withColumn("missing", missing)
