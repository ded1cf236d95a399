"""Cost tables, category sums and vendor ratios from offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from costproof import fixed_values as fx
from costproof.functions.german import format_date, format_de, format_pages, strip
from costproof.operators.checks import offer_cross_sum

ZERO = "0"


def _if(category: str, amount: str = "line_total_net") -> Column:
    return F.when(F.col("kategorie") == category, F.col(amount)).otherwise(F.lit(0).cast("decimal(18,2)"))


def _ratio(part: Column, base: Column) -> Column:
    # DECIMAL(18,2) operands keep 20 digits in the quotient; wider ones would leave 10.
    quotient = part.cast("decimal(18,2)") / F.nullif(base, F.lit(0)).cast("decimal(18,2)")
    return F.when(base == 0, F.lit(0)).otherwise(quotient).cast("decimal(38,20)")


def cost_table(offers: DataFrame, positions: DataFrame) -> DataFrame:
    """Position rows and one total row per offer from a single pass over the lines."""
    split = positions.select(
        "offer_id", "pos_seq", "pos", "description", "line_total_net",
        F.when(F.col("line_total_net").isNotNull(), _if("investitionskosten")).alias("ik"),
        F.when(F.col("line_total_net").isNotNull(), _if("nebenkosten")).alias("nk"),
        F.when(F.col("line_total_net").isNotNull(), _if("nachlass")).alias("nachlass"),
    )
    zero = F.lit(0).cast("decimal(28,2)")
    totals = split.groupBy("offer_id").agg(
        *[F.coalesce(F.sum(c), zero).alias(c) for c in ("line_total_net", "ik", "nk")]
    )
    checks = offer_cross_sum(offers, positions).select("offer_id", "passed", "not_applicable")
    total_rows = totals.join(checks, "offer_id").select(
        "offer_id", F.lit("total").alias("row_kind"), F.lit(None).cast("bigint").alias("pos_seq"),
        F.lit(None).cast("string").alias("pos"), F.lit("Σ").alias("description"),
        "line_total_net", "ik", "nk", (F.col("line_total_net") - F.col("ik") - F.col("nk")).cast("decimal(28,2)").alias("nachlass"),
        F.when(F.col("line_total_net") != 0, _ratio(F.col("ik"), F.col("line_total_net"))).alias("share_ik"),
        F.when(F.col("line_total_net") != 0, _ratio(F.col("nk"), F.col("line_total_net"))).alias("share_nk"),
        (~F.col("passed") & ~F.col("not_applicable")).alias("cross_sum_failed"),
    )
    position_rows = split.select(
        "offer_id", F.lit("position").alias("row_kind"), "pos_seq", "pos", "description",
        *[F.col(c).cast("decimal(28,2)").alias(c) for c in ("line_total_net", "ik", "nk", "nachlass")],
        *[F.lit(None).cast("decimal(38,20)").alias(c) for c in ("share_ik", "share_nk")],
        F.lit(None).cast("boolean").alias("cross_sum_failed"),
    )
    return position_rows.unionByName(total_rows)


def effective_special_price(offers: DataFrame) -> DataFrame:
    """The negotiated price, stated or by discount; null unless positive."""
    by_discount = F.when(F.col("preisnachlass") != 0, F.col("nettosumme") - F.col("preisnachlass"))
    price = F.coalesce(F.col("sonderpreis"), by_discount).cast("decimal(18,2)")
    return offers.withColumn("effective_price", F.when(price > 0, price))


def category_subtotals(positions: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("decimal(28,2)")
    return positions.groupBy("offer_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("kategorie") == k, F.col("line_total_net"))), zero).alias(k)
          for k in ("investitionskosten", "nebenkosten", "nachlass")]
    )


def narrative_sentence(opening: str, amount: Column, items: Column, source: Column, pages: Column) -> Column:
    """``Die … beinhalten … (s. Anlage …)``; the amount only when positive, null without items."""
    cited = format_pages(pages)
    citation = F.concat(F.lit("(s. Anlage "), source, F.when(cited != "", F.concat(F.lit(", "), cited)).otherwise(""), F.lit(")"))
    sum_text = F.when(amount > 0, F.concat(F.lit(" "), format_de(amount), F.lit(" €"))).otherwise("")
    sentence = F.concat(F.lit(opening), sum_text, F.lit(" beinhalten "), strip(items), F.lit(" "), citation)
    return F.when(strip(items) != "", sentence)


def category_narrative(narratives: DataFrame, positions: DataFrame) -> DataFrame:
    """Both cost paragraphs of an offer. ``narratives``: offer_id, source_name, ik_items,
    ik_pages, nk_items, nk_pages."""
    df = narratives.join(category_subtotals(positions), "offer_id", "left")
    zero = F.lit(0).cast("decimal(28,2)")
    return df.select(
        "offer_id",
        narrative_sentence("Die Investitionskosten", F.coalesce("investitionskosten", zero), F.col("ik_items"),
                           F.col("source_name"), F.col("ik_pages")).alias("ik_text"),
        narrative_sentence("Die Nebenkosten", F.coalesce("nebenkosten", zero), F.col("nk_items"),
                           F.col("source_name"), F.col("nk_pages")).alias("nk_text"),
    )


def ratios_from_offers(offers: DataFrame, positions: DataFrame) -> DataFrame:
    """Vendor blocks from live offers: category sums and the IK/NK shares of their sum."""
    zero = F.lit(0).cast("decimal(28,2)")
    sums = positions.groupBy("offer_id").agg(
        F.coalesce(F.sum("line_total_net"), zero).alias("gesamt"),
        F.coalesce(F.sum(F.when(F.col("kategorie") == "investitionskosten", F.col("line_total_net"))), zero).alias("ik"),
        F.coalesce(F.sum(F.when(F.col("kategorie") == "nebenkosten", F.col("line_total_net"))), zero).alias("nk"),
    )
    df = offers.join(sums, "offer_id", "left").withColumns({c: F.coalesce(c, zero) for c in ("gesamt", "ik", "nk")})
    base = F.col("ik") + F.col("nk")
    return df.select(
        "project_id", F.col("seq").alias("block_seq"), F.coalesce("vendor_short", "vendor_name").alias("vendor"),
        F.col("vendor_name").alias("header"), _ratio(F.col("ik"), base).alias("anteil_ik"),
        _ratio(F.col("nk"), base).alias("anteil_nk"), F.col("ik").alias("beantragt_ik"), F.col("nk").alias("beantragt_nk"),
        "gesamt", "sonderpreis", F.lit("live-extraction").alias("source"), (F.col("kind") == "statement").alias("statement"),
    )


def resolve_ratio_source(sheet_blocks: DataFrame, live_blocks: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, source per project). A verified sheet wins over live offers; of several sheets
    the first by path that yields blocks. ``sheet_blocks`` carry a ``sheet_path``."""
    sheets = sheet_blocks.where(F.lower("sheet_path").contains("kostenaufstellung"))
    first = sheets.groupBy("project_id").agg(F.min("sheet_path").alias("sheet_path"))
    from_sheet = sheets.join(first, ["project_id", "sheet_path"], "left_semi").withColumn(
        "ratio_source", F.concat(F.lit("pdf:"), F.element_at(F.split("sheet_path", "/"), -1))).drop("sheet_path")
    live = live_blocks.join(first, "project_id", "left_anti").withColumn("ratio_source", F.lit("live-extraction"))
    blocks = from_sheet.unionByName(live, allowMissingColumns=True)
    per_project = blocks.groupBy("project_id").agg(F.min("ratio_source").alias("ratio_source"))
    sources = projects.select("project_id").join(per_project, "project_id", "left").select(
        "project_id", F.coalesce("ratio_source", F.lit("none")).alias("ratio_source"))
    return blocks, sources


def offer_report_labels(offers: DataFrame, positions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block header and cross-sum warning per offer, label per position)."""
    df = offers.join(offer_cross_sum(offers, positions).drop("project_id"), "offer_id")
    vendor = F.coalesce("vendor_short", "vendor_name")
    date = format_date(F.col("offer_date"))
    header = F.when(
        F.col("kind") == "statement",
        F.concat(F.lit("SOLL: SCHÄTZUNG lt. Stellungnahme "), vendor, F.lit(" vom "), date, F.lit(" (kein Angebot, netto angenommen)")),
    ).otherwise(F.concat(F.lit("SOLL: "), vendor, F.lit(" Angebot "), F.col("offer_number"), F.lit(" vom "), date))
    title = F.when(F.col("title").isNotNull(), F.concat(F.lit(", "), F.col("title"))).otherwise("")
    full_nearer = F.abs(F.col("actual_incl_optional") - F.col("expected")) < F.abs(F.col("actual") - F.col("expected"))
    actual = F.when(full_nearer, F.col("actual_incl_optional")).otherwise(F.col("actual"))
    failed = ~F.col("passed") & ~F.col("not_applicable")
    warning = F.when(
        failed & F.col("expected").isNull(),
        F.concat(F.lit("⚠ KREUZSUMME NICHT PRÜFBAR: keine Nettosumme im Dokument gefunden — Σ Positionen = "),
                 format_de(F.col("actual")), F.lit(" € manuell gegen das PDF prüfen")),
    ).when(
        failed,
        F.concat(F.lit("⚠ KREUZSUMME WEICHT AB: Σ Positionen = "), format_de(actual), F.lit(" € vs. Nettosumme lt. Dokument = "),
                 format_de(F.col("expected")), F.lit(" € (Differenz "), format_de(actual - F.col("expected")),
                 F.lit(" €) — Positionen manuell gegen das PDF prüfen")),
    )
    blocks = df.select("offer_id", F.concat(header, title).alias("header"), warning.alias("warning"))
    unmarked = F.col("optional") & ~F.contains(F.lower("description"), F.lit("option"))
    labels = positions.select(
        "offer_id", "pos_seq",
        F.when(unmarked, F.concat("description", F.lit(" (optional)"))).otherwise(F.col("description")).alias("label"))
    return blocks, labels
