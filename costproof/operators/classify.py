"""Document classes and routing by name, folder and first page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from costproof import fixed_values as fx
from costproof.functions.text import file_stem, file_suffix
from costproof.functions.vendor import is_own_company


def class_by_name(name: Column) -> Column:
    """The class a name alone decides, or null. The order of the tests is part of the rule."""
    return (
        F.when(name.rlike(fx.ANTRAG_NAME), "antragsbestaetigung")
        .when(name.rlike(fx.BESCHEID_NAME), "zuwendungsbescheid")
        .when(name.rlike(fx.ZAHLUNG_NAME), "zahlungsnachweis")
        .when(name.rlike(fx.OTHER_NAME) & ~name.rlike(fx.INVOICE_NAME), "other")
        .when(name.rlike(fx.INVOICE_NAME), "invoice")
        .when(name.rlike(fx.OFFER_NAME), "offer")
    )


def class_by_text(text: Column) -> Column:
    return (
        F.when(text.rlike(fx.ANTRAG_TEXT), "antragsbestaetigung")
        .when(text.rlike(fx.BESCHEID_TEXT), "zuwendungsbescheid")
        .when(text.rlike(fx.ZAHLUNG_TEXT), "zahlungsnachweis")
        .when(text.rlike(fx.INVOICE_TEXT), "invoice")
        .when(text.rlike(fx.OTHER_TEXT), "other")
        .when(text.rlike(fx.OFFER_TEXT), "offer")
    )


def is_image(name: Column) -> Column:
    return file_suffix(name).isin(fx.IMAGE_SUFFIXES)


def is_candidate(name: Column) -> Column:
    """PDF or image, neither hidden nor a lock file."""
    hidden = name.startswith(".") | name.startswith("~") | name.contains(".~lock")
    return ~hidden & file_suffix(name).isin([".pdf", *fx.IMAGE_SUFFIXES])


def classify_images(manifest: DataFrame) -> DataFrame:
    """Images prove a payment when folder or name says so; everything else is other."""
    paid = F.concat_ws(" ", "parent_name", "name").rlike(fx.ZAHLUNG_NAME)
    return manifest.withColumns({
        "doc_class": F.when(paid, "zahlungsnachweis").otherwise("other"),
        "reason": F.when(paid, "image in Zahlungsnachweis context").otherwise("image without payment-proof signal"),
    })


def classify_documents(manifest: DataFrame) -> DataFrame:
    """Class and reason for PDFs: file name, then folder, then first page, then invoice."""
    by_name = class_by_name(F.col("name"))
    folder = class_by_name(F.col("parent_name"))
    by_folder = F.when(folder.isin("zahlungsnachweis", "invoice"), folder)
    by_text = class_by_text(F.col("first_page_text"))
    hit = F.coalesce(
        F.when(by_name.isNotNull(), F.struct(by_name.alias("c"), F.lit("filename").alias("r"))),
        F.when(by_folder.isNotNull(), F.struct(by_folder.alias("c"), F.lit("parent folder name").alias("r"))),
        F.when(by_text.isNotNull(), F.struct(by_text.alias("c"), F.lit("first-page text").alias("r"))),
        F.struct(F.lit("invoice").alias("c"), F.lit("undecided — defaulted to invoice for review").alias("r")),
    )
    return manifest.withColumn("_hit", hit).withColumns({"doc_class": F.col("_hit.c"), "reason": F.col("_hit.r")}).drop("_hit")


def classify_files(manifest: DataFrame) -> DataFrame:
    """PDF and image rules together, over candidate files."""
    files = manifest.where(is_candidate(F.col("name")))
    images = classify_images(files.where(is_image(F.col("name"))))
    return classify_documents(files.where(~is_image(F.col("name")))).unionByName(images)


def offer_kind(offers: DataFrame, name: str = "source_name", doc_type: str = "doc_type") -> DataFrame:
    """A statement by file name, else what the extraction said."""
    statement = file_stem(F.col(name)).rlike(fx.STATEMENT_FILENAME)
    return offers.withColumn("kind", F.when(statement, "statement").otherwise(F.col(doc_type)))


def offer_inputs(classified: DataFrame) -> DataFrame:
    return classified.where((F.col("doc_class") == "offer") & (file_suffix(F.col("name")) == ".pdf"))


def ignored_documents(manifest: DataFrame, classified: DataFrame, used_classes: list[str]) -> DataFrame:
    """Every file a run does not use, with its class; files that were never classified too."""
    unused = classified.where(~F.col("doc_class").isin(used_classes)).select("project_id", "file_id", "name", "doc_class")
    hidden = F.col("name").startswith(".") | F.col("name").startswith("~") | F.col("name").contains(".~lock")
    unknown = (
        manifest.where(~hidden)
        .join(classified.select("project_id", "file_id"), ["project_id", "file_id"], "left_anti")
        .select("project_id", "file_id", "name", F.lit("unclassified").alias("doc_class"))
    )
    return unused.unionByName(unknown)


def is_statement_block(header: Column, statement: Column) -> Column:
    return F.coalesce(statement, F.lit(False)) | F.coalesce(header.rlike(fx.STATEMENT_BLOCK), F.lit(False))


def is_deduction_line(amount: Column, description: Column) -> Column:
    """A negative line that restates money already billed as an advance."""
    return F.coalesce((amount < 0) & description.rlike(fx.DEDUCTION_LINE), F.lit(False))


def label_trade_section(invoices: DataFrame, labels: DataFrame, own_pattern: str = fx.OWN_COMPANY) -> DataFrame:
    """Trade and section: own company and planners by name, the rest from supplied labels."""
    own = is_own_company(F.col("vendor_name"), own_pattern)
    text = F.concat_ws(" ", F.col("vendor_name"), F.coalesce("subject", F.lit("")))
    planner = text.rlike(fx.PLANNER)
    architect = text.rlike(fx.ARCHITECT)
    supplied = labels.select("invoice_id", F.col("trade").alias("_trade"), F.col("section").alias("_section"))
    return invoices.join(supplied, "invoice_id", "left").withColumns({
        "trade": F.when(own, "Energieberater").when(planner & architect, "Architekt / Bauleiter")
        .when(planner, "Fachplanung").otherwise(F.col("_trade")),
        "section": F.when(own | planner, "baubegleitung").otherwise(F.coalesce("_section", F.lit("massnahme"))),
    }).drop("_trade", "_section")
