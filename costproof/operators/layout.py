"""Cost sheets as printed lines or as rows: blocks, figures and positions.

A printed sheet is one text cell, so its lines never exceed a row; windows over one text are
bounded by that cell. Row sheets may be of any size and use bucketed carries instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from costproof import fixed_values as fx
from costproof.functions.german import money_token, money_tokens, strip
from costproof.scale import running_last

MONEY = "decimal(18,2)"


def vendor_from_header(header: Column) -> Column:
    """The vendor a block header names: before the offer word, else after the date, else all of it."""
    text = strip(header)
    before = F.regexp_replace(F.regexp_extract(text, fx.VENDOR_BEFORE_OFFER, 1), r"^[ ,;:]+|[ ,;:]+$", "")
    after = F.regexp_replace(F.regexp_extract(text, fx.VENDOR_AFTER_DATE, 1), r"^[ ,;:]+|[ ,;:]+$", "")
    vague = (before == "") | F.startswith(F.lower(before), F.lit("angebot"))
    return F.when(vague & text.rlike(fx.VENDOR_AFTER_DATE), after).when(before != "", before).otherwise(text)


def _dec(x: str) -> Column:
    return F.lit(x).cast("decimal(6,4)")


def choose_block_figures(blocks: DataFrame) -> DataFrame:
    """gesamt, ik, nk and sonderpreis of a block from its printed rows: the special-price row, then
    the sum row, each only if its parts add up and agree with the percent row; else the percent
    split; else everything is investment. Needs arrays totals, sonder_totals, pcts."""
    pct_base = F.try_element_at("pcts", F.lit(2)) + F.try_element_at("pcts", F.lit(3))
    pct = F.when((F.size("pcts") >= 3) & (pct_base > 0), F.element_at("pcts", F.lit(2)).cast(MONEY) / F.nullif(pct_base, F.lit(0)).cast(MONEY))

    def candidate(rows: str) -> Column:
        total, ik, nk = (F.try_element_at(rows, F.lit(i)) for i in (1, 2, 3))
        base = ik + nk
        agrees = F.when(pct.isNull(), True).when(base > 0, F.abs(ik.cast(MONEY) / F.nullif(base, F.lit(0)).cast(MONEY) - pct) <= _dec(fx.RATIO_AGREEMENT)).otherwise(False)
        fits = (F.size(rows) >= 3) & (total > 0) & (F.abs(base - total) <= _dec("0.05")) & agrees
        return F.when(F.coalesce(fits, F.lit(False)), F.struct(total.cast(MONEY).alias("gesamt"), ik.cast(MONEY).alias("ik"), nk.cast(MONEY).alias("nk")))

    first = F.try_element_at("totals", F.lit(1))
    split_ik = F.bround(first * pct.cast("decimal(20,18)"), 2).cast(MONEY)
    by_pct = F.when((F.size("totals") > 0) & pct.isNotNull(), F.struct(first.cast(MONEY).alias("gesamt"), split_ik.alias("ik"), (first - split_ik).cast(MONEY).alias("nk")))
    plain = F.when(F.size("totals") > 0, F.struct(first.cast(MONEY).alias("gesamt"), first.cast(MONEY).alias("ik"), F.lit(0).cast(MONEY).alias("nk")))
    chosen = F.coalesce(candidate("sonder_totals"), candidate("totals"), by_pct, plain)
    # inline drops blocks without figures and keeps the choice from being repeated in a filter.
    return blocks.select(
        *blocks.columns, F.inline(F.array_compact(F.array(chosen))), F.try_element_at("sonder_totals", F.lit(1)).alias("sonderpreis")).drop("totals", "sonder_totals", "pcts")


def _shares(df: DataFrame) -> DataFrame:
    base = F.col("ik") + F.col("nk")

    def share(c: str) -> Column:
        return F.when(base == 0, F.lit(0)).otherwise(F.col(c).cast(MONEY) / F.nullif(base, F.lit(0)).cast(MONEY)).cast("decimal(38,20)")

    return df.withColumns({"anteil_ik": share("ik"), "anteil_nk": share("nk")})


def _lines(docs: DataFrame) -> DataFrame:
    """Lines that print something. Texts are dealt before they are taken apart, so a few large input files keep no task busy
    alone, and the lines of a text need no shuffle of their own."""
    dealt = docs.select("doc_id", "text").repartition("doc_id")
    exploded = dealt.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return exploded.where(F.col("line").rlike(r"(?U)\S"))


def _along() -> tuple[WindowSpec, WindowSpec, WindowSpec]:
    """A text's lines in order, those so far and those before. All carries use this order, which is sorted once."""
    along = Window.partitionBy("doc_id").orderBy("line_no")
    return along, along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(Window.unboundedPreceding, -1)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``value`` as a column that a later filter does not compute again."""
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def _with_blocks(lines: DataFrame, is_position: Column) -> DataFrame:
    header = ~is_position & F.col("line").rlike(fx.BLOCK_HEADER)
    _, so_far, _ = _along()
    return lines.withColumn("is_header", header).withColumn("block_no", F.sum(F.col("is_header").cast("int")).over(so_far)).where(F.col("block_no") > 0)


def blocks_from_layout_lines(docs: DataFrame) -> DataFrame:
    """Vendor blocks of printed cost sheets (doc_id, text), figures chosen as above. The sum row
    is the last one with two amounts; without one, the last amount row before the first percent
    row counts."""
    _, so_far, before = _along()
    numbered = F.col("line").rlike(fx.NUMBERED_LINE)
    df = _with_blocks(_lines(docs), numbered)
    df = df.withColumns({"numbered": numbered, "text": strip(F.col("line"))})
    df = df.withColumns({"monies": money_tokens(F.col("text")), "found": money_tokens(F.col("text"), fx.PERCENT)})
    special = ~F.col("is_header") & F.col("text").rlike(fx.SPECIAL_PRICE_LINE)
    percent = ~F.col("is_header") & ~special & (F.size("found") >= 2)
    df = df.withColumn("kind", F.when(F.col("is_header"), "header").when(special, F.when(F.size("monies") > 0, "special").otherwise("skip")).when(percent, "percent"))
    pct_before = F.max(F.when(F.col("kind") == "percent", F.col("line_no"))).over(before) > F.max(F.when(F.col("is_header"), F.col("line_no"))).over(so_far)
    df = df.withColumn("pct_before", F.coalesce(pct_before, F.lit(False)))
    plain = F.col("kind").isNull() | ((F.col("kind") == "percent") & F.col("pct_before"))
    amounts = plain & ~F.col("numbered") & (F.size("monies") >= 2)
    df = df.withColumn("kind", F.when(amounts & F.col("text").rlike(fx.SUM_LINE), "sum").when(amounts, "amounts").otherwise(F.col("kind")))

    def last(cond: Column, value: str) -> Column:
        return F.max_by(F.when(cond, F.col(value)), F.when(cond, F.col("line_no")))

    empty = F.array().cast("array<decimal(18,2)>")
    first_pct = (F.col("kind") == "percent") & ~F.col("pct_before")
    blocks = df.groupBy("doc_id", "block_no").agg(
        F.min_by(F.when(F.col("is_header"), F.col("text")), F.when(F.col("is_header"), F.col("line_no"))).alias("header"),
        F.coalesce(last(F.col("kind") == "special", "monies"), empty).alias("sonder_totals"),
        last(first_pct, "found").alias("_pcts"),
        last(F.col("kind") == "sum", "monies").alias("_sum"),
        last(F.col("kind").isin("sum", "amounts") & ~F.col("pct_before"), "monies").alias("_pending"))
    pending = F.when(F.col("_pcts").isNotNull(), F.col("_pending"))
    blocks = blocks.withColumns({"totals": F.coalesce(F.col("_sum"), pending, empty), "pcts": F.coalesce("_pcts", empty)}).drop("_sum", "_pending", "_pcts")
    chosen = _shares(choose_block_figures(blocks))
    return chosen.withColumn("vendor", vendor_from_header(F.col("header"))).withColumn("source", F.lit("pdf"))


def positions_from_layout_lines(docs: DataFrame) -> DataFrame:
    """Position rows of every vendor block. A line of text alone belongs to the position above it
    while that has no such line yet, else to the next one; a sum row ends both."""
    along, so_far, _ = _along()
    numbered = F.col("line").rlike(fx.POSITION_LINE)
    lines = _lines(docs).where(~F.contains("line", F.lit("\f")))
    df = _with_blocks(lines, numbered).withColumn("line", F.regexp_replace("line", r"(?U)\s+$", ""))
    df = df.withColumn("text", strip(F.col("line")))
    # A block starts at its header, so the last header so far is the block's.
    df = df.withColumn("header", F.last(F.when(F.col("is_header"), F.col("text")), ignorenulls=True).over(so_far))
    df = df.where(~F.col("is_header") & ~F.col("header").rlike(fx.STATEMENT_BLOCK))
    df = df.withColumn("monies", money_tokens(F.col("line"), fx.MONEY_EUR))
    kind = (
        F.when(F.col("line").rlike(fx.SKIPPED_LINE), F.when(F.startswith("text", F.lit("Σ")), "reset").otherwise("skip"))
        .when((F.size("monies") >= 3) & numbered, "position").when(F.size("monies") > 0, "skip").otherwise("text"))
    df = _once(df, "kind", kind).where(F.col("kind") != "skip")
    df = df.withColumns({
        "segment": F.sum(F.when(F.col("kind") == "reset", 1).otherwise(0)).over(so_far),
        "at": F.sum(F.when(F.col("kind") == "position", 1).otherwise(0)).over(so_far),
        "above": F.lag(F.struct("kind", "block_no")).over(along)})
    df = df.where(F.col("kind") != "reset")
    # The first text line after a position trails it, later ones lead the next.
    trails = F.coalesce((F.col("kind") == "text") & (F.col("above.kind") == "position") & (F.col("above.block_no") == F.col("block_no")), F.lit(False))
    owner = F.when((F.col("kind") == "position") | trails, F.col("at")).otherwise(F.col("at") + 1)
    before_money = F.split(F.regexp_extract("line", fx.POSITION_LINE, 2), fx.MONEY_EUR, 2)[0]
    piece = F.when(F.col("kind") == "position", strip(before_money)).otherwise(F.col("text"))
    df = df.withColumns({"owner": owner, "piece": piece, "place": F.when(trails, 2).when(F.col("kind") == "position", 1).otherwise(0)})
    pieces = F.array_sort(F.collect_list(F.struct("place", "line_no", "piece")))
    position = F.col("kind") == "position"
    out = df.groupBy("doc_id", "block_no", "segment", "owner").agg(
        F.array_join(F.transform(pieces, lambda p: p["piece"]), " ").alias("description"), F.max(F.when(position, F.col("line_no"))).alias("line_no"),
        F.max(F.when(position, F.regexp_extract("line", fx.POSITION_LINE, 1))).alias("pos"), F.max(F.when(position, F.col("monies")[0])).alias("line_total_net"),
        F.max(F.when(position, F.contains(F.lower("piece"), F.lit("option")))).alias("optional"), F.max("header").alias("header"))
    return out.where(F.col("pos").isNotNull()).select(
        "doc_id", "block_no", vendor_from_header(F.col("header")).alias("label"), "line_no", "pos", "description", "line_total_net", "optional")


def blocks_from_rows(rows: DataFrame) -> DataFrame:
    """Vendor blocks of cost sheets given as rows (sheet_id, row_no, a, b, c, d, e). A complete sum
    row wins; without one the position rows above it are added up."""
    first = strip(F.coalesce("a", F.lit("")))
    df = rows.withColumn("first", first)
    df = running_last(df, ["sheet_id"], "row_no", F.startswith("first", F.lit("SOLL")), "block_row").where(F.col("block_row").isNotNull())
    second = F.coalesce("b", F.lit(""))
    header = F.startswith("first", F.lit("SOLL"))
    sum_row = ~header & F.startswith("first", F.lit("Σ"))
    special = ~header & ~sum_row & F.startswith(second, F.lit("Sonderpreis"))
    stated = F.startswith(second, F.lit("Nettosumme lt. Dokument"))
    position = ~header & ~sum_row & ~special & ~stated & (F.col("first") != "") & (F.col("first") != "Position") & F.col("c").isNotNull()
    df = df.withColumns({"sum_row": sum_row, "special": special, "position": position, "header": header})
    firsts = df.groupBy("sheet_id", "block_row").agg(F.min(F.when(F.col("sum_row"), F.col("row_no"))).alias("first_sum"))
    df = df.join(firsts, ["sheet_id", "block_row"])
    above = F.col("position") & (F.col("first_sum").isNull() | (F.col("row_no") < F.col("first_sum")))
    zero = F.lit(0).cast("decimal(28,2)")
    last_sum = F.max_by(F.when(F.col("sum_row"), F.struct("c", "d", "e")), F.when(F.col("sum_row"), F.col("row_no"))).alias("_s")
    blocks = df.groupBy("sheet_id", "block_row").agg(
        F.max(F.when(F.col("header"), F.col("first"))).alias("header"), last_sum,
        *[F.coalesce(F.sum(F.when(above, F.col(c))), zero).alias(f"_{c}") for c in ("c", "d", "e")],
        F.max_by(F.when(F.col("special"), F.col("c")), F.when(F.col("special"), F.col("row_no"))).alias("sonderpreis"))
    complete = F.col("_s.c").isNotNull() & F.col("_s.d").isNotNull() & F.col("_s.e").isNotNull()

    def figure(c: str) -> Column:
        return F.when(complete, F.col(f"_s.{c}").cast("decimal(28,2)")).otherwise(F.col(f"_{c}"))

    out = blocks.select("sheet_id", "block_row", "header", vendor_from_header(F.col("header")).alias("vendor"),
                        figure("c").alias("gesamt"), figure("d").alias("ik"), figure("e").alias("nk"), "sonderpreis")
    return _shares(out)


def ground_truth_rows(rows: DataFrame) -> DataFrame:
    """Invoices of a consultant's result sheet given as rows with mapped columns (sheet_id, row_no,
    recipient, invoice_date, brutto, netto, netto_after_skonto, cat, ik, nk, ek). An invoice starts
    at a row with recipient, date and gross; the closing question ends the table."""
    closing = F.startswith(strip(F.col("recipient")), F.lit("Wurde durch")) | F.startswith(strip(F.col("recipient")), F.lit("Ergab sich"))
    ends = rows.where(closing).groupBy("sheet_id").agg(F.min("row_no").alias("_end"))
    body = rows.join(ends, "sheet_id", "left").where(F.col("_end").isNull() | (F.col("row_no") < F.col("_end"))).drop("_end")
    starts = F.col("recipient").isNotNull() & F.col("invoice_date").isNotNull() & F.col("brutto").isNotNull()
    df = running_last(body, ["sheet_id"], "row_no", starts, "start_row").where(F.col("start_row").isNotNull())
    at_start = F.col("row_no") == F.col("start_row")
    zero = F.lit(0).cast("decimal(28,2)")

    def head(c: str) -> Column:
        return F.max(F.when(at_start, F.col(c))).alias(c)

    return df.groupBy("sheet_id", "start_row").agg(
        F.max(F.when(at_start, strip(F.regexp_replace("recipient", "\n", " ")))).alias("recipient"), head("invoice_date"), head("brutto"), head("netto"),
        F.min_by("netto_after_skonto", F.when(F.col("netto_after_skonto").isNotNull(), F.col("row_no"))).alias("netto_after_skonto"),
        F.count_if(F.coalesce(strip(F.col("cat")) != "", F.lit(False))).alias("n_categories"),
        *[F.coalesce(F.sum(c), zero).alias(f"{c}_amount") for c in ("ik", "nk", "ek")])


# Header texts of the result sheet per field, tried in this order.
RESULT_HEADERS = {
    "recipient": ["herstellername", "empfänger", "zahlungsempfänger"],
    "invoice_date": ["rechnungsdatum", "rechnung gestellt am"],
    "brutto": ["betrag\nbrutto", "brutto"],
    "netto": ["betrag\nnetto", "betrag netto"],
    "netto_after_skonto": ["skto", "skonto", "rab."],
    "cat": ["ik oder", "ik \noder", "ik  \noder"],
    "ik": ["investitions-kosten", "investitions", "investitionskosten"],
    "nk": ["nebenkosten"],
    "ek": ["einsparkonzept"],
}


def map_result_columns(header_cells: DataFrame) -> DataFrame:
    """(sheet_id, field, col): the first header cell whose text names each field.
    ``header_cells``: sheet_id, col, text."""
    low = F.lower(strip(F.coalesce("text", F.lit(""))))
    hits = []
    for field, needles in RESULT_HEADERS.items():
        named = F.lit(False)
        for n in needles:
            named = named | F.contains(low, F.lit(n))
        if field == "netto":
            named = named & ~low.rlike("investitions|nebenkosten|skto")
        hits.append(F.when((low != "") & named, F.lit(field)))
    found = header_cells.select("sheet_id", "col", F.explode(F.array_compact(F.array(*hits))).alias("field"))
    return found.groupBy("sheet_id", "field").agg(F.min("col").alias("col"))
