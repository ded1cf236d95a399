"""Which offer block, group or final invoice does an invoice belong to?

Names are matched per distinct (project, name): invoices that repeat a name collapse before any
candidate is formed, and candidates come from shared keys, so a vendor or project with a third of
all invoices costs one row here and one broadcast-sized lookup on the way back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from costproof import fixed_values as fx
from costproof.functions.vendor import (
    earliest_overlap, is_own_company, near_words, overlapping_sets, token_set, vendor_overlap, vendor_set, with_vendor_tokens,
)
from costproof.operators.classify import is_statement_block
from costproof.scale import merged
from costproof.session import materialize

_GRAM = 5


def _containment_pairs(left: DataFrame, right: DataFrame, by: Sequence[str], left_id: str, right_id: str) -> DataFrame:
    """Pairs in which one ``compact`` name contains the other, both of five characters or more.

    If a stands inside b, then b holds a's first five characters; that gram is the join key. Of a name's grams only those
    count that begin a name of the other side, found over the distinct names.
    """
    def heads(df: DataFrame, key: str) -> DataFrame:
        return df.where(F.length("compact") >= _GRAM).select(
            *by, F.col(key), F.col("compact").alias("inner"), F.left("compact", F.lit(_GRAM)).alias("gram"))

    def grams(df: DataFrame, key: str, begins: DataFrame) -> DataFrame:
        long = df.where(F.length("compact") >= _GRAM)
        spots = F.sequence(F.lit(1), F.length("compact") - (_GRAM - 1))
        parts = F.array_distinct(F.transform(spots, lambda i: F.substring(F.col("compact"), i, F.lit(_GRAM))))
        vocabulary = long.select("compact").distinct().select("compact", F.explode(parts).alias("gram"))
        known = merged(vocabulary, begins.select("gram").distinct(), "gram")
        return merged(long.select(*by, key, "compact"), known, "compact")

    left_heads, right_heads = heads(left, left_id), heads(right, right_id)
    inside_right = merged(left_heads, grams(right, right_id, left_heads), [*by, "gram"]).where(F.contains("compact", "inner"))
    inside_left = merged(right_heads, grams(left, left_id, right_heads), [*by, "gram"]).where(F.contains("compact", "inner"))
    columns = [*by, left_id, right_id]
    return inside_right.select(*columns).unionByName(inside_left.select(*columns)).distinct()


def match_vendor(invoices: DataFrame, blocks: DataFrame, own_pattern: str = fx.OWN_COMPANY) -> DataFrame:
    """Each invoice with the best block of its project (``block_seq``, ``match_score``), or null.

    Score: shared distinctive tokens; a pair without any scores one half if one compact name
    contains the other. The first block wins ties. The own company never matches.
    """
    own = is_own_company(F.col("vendor_name"), own_pattern)
    names = with_vendor_tokens(invoices.where(~own).select("project_id", "vendor_name").distinct(), {"vendor_name": "_all"})
    names = materialize(names.where(F.size("_all") > 0).select(
        "project_id", "vendor_name", token_set(F.col("_all")).alias("tokens"), F.array_join("_all", "").alias("compact")))
    sides = with_vendor_tokens(blocks.select("project_id", "block_seq", "vendor", "header"), {"vendor": "_own", "header": "_head"})
    sides = materialize(sides.select(
        "project_id", "block_seq", F.array_join("_own", "").alias("compact"), F.array_sort(F.array_union("_own", "_head")).alias("block_tokens")))
    overlaps = overlapping_sets(names, sides, ["project_id"], "tokens", "block_tokens").withColumn(
        "score", vendor_overlap(F.col("tokens"), F.col("block_tokens")))
    by_tokens = merged(overlaps, names.select("project_id", "vendor_name", "tokens"), ["project_id", "tokens"])
    by_tokens = merged(by_tokens, sides.select("project_id", "block_seq", "block_tokens"), ["project_id", "block_tokens"]).select(
        "project_id", "vendor_name", "block_seq", "score")
    contained = _containment_pairs(names, sides, ["project_id"], "vendor_name", "block_seq").withColumn("score", F.lit(0.5).cast("double"))
    by_name = merged(contained, by_tokens, ["project_id", "vendor_name", "block_seq"], "left_anti")
    best = by_tokens.unionByName(by_name).groupBy("project_id", "vendor_name").agg(
        F.max(F.struct(F.col("score"), (-F.col("block_seq")).alias("_neg"))).alias("_best")
    ).select("project_id", "vendor_name", (-F.col("_best._neg")).alias("block_seq"), F.col("_best.score").alias("match_score"))
    return merged(invoices.withColumn("own_company", own), best, ["project_id", "vendor_name"], "left")


def statement_fallback(matched: DataFrame, blocks: DataFrame) -> DataFrame:
    """Unmatched invoices take the ratio of their project's only statement block; with several
    or none they stay unallocated. Adds ``match_kind``."""
    statements = blocks.where(is_statement_block(F.col("header"), F.col("statement"))).groupBy("project_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("block_seq").alias("_statement_seq"))
    df = merged(matched, statements.where(F.col("_n") == 1).drop("_n"), "project_id", "left")
    unmatched = ~F.col("own_company") & F.col("block_seq").isNull()
    kind = (
        F.when(F.col("own_company"), "own")
        .when(~unmatched, "vendor")
        .when(F.col("_statement_seq").isNotNull(), "statement")
        .otherwise("none")
    )
    return df.withColumn("match_kind", kind).withColumn(
        "block_seq", F.when(unmatched, F.col("_statement_seq")).otherwise(F.col("block_seq"))).drop("_statement_seq")


def fuzzy_vendor_join_global(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Distinct names of two tables that overlap anywhere in the portfolio, with the score."""
    lhs = left.select(F.col(left_name).alias("left_name")).distinct().withColumn("left_tokens", vendor_set(F.col("left_name")))
    rhs = right.select(F.col(right_name).alias("right_name")).distinct().withColumn("right_tokens", vendor_set(F.col("right_name")))
    pairs = overlapping_sets(lhs, rhs, [], "left_tokens", "right_tokens").withColumn(
        "score", vendor_overlap(F.col("left_tokens"), F.col("right_tokens")))
    return pairs.join(lhs, "left_tokens").join(rhs, "right_tokens").select("left_name", "right_name", "score")


def _leaders(labels: DataFrame) -> DataFrame:
    """First-fit grouping of distinct labels: project_id, tokens, seq → + leader_seq.

    A label leads if no earlier leader overlaps it, else it follows the earliest such leader.
    Solved in rounds: a label is settled once every word it shares has a settled head below it.
    Each round reads one minimum per word, never a pair of labels; the number of rounds is the
    longest chain of labels of one project that hang on each other.
    """
    spark = labels.sparkSession
    own = materialize(labels.select("project_id", "seq", F.explode("tokens").alias("word")))
    words = own.select("word").distinct()
    looks = materialize(merged(own, near_words(words, words), "word").select("project_id", "seq", F.col("other").alias("word")).distinct())
    open_ = labels.select("project_id", "seq")
    settled = spark.createDataFrame([], "project_id bigint, seq bigint, leader_seq bigint")
    while True:
        led = settled.where(F.col("seq") == F.col("leader_seq")).select("project_id", "seq")
        alive = open_.withColumn("led", F.lit(False)).unionByName(led.withColumn("led", F.lit(True)))
        heads = (
            merged(own, alive, ["project_id", "seq"])
            .groupBy("project_id", "word")
            .agg(F.min("seq").alias("any_head"), F.min(F.when(F.col("led"), F.col("seq"))).alias("led_head"))
        )
        seen = (
            merged(merged(looks, open_, ["project_id", "seq"]), heads, ["project_id", "word"], "left")
            .groupBy("project_id", "seq")
            .agg(F.min(F.when(F.col("any_head") < F.col("seq"), F.col("any_head"))).alias("first_any"),
                 F.min(F.when(F.col("led_head") < F.col("seq"), F.col("led_head"))).alias("first_led"))
        )
        # Labels without keys (no distinctive token) overlap nothing, themselves included.
        state = merged(open_, seen, ["project_id", "seq"], "left")
        leads = F.col("first_any").isNull()
        follows = F.col("first_led").isNotNull() & (F.col("first_led") == F.col("first_any"))
        state = materialize(state.withColumn(
            "leader_seq", F.when(leads, F.col("seq")).when(follows, F.col("first_led"))))
        settled = materialize(settled.unionByName(
            state.where(F.col("leader_seq").isNotNull()).select("project_id", "seq", "leader_seq")))
        open_ = state.where(F.col("leader_seq").isNull()).select("project_id", "seq")
        if not open_.take(1):
            return settled


def group_offer_blocks(blocks: DataFrame, own_pattern: str = fx.OWN_COMPANY) -> DataFrame:
    """Blocks with the group they merge into: ``group_seq`` (the founding block), its label, and
    the special price, which only a group of a single block keeps. Own-company blocks and
    statements never enter. ``blocks``: project_id, block_seq, label, header, statement, sonderpreis.
    """
    vendors = with_vendor_tokens(blocks.where(
        ~is_own_company(F.col("label"), own_pattern) & ~is_statement_block(F.col("header"), F.col("statement"))
    ), {"label": "tokens"}).withColumn("tokens", token_set(F.col("tokens")))
    # Equal token sets always fall into one group, so only the first of them takes part; an
    # empty set founds its own group every time.
    empty = F.size("tokens") == 0
    firsts = vendors.where(~empty).groupBy("project_id", "tokens").agg(F.min("block_seq").alias("seq"))
    leaders = _leaders(materialize(firsts)).withColumnRenamed("leader_seq", "group_seq")
    grouped = merged(merged(vendors, firsts, ["project_id", "tokens"], "left"), leaders, ["project_id", "seq"], "left").withColumn(
        "group_seq", F.when(empty, F.col("block_seq")).otherwise(F.col("group_seq"))).drop("seq")
    groups = grouped.groupBy("project_id", "group_seq").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.min_by("label", "block_seq").alias("group_label"),
        F.min_by("sonderpreis", "block_seq").alias("_special"))
    return merged(grouped.drop("sonderpreis"), groups, ["project_id", "group_seq"]).withColumn(
        "group_sonderpreis", F.when(F.col("n_blocks") == 1, F.col("_special"))).drop("_special", "tokens")


def assign_invoices_to_groups(invoices: DataFrame, groups: DataFrame) -> DataFrame:
    """Each invoice with the group whose label overlaps its vendor best, first group on ties;
    null for invoices without an offer. ``groups``: project_id, group_seq, group_label."""
    names = invoices.select("project_id", "vendor_name").distinct().withColumn("tokens", vendor_set(F.col("vendor_name")))
    labels = groups.select("project_id", "group_seq", "group_label").distinct().withColumn("label_tokens", vendor_set(F.col("group_label")))
    best = (
        overlapping_sets(labels, names, ["project_id"], "label_tokens", "tokens")
        .withColumn("score", vendor_overlap(F.col("label_tokens"), F.col("tokens")))
        .join(labels.select("project_id", "label_tokens", "group_seq"), ["project_id", "label_tokens"])
        .groupBy("project_id", "tokens")
        .agg(F.max(F.struct("score", (-F.col("group_seq")).alias("_neg"))).alias("_best"))
        .select("project_id", "tokens", (-F.col("_best._neg")).alias("group_seq"), F.col("_best.score").alias("group_score"))
    )
    lookup = names.join(best, ["project_id", "tokens"]).drop("tokens")
    return invoices.join(lookup, ["project_id", "vendor_name"], "left")


def fold_advances(invoices: DataFrame, by: Sequence[str] = ("project_id",)) -> DataFrame:
    """Adds ``final_seq`` (the first cumulative final invoice of the same vendor), ``folded``
    (advances and earlier credit notes it contains) and ``n_folded`` on the final itself."""
    by = list(by)
    df = invoices.withColumn("_tokens", vendor_set(F.col("vendor_name")))
    finals = df.where((F.col("invoice_type") == "schlussrechnung") & F.col("cumulative_netto").isNotNull())
    # Only one final per distinct vendor set can be the first.
    heads = finals.groupBy(*by, "_tokens").agg(F.min("seq").alias("seq"))
    first = earliest_overlap(df.select(*by, "_tokens"), heads, by, "_tokens", "seq", "final_seq")
    dated = finals.select(*by, F.col("seq").alias("final_seq"), F.col("invoice_date").alias("_final_date"))
    df = df.join(first, [*by, "_tokens"], "left").join(dated, [*by, "final_seq"], "left")
    kind = F.col("invoice_type")
    foldable = kind.isin("anzahlung", "teilrechnung") | (
        (kind == "gutschrift") & (F.col("invoice_date") <= F.col("_final_date")))
    df = df.withColumn("folded", F.coalesce(F.col("final_seq").isNotNull() & foldable, F.lit(False)))
    counts = df.where("folded").groupBy(*by, F.col("final_seq").alias("seq")).agg(F.count(F.lit(1)).alias("n_folded"))
    return df.join(counts, [*by, "seq"], "left").withColumn("n_folded", F.coalesce("n_folded", F.lit(0))).drop("_tokens", "_final_date")


def match_totals_to_blocks(offers: DataFrame, blocks: DataFrame, tolerance: str = "0.02") -> DataFrame:
    """Offers whose net total equals no block total of the project within the tolerance.
    The tolerance becomes cent keys, so the range test is an equality join."""
    cents = (F.lit(tolerance).cast("decimal(18,2)") * 100).cast("int")
    totals = blocks.where(F.col("gesamt").isNotNull()).select(
        "project_id", (F.col("gesamt") * 100).cast("bigint").alias("_cents"))
    near = totals.select("project_id", F.explode(F.sequence(F.col("_cents") - cents, F.col("_cents") + cents)).alias("_key")).distinct()
    keyed = offers.withColumn("_key", (F.col("net_total") * 100).cast("bigint"))
    return merged(keyed, near, ["project_id", "_key"], "left_anti").drop("_key")


def compare_block_totals(left: DataFrame, right: DataFrame) -> DataFrame:
    """Totals of two cost sheets, block by block in order. Both: sheet_id, block_no, total."""
    a = left.withColumnRenamed("total", "left_total")
    b = right.withColumnRenamed("total", "right_total")
    zero = F.lit(0).cast("decimal(28,2)")
    return a.join(b, ["sheet_id", "block_no"], "full").withColumn(
        "delta", F.when(F.col("left_total").isNotNull() & F.col("right_total").isNotNull(),
                        F.coalesce("left_total", zero) - F.coalesce("right_total", zero)))


def scope_check_inputs(rows: DataFrame, offers: DataFrame, own_pattern: str = fx.OWN_COMPANY) -> tuple[DataFrame, DataFrame]:
    """(invoices that enter the position comparison, those that do not). Unusable rows and the
    own company's stay out, and so does every project without offer lines."""
    fit = ~F.col("unusable") & ~is_own_company(F.col("vendor_name"), own_pattern)
    with_offers = offers.select("project_id").distinct()
    return rows.where(fit).join(with_offers, "project_id", "left_semi"), rows.where(~fit)


def scope_check_skipped(projects: DataFrame, offers: DataFrame) -> DataFrame:
    reason = ("Positionsabgleich übersprungen — keine Angebotspositionen lesbar (die geprüfte "
              "Kostenaufstellung als PDF hochladen, oder die Angebots-PDFs ohne Kostenaufstellung)")
    return projects.select("project_id").join(offers.select("project_id").distinct(), "project_id", "left_anti").withColumn(
        "skipped_reason", F.lit(reason))
