"""Invoice lines against offer lines, per vendor group.

Line tables: ``offer_lines`` (project_id, group_seq, line_seq, pos, artikelnummer, description, qty,
line_total_net, optional) and ``invoice_lines`` (project_id, group_seq, invoice_id, pos_seq, pos,
description, qty, line_total_net). ``line_seq`` is the order of offer lines within the group.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from costproof import fixed_values as fx
from costproof.functions.german import format_de
from costproof.functions.text import article_numbers, desc_tokens
from costproof.operators.classify import is_deduction_line
from costproof.scale import merged, order_index, running_last
from costproof.session import materialize

GROUP = ["project_id", "group_seq"]
_LINE = ["invoice_id", "pos_seq"]
_SIGNALS = ["article", "description", "price", "qty"]
_SHAPE = ["shape", "i_articles", "i_tokens", "i_price", "i_qty"]
# Numbers of offer lines below it, either sign, leave room for score and signals in one decimal; groups with larger ones sort their pairs.
LINE_SEQ = 5 * 10**17
# Words of a line that are looked up by compiled code.
PLAIN_WORDS = 8
# Pairs of one group that are formed in one task; the pairs of larger groups are found by article and word.
GROUP_PAIRS = 1 << 18


def _w(value: str) -> Column:
    return F.lit(value).cast("decimal(10,6)")


def matchable_offer_lines(offer_lines: DataFrame) -> DataFrame:
    """Binding lines, and options that carry a price."""
    priced = F.coalesce(F.col("line_total_net") != 0, F.lit(False))
    return offer_lines.where(~F.col("optional") | priced)


def matchable_invoice_lines(invoice_lines: DataFrame) -> DataFrame:
    """Lines that bill something; restated advances are money already matched."""
    return invoice_lines.where(~is_deduction_line(F.col("line_total_net"), F.col("description")))


def _covered(tokens: Column, others: Column) -> Column:
    """Share of tokens that stand in the other description, a longer compound included."""
    def found(t: Column) -> Column:
        def holds(u: Column) -> Column:
            both_long = (F.length(t) >= 4) & (F.length(u) >= 4)
            return (t == u) | (both_long & (F.contains(u, t) | F.contains(t, u)))
        return F.exists(others, holds)

    return F.size(F.filter(tokens, found)).cast("decimal(10,0)") / F.size(tokens).cast("decimal(10,0)")


def description_similarity(a: Column, b: Column) -> Column:
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both, (_covered(a, b) + _covered(b, a)) / 2).otherwise(F.lit(0)).cast("decimal(20,12)")


def _probes(tokens: Column) -> Column:
    """Words as they are looked up in a ``_line_text``: short ones only match whole words."""
    return F.transform(tokens, lambda t: F.when(F.length(t) >= 4, t).otherwise(F.concat(F.lit(" "), t, F.lit(" "))))


def _line_text(tokens: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def _looked_up(probes: Column, text: Column) -> Column:
    """How many of the first ``PLAIN_WORDS`` words stand in a text, written out so that Spark compiles it."""
    return sum((F.when(F.contains(text, F.get(probes, F.lit(k))), 1).otherwise(0) for k in range(PLAIN_WORDS)), F.lit(0))


def _likeness(a: str, b: str) -> Column:
    """The weighted ``description_similarity`` of two prepared sides that were looked up, in units of the ninth decimal.

    Mostly the words found are whole words of both lines, and counting them settles it. Otherwise a word that holds a word of the
    other line needs one that is found in this line's text, so only the few words found are compared with each other.
    """
    probes, text, n = ({s: F.col(f"{s}_{c}") for s in (a, b)} for c in ("probes", "text", "found"))

    def share(found: Column, side: str) -> Column:
        """Half up at the eleventh decimal, as decimals divide."""
        words = F.size(probes[side])
        return F.call_function("div", found.cast("bigint") * F.lit(2 * 10**11) + words, words * 2)

    def weighted(found_a: Column, found_b: Column) -> Column:
        weight = int(Decimal(fx.WEIGHT_DESCRIPTION) * 10**6)
        return F.call_function("div", (share(found_a, a) + share(found_b, b)) * F.lit(5 * weight) + F.lit(5 * 10**8), F.lit(10**9))

    def compared(h: Column, side: str, other: str) -> Column:
        return F.size(F.filter(probes[side], lambda p: F.contains(text[other], p) | F.exists(h[other], lambda u: F.contains(p, u))))

    inside = F.struct(_standing(probes[a], text[b]).alias(a), _standing(probes[b], text[a]).alias(b))
    full = F.transform(F.array(inside), lambda h: weighted(compared(h, a, b), compared(h, b, a)))[0]
    both = (F.size(probes[a]) > 0) & (F.size(probes[b]) > 0)
    plain = F.col(f"{a}_plain") & F.col(f"{b}_plain")
    none = plain & (n[a] == 0) & (n[b] == 0)
    whole = plain & (n[a] == n[b]) & (F.size(F.array_intersect(probes[a], probes[b])) == n[a])
    return F.when(both, F.when(none, F.lit(0).cast("bigint")).when(whole, weighted(n[a], n[b])).otherwise(full)).otherwise(F.lit(0).cast("bigint"))


def _standing(probes: Column, text: Column) -> Column:
    return F.filter(probes, lambda p: F.contains(text, p))


def price_proximity(offer: Column, billed: Column, rough: Column | None = None) -> Column:
    """1 at equality falling to 0 at half the price off, or 0.6 for a clean fraction of it. ``rough``, the ratio as floating point,
    settles what is far from a limit; decimals settle the rest."""
    usable = offer.isNotNull() & (offer != 0)
    offer = F.nullif(offer, F.lit(0)).cast("decimal(18,2)")
    rough = billed.cast("double") / offer.cast("double") if rough is None else rough
    delta = F.abs(billed - offer).cast("decimal(18,2)") / F.abs(offer)
    near = (F.abs(rough - 1) <= 0.51) & (delta <= F.lit("0.5").cast("decimal(2,1)"))
    ratio = billed.cast("decimal(18,2)") / offer
    clean = F.lit(False)
    for fraction in fx.CLEAN_FRACTIONS:
        off = F.abs(rough - float(fraction))
        clean = clean | (off < 0.01 - 1e-9) | ((off < 0.01 + 1e-9) & (F.abs(ratio - F.lit(fraction).cast("decimal(20,12)")) < F.lit("0.01").cast("decimal(3,2)")))
    partial = F.when((rough < 1.01) & clean & (billed > 0) & (billed < offer), F.lit("0.6")).otherwise(F.lit("0")).cast("decimal(20,12)")
    direct = (F.lit(1) - delta * 2).cast("decimal(20,12)")
    return F.when(usable, F.when(near, F.greatest(direct, partial)).otherwise(partial)).otherwise(F.lit(0)).cast("decimal(20,12)")


def _offer_side(offer_lines: DataFrame) -> DataFrame:
    """What of an offer line is compared; ``optional`` is for lump sums."""
    offer_text = F.concat_ws(" ", F.coalesce("artikelnummer", F.lit("")), "description")
    return matchable_offer_lines(offer_lines).where("line_total_net is not null").select(  # a binding line without a total stays missing
        *GROUP, "line_seq", F.array_sort(article_numbers(offer_text)).alias("o_articles"), desc_tokens(F.col("description")).alias("o_tokens"),
        F.col("line_total_net").alias("o_price"), F.col("qty").alias("o_qty"), "optional")


def _billed_side(invoice_lines: DataFrame) -> DataFrame:
    return invoice_lines.select(
        *GROUP, *_LINE, F.array_sort(article_numbers(F.col("description"))).alias("i_articles"),
        desc_tokens(F.col("description")).alias("i_tokens"), F.col("line_total_net").alias("i_price"), F.col("qty").alias("i_qty"))


def _dealt(df: DataFrame) -> DataFrame:
    """Rows of a group in one task: its lines are made ready, its copies and its pairs are formed there."""
    return df.repartition(*GROUP)


def _offer_shapes(offers: DataFrame) -> DataFrame:
    """Distinct shapes: lines alike in words, articles, price and quantity score alike, so copies are scored once. The first
    offer line of a shape stands for it."""
    return offers.groupBy(*GROUP, "o_articles", "o_tokens", "o_price", "o_qty").agg(F.min("line_seq").alias("line_seq"))


def _shaped(billed: DataFrame) -> DataFrame:
    """Hashes pass over nulls, so a missing price and an equal quantity are told apart by what is missing."""
    return billed.withColumn("shape", F.xxhash64("i_articles", "i_tokens", "i_price", "i_qty", F.isnull("i_price"), F.isnull("i_qty")))


def _related_words(offers: DataFrame, billed: DataFrame) -> DataFrame:
    """(offer word, invoice word): equal, or one inside the other from four characters. Works on
    the distinct words of the tables."""
    def words(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.select(F.explode(column).alias(name)).distinct()

    left, right = words(offers, "o_tokens", "o_word"), words(billed, "i_tokens", "i_word")
    same = left.select("o_word", F.col("o_word").alias("i_word")).join(right, "i_word").select("o_word", "i_word")
    in_offer, in_invoice = _held_words(right, "i_word", left, "o_word"), _held_words(left, "o_word", right, "i_word")
    return same.union(in_offer.select("o_word", "i_word")).union(in_invoice.select("o_word", "i_word"))


def _held_words(short: DataFrame, inner: str, long: DataFrame, outer: str) -> DataFrame:
    """Pairs of different words of which the inner one stands in the outer one: they meet at the inner word's rarest four
    letters, so a word costs as many keys as it has letters."""
    def grams(word: str) -> Column:
        return F.explode(F.array_distinct(F.regexp_extract_all(word, F.lit("(?s)(?=(.{4}))"), F.lit(1)))).alias("gram")

    held = long.where(F.length(outer) > 4).select(outer, grams(outer))
    often = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    anchors = short.where(F.length(inner) >= 4).select(inner, grams(inner)).join(often, "gram", "left").groupBy(inner).agg(
        F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return held.join(anchors, "gram").where((F.length(outer) > F.length(inner)) & F.contains(outer, inner)).select(inner, outer)


def _price_and_quantity(offers: DataFrame, shapes: DataFrame) -> DataFrame:
    """For each distinct (group, i_price, i_qty): offer lines among which is the one of the largest price and quantity signal.

    Of all prices only few can be the closest: the next one below, the next one above, and for every clean fraction the first above
    the price that the fraction at its upper edge would give. Sorted runs of offer prices and of these thresholds find
    them for the whole group and for the lines of equal quantity, without a pair of lines.
    """
    quantity = lambda c: F.col(c).cast("decimal(24,6)").cast("string")
    everyone = F.lit("*")
    lanes = lambda c: F.explode(F.array_compact(F.array(everyone, quantity(c)))).alias("lane")
    key = [*GROUP, "lane", "sign"]
    at = lambda c: (F.signum(F.col(c).cast("double")).cast("int").alias("sign"), F.abs(c).cast("decimal(38,12)").alias("at"))
    points = offers.where("o_price <> 0").select(*GROUP, lanes("o_qty"), *at("o_price"), "o_price", "line_seq")
    points = points.groupBy(*key, "at", "o_price").agg(F.min("line_seq").alias("line_seq"))
    asked = shapes.select(*GROUP, "i_price", lanes("i_qty")).distinct()
    priced = asked.where("i_price <> 0").select(*GROUP, "lane", "i_price", *at("i_price"))
    edges = [F.when(F.col("sign") > 0, (F.col("at") / (F.lit(f).cast("decimal(20,12)") + F.lit("0.01").cast("decimal(3,2)"))).cast("decimal(38,12)")) for f in fx.CLEAN_FRACTIONS]
    below = priced.withColumn("above", F.lit(False))
    above = priced.withColumn("at", F.explode(F.array_compact(F.array("at", *edges)))).withColumn("above", F.lit(True))
    no = F.lit(None)
    stock = points.select(*key, "at", no.cast("decimal(18,2)").alias("i_price"), "o_price", "line_seq")
    found = []
    for queries, forward in ((below, True), (above, False)):
        mixed = stock.union(queries.select(*key, "at", "i_price", no.cast("decimal(18,2)").alias("o_price"), no.cast("bigint").alias("line_seq")))
        order = [F.col("at"), F.col("i_price").isNotNull()] if forward else [F.col("at").desc(), F.col("i_price").isNull()]
        runs = order_index(mixed, [*key, *order, "i_price"])
        last = running_last(runs, key, "ord", F.col("i_price").isNull(), "hit").where(F.col("i_price").isNotNull() & F.col("hit").isNotNull())
        hits = runs.where(F.col("i_price").isNull()).select(F.col("ord").alias("hit"), "o_price", "line_seq")
        found.append(last.select(*GROUP, "lane", "i_price", "hit").join(hits, "hit").select(*GROUP, "lane", "i_price", "line_seq", price_proximity(F.col("o_price"), F.col("i_price")).alias("price")))
    first = offers.select(*GROUP, lanes("o_qty"), "line_seq").groupBy(*GROUP, "lane").agg(F.min("line_seq").alias("line_seq"))
    found.append(asked.join(first, [*GROUP, "lane"]).select(*GROUP, "lane", "i_price", "line_seq", F.lit(0).cast("decimal(20,12)").alias("price")))
    best = found[0].union(found[1]).union(found[2]).groupBy(*GROUP, "lane", "i_price").agg(F.max(F.struct("price", (-F.col("line_seq")).alias("neg"))).alias("b"))
    keyed = shapes.select(*GROUP, "shape", "i_price", lanes("i_qty")).withColumn("_p", F.coalesce(F.col("i_price").cast("string"), F.lit("")))
    best = best.withColumn("_p", F.coalesce(F.col("i_price").cast("string"), F.lit(""))).drop("i_price")
    none = F.lit(0).cast("decimal(12,9)")
    return keyed.join(best, [*GROUP, "lane", "_p"]).select(
        *GROUP, (-F.col("b.neg")).alias("line_seq"), "shape", none.alias("article"), none.alias("description"),
        F.round(F.col("b.price") * _w(fx.WEIGHT_PRICE), 9).cast("decimal(12,9)").alias("price"),
        F.when(F.col("lane") == everyone, none).otherwise(_w(fx.WEIGHT_QTY).cast("decimal(12,9)")).alias("qty"))


def score_positions(offer_lines: DataFrame, invoice_lines: DataFrame) -> DataFrame:
    """Scored candidates per invoice line, signals kept.

    A pair without a common article or word scores at most 0.35 and can never be proposed
    (0.40), so candidates come from shared articles and related words only.
    """
    columns = [*GROUP, *_LINE, "line_seq", *_SIGNALS, "score"]
    near, crowded = _by_size(materialize(_offer_side(offer_lines)), materialize(_billed_side(invoice_lines)))
    scored = _scored_in_group(_offer_shapes(_dealt(near[0])), _dealt(near[1]), _LINE).select(*columns)
    if crowded is None:
        return scored
    billed = materialize(_shaped(crowded[1]))
    shapes = billed.select(*GROUP, *_SHAPE).distinct()
    far = merged(billed.select(*GROUP, *_LINE, "shape"), _scored_by_word(materialize(_offer_shapes(crowded[0])), shapes), [*GROUP, "shape"])
    return scored.union(far.select(*columns))


def _by_size(offers: DataFrame, billed: DataFrame, numbers: bool = False) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame] | None]:
    """Both sides of the groups with at most ``GROUP_PAIRS`` pairs, and of the crowded ones if there are any; with ``numbers`` those with
    a ``line_seq`` beyond ``LINE_SEQ`` are among these."""
    seq = F.col("line_seq")
    wide = F.lit(numbers) & F.coalesce(F.bool_or((seq >= LINE_SEQ) | (seq <= -LINE_SEQ)), F.lit(False))
    n = offers.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), wide.alias("wide"))
    m = billed.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("m"))
    crowded = materialize(merged(n, m, GROUP).where((F.col("n") * F.col("m") > GROUP_PAIRS) | F.col("wide")).select(*GROUP))
    if not crowded.take(1):
        return (offers, billed), None
    near, far = (tuple(df.join(crowded, GROUP, how) for df in (offers, billed)) for how in ("left_anti", "left_semi"))
    return near, far


def _units(weight: str) -> int:
    return int(Decimal(weight) * 10**9)


def _decimal(units: Column) -> Column:
    """A signal from its units of the ninth decimal."""
    return (units.cast("decimal(19,0)") * F.lit("0.000000001").cast("decimal(10,9)")).cast("decimal(12,9)")


def _signals(description: Column) -> dict[str, Column]:
    article = F.when(F.arrays_overlap("o_articles", "i_articles"), F.lit(1)).otherwise(F.lit(0))
    signals = {
        "article": article.cast("decimal(20,12)") * _w(fx.WEIGHT_ARTICLE),
        "description": description * _w(fx.WEIGHT_DESCRIPTION),
        "price": price_proximity(F.col("o_price"), F.col("i_price")) * _w(fx.WEIGHT_PRICE),
        "qty": F.when(F.col("o_qty") == F.col("i_qty"), F.lit(1)).otherwise(F.lit(0)).cast("decimal(20,12)") * _w(fx.WEIGHT_QTY),
    }
    return {n: F.round(s, 9).cast("decimal(12,9)") for n, s in signals.items()}


def _prepared(df: DataFrame, side: str) -> DataFrame:
    """Words as text and probes, the price as floating point; inline keeps what follows from making them again for every pair.
    ``plain``: few words of which none stands in another."""
    tokens, probes = F.col(f"{side}_tokens"), F.col(f"{side}_probes")
    df = df.select("*", F.inline(F.array(F.struct(
        _probes(tokens).alias(f"{side}_probes"), _line_text(tokens).alias(f"{side}_text"), F.nullif(F.col(f"{side}_price"), F.lit(0)).cast("double").alias(f"{side}_rough")))))
    nested = F.exists(probes, lambda p: F.exists(probes, lambda q: (p != q) & F.contains(q, p)))
    return df.drop(f"{side}_tokens").select("*", F.inline(F.array(F.struct(((F.size(probes) <= PLAIN_WORDS) & ~nested).alias(f"{side}_plain")))))


def _pairs(offers: DataFrame, billed: DataFrame, ids: list[str], how: str = "inner") -> DataFrame:
    """All pairs that a group's lines form where they meet, with signals in units of the ninth decimal. What is compiled stays apart
    from what is not: an expression inside ``inline`` is interpreted as a whole if any part of it is."""
    met = merged(_prepared(billed, "i"), _prepared(offers, "o"), GROUP, how).withColumns({
        "o_found": _looked_up(F.col("o_probes"), F.col("i_text")), "i_found": _looked_up(F.col("i_probes"), F.col("o_text")), "rough": F.coalesce("i_rough", F.lit(0.0)) / F.col("o_rough")})
    rough = F.col("rough")
    reached = (F.abs(rough - 1) <= 0.51) | ((rough > 0) & (rough < 1.01))
    price = F.round(price_proximity(F.col("o_price"), F.col("i_price"), rough) * _w(fx.WEIGHT_PRICE), 9)

    def weighed(hit: Column, weight: str) -> Column:
        return F.when(hit, F.lit(_units(weight))).otherwise(F.lit(0)).cast("bigint")

    return met.select(
        *GROUP, *ids, "line_seq", F.col("o_price").isNotNull().alias("paired"), weighed(F.arrays_overlap("o_articles", "i_articles"), fx.WEIGHT_ARTICLE).alias("article"),
        _likeness("o", "i").alias("description"), F.when(reached, (price * 10**9).cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias("price"),
        weighed(F.col("o_qty") == F.col("i_qty"), fx.WEIGHT_QTY).alias("qty"))


def _scored_in_group(offers: DataFrame, billed: DataFrame, ids: list[str]) -> DataFrame:
    """Pairs with a common article or word that a group's lines form where they meet, so that no pair is shuffled."""
    return _as_decimals(_pairs(offers, billed, ids).where((F.col("article") > 0) | (F.col("description") > 0)), ids)


def _as_decimals(pairs: DataFrame, ids: list[str]) -> DataFrame:
    return pairs.select(*GROUP, "line_seq", *ids, *[_decimal(F.col(n)).alias(n) for n in _SIGNALS]).withColumn("score", _total())


def _best_in_group(offers: DataFrame, billed: DataFrame) -> DataFrame:
    """Each invoice line with its best offer line ``b``. Score, offer line and signals are one number of 10, 18 and 10 digits: its
    largest needs no sort, so pairs are neither kept nor shuffled."""
    article, qty, price = F.col("article"), F.col("qty"), F.col("price")
    score = (article + F.col("description") + price + qty).cast("decimal(10,0)")
    earlier = F.coalesce(F.lit(LINE_SEQ) - F.col("line_seq"), F.lit(0)).cast("decimal(18,0)")  # a line without a number comes last
    rest = (price * 4 + F.when(article > 0, 2).otherwise(0) + F.when(qty > 0, 1).otherwise(0)).cast("decimal(10,0)")
    digits = lambda n: F.lit(Decimal(10**n)).cast(f"decimal({n + 1},0)")
    number = (score * digits(28)).cast("decimal(38,0)") + earlier * digits(10) + rest
    pairs = _pairs(offers, billed.withColumn("line", F.monotonically_increasing_id()), [*_LINE, "line"], "left")
    best = pairs.groupBy(*GROUP, *_LINE, "line").agg(F.max(F.when(F.col("paired"), number).cast("decimal(38,0)")).alias("best"))
    text = F.lpad(F.col("best").cast("string"), 38, "0")
    part = lambda start, length: F.substring(text, start, length).cast("bigint")
    parts = best.select(*GROUP, *_LINE, part(1, 10).alias("score"), F.nullif(part(11, 18), F.lit(0).cast("bigint")).alias("earlier"), part(29, 10).alias("rest"))
    rest = F.col("rest")
    signals = {"article": F.when(rest.bitwiseAND(2) > 0, _units(fx.WEIGHT_ARTICLE)).otherwise(0), "price": F.shiftright(rest, 2),
               "qty": F.when(rest.bitwiseAND(1) > 0, _units(fx.WEIGHT_QTY)).otherwise(0)}
    signals["description"] = F.col("score") - sum(signals.values(), F.lit(0))
    b = F.struct(_decimal(F.col("score")).alias("score"), (F.col("earlier") - F.lit(LINE_SEQ)).alias("neg"), *[_decimal(signals[n]).alias(n) for n in _SIGNALS])
    return parts.select(*GROUP, *_LINE, F.when(F.col("score").isNotNull(), b).alias("b"))


def _scored_by_word(offers: DataFrame, shapes: DataFrame) -> DataFrame:
    keyed_offers = offers.select(*GROUP, "line_seq", F.explode("o_tokens").alias("o_word"))
    keyed_shapes = shapes.select(*GROUP, "shape", F.explode("i_tokens").alias("i_word"))
    by_word = (
        keyed_offers.join(_related_words(offers, shapes), "o_word").join(keyed_shapes, [*GROUP, "i_word"])
        .select(*GROUP, "line_seq", "shape"))
    by_article = (
        offers.select(*GROUP, "line_seq", F.explode("o_articles").alias("article"))
        .join(shapes.select(*GROUP, "shape", F.explode("i_articles").alias("article")), [*GROUP, "article"]).select(*GROUP, "line_seq", "shape"))
    pairs = by_word.unionByName(by_article).distinct()
    joined = pairs.join(offers, [*GROUP, "line_seq"]).join(shapes, [*GROUP, "shape"])
    signals = _signals(description_similarity(F.col("o_tokens"), F.col("i_tokens")))
    scored = joined.select(*GROUP, "line_seq", "shape", *[c.alias(n) for n, c in signals.items()])
    return scored.withColumn("score", _total())


def _total() -> Column:
    return (F.col("article") + F.col("description") + F.col("price") + F.col("qty")).cast("decimal(12,9)")


def propose_matches(offer_lines: DataFrame, invoice_lines: DataFrame) -> DataFrame:
    """Best offer line per invoice line, first on ties: high from 0.55, medium from 0.40, else
    none. Several invoice lines may share an offer line. A line of confidence none keeps score and signals of the best
    of all offer lines; without any it has score 0 and no signals. A group of at most ``GROUP_PAIRS`` pairs compares them all where
    they meet; in larger ones, of two candidates of one price signal the one of the nearer price below stands for it."""
    return _proposed(materialize(_offer_side(offer_lines)), materialize(_billed_side(invoice_lines)))


def _proposed(offers: DataFrame, billed: DataFrame) -> DataFrame:
    near, large = _by_size(offers, billed, numbers=True)
    best = _best_in_group(*map(_dealt, near))
    if large is not None:
        best = best.unionByName(_best_by_shape(*large))
    score = F.col("b.score")
    hit = score >= F.lit(fx.MEDIUM_THRESHOLD).cast("decimal(12,9)")
    return best.select(
        *GROUP, *_LINE, F.when(hit, -F.col("b.neg")).alias("line_seq"), F.coalesce(score, F.lit(0).cast("decimal(12,9)")).alias("score"),
        F.when(score >= F.lit(fx.HIGH_THRESHOLD).cast("decimal(12,9)"), "high").when(hit, "medium").otherwise("none").alias("confidence"),
        F.when(F.col("b").isNotNull(), F.struct(*[F.col(f"b.{s}").alias(s) for s in _SIGNALS])).alias("signals"))


def _best_by_shape(offers: DataFrame, billed: DataFrame) -> DataFrame:
    """The same for groups of many lines: copies are compared once, and still larger groups go by article, word and price."""
    offers, billed = materialize(_offer_shapes(offers)), materialize(_shaped(billed))
    shapes = materialize(billed.select(*GROUP, *_SHAPE).distinct())
    near, crowded = _by_size(offers, shapes)
    scored = _as_decimals(_pairs(*map(_dealt, near), ["shape"]), ["shape"])
    if crowded is not None:
        others = _price_and_quantity(*crowded).withColumn("score", _total())
        scored = scored.unionByName(_scored_by_word(*crowded)).unionByName(others)
    best = scored.groupBy(*GROUP, "shape").agg(
        F.max(F.struct("score", (-F.col("line_seq")).alias("neg"), *_SIGNALS)).alias("b"))
    return billed.select(*GROUP, *_LINE, "shape").join(best, [*GROUP, "shape"], "left").drop("shape")


def allocate_lump_sums(offer_lines: DataFrame, invoice_lines: DataFrame, groups: DataFrame) -> DataFrame:
    """Invoice lines that bill a whole offer at once, spread pro rata over the lines covered: the
    binding total, the total with priced options, or the special price, in that order.
    ``groups``: project_id, group_seq, group_sonderpreis."""
    return _spread(offer_lines, _lump_lines(offer_lines, invoice_lines, groups))


def _priced_lines(offer_lines: DataFrame) -> DataFrame:
    return matchable_offer_lines(offer_lines).where(F.col("line_total_net") != 0)


def _lump_lines(offer_lines: DataFrame, invoice_lines: DataFrame, groups: DataFrame) -> DataFrame:
    """Invoice lines whose amount is a total of their group, with that total."""
    sums = _priced_lines(offer_lines).groupBy(*GROUP).agg(
        F.sum(F.when(~F.col("optional"), F.col("line_total_net"))).alias("mandatory"), F.sum("line_total_net").alias("everything"),
        F.count_if(~F.col("optional")).alias("n_mandatory"))
    targets = sums.join(groups.select(*GROUP, "group_sonderpreis").distinct(), GROUP, "left")
    amount, tolerance = F.col("line_total_net"), F.lit(fx.CENT_TOLERANCE).cast("decimal(18,2)")

    def fits(target: Column) -> Column:
        return F.coalesce((target != 0) & (F.abs(amount - target) <= tolerance), F.lit(False))

    has_mandatory = F.col("n_mandatory") > 0
    hit = (
        F.when(has_mandatory & fits(F.col("mandatory")), F.struct(F.col("mandatory").alias("target"), F.lit(False).alias("options")))
        .when(fits(F.col("everything")), F.struct(F.col("everything").alias("target"), F.lit(True).alias("options")))
        .when(has_mandatory & fits(F.col("group_sonderpreis")), F.struct(F.col("group_sonderpreis").cast("decimal(28,2)").alias("target"), F.lit(False).alias("options"))))
    return invoice_lines.where(amount != 0).join(targets, GROUP).withColumn("hit", hit).where(F.col("hit").isNotNull()).select(
        *GROUP, *_LINE, F.col("line_total_net").alias("lump"), "hit")


def _spread(offer_lines: DataFrame, lumps: DataFrame) -> DataFrame:
    covered = _priced_lines(offer_lines).select(*GROUP, "line_seq", "optional", F.col("line_total_net").alias("offered"))
    share = F.bround(F.col("offered") * F.col("lump") / F.col("hit.target"), 2).cast("decimal(18,2)")
    note = F.concat(F.lit("Gesamtangebot pauschal abgerechnet — eine Rechnungszeile über "), format_de(F.col("lump")), F.lit(" €"))
    return lumps.join(covered, GROUP).where(F.col("hit.options") | ~F.col("optional")).select(
        *GROUP, *_LINE, "line_seq", share.alias("amount"), F.lit("high").alias("confidence"), F.lit("lump").alias("source"), note.alias("note"))


def merge_second_source(proposals: DataFrame, pairs: DataFrame) -> DataFrame:
    """Proposals after a second opinion: it may fill ``none`` (as medium) and redirect ``medium``
    from a confidence of 0.55; ``high`` is never touched. ``pairs``: project_id, group_seq,
    invoice_id, pos_seq, second_line_seq, reason, certainty."""
    df = proposals.join(pairs, [*GROUP, "invoice_id", "pos_seq"], "left")
    sure = F.col("second_line_seq").isNotNull() & (F.col("certainty") >= fx.SECOND_SOURCE_FLOOR)
    none, medium = F.col("confidence") == "none", F.col("confidence") == "medium"
    agrees = F.coalesce(F.col("second_line_seq") == F.col("line_seq"), F.lit(False))
    fills, redirects = none & sure, medium & sure & ~agrees
    takes = F.coalesce(fills | redirects, F.lit(False))
    note = F.when(takes | none | (medium & agrees), F.col("reason"))
    return df.withColumn("_takes", takes).withColumn("note", F.coalesce(note, F.lit(""))).withColumns({
        "line_seq": F.when(F.col("_takes"), F.col("second_line_seq")).otherwise(F.col("line_seq")),
        "source": F.when(F.col("_takes"), "second").otherwise("signal"),
        "confidence": F.when(F.col("_takes") & none, "medium").otherwise(F.col("confidence")),
    }).drop("second_line_seq", "reason", "certainty", "_takes")


def match_lines(offer_lines: DataFrame, invoice_lines: DataFrame, groups: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """Every billed line in exactly one of: spread as a lump sum, matched to an offer line, or
    extra (``line_seq`` null). Both sides are read once."""
    offers, billed = materialize(_offer_side(offer_lines)), materialize(_billed_side(matchable_invoice_lines(invoice_lines)))
    stated = offers.select(*GROUP, "line_seq", "optional", F.col("o_price").alias("line_total_net"))
    lump_lines = materialize(_lump_lines(stated, billed.select(*GROUP, *_LINE, F.col("i_price").alias("line_total_net")), groups))
    lumps = _spread(stated, lump_lines)
    single = materialize(billed.join(lump_lines.select(*GROUP, *_LINE).distinct(), [*GROUP, *_LINE], "left_anti"))
    proposals = _proposed(offers, single).drop("score", "signals")
    if second is not None:
        proposals = merge_second_source(proposals, second)
    else:
        proposals = proposals.withColumns({"source": F.lit("signal"), "note": F.lit("")})
    amounts = single.select(*GROUP, *_LINE, F.col("i_price").alias("amount"))
    matched = proposals.join(amounts, [*GROUP, "invoice_id", "pos_seq"])
    columns = [*GROUP, "invoice_id", "pos_seq", "line_seq", "amount", "confidence", "source", "note"]
    return lumps.select(*columns).unionByName(matched.select(*columns))


def position_refs(matches: DataFrame, invoice_lines: DataFrame) -> DataFrame:
    """``<invoice number>#<line>`` per match: one row each, so an offer line billed any number of
    times never has to fit one cell."""
    number = F.coalesce(F.nullif(F.col("pos"), F.lit("")), F.col("pos_seq").cast("string"))
    named = invoice_lines.select(*GROUP, "invoice_id", "pos_seq", F.concat("invoice_number", F.lit("#"), number).alias("ref"), "description")
    return matches.join(named, [*GROUP, "invoice_id", "pos_seq"])


def position_comparison(offer_lines: DataFrame, matches: DataFrame, groups: DataFrame, invoices: DataFrame) -> DataFrame:
    """Offer lines with what was billed on them, extras, a total per group, and invoices without
    an offer. ``groups``: project_id, group_seq, group_label, group_sonderpreis; ``invoices``: the
    invoices in scope with their group_seq (null without an offer). References: ``position_refs``."""
    matches = materialize(matches)  # read by the offer rows, the extras and the totals
    weakest = F.max("confidence")
    billed = matches.where(F.col("line_seq").isNotNull()).groupBy(*GROUP, "line_seq").agg(
        F.sum("amount").alias("invoiced"), weakest.alias("confidence"), F.count(F.lit(1)).alias("n_lines"))
    lines = matchable_offer_lines(offer_lines).join(billed, [*GROUP, "line_seq"], "left")
    offered = F.col("line_total_net")
    variance = F.when(F.col("n_lines").isNotNull(), F.col("invoiced") - offered)
    hint = F.when(F.col("n_lines").isNull(), F.when(F.col("optional"), "optional, nicht abgerufen").otherwise("FEHLT — keine Rechnungszeile zugeordnet"))
    no = F.lit(None)
    rows = lines.withColumn("variance", variance).select(
        *GROUP, F.lit("offer").alias("kind"), "line_seq", no.cast("bigint").alias("invoice_id"), no.cast("bigint").alias("pos_seq"), "pos", "description",
        offered.cast("decimal(28,2)").alias("offered"), F.col("invoiced").cast("decimal(28,2)").alias("invoiced"), F.col("variance").cast("decimal(28,2)").alias("variance"),
        F.when(offered != 0, F.col("variance").cast("decimal(18,2)") / F.nullif(offered, F.lit(0)).cast("decimal(18,2)")).cast("decimal(20,8)").alias("variance_share"),
        "confidence", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), hint.alias("hint"), "optional")
    extras = matches.where(F.col("line_seq").isNull())
    extra_rows = extras.select(
        *GROUP, F.lit("extra").alias("kind"), no.cast("bigint").alias("line_seq"), "invoice_id", "pos_seq", F.lit("EXTRA").alias("pos"), no.cast("string").alias("description"),
        no.cast("decimal(28,2)").alias("offered"), F.col("amount").cast("decimal(28,2)").alias("invoiced"), no.cast("decimal(28,2)").alias("variance"),
        no.cast("decimal(20,8)").alias("variance_share"), no.cast("string").alias("confidence"), F.lit(1).cast("bigint").alias("n_lines"),
        F.coalesce(F.nullif(F.col("note"), F.lit("")), F.lit("keine Angebotsposition zugeordnet")).alias("hint"), no.cast("boolean").alias("optional"))
    zero = F.lit(0).cast("decimal(28,2)")
    totals = rows.unionByName(extra_rows).groupBy(*GROUP).agg(
        F.coalesce(F.sum(F.when(F.col("optional") == F.lit(False), F.col("offered"))), zero).alias("offered"), F.coalesce(F.sum("invoiced"), zero).alias("invoiced"),
        F.count_if((F.col("kind") == "offer") & (F.col("n_lines") == 0) & ~F.col("optional")).alias("missing"),
        F.count_if((F.col("kind") == "offer") & (F.col("n_lines") > 0) & (F.col("variance") != 0)).alias("drifted"),
        F.count_if(F.col("kind") == "extra").alias("extra"))
    used = invoices.where(F.col("group_seq").isNotNull()).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n_invoices"))
    group_rows = groups.select(*GROUP, "group_label", "group_sonderpreis").distinct().join(totals, GROUP, "left").join(used, GROUP, "left")
    sum_hint = F.when(F.col("n_invoices").isNull(), "keine Rechnung dieses Lieferanten im Lauf").when(
        F.col("group_sonderpreis").isNotNull(), F.concat(F.lit("Sonderpreis lt. Angebot: "), format_de(F.col("group_sonderpreis")), F.lit(" €")))
    total_rows = group_rows.select(
        *GROUP, F.lit("sum").alias("kind"), F.lit("Σ").alias("pos"), F.concat(F.lit("Summe "), "group_label", F.lit(" (ohne optionale Positionen)")).alias("description"),
        F.coalesce("offered", zero).alias("offered"), F.coalesce("invoiced", zero).alias("invoiced"),
        (F.coalesce("invoiced", zero) - F.coalesce("offered", zero)).cast("decimal(28,2)").alias("variance"), sum_hint.alias("hint"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("missing", "drifted", "extra")])
    offerless = invoices.where(F.col("group_seq").isNull()).select(
        *GROUP, F.lit("offerless").alias("kind"), "invoice_id", F.concat("vendor_name", F.lit(" — "), "invoice_number").alias("description"),
        F.col("netto").cast("decimal(28,2)").alias("invoiced"), F.lit("kein Angebot dieses Lieferanten (ggf. lt. Schätzung)").alias("hint"))
    detail = rows.drop("optional").unionByName(extra_rows.drop("optional"))
    return detail.unionByName(total_rows, allowMissingColumns=True).unionByName(offerless, allowMissingColumns=True)
