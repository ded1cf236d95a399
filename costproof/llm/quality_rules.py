"""Quality rules: a decision list learned by sequential covering.

Text statistics of every document are column expressions. From labelled rows, conjunctions of at most ``TERMS`` thresholds are grown
on two thirds of the sample, each step taking the threshold of the largest information gain, and pruned on the other
third; a rule that rejects there with a precision of ``PRECISION`` or more joins the list, the rows it covers leave, and
the next rule is grown. The list becomes one ordered CASE expression; what no rule rejects is kept.

The search reads at most ``SAMPLE`` labelled rows (those of the smallest id hash), so each step is one small aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from costproof.llm.tables import written

SAMPLE, QUANTILES, TERMS, RULES, PRECISION, LEAST = 16_000, 24, 3, 10, 0.95, 10
#: Longs that ``statistics`` returns, the first five by the contract of op2.
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_exclaims", "n_capitals", "n_chars"]
WINDOW = 8

Rule = list[tuple[str, str, float]]


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``__stats`` of STATISTICS; a null text counts as empty.

    n_repeat_words: words that lie in a window of 8 words that the text has twice or more. Windows are compared by 64-bit
    hashes of their words' hashes; equal ones are found by sorting, so long repetitive texts cost n log n.
    """
    words = F.filter(F.split(F.coalesce(F.col("__text"), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(F.coalesce(F.col("__text"), F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    staged = docs.withColumn("__text", F.col(text)).withColumn("__words", words).withColumn("__lines", lines)
    count = lambda pattern: F.coalesce(F.regexp_count("__text", F.lit(pattern)), F.lit(0))
    staged = staged.withColumns({
        "__hash": F.transform("__words", lambda w: F.xxhash64(w)),
        "__plain": F.struct(
            F.size("__words").alias("n_words"), F.length(F.array_join("__words", "")).alias("word_chars"), count("[#*$%&|<>]").alias("n_symbols"),
            (F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"), F.size("__lines").alias("n_lines"), count("!").alias("n_exclaims"),
            count("\\p{Lu}").alias("n_capitals"), F.coalesce(F.length("__text"), F.lit(0)).alias("n_chars"))}).drop("__text", "__words", "__lines")
    last = F.size("__hash") - WINDOW
    windows = F.when(last >= 1, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("__hash", i + k) for k in range(WINDOW)])))
    staged = staged.withColumn("__windows", F.coalesce(windows, F.array().cast("array<bigint>"))).withColumn("__distinct", F.size(F.array_distinct("__hash")))
    staged = staged.drop("__hash").withColumn("__repeats", F.size("__windows") > F.size(F.array_distinct("__windows")))
    by_hash = F.when(F.col("__repeats"), F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    staged = staged.withColumn("__sorted", by_hash).drop("__windows")
    twice = F.filter("__sorted", lambda x, i: (x["h"] == F.get("__sorted", i - 1)["h"]) | (x["h"] == F.get("__sorted", i + 1)["h"]))
    staged = staged.withColumn("__starts", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("__sorted", "__repeats")
    covered = F.aggregate("__starts", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("end")), lambda s, i: F.struct(
        (s["n"] + F.lit(WINDOW) - F.greatest(F.lit(0), s["end"] - i)).alias("n"), (i + F.lit(WINDOW)).alias("end")))
    stats = {c: F.col("__plain")[c] for c in STATISTICS if c not in ("n_repeat_words", "n_distinct")}
    stats |= {"n_repeat_words": F.coalesce(covered["n"], F.lit(0)), "n_distinct": F.col("__distinct")}
    return staged.withColumn("__stats", F.struct(*[stats[c].cast("long").alias(c) for c in STATISTICS])).drop("__plain", "__starts", "__distinct")


def measures(stats: Column) -> dict[str, Column]:
    """What rules set thresholds on: shares and means of a ``stats`` struct, null where there is nothing to divide by."""
    per = lambda a, b: F.try_divide(stats[a].cast("double"), stats[b].cast("double"))
    return {
        "symbols_per_word": per("n_symbols", "n_words"), "repeated_share": per("n_repeat_words", "n_words"), "dup_line_share": per("n_dup_lines", "n_lines"),
        "exclaims_per_word": per("n_exclaims", "n_words"), "capital_share": per("n_capitals", "word_chars"), "distinct_share": per("n_distinct", "n_words"),
        "word_length": per("word_chars", "n_words"), "words": stats["n_words"].cast("double"), "words_per_line": per("n_words", "n_lines"),
    }


def base_failed(stats: Column) -> Column:
    """Fixed limits that hold before any learned rule."""
    return (stats["n_words"] < 20) | (100 * stats["n_repeat_words"] > 30 * stats["n_words"])


def learn_rules(labelled: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules that reject, in order, from rows (id, stats, bad): ``bad`` is 1 for a row to reject. No labels of both kinds, no rules."""
    named = measures(F.col("stats"))
    rows = labelled.where("bad is not null").select("id", F.col("bad").cast("int").alias("bad"), *[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in named.items()])
    rows = written(rows.orderBy(F.xxhash64("id"), "id").limit(sample).withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3))))
    grid = [(i + 0.5) / QUANTILES for i in range(QUANTILES)]
    of = lambda n, b: F.percentile_approx(F.when(F.col("bad") == b, F.col(n)), grid, 10_000).alias(f"{n}_{b}")
    marks = rows.coalesce(1).agg(*[of(n, b) for n in named for b in (0, 1)]).first()
    cuts = {n: _with_middles(sorted({*(marks[f"{n}_0"] or ()), *(marks[f"{n}_1"] or ())})) for n in named}
    binned = written(rows.coalesce(1).select("bad", "part", *[F.size(_at_or_below(t, n)).alias(n) for n, t in cuts.items() if t]))
    cuts = {n: t for n, t in cuts.items() if t}
    if not cuts:
        return []
    open_rows, rules = binned.coalesce(1), []
    while len(rules) < RULES:
        rule: list[tuple[str, str, int]] = []
        while len(rule) < TERMS:
            best = _best_term(open_rows.where("part > 0").where(_bins(rule)), list(cuts))
            if best is None:
                break
            rule.append(best[:3])
            if best[3] == 0:
                break
        rule = _pruned(open_rows.where("part = 0"), rule)
        if not rule:
            break
        rules.append([(n, op, float(cuts[n][k])) for n, op, k in rule])
        open_rows = open_rows.where(~_bins(rule))
    return rules


def _with_middles(values: list[float]) -> list[float]:
    """The values and the middle of each two neighbours."""
    return sorted({*values, *((a + b) / 2 for a, b in zip(values, values[1:]))})


def _at_or_below(cuts: list[float], name: str) -> Column:
    return F.filter(F.array(*map(F.lit, cuts)), lambda x: x <= F.col(name))


def _bins(rule: list[tuple[str, str, int]]) -> Column:
    """A conjunction over bin numbers: a value's bin is its number of thresholds at or below it."""
    return reduce(Column.__and__, [F.col(n) > k if op == ">=" else F.col(n) <= k for n, op, k in rule], F.lit(True))


def _best_term(rows: DataFrame, names: list[str]) -> tuple[str, str, int, int] | None:
    """(measure, operator, threshold number, good rows left) of the largest gain, or None without a gain."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("bin")) for n in names])).alias("x")
    cells = rows.select("bad", pairs).groupBy("x.name", "x.bin").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
    whole, up = Window.partitionBy("name"), Window.partitionBy("name").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = cells.select("name", "bin", F.sum("p").over(whole).alias("all_p"), F.sum("n").over(whole).alias("all_n"), F.sum("p").over(up).alias("p"), F.sum("n").over(up).alias("n"))
    below = sums.select("name", F.lit("<").alias("op"), F.col("bin").alias("k"), "p", "n", "all_p", "all_n")
    above = sums.select("name", F.lit(">=").alias("op"), F.col("bin").alias("k"), (F.col("all_p") - F.col("p")).alias("p"), (F.col("all_n") - F.col("n")).alias("n"), "all_p", "all_n")
    gain = F.col("p") * (F.log2((F.col("p") + 1) / (F.col("p") + F.col("n") + 2)) - F.log2((F.col("all_p") + 1) / (F.col("all_p") + F.col("all_n") + 2)))
    scored = below.union(above).where((F.col("p") >= LEAST) & (F.col("p") + F.col("n") < F.col("all_p") + F.col("all_n"))).withColumn("gain", gain).where("gain > 0")
    wider = F.when(F.col("op") == ">=", F.col("k")).otherwise(-F.col("k"))  # of equal gains the rule that covers more
    best = scored.orderBy(F.desc("gain"), "name", "op", wider).first()
    return best and (best["name"], best["op"], best["k"], best["n"])


def _pruned(rows: DataFrame, rule: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
    """The first terms of a rule that do best on rows it was not grown on; none if they reject too many good ones."""
    if not rule:
        return []
    heads = [rule[: i + 1] for i in range(len(rule))]
    sums = rows.agg(*[F.sum(F.when(_bins(h), y).otherwise(0)) for h in heads for y in (F.col("bad"), 1 - F.col("bad"))]).first()
    best, found = None, []
    for head, p, n in zip(heads, sums[::2], sums[1::2], strict=True):
        if p and p >= LEAST / 2 and p / (p + n) >= PRECISION and (best is None or p - n > best):
            best, found = p - n, head
    return found


def rejected_by(rules: list[Rule], stats: Column) -> Column:
    """Number of the first rule that rejects, from 1; 0 if none does."""
    named = measures(stats)
    verdict: Column | None = None
    for i, rule in enumerate(rules, 1):
        terms = [F.coalesce(named[n], F.lit(0.0)) >= t if op == ">=" else F.coalesce(named[n], F.lit(0.0)) < t for n, op, t in rule]
        met = reduce(Column.__and__, terms)
        verdict = F.when(met, i) if verdict is None else verdict.when(met, i)
    return F.lit(0) if verdict is None else verdict.otherwise(0)


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """``docs`` (without their text unless ``carry``) with __stats, __failed, __rule and __kept."""
    columns = [f"`{c}`" for c in docs.columns if carry or c in (doc_id, text)]
    counted = statistics(docs.select(*columns), text)
    counted = written(counted if carry else counted.drop(text))
    marked = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("quality"))
    learned_from = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(4)) != 2
    seen = counted.select(F.col(doc_id).cast("long").alias("id"), "__stats").join(marked.where(learned_from), "id")
    rules = learn_rules(seen.where(~base_failed(F.col("__stats"))).select("id", F.col("__stats").alias("stats"), (F.col("quality") == 0).cast("int").alias("bad")))
    return counted.withColumn("__failed", base_failed(F.col("__stats"))).withColumn("__rule", rejected_by(rules, F.col("__stats"))).withColumn(
        "__kept", ~F.col("__failed") & (F.col("__rule") == 0))


def quality_rules(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule, kept.

    ``labels`` has doc_id and quality (0 rejects, 1 keeps); rows whose crc32(doc_id as text) mod 4 is 2 are held out of learning. A
    null or wordless text fails the base rule. Without labels, or with one kind only, no rule is learned and the base rule
    alone decides. Rows that repeat are rows of their own, a null doc_id stays null, further columns are ignored.
    """
    found = judged(docs, labels, doc_id, text)
    return found.select(F.col(doc_id).cast("long").alias("doc_id"), *[F.col("__stats")[c].alias(c) for c in STATISTICS[:5]],
                        F.col("__failed").alias("base_failed"), F.col("__rule").alias("rule"), F.col("__kept").alias("kept"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    return judged(docs, labels, carry=True).where("__kept").select(*[f"`{c}`" for c in docs.columns])
