"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken target / source size times. The whole part is taken for sure; the fraction is
rounded to 0 or 1 so that expectations hold and sums hardly move: two fractions meet, one hands mass to the other at random
until one of them is integral, and the other goes on. Fractions meet in blocks of about ``BLOCK`` documents of nearly the
same size; what each block leaves over meets the leftovers of other blocks, level by level (a tree with a fan of ``BLOCK``), then
the leftovers of a source's size classes meet from large to small. So a source's words differ from the target by
differences of sizes within a class and, at the end, by part of one small document.

Column expressions only; what a level hands on is written to the shared folder. Random numbers are hashes of document ids,
so reruns agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from costproof.llm.tables import written
from costproof.scale import rank_by_index, rank_within

WEIGHTS, CEILING, BLOCK, CLASSES = (5.0, 2.0, 1.0), 3.0, 128, 8
_EPS = 1e-9


def word_count(text: Column) -> Column:
    """Number of runs without white space; 0 for null."""
    parts = F.split(text, "[\\x20\\x09-\\x0D]+")
    edges = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.coalesce((F.size(parts) - edges).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size): one row per source, null among them.

    Sources in code point order, null last, weigh WEIGHTS in turn and share the sum of all sizes; none gets more than CEILING times its own
    size, and what that leaves goes to the others by weight until none is above.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.col("rn") - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (turn + 1).cast("int"))
    sources = written(rank_within(sources, [], [F.col("source").asc_nulls_last()]).withColumn("weight", weight).drop("rn"))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    share, capped = 0.0, -1
    while True:  # the share of a unit of weight only rises, and each round but the last caps another source
        above = F.col("weight") * F.lit(share) > CEILING * F.col("source_size")
        full, left, n = sources.agg(
            F.sum(F.when(above, CEILING * F.col("source_size")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.sum(above.cast("int"))).first()
        if n is None or n == capped or not left:
            break
        share, capped = (total - full) / left, n
    return sources.select("source", "source_size", F.least(F.col("weight") * F.lit(share), CEILING * F.col("source_size")).alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def _meet(units: Column, level: int) -> Column:
    """Pivotal rounding along an array of units: (left: the unit that stays fractional or null, done: the others)."""
    unit = "struct<size:bigint,id:bigint,p:double,keep:bigint>"

    def having(u: Column, p: Column) -> Column:
        return F.struct(u["size"].alias("size"), u["id"].alias("id"), p.alias("p"), u["keep"].alias("keep"))

    def step(state: Column, x: Column) -> Column:
        held = state["left"]
        both, chance = held["p"] + x["p"], _uniform(held["id"], x["id"], F.lit(level))
        low, even = both < 1 - _EPS, F.abs(both - 1) <= _EPS
        held_wins = F.when(low, chance * both < held["p"]).when(even, chance < held["p"]).otherwise(chance * (2 - both) < 1 - x["p"])
        high_p = F.when(low, both).otherwise(F.lit(1.0))
        low_p = F.when(low | even, F.lit(0.0)).otherwise(both - 1)
        first, second = having(held, F.when(held_wins, high_p).otherwise(low_p)), having(x, F.when(held_wins, low_p).otherwise(high_p))
        open_first = (first["p"] > _EPS) & (first["p"] < 1 - _EPS)
        open_second = (second["p"] > _EPS) & (second["p"] < 1 - _EPS)
        none = F.lit(None).cast(unit)
        met = F.struct(
            F.when(open_first, first).when(open_second, second).otherwise(none).alias("left"),
            F.concat(state["done"], F.when(open_first, F.array(second)).when(open_second, F.array(first)).otherwise(F.array(first, second))).alias("done"))
        return F.when(held.isNull(), F.struct(x.alias("left"), state["done"].alias("done"))).otherwise(met)

    start = F.struct(F.lit(None).cast(unit).alias("left"), F.array().cast(f"array<{unit}>").alias("done"))
    return F.aggregate(units, start, step)


def copies(docs: DataFrame) -> DataFrame:
    """(source, size, id, keep, source_size, target, copies) of (source, size, id, keep): how often each row is taken.

    ``id`` seeds the random numbers and ``keep`` is carried along. Rows of size 0 are not taken.
    """
    targets = written(source_targets(docs))
    unit = F.struct("size", "id", "p", "keep").alias("unit")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(wanted + _EPS)
    fraction = F.greatest(F.lit(0.0), wanted - whole)
    sized = docs.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    sized = sized.withColumn("whole", F.when(F.col("size") > 0, whole).otherwise(0)).withColumn("p", F.when((F.col("size") > 0) & (fraction > _EPS), fraction).otherwise(0.0))
    sized = written(sized.withColumn("class", F.floor(F.log2(F.col("size") + 1) * CLASSES).cast("int")))
    # Rows alike in id and size are numbered, so that one id never fills a block.
    open_rows = rank_by_index(sized.where("p > 0"), ["source", "class", "id", "size"], "keep", "copy")
    counts = written(open_rows.groupBy("source", "class").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")))
    most = counts.agg(F.max("blocks")).first()[0] or 0
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c"))
    spread = F.xxhash64("id", "copy").alias("spread")
    units = open_rows.join(counts.select(F.col("source").alias("s"), F.col("class").alias("c"), "blocks"), same).select("source", "class", "blocks", spread, unit)
    done, level = [], 0
    while level == 0 or most > 0:
        block = F.pmod(F.xxhash64("spread", F.lit(level)), "blocks")
        groups = units.groupBy("source", "class", "blocks", block.alias("block")).agg(F.reverse(F.array_sort(F.collect_list("unit"))).alias("units"), F.min("spread").alias("spread"))
        met = written(groups.select("source", "class", "blocks", "spread", _meet(F.col("units"), level).alias("met")))
        done.append(met.select(F.explode("met.done").alias("unit")))
        units = met.where("met.left is not null").select("source", "class", F.ceil(F.col("blocks") / BLOCK).alias("blocks"), "spread", F.col("met.left").alias("unit"))
        level += 1
        if most <= 1:
            break
        most = -(-most // BLOCK)
    # The leftovers of a source's size classes: one unit for each class, from large to small.
    last = units.groupBy("source").agg(F.reverse(F.array_sort(F.collect_list("unit"))).alias("units"))
    last = written(last.select(_meet(F.col("units"), level).alias("met")))
    rest = last.where("met.left is not null").select(F.col("met.left").alias("unit"))
    rest = rest.select(F.struct("unit.size", "unit.id", (_uniform(F.col("unit.id"), F.lit(-1)) < F.col("unit.p")).cast("double").alias("p"), "unit.keep").alias("unit"))
    done += [last.select(F.explode("met.done").alias("unit")), rest]
    extra = reduce(DataFrame.union, done).select("unit.keep", F.round("unit.p").cast("long").alias("extra")).where("extra > 0")
    return sized.join(extra, "keep", "left").select(
        "source", "size", "id", "keep", "source_size", "target", (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("long").alias("copies"))


def _sized(docs: DataFrame, doc_id: str, source: str, text: str, keep: Column) -> DataFrame:
    seed = F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(F.col(text)))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), seed.alias("id"), keep.alias("keep"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (words the mix takes, copies counted).

    A null text has size 0; rows of size 0 are never taken. A null source is a source of its own, the last. Rows that repeat
    are rows of their own. A null doc_id stays null. Without words at all every target is 0. Empty input gives no rows;
    further columns are ignored.
    """
    rows = written(_sized(docs, doc_id, source, text, F.monotonically_increasing_id()))
    taken = copies(rows.select("source", "size", "id", "keep"))
    return rows.select("doc_id", "keep").join(taken, "keep").select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    kept = written(docs.withColumn("__row", F.monotonically_increasing_id()))
    rows = written(_sized(kept, doc_id, source, text, F.col("__row")).drop("doc_id"))
    taken = copies(rows).where("copies > 0").select(F.col("keep").alias("__row"), F.col("copies").cast("int").alias("__copies"))
    copied = kept.join(taken, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return copied.select(*[F.col(f"`{c}`") for c in docs.columns])
