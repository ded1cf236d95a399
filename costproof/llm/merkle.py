"""Merkle dataset manifest: a tree of digests per source, and one tree over the sources' roots.

A node is (tree, idx). At every level the nodes in slot 0 of their run compute the indices of their siblings by slot offset
(for two slots that is idx XOR 1), one equijoin fetches those, and the slot-0 rows emit the parents, each with its run. An index is met by
one row, so a source that holds a third of all rows is spread like any other. Every level is a written table, ``fanout`` times
smaller than the one below.

Proofs go the other way: a parent hands its steps (the digests left and right of the path) to its children, so only the lowest
level joins as many rows as there are leaves. A proof is digested, and folded with a leaf, where it is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from costproof.llm.tables import written
from costproof.scale import rank_within

FANOUT = 16
#: The columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEPS = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*fields: Column) -> Column:
    """Each field is ``-`` if null, else its UTF-8 byte count, ``:`` and its text."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def built(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the leaves (tree, idx, digest and more) up, each with height, the levels above the tree's leaves.

    Nodes above the leaves are (tree, idx, digest, height, nodes, run): the digests of their children in order. A tree ends where one
    node is left: at the level that equals its height.
    """
    sizes = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("nodes"))
    above = sum(((F.col("nodes") > fanout**k).cast("int") for k in range(1, 62) if fanout**k < 1 << 62), (F.col("nodes") > 1).cast("int"))
    levels = [written(leaves.join(sizes.withColumn("height", above), "tree"))]
    top = levels[0].agg(F.max("height")).first()[0] or 0
    for level in range(top):
        nodes = levels[-1].where(F.col("height") > level).select("tree", "idx", "digest", "height", "nodes")
        zero = nodes.where(F.col("idx") % fanout == 0)
        last = F.least(F.lit(fanout - 1), F.col("nodes") - 1 - F.col("idx"))
        shape = ["tree", "height", "nodes"]
        asked = zero.where(last > 0).select(*shape, F.col("idx").alias("zero"), F.explode(F.sequence(F.lit(1), last.cast("int"))).alias("slot"))
        siblings = asked.withColumn("idx", F.col("zero") + F.col("slot")).join(nodes.select("tree", "idx", "digest"), ["tree", "idx"])
        members = siblings.select(*shape, "zero", "slot", "digest").union(zero.select(*shape, F.col("idx").alias("zero"), F.lit(0), "digest"))
        runs = members.groupBy(*shape, "zero").agg(F.array_sort(F.collect_list(F.struct("slot", "digest")))["digest"].alias("run"))  # at most ``fanout``
        levels.append(written(runs.select(
            "tree", F.floor(F.col("zero") / fanout).alias("idx"), digest(F.array_join("run", "")).alias("digest"), "height",
            F.ceil(F.col("nodes") / fanout).alias("nodes"), "run")))
    return levels


def paths(levels: list[DataFrame], roots: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The leaves of ``levels`` with the columns of ``roots`` (tree, steps, more), their own steps put before those of their root."""
    more = [c for c in roots.columns if c not in ("tree", "steps")]
    parents = None
    for level in range(len(levels) - 1, -1, -1):
        nodes = levels[level]
        own = nodes.columns
        here = nodes.where(F.col("height") == level).join(roots, "tree").select(*own, *more, "steps")
        if parents is not None:
            slot = (F.col("idx") % fanout).cast("int")
            step = F.struct(F.array_join(F.slice("_run", F.lit(1), slot), "").alias("left"), F.array_join(F.slice("_run", slot + 2, F.lit(fanout)), "").alias("right"))
            found = nodes.where(F.col("height") > level).withColumn("_at", F.floor(F.col("idx") / fanout)).join(parents, ["tree", "_at"])
            here = here.union(found.select(*own, *more, F.concat(F.array(step), "steps").alias("steps")))
        if level:
            parents = written(here.select("tree", F.col("idx").alias("_at"), F.col("run").alias("_run"), *more, "steps"))
    return here


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf's digest and the steps of its path give."""
    return F.aggregate(steps, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def proof_digest(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def every_fifth_lowered(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text after a tampering that lower-cases A-Z where 5 divides the crc32 of the decimal doc_id."""
    hit = F.crc32(F.col(doc_id).cast("string")) % 5 == 0
    return F.when(hit, F.translate(F.col(text), UPPER, LOWER)).otherwise(F.col(text))


def manifest(docs: DataFrame, tampered: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tampered`` is the text found when verifying (the stored one by default). Leaves ascend by doc_id, null first, rows of one doc_id by their digest;
    equal rows are leaves of their own and share all results. A null source is a tree of its own, apart from an empty one. A null doc_id
    is never tampered with by ``every_fifth_lowered``. One document is its own leaf, subroot and root, and its proof is the digest of
    nothing. Empty input gives no rows; further columns are ignored.
    """
    columns = [F.col(c) for c in FIELDS]
    given = F.col("text") if tampered is None else tampered
    found = F.when(F.col("text").eqNullSafe(given), F.lit(None)).otherwise(leaf_digest(*columns[:-1], given))
    leaves = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("tree"), leaf_digest(*columns).alias("digest"), found.alias("found"))
    numbered = lambda df, order: rank_within(df, ["tree"], order, "_n").withColumn("idx", F.col("_n") - 1).drop("_n")
    levels = built(numbered(written(leaves), ["tree", "doc_id", "digest"]), fanout)
    subroots = levels[0].where("height = 0").select("tree", "digest")
    for level, nodes in enumerate(levels[1:], 1):
        subroots = subroots.union(nodes.where(F.col("height") == level).select("tree", "digest"))
    ordered = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source_tree"), "digest")
    top = built(numbered(ordered, ["source_tree"]), fanout)
    root = top[-1].select("tree", F.col("digest").alias("root"), F.array().cast(_STEPS).alias("steps"))  # one row
    subpaths = written(paths(top, root, fanout).select(F.col("source_tree").alias("tree"), F.col("digest").alias("subroot"), "root", "steps"))
    back = folded(F.coalesce("found", "digest"), F.col("steps"))
    return paths(levels, subpaths, fanout).select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), back.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
