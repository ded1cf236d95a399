"""Company names: distinctive tokens, overlap, and the keys that find overlapping names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from costproof import fixed_values as fx
from costproof.functions.german import fold_umlauts
from costproof.scale import merged


def is_own_company(col: Column, pattern: str = fx.OWN_COMPANY) -> Column:
    return F.coalesce(col.rlike(pattern), F.lit(False))


_GLUED = r"^(.{4,}?)(" + "|".join(fx.GLUED_LEGAL_SUFFIXES) + r")$"


def _peel(token: Column) -> Column:
    """Take glued legal forms off a token's end, longest first, leaving four characters."""
    once = F.regexp_replace(token, _GLUED, "$1")
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), (F.length(token) / 2).cast("int")))
    fully = F.aggregate(rounds, once, lambda acc, _: F.regexp_replace(acc, _GLUED, "$1"))
    return F.when(once == token, token).otherwise(fully)


def vendor_tokens(col: Column) -> Column:
    """Distinctive tokens of a company name in order, repeats kept."""
    name = fold_umlauts(F.lower(col))
    name = F.regexp_replace(name, r"(?U)\b(\w)\s*&\s*(\w)\b", "$1$2")
    name = F.regexp_replace(name, fx.LEGAL_FORMS, " ")
    name = F.regexp_replace(name, fx.NAME_NOISE, " ")
    words = F.filter(F.split(name, r"(?U)\s+"), lambda w: w != "")
    legal = F.array(*[F.lit(s) for s in fx.GLUED_LEGAL_SUFFIXES])
    peeled = F.transform(words, _peel)
    return F.filter(peeled, lambda t: (F.length(t) >= 2) & ~F.array_contains(legal, t))


def vendor_set(col: Column) -> Column:
    """The token set in canonical order, fit to be a grouping or join key."""
    return F.coalesce(F.array_sort(F.array_distinct(vendor_tokens(col))), F.array().cast("array<string>"))


def vendor_compact(col: Column) -> Column:
    return F.coalesce(F.array_join(vendor_tokens(col), ""), F.lit(""))


def with_vendor_tokens(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """``df`` with the tokens of its name columns: column → name of the token column.

    Names are taken apart once per distinct text. A number of two digits or more is never part of a token, so texts that
    differ only in such numbers are one.
    """
    for column, out in names.items():
        df = df.withColumn("_text", F.regexp_replace(F.coalesce(column, F.lit("")), r"(?U)\b\d{2,}\b", "00"))
        texts = df.select("_text").distinct().select("_text", vendor_tokens(F.col("_text")).alias(out))
        df = merged(df, texts, "_text").drop("_text")
    return df


def token_set(tokens: Column) -> Column:
    return F.array_sort(F.array_distinct(tokens))


def near(a: Column, b: Column) -> Column:
    """Equal, or one edit apart when both have five or more characters."""
    return (a == b) | (
        (F.length(a) >= 5) & (F.length(b) >= 5) & (F.levenshtein(a, b, 1) >= 0)
    )


def vendor_overlap(a: Column, b: Column) -> Column:
    """Tokens of ``a`` found in ``b`` over the smaller set; not symmetric, may exceed 1."""
    shared = F.filter(a, lambda t: F.exists(b, lambda u: near(t, u)))
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(shared) / smaller).otherwise(F.lit(0.0))


def share_token(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


# Rows of overlap keys: two names overlap exactly if one's (key, role) meets the other's
# (key, partner role). "=" keys meet each other: the token itself, and the token with one
# position masked (one substitution). "s" keys (the token) meet "l" keys (a token one longer
# with one character taken out): one insertion or deletion.
_PARTNER = {"=": "=", "s": "l", "l": "s"}


def _token_keys(token: Column) -> Column:
    spots = F.sequence(F.lit(1), F.length(token))

    def key(text: Column, role: str) -> Column:
        return F.struct(text.alias("key"), F.lit(role).alias("role"), F.lit(_PARTNER[role]).alias("partner"))

    def before(p: Column) -> Column:
        return F.substring(token, F.lit(1), p - 1)

    def after(p: Column) -> Column:
        return F.substring(token, p + 1, F.length(token))

    exact = F.array(key(F.concat(F.lit("="), token), "="))
    masked = F.transform(spots, lambda p: key(F.concat(F.lit("~"), before(p), F.lit("\u0001"), after(p)), "="))
    # The shorter token of an insertion pair must itself have five characters.
    short = F.when(F.length(token) >= 5, F.array(key(F.concat(F.lit("-"), token), "s")))
    longer = F.when(
        F.length(token) >= 6,
        F.transform(spots, lambda p: key(F.concat(F.lit("-"), before(p), after(p)), "l")),
    )
    empty = F.slice(exact, 1, 0)
    near_keys = F.when(F.length(token) >= 5, F.concat(masked, F.coalesce(short, empty), F.coalesce(longer, empty)))
    return F.concat(exact, F.coalesce(near_keys, empty))


def near_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """(word, other): equal words and near misses between two one-column vocabularies.

    Works on the distinct words of whole tables, whatever project they come from; a vocabulary
    grows far slower than the rows that use it. Candidates meet by key, never pair by pair.
    """
    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(df.columns[0]).alias(name)).distinct().select(name, F.inline(_token_keys(F.col(name))))

    lhs = keyed(left, "word")
    rhs = keyed(right, "other").select("other", "key", F.col("role").alias("partner"))
    return merged(lhs, rhs, ["key", "partner"]).select("word", "other").distinct()


def _exploded(df: DataFrame, by: list[str], tokens: str, name: str) -> DataFrame:
    return df.select(*by, tokens, F.explode(tokens).alias(name))


def overlapping_sets(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_tokens: str, right_tokens: str
) -> DataFrame:
    """Pairs of distinct token sets with a positive overlap, found by shared or near words, never
    by a cross join. ``left``/``right`` hold the ``by`` columns and one token column each; rows
    with the same set collapse first, so copies of one vendor cost one candidate."""
    by = list(by)
    lhs = _exploded(left.select(*by, left_tokens).distinct(), by, left_tokens, "word")
    rhs = _exploded(right.select(*by, right_tokens).distinct(), by, right_tokens, "other")
    reach = merged(lhs, near_words(lhs.select("word"), rhs.select("other")), "word")
    return merged(reach, rhs, [*by, "other"]).select(*by, left_tokens, right_tokens).distinct()


def earliest_overlap(
    probes: DataFrame, heads: DataFrame, by: Sequence[str], tokens: str, order: str, out: str
) -> DataFrame:
    """For each distinct probe set, the smallest ``order`` among ``heads`` whose set overlaps.

    Only a minimum is needed, so each word keeps one head and no pairs are formed.
    """
    by = list(by)
    members = heads.select(*by, order, F.explode(tokens).alias("other"))
    tops = members.groupBy(*by, "other").agg(F.min(order).alias(out))
    lhs = _exploded(probes.select(*by, tokens).distinct(), by, tokens, "word")
    reach = merged(lhs, near_words(lhs.select("word"), members.select("other")), "word")
    return merged(reach, tops, [*by, "other"]).groupBy(*by, tokens).agg(F.min(out).alias(out))
