"""German numbers, dates and list formats as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from costproof import fixed_values as fx

WS = r"(?U)\s+"
# What (?U)\s matches: the characters of the Unicode property White_Space.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(col: Column) -> Column:
    """Trim every kind of Unicode white space, not only blanks."""
    return F.btrim(col, F.lit(_WHITE))


def fold_umlauts(col: Column) -> Column:
    for letter, plain in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        col = F.replace(col, F.lit(letter), F.lit(plain))
    return col


def de_decimal(col: Column) -> Column:
    """First German number anywhere in a text; null when there is none."""
    token = F.regexp_substr(col, F.lit(fx.DE_DECIMAL))
    return F.replace(F.replace(token, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(28,6)")


def money_token(col: Column) -> Column:
    """A German or en-US amount; whichever of ``,`` and ``.`` comes last is the decimal mark."""
    token = strip(F.replace(F.replace(col, F.lit("%"), F.lit("")), F.lit("€"), F.lit("")))
    german = F.replace(F.replace(token, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    english = F.replace(token, F.lit(","), F.lit(""))
    comma_last = token.rlike(r",[^.]*$")
    return F.when(comma_last, german).otherwise(english).try_cast("decimal(18,2)")


def money_tokens(col: Column, pattern: str = fx.MONEY) -> Column:
    """All amounts of a line in order."""
    return F.transform(F.regexp_extract_all(col, F.lit(pattern), F.lit(1)), money_token)


def _ymd(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def de_date(col: Column) -> Column:
    """``DD.MM.YYYY`` or ``DD. Monat YYYY`` anywhere in a text; the numeric form wins."""
    numeric = r"(\d{1,2})\.(\d{1,2})\.(\d{4})"
    named = r"(?iu)(\d{1,2})\.\s*(" + "|".join(fx.MONTH_SPELLINGS) + r")\s+(\d{4})"
    months = F.create_map(*[F.lit(x) for pair in fx.MONTH_SPELLINGS.items() for x in pair])
    month = F.lower(F.regexp_extract(col, named, 2))
    return (
        F.when(col.rlike(numeric), _ymd(*[F.regexp_extract(col, numeric, g) for g in (3, 2, 1)]))
        .when(
            col.rlike(named),
            _ymd(F.regexp_extract(col, named, 3), F.try_element_at(months, month).cast("string"),
                 F.regexp_extract(col, named, 1)),
        )
    )


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFC")


def clean_text(col: Column) -> Column:
    """Unicode NFC, and words split by a line-end hyphen joined again.

    Spark has no normalisation function; the Arrow batch step runs only for texts that hold
    a character outside Latin-1, since all others are in NFC already.
    """
    composed = F.when(col.rlike(r"[^\x00-\xff]"), _nfc(col)).otherwise(col)
    return F.regexp_replace(composed, r"(?U)(\w)-\n\s*(\w)", "$1$2")


def format_de(col: Column, places: int = 2) -> Column:
    """``1.234,56``; half-even like the decimal arithmetic around it."""
    return F.translate(F.format_number(F.bround(col, places), places), ",.", ".,")


def format_pages(pages: Column) -> Column:
    """``Seite 2, 3 und 5`` from a page list: positive, distinct, ascending."""
    nums = F.transform(
        F.array_sort(F.array_distinct(F.filter(pages, lambda p: p > 0))), lambda p: p.cast("string")
    )
    head = F.array_join(F.slice(nums, 1, F.greatest(F.size(nums) - 1, F.lit(0))), ", ")
    return (
        F.when(pages.isNull() | (F.size(nums) == 0), F.lit(""))
        .when(F.size(nums) == 1, F.concat(F.lit("Seite "), nums[0]))
        .otherwise(F.concat(F.lit("Seite "), head, F.lit(" und "), F.element_at(nums, -1)))
    )


def format_date(col: Column) -> Column:
    return F.date_format(col, "dd.MM.yyyy")
