"""Names, numbers and tokens taken out of free text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from costproof import fixed_values as fx
from costproof.functions.german import fold_umlauts, strip


def truncate_name(col: Column, limit: int = fx.MAX_DESCRIPTION) -> Column:
    """Cap a name at ``limit`` characters, at a word end if that keeps half of it."""
    name = strip(col)
    cut = F.regexp_replace(F.left(name, F.lit(limit - 1)), r"(?U)\s+$", "")
    last_blank = F.length(cut) - F.instr(F.reverse(cut), " ")
    at_word = F.regexp_replace(F.substring(cut, F.lit(1), last_blank), r"(?U)\s+$", "")
    kept = F.when((F.instr(cut, " ") > 0) & (last_blank >= limit // 2), at_word).otherwise(cut)
    return F.when(F.length(name) <= limit, name).otherwise(F.concat(kept, F.lit("…")))


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def file_suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1))


def vendor_from_filename(name: Column) -> Column:
    """The leading words of a file name, up to the first word with a digit or a document-type
    marker; null under three letters."""
    words = F.transform(F.split(strip(file_stem(name)), "[-_]+"), lambda w: F.regexp_replace(w, r"^[ .]+|[ .]+$", ""))
    markers = F.array(*[F.lit(m) for m in fx.FILENAME_TYPE_MARKERS])
    stops = F.transform(
        words,
        lambda w: (w == "") | w.rlike(r"\d") | F.array_contains(markers, F.regexp_replace(F.lower(w), r"\.+$", "")),
    )
    first_stop = F.array_position(stops, F.lit(True))
    keep = F.when(first_stop > 0, (first_stop - 1).cast("int")).otherwise(F.size(words))
    joined = F.array_join(F.slice(words, F.lit(1), keep), " ")
    letters = F.length(F.regexp_replace(joined, r"(?U)[^\p{L}]", ""))
    return F.when(letters >= 3, joined)


def invoice_number_key(col: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(col), r"(?U)[^\p{Alnum}]", "")


def squeeze(col: Column) -> Column:
    return F.regexp_replace(F.lower(col), r"(?U)\s+", "")


def digits_only(col: Column) -> Column:
    return F.regexp_replace(col, r"[^0-9]", "")


def numbers_similar(a: Column, b: Column) -> Column:
    """Equal but for case and blanks, or one digit string of five or more ends the other."""
    da, db = digits_only(a), digits_only(b)
    long_enough = (F.length(da) >= 5) & (F.length(db) >= 5)
    same = (squeeze(a) != "") & (squeeze(a) == squeeze(b))
    return same | (long_enough & (F.endswith(da, db) | F.endswith(db, da)))


def article_numbers(col: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(col, F.lit(fx.ARTICLE_NUMBER), F.lit(0)), F.lower))


def desc_tokens(col: Column) -> Column:
    """Description words of three or more characters without filler words."""
    words = F.split(fold_umlauts(F.lower(col)), "[^a-z0-9]+")
    stop = F.array(*[F.lit(w) for w in fx.DESCRIPTION_STOPWORDS])
    return F.array_sort(F.array_except(F.filter(words, lambda w: F.length(w) > 2), stop))


# Every letter named: Java looks named characters up in a table, ranges beside umlauts are tried one after the other.
_LOOSE = "[^abcdefghijklmnopqrstuvwxyz0123456789äöüß]+"


def loose(col: Column) -> Column:
    """Letters and digits, lower case, single blanks: comparison form of printed text."""
    return F.trim(F.regexp_replace(F.lower(col), _LOOSE, " "))


def extract_fields_regex(text: Column) -> Column:
    """Dates, euro amounts, invoice number and address block of a raw text, as one struct."""
    months = "|".join(fx.MONTH_SPELLINGS)
    numeric_dates = F.regexp_extract_all(text, F.lit(r"\d{2}\.\d{2}\.\d{4}"), F.lit(0))
    named_dates = F.regexp_extract_all(text, F.lit(rf"(?iu)\d{{1,2}}\.\s?(?:{months})\s?\d{{4}}"), F.lit(0))
    raw_amounts = F.regexp_extract_all(text, F.lit(r"(\d{1,3}(?:\.\d{3})*(?:,\d{2}))\s?€"), F.lit(1))
    amounts = F.transform(
        raw_amounts,
        lambda a: F.replace(F.replace(a, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(18,2)"),
    )
    number_patterns = [
        r"(?iu)R E C H N U N G[:\s]*([a-zA-Z0-9-]+)",
        r"(?iu)Rechnung[:\s]*([a-zA-Z0-9-]+)",
        r"(?iu)Rechnung Nr[:.\s]*([a-zA-Z0-9-]+)",
    ]
    number = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in number_patterns])
    address = r"(?U)([\w\s.]+?)\s(\d+)\n(\d{5})\s([\w\s-]+)"
    has_address = text.rlike(r"(?U)\s\d+\n\d{5}\s[\w\s-]")
    block = F.when(
        has_address,
        F.concat(F.regexp_extract(text, address, 1), F.lit(" "), F.regexp_extract(text, address, 2), F.lit("\n"),
                 F.regexp_extract(text, address, 3), F.lit(" "), F.regexp_extract(text, address, 4)),
    )
    return F.struct(
        F.concat(numeric_dates, named_dates).alias("dates"),
        amounts.alias("amounts"),
        F.coalesce(number, F.lit("Not Found")).alias("invoice_number"),
        F.coalesce(block, F.lit("Not Found")).alias("address"),
    )
