"""DuckDB snippets for the oracle side."""

from __future__ import annotations


def fold(x: str) -> str:
    return f"replace(replace(replace(replace({x}, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')"


def tokens(x: str) -> str:
    s = fold(f"lower({x})")
    s = rf"regexp_replace({s}, '\b(\w)\s*&\s*(\w)\b', '\1\2', 'g')"
    s = rf"regexp_replace({s}, '\b(gmbh|mbh|ag|kg|ug|ohg|co|cokg|se|e\.?k\.?|inc|ltd)\b\.?', ' ', 'g')"
    s = rf"regexp_replace({s}, '[&+./,()\-–]|\bund\b|\b\d+\b', ' ', 'g')"
    peel = "t"
    for _ in range(3):
        peel = rf"regexp_replace({peel}, '^(.{{4,}}?)(gmbh|mbh|cokg|co|kg|ug|ohg)$', '\1')"
    words = rf"list_filter(string_split_regex({s}, '\s+'), lambda w: w <> '')"
    return (f"list_filter(list_transform({words}, lambda t: {peel}), "
            "lambda t: length(t) >= 2 and t not in ('gmbh','mbh','cokg','co','kg','ug','ohg'))")


def vset(x: str) -> str:
    return f"coalesce(list_sort(list_distinct({tokens(x)})), cast([] as varchar[]))"


def overlap(a: str, b: str) -> str:
    near = "(t = u or (length(t) >= 5 and length(u) >= 5 and levenshtein(t, u) <= 1))"
    shared = f"list_filter({a}, lambda t: length(list_filter({b}, lambda u: {near})) > 0)"
    return f"case when least(length({a}), length({b})) > 0 then length({shared}) / least(length({a}), length({b})) else 0.0 end"


def format_de(x: str) -> str:
    return f"translate(format('{{:,.2f}}', cast({x} as decimal(28,2))), ',.', '.,')"


def loose(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9äöüß]+', ' ', 'g'))"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def de_date(x: str) -> str:
    return f"strftime({x}, '%d.%m.%Y')"


def alnum(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]', '', 'g')"
