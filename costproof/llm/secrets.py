"""Secret scans: fixed patterns, and two character Markov models.

The patterns find assignments, access ids and long hex runs. Other runs of 16 and more identifier characters are judged by two
first-order models of characters, one of random strings and one of ordinary identifiers: a run whose log-likelihood ratio is
``MARGIN`` or more, and that has at least ``VARIED`` different characters, is a secret too.

Samples are labelled by the corpus itself. Random strings are digests written in common alphabets, and what the patterns find if it
looks random. Ordinary ones are the short words of all texts, and the longer runs that the models so far do not call random, each
counted once per document that holds it; so keys that fill most of a corpus do not become ordinary. Labels and models are
repeated until they agree. A model is a table of at most 68 x 67 counts, whatever the input.

Column expressions only. Spans are of code points, end exclusive: the text is split at a pattern, and running sums of the lengths
of parts and hits, taken in blocks, give the places, so the work grows with the text and not with its square.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from costproof.llm.tables import written

# Kinds in order, their patterns, and the shortest hit.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}+"
SHORTEST_VALUE = 6

_IN = "[A-Za-z0-9+/_=-]"
RUN = f"(?<!{_IN}){_IN}{{16,}}+"
WORDS = f"(?<!{_IN}){_IN}{{3,15}}(?!{_IN})"
#: Runs apart from all hits of the patterns: hits are consumed first, and a run with a hit inside is none.
APART = f"{ASSIGN}|{ACCESS}|{HEX}|(?<!{_IN})(?!{_IN}*(?:(?i:password|passwd|secret|token|api_?key)[:=]|{ACCESS}|[0-9a-f]{{24}}))({_IN}{{16,}}+)"
KINDS = ["assign", "access", "hex", "random"]
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Ratio from which a run is a secret, and its least number of different characters.
MARGIN, VARIED = 10.0, 8
#: Share of the next coarser model in each (pairs, single characters, equal chances) and weight of a pair's prior; digests per alphabet; rounds of labelling.
EQUAL, BACKOFF, DIGESTS, ROUNDS = 0.1, 20.0, 2048, 4
MASK = "[SECRET]"
_BLOCK, _CHUNK = 256, 4096


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _before(values: Column, combine) -> Column:
    """For each number of an array the combination of all before it, from 0: blocks first, then inside each block."""
    def run(start: Column, items: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(items, zero, lambda s, x: F.struct(combine(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]

    def in_blocks(blocks: Column) -> Column:
        heads = run(F.lit(0), F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), combine)))
        return _let(heads, lambda h: F.flatten(F.transform(blocks, lambda b, k: run(F.get(h, k), b))))

    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / _BLOCK).cast("int")), lambda k: F.slice(v, k * _BLOCK + 1, F.lit(_BLOCK)))
    return _let(values, lambda v: _let(cut(v), in_blocks))


def spans_of(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Leftmost, non-overlapping hits as (start, kind, end, hit), without those whose ``group`` is shorter than ``least``."""
    parts = F.split(text, pattern, -1)
    hits = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"), parts.alias("before"))
    hits = F.filter(hits, lambda x: x["whole"].isNotNull())  # the last part has no hit behind it

    def span(x: Column, at: Column) -> Column:
        start = at + F.length(x["before"])
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x["whole"])).alias("end"), x["value"].alias("hit"))

    def placed(h: Column) -> Column:
        at = _before(F.transform(h, lambda x: F.length(x["before"]) + F.length(x["whole"])), lambda a, b: a + b)
        return F.filter(F.zip_with(h, at, span), lambda s: F.length(s["hit"]) >= least)

    none = F.array().cast("array<struct<start:int,kind:int,end:int,hit:string>>")
    return F.coalesce(F.when(text.rlike(pattern), _let(hits, placed)), none)


def _scanned(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with __base (spans of the patterns) and __runs (spans of other long runs)."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(spans_of(t, ASSIGN, 0, 2, SHORTEST_VALUE), spans_of(t, ACCESS, 1), spans_of(t, HEX, 2))
    return docs.withColumn("__base", F.array_sort(base)).withColumn("__runs", F.when(t.rlike(RUN), spans_of(t, APART, 3, 3, 16)).otherwise(F.slice("__base", 1, 0)))


def _pairs(tokens: DataFrame) -> dict[tuple[int, int], float]:
    """Weighted counts of character pairs of (token, n); the first of a pair is 0 at a token's beginning."""
    at = F.expr(f"transform(filter(split(token, ''), c -> c <> ''), c -> instr('{ALPHABET}', c))")
    pairs = tokens.select("n", at.alias("at")).select("n", F.explode(F.expr("transform(at, (c, i) -> struct(coalesce(get(at, i - 1), 0) as a, c as b))")).alias("p"))
    return {(r["a"], r["b"]): float(r["n"]) for r in pairs.where("p.b > 0").groupBy("p.a", "p.b").agg(F.sum("n").alias("n")).collect()}  # at most 68 x 67 rows


def _model(seen: dict[tuple[int, int], float]) -> list[list[float]]:
    """Logarithms of the chance of each character after each."""
    n = len(ALPHABET)
    alone = [sum(seen.get((a, b), 0.0) for a in range(n + 1)) for b in range(1, n + 1)]
    whole = sum(alone)
    base = [((1 - EQUAL) * x / whole if whole else (1 - EQUAL) / n) + EQUAL / n for x in alone]
    out = []
    for a in range(n + 1):  # a character that was never followed by any backs off to the single ones
        row = [seen.get((a, b), 0.0) for b in range(1, n + 1)]
        total = sum(row)
        out.append([math.log((1 - EQUAL) * (x + BACKOFF * y) / (total + BACKOFF) + EQUAL * y) for x, y in zip(row, base, strict=True)])
    return out


def _table(random: dict, ordinary: dict) -> list[float]:
    """Log-likelihood ratios of character pairs, flattened: row 0 is a token's beginning, then the characters of ALPHABET."""
    return [x - y for p, q in zip(_model(random), _model(ordinary), strict=True) for x, y in zip(p, q, strict=True)]


def _digests(spark: SparkSession) -> DataFrame:
    """Random strings in common alphabets: (token, n)."""
    raw = F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256)))
    plain = F.regexp_replace(raw, "[+/=]", "")
    forms = F.array(F.sha2(F.col("id").cast("string"), 256), F.regexp_replace(raw, "=", ""), plain, F.lower(plain), F.upper(plain))
    return spark.range(DIGESTS).select(F.explode(forms).alias("token"), F.lit(1).alias("n"))


def self_labelled(docs: DataFrame, scanned: DataFrame, text: str) -> list[float]:
    """The table of ratios from samples that the corpus labels itself."""
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(WORDS), F.lit(0)))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    common, digests = _pairs(words), _pairs(_digests(docs.sparkSession))
    each = lambda c, label: scanned.select(F.explode(F.array_distinct(F.transform(c, lambda x: x["hit"]))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).withColumn("label", F.lit(label))
    tokens = written(each("__base", 1).union(each("__runs", 0)))
    table = _table(digests, common)
    for _ in range(ROUNDS):
        hits = _pairs(tokens.where((F.col("label") == 1) & (ratio(F.col("token"), table) >= 0)).select("token", F.lit(1).alias("n")))
        runs = _pairs(tokens.where((F.col("label") == 0) & ~is_random(F.col("token"), table)).select("token", "n"))
        share = min(1.0, sum(digests.values()) / max(1.0, sum(hits.values())))  # digests weigh as much as hits at least
        new = _table({k: digests.get(k, 0.0) + share * hits.get(k, 0.0) for k in digests.keys() | hits.keys()}, {k: common.get(k, 0.0) + runs.get(k, 0.0) for k in common.keys() | runs.keys()})
        same = max(abs(a - b) for a, b in zip(table, new, strict=True)) < 1e-9
        table = new
        if same:
            break
    return table


def learn(labelled: DataFrame) -> list[float]:
    """The table of ratios from a sample (token, label): 1 random, 0 ordinary."""
    of = lambda label: _pairs(labelled.where(F.col("label") == label).select("token", F.lit(1).alias("n")))
    return _table(of(1), of(0))


def ratio(token: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a token: how much likelier it is as a random string."""
    n = len(ALPHABET)
    values = F.split(F.lit(",".join(f"{x:.5f}" for x in table)), ",").cast("array<double>")
    at = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    moved = F.aggregate(at, F.struct(F.lit(0).alias("was"), F.lit(0.0).alias("sum")), lambda s, c: F.struct(
        c.alias("was"), (s["sum"] + F.when(c > 0, F.get(values, s["was"] * n + c - 1)).otherwise(0.0)).alias("sum")))
    return moved["sum"]


def is_random(token: Column, table: list[float]) -> Column:
    return (F.size(F.array_distinct(F.split(token, ""))) >= VARIED) & (ratio(token, table) >= MARGIN)


def found_secrets(docs: DataFrame, text: str = "text", labelled: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``keep`` columns of ``docs`` with __base and __added spans; models come from ``labelled`` (token, label) or the corpus."""
    scanned = written(_scanned(docs.select(*[f"`{c}`" for c in dict.fromkeys((*keep, text))]), text).select(*[f"`{c}`" for c in keep], "__base", "__runs"))
    table = self_labelled(docs, scanned, text) if labelled is None else learn(labelled)
    return scanned.withColumn("__added", F.filter("__runs", lambda r: is_random(r["hit"], table))).drop("__runs")


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, labelled: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    Spans read kind:start:end, by start, then kind in the order of KINDS. A null text counts as empty: no spans. Rows that repeat are
    rows of their own, a null doc_id stays null, further columns are ignored. Texts of any length are scanned whole. Without ordinary words or runs, or with
    a sample of one label only, the missing model gives all characters equal chances.
    """
    found = found_secrets(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", labelled, ("doc_id",))
    count = lambda c, k: F.size(F.filter(c, lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count("__base", k).alias(f"n_{KINDS[k]}") for k in range(3)], F.size("__added").cast("long").alias("n_random"),
        F.sha2(_joined(F.col("__base")), 256).alias("base_sha256"), _joined(F.concat("__base", "__added")).alias("spans"))


def masked(docs: DataFrame, text: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with every span of its texts replaced by MASK; n_chars, where there is one, follows the text."""
    found = found_secrets(docs, text, labelled, tuple(docs.columns))
    spans = F.array_sort(F.concat("__base", "__added"))

    def piece(chunks: Column, start: Column, end: Column) -> Column:
        """Code points start to end of a text cut into chunks."""
        first, last = F.floor(start / _CHUNK).cast("int"), F.floor((end - 1) / _CHUNK).cast("int")
        whole = F.array_join(F.slice(chunks, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
        return F.when(end > start, F.substring(whole, start - first * _CHUNK + 1, end - start)).otherwise("")

    def replaced(chunks: Column) -> Column:
        def joined(s: Column, reach: Column) -> Column:
            # A span that overlaps one before goes with it.
            cut = lambda x, at: F.when(x["start"] < at, F.lit("")).otherwise(F.concat(piece(chunks, at, x["start"]), F.lit(MASK)))
            end = F.array_max(F.transform(s, lambda x: x["end"]))
            return F.concat(F.array_join(F.zip_with(s, reach, cut), ""), piece(chunks, end, F.length(F.col(f"`{text}`"))))

        return _let(spans, lambda s: _let(_before(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b)), lambda reach: joined(s, reach)))

    chunks = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    new = F.when(F.size(spans) > 0, _let(chunks, replaced)).otherwise(F.col(f"`{text}`"))
    out = found.withColumn("__new", new)
    chars = {"n_chars": F.when(F.size("__base") + F.size("__added") > 0, F.length("__new").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return out.select(*[(F.col("__new") if c == text else chars.get(c, F.col(f"`{c}`"))).alias(c) for c in docs.columns])
