"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet as log-probabilities per language:

* text: a multinomial model of hashed byte trigrams, counted from labelled texts (grouped counts of all of them), its
  log-likelihood scaled down because neighbouring trigrams are not independent;
* the language that the markup declares, and the address suffix (the last label of the host, and a language-like first
  part of the path): how often each goes with a language, by grouped counts over all rows under the text's own verdict;
* the host: its rows' languages, smoothed by those of its domain, those by the suffix's and those by all rows'. A row's own vote is
  taken out of its host's and domain's counts.

All tables but the hosts' have a fixed number of rows or one per declared value; hosts and domains are joined, not broadcast
by hand, so that a host with a third of all rows is split by adaptive execution.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from costproof.llm.bytehash import batches
from costproof.llm.tables import written

BUCKETS, SMOOTHING, TEMPERATURE, HOST_WEIGHT, LANGUAGES = 4096, 0.5, 0.2, 4.0, 256
_OPEN = re.compile(r"<(?:(script|style)\b|(!--))?", re.I)
_CLOSE = {"script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I), "!--": re.compile("-->"), "": re.compile(">")}
_SPACES = re.compile(r"\s+")


def visible(html: str) -> str:
    """Text of a page without scripts, styles, comments and tags. What has no end is read like a tag, and a ``<`` without any ``>`` behind it is text."""
    out, at, gone = [], 0, set()
    while (opened := _OPEN.search(html, at)) is not None:
        closed = None
        for kind in ((opened[1] or opened[2] or "").lower(), ""):
            if kind not in gone and (closed := _CLOSE[kind].search(html, opened.end() if kind else opened.start() + 1)) is not None:
                break
            gone.add(kind)  # none behind this place either: never looked for again
        if closed is None:
            break
        out += html[at : opened.start()], " "
        at = closed.end()
    out.append(html[at:])
    return _SPACES.sub(" ", "".join(out)).strip()


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigrams of all texts, first of each text and, last, their number)."""
    buffer = np.frombuffer(b"  ".join(texts) + b"    ", np.uint8).astype(np.uint32)
    size = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    h = (buffer[:-2] * np.uint32(0x9E3779B1) ^ buffer[1:-1] * np.uint32(0x85EBCA77) ^ buffer[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    return (h >> np.uint32(20)).astype(np.int64), np.concatenate(([0], np.cumsum(size)))


def _counted(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in found:
        texts, langs = [(t or "").lower().encode() for t in batch.column("text").to_pylist()], batch.column("lang").to_pylist()
        for a, b in batches(texts):
            grams, first = _grams(texts[a:b])
            for lang in set(langs[a:b]):
                own = [grams[first[i] : first[i + 1]] for i in range(b - a) if langs[a + i] == lang]
                sums[lang] = sums.get(lang, 0) + np.bincount(np.concatenate(own), minlength=BUCKETS)
    for lang, n in sums.items():
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used.astype(np.int32)), pa.array(n[used])], ["lang", "gram", "n"])


def text_model(labelled: DataFrame) -> dict:
    """{"langs": names, "table": log-probabilities (languages x trigrams)} from (text, lang); BUCKETS rows per language at most.

    Only the ``LANGUAGES`` languages with the most texts are possible answers, so the model is bounded; ties go by name.
    """
    most = labelled.where("lang is not null and text is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select("lang")
    labelled = labelled.join(F.broadcast(most), "lang", "left_semi")  # at most LANGUAGES rows
    counts = labelled.where("lang is not null and text is not null").select("text", "lang").mapInArrow(_counted, "lang string, gram int, n long")
    rows = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in rows})
    table = np.full((len(langs), BUCKETS), SMOOTHING)
    for r in rows:
        table[langs.index(r["lang"]), r["gram"]] += r["n"]
    return {"langs": langs, "table": np.log(table / table.sum(1, keepdims=True)).astype(np.float32)}


def _scored(model, html: bool):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value["table"]
        for batch in found:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            texts = [(visible(t) if html else t).lower().encode() for t in texts]
            out = []
            for a, b in batches(texts):
                grams, first = _grams(texts[a:b])
                sums = np.stack([np.add.reduceat(t[grams].astype(np.float64), first[:-1]) for t in table], axis=1) * TEMPERATURE
                sums[[not t.strip() for t in texts[a:b]]] = 0.0  # nothing to read: no evidence
                out += (sums - sums.max(1, keepdims=True)).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "declared", "host", "suffix", "path")), pa.array(out, pa.list_(pa.float64()))],
                                             ["id", "declared", "host", "suffix", "path", "text_log"])

    return run


def address_parts(url: Column) -> dict[str, Column]:
    """host, suffix and first path part of an address; null where there is none."""
    host = F.nullif(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    path = F.nullif(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:[/?#]|$)", 1)), F.lit(""))
    return {"host": host, "suffix": F.nullif(F.regexp_extract(host, "([^.]+)$", 1), F.lit("")), "path": path}


def declared_language(html: Column) -> Column:
    """The two-letter language of the html element's lang attribute, or null."""
    return F.nullif(F.lower(F.regexp_extract(html, "(?i)<html\\b[^>]*?\\blang\\s*=\\s*[\"']?([A-Za-z]{2})\\b", 1)), F.lit(""))


def identify(rows: DataFrame, labelled: DataFrame | dict, html: bool = False) -> DataFrame:
    """(id, lang, probability, text_lang) of (id, text, declared, host, suffix, path).

    ``labelled`` has text and lang, its languages are the possible ones; or it is a ``text_model``. Texts of any length are read whole. Null evidence of any kind is no evidence; a row with none gets
    the most frequent language. Rows that repeat are rows of their own. Equal probabilities go to the first language by
    name. Without labelled texts the language is null and its probability 0. Empty input gives no rows.
    """
    model = labelled if isinstance(labelled, dict) else text_model(labelled)
    langs = model["langs"]
    if not langs:
        return rows.select("id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("probability"), F.lit(None).cast("string").alias("text_lang"))
    shared = rows.sparkSession.sparkContext.broadcast(model)
    read = rows.select("id", "text", "declared", "host", "suffix", "path").mapInArrow(
        _scored(shared, html), "id long, declared string, host string, suffix string, path string, text_log array<double>")
    domain = F.coalesce(F.nullif(F.regexp_extract("host", "([^.]+\\.[^.]+)$", 1), F.lit("")), F.col("host"))
    read = written(read.withColumn("domain", domain).withColumn("vote", F.array_position("text_log", F.array_max("text_log")).cast("int")))

    def counts(key: str) -> DataFrame:
        votes = F.array(*[F.sum((F.col("vote") == i + 1).cast("double")) for i in range(len(langs))])
        return written(read.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"of_{key}")).agg(votes.alias(f"n_{key}")))

    total = read.agg(*[F.sum((F.col("vote") == i + 1).cast("double")) for i in range(len(langs))]).first()
    total = [float(x or 0) for x in total]
    share = [(x + 1) / (sum(total) + len(langs)) for x in total]
    for key in ("declared", "path", "suffix", "domain", "host"):
        read = read.join(counts(key), F.col(key) == F.col(f"of_{key}"), "left").drop(f"of_{key}")
    each = lambda f: F.array(*[f(i) for i in range(len(langs))])
    n = lambda key, i: F.coalesce(F.get(f"n_{key}", F.lit(i)), F.lit(0.0))
    own = lambda i: (F.col("vote") == i + 1).cast("double")
    every = lambda key: sum((n(key, i) for i in range(1, len(langs))), n(key, 0))
    smooth = lambda key, i, below, less: (n(key, i) - less * own(i) * F.col(key).isNotNull().cast("double") + HOST_WEIGHT * below) / (
        every(key) - less * F.col(key).isNotNull().cast("double") + HOST_WEIGHT)
    read = read.withColumn("p_suffix", each(lambda i: smooth("suffix", i, F.lit(share[i]), 0.0)))
    read = read.withColumn("p_domain", each(lambda i: smooth("domain", i, F.get("p_suffix", F.lit(i)), 1.0)))
    read = read.withColumn("p_host", each(lambda i: smooth("host", i, F.get("p_domain", F.lit(i)), 1.0)))
    # How likely a value is declared for a language: its votes among all votes of that language.
    given = lambda key, i: F.when(F.col(f"n_{key}").isNull(), F.lit(0.0)).otherwise(F.log((n(key, i) + SMOOTHING) / F.lit(total[i] + 2 * SMOOTHING)))
    logs = read.withColumn("logs", each(lambda i: F.get("text_log", F.lit(i)) + given("declared", i) + given("path", i) + F.log(F.get("p_host", F.lit(i)))))
    powers = logs.withColumn("powers", F.transform("logs", lambda x: F.exp(x - F.array_max("logs"))))
    names = F.array(*map(F.lit, langs))
    best = F.array_position("powers", F.array_max("powers")).cast("int")
    return powers.select("id", F.get(names, best - 1).alias("lang"), (F.array_max("powers") / F.aggregate("powers", F.lit(0.0), lambda a, b: a + b)).alias("probability"),
                         F.get(names, F.col("vote") - 1).alias("text_lang"))


def page_languages(pages: DataFrame, labelled: DataFrame | dict) -> DataFrame:
    """``identify`` for pages (page_id, url, html)."""
    parts = address_parts(F.col("url"))
    return identify(pages.select(F.col("page_id").cast("long").alias("id"), F.col("html").alias("text"), declared_language(F.col("html")).alias("declared"), *[c.alias(k) for k, c in parts.items()]), labelled, html=True)


def document_languages(docs: DataFrame, labelled: DataFrame | dict) -> DataFrame:
    """``identify`` for documents (doc_id, text, source), which declare nothing: a source stands for its host."""
    nothing = F.lit(None).cast("string")
    return identify(docs.select(F.col("doc_id").cast("long").alias("id"), "text", nothing.alias("declared"), F.col("source").alias("host"), nothing.alias("suffix"), nothing.alias("path")), labelled)
