"""Job histories, retention and login lockouts over event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from costproof import fixed_values as fx
from costproof.functions.german import format_de
from costproof.scale import order_index, rank_within
from costproof.session import materialize

# Attempts of one address that share a task: 2 ** RANGE_BITS.
RANGE_BITS = 14


def _place(events: DataFrame) -> list[str]:
    """What orders the events of a log: time, then file (where there are several) and line."""
    return [c for c in ("ts", "log_file", "line_no") if c in events.columns]


def job_state(events: DataFrame) -> DataFrame:
    """Where every job stands: title, procedure, times, status and latest feedback. A job without
    a finishing event was cut off by a restart; a malformed line (null event) is an error.
    One aggregate with map-side combine, also valid on a stream in update mode."""
    kind, place = F.col("event"), F.struct(*_place(events))

    def latest(column: str, of: str) -> Column:
        return F.max_by(F.when(kind == of, F.col(column)), F.when(kind == of, place))

    df = events.groupBy("job").agg(
        F.max_by("procedure", place).alias("procedure"), latest("message", "created").alias("title"),
        F.max(F.when(kind == "created", F.col("ts"))).alias("created"), F.max(F.when(kind == "finished", F.col("ts"))).alias("finished"),
        latest("status", "finished").alias("_status"), latest("verified", "feedback").alias("verified"),
        latest("message", "feedback").alias("feedback"), F.max(F.when(kind == "feedback", F.col("ts"))).alias("feedback_at"),
        F.count_if(kind == "output").alias("n_outputs"), F.count_if(kind == "error").alias("n_errors"), F.count_if(kind.isNull()).alias("_malformed"))
    cut_off = F.col("finished").isNull() & (F.col("_malformed") == 0)
    status = F.when(F.col("_malformed") > 0, "fehler").when(cut_off, "fehler").otherwise(F.coalesce("_status", F.lit("fertig")))
    return df.withColumns({
        "title": F.coalesce("title", "job"), "procedure": F.coalesce("procedure", F.lit("?")), "status": status,
        "verified": F.coalesce("verified", F.lit(False)), "feedback": F.coalesce("feedback", F.lit("")),
        "error_class": F.when(cut_off, "server-restart"),
    }).drop("_status", "_malformed")


def file_status(events: DataFrame) -> DataFrame:
    """Latest status and message per file of a job."""
    files = events.where(F.col("event") == "file")
    last = F.max_by(F.struct("status", "message"), F.struct(*_place(events))).alias("_f")
    return files.groupBy("job", "file").agg(last).select("job", "file", "_f.status", "_f.message")


def job_lists(events: DataFrame) -> DataFrame:
    """Progress, flags, errors and outputs of each job in order, one row per entry with its
    position, so a job with any number of entries stays spread out. ``live`` marks the progress
    lines a live view still shows: past 500 it drops its oldest 100 each time."""
    entries = events.where(F.col("event").isin("progress", "flag", "error", "output"))
    stamped = F.when(F.col("event") == "progress", F.concat(F.date_format("ts", "HH:mm:ss"), F.lit(" "), F.col("message"))).when(
        F.col("event") == "output", F.col("file")).otherwise(F.col("message"))
    place = _place(events)
    rows = entries.select("job", F.col("event").alias("kind"), *place, stamped.alias("entry"))
    ranked = rank_within(rows, ["job", "kind"], ["job", "kind", *place], "position")
    sizes = rows.groupBy("job", "kind").agg(F.count(F.lit(1)).alias("_n"))
    dropped = F.greatest(F.lit(0), F.ceil((F.col("_n") - fx.LIVE_LOG_LIMIT) / fx.LIVE_LOG_DROP) * fx.LIVE_LOG_DROP)
    return ranked.join(sizes, ["job", "kind"]).withColumn(
        "live", (F.col("kind") != "progress") | (F.col("position") > dropped)).drop("_n", "log_file", "line_no")


def runs_to_prune(jobs: DataFrame, keep: int = fx.RETAIN_RUNS) -> DataFrame:
    """All but the newest runs by id; running ones stay. The newest N come from a top-N, not from
    a global window."""
    newest = jobs.select("job").orderBy(F.col("job").desc()).limit(keep)
    return jobs.where(F.col("status") != "läuft").join(newest, "job", "left_anti")


def job_outcomes(jobs: DataFrame) -> DataFrame:
    """Runs per procedure, day and outcome: no output is an error, outputs with errors still count."""
    outcome = F.when(F.col("n_outputs") == 0, "fehler").otherwise("fertig")
    return jobs.withColumn("outcome", outcome).groupBy("procedure", F.to_date(F.coalesce("created", "finished")).alias("day"), "outcome").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if((F.col("n_outputs") > 0) & (F.col("n_errors") > 0)).alias("partial"))


def _gate(events: Column, start: Column, max_attempts: int, window: float, lock: float) -> Column:
    """The gate after a run of attempts in order: hits that count, until when it is locked, and the times at which it locked."""
    none, never = F.array().cast("array<double>"), F.lit(float("-inf"))

    def step(acc: Column, a: Column) -> Column:
        recent = F.concat(F.filter(acc["hits"], lambda h: a["ts"] - h < window), F.array(a["ts"]))
        return (
            F.when(a["ts"] < acc["until"], acc)
            .when(a["ok"], F.struct(none.alias("hits"), never.alias("until"), acc["locks"].alias("locks")))
            .when(F.size(recent) >= max_attempts, F.struct(none.alias("hits"), (a["ts"] + lock).alias("until"), F.concat(acc["locks"], F.array(a["ts"])).alias("locks")))
            .otherwise(F.struct(recent.alias("hits"), acc["until"].alias("until"), acc["locks"].alias("locks"))))

    return F.aggregate(events, F.struct(start["hits"].alias("hits"), start["until"].alias("until"), none.alias("locks")), step)


def _folded(attempts: DataFrame, max_attempts: int, window: float, lock: float) -> DataFrame:
    """(address, range, s): the state of the gate after each range of an address' attempts, with hits, until and locks.

    All attempts are sorted once and cut into ranges of at most 2 ** RANGE_BITS; an address with any number of them is many
    ranges. Every range is folded from an untouched gate first. Then each one gets the state that the range before it
    left, as far as that still matters at its first attempt, and those that began with another state are folded again, until none did.
    """
    known = attempts.where(F.col("address").isNotNull() & F.col("ts").isNotNull())
    ordered = order_index(known.select("address", "ts", "ok"), ["address", "ts", "ok"])
    ranges = materialize(ordered.groupBy("address", F.shiftright("ord", RANGE_BITS).alias("range")).agg(
        F.array_sort(F.collect_list(F.struct("ts", "ok"))).alias("events"), F.min("ts").alias("first")))
    untouched = F.struct(F.array().cast("array<double>").alias("hits"), F.lit(float("-inf")).alias("until"))
    fold = lambda df: df.select("address", "range", "first", "start", _gate(F.col("events"), F.col("start"), max_attempts, window, lock).alias("s"))
    done = materialize(fold(ranges.withColumn("start", untouched)))
    while True:
        left = F.lag("s").over(Window.partitionBy("address").orderBy("range"))
        handed = done.withColumn("_left", left).withColumn("handed", F.when(F.col("_left").isNull(), untouched).otherwise(F.struct(
            F.filter("_left.hits", lambda h: F.col("first") - h < window).alias("hits"),
            F.when(F.col("_left.until") > F.col("first"), F.col("_left.until")).otherwise(F.lit(float("-inf"))).alias("until"))))
        wrong = materialize(handed.where(F.col("handed") != F.col("start")).select("address", "range", F.col("handed").alias("start")))
        if wrong.isEmpty():
            return done
        again = fold(ranges.join(wrong, ["address", "range"]))
        done = materialize(done.join(wrong, ["address", "range"], "left_anti").unionByName(again))


def lockouts(attempts: DataFrame, max_attempts: int = fx.MAX_ATTEMPTS, window: float = fx.WINDOW_SECONDS, lock: float = fx.LOCKOUT_SECONDS) -> DataFrame:
    """Lockouts per address: the fifth failure within the window locks, clears the count, and
    nothing is counted until the lock ends; a success clears everything. ``attempts``: address, ts
    (seconds, double), ok. One row per address and lock. A success, or a pause, makes a range independent of those before it, so
    few ranges are folded more than once; the worst case is one round per range of an address that is locked throughout."""
    folded = _folded(attempts, max_attempts, window, lock)
    return folded.select("address", F.explode("s.locks").alias("locked_at")).withColumn("locked_until", F.col("locked_at") + lock)


def attempts_left(attempts: DataFrame, now: float, max_attempts: int = fx.MAX_ATTEMPTS, window: float = fx.WINDOW_SECONDS, lock: float = fx.LOCKOUT_SECONDS) -> DataFrame:
    """Failures an address may still make at a time, as the gate stands then: what comes later is not known yet, and a lock or a
    success has cleared the count."""
    last = _folded(attempts.where(F.col("ts") <= now), max_attempts, window, lock).groupBy("address").agg(F.max_by("s.hits", "range").alias("hits"))
    recent = F.size(F.filter("hits", lambda h: F.lit(float(now)) - h < window))
    return last.select("address", F.greatest(F.lit(0), F.lit(max_attempts) - recent).cast("bigint").alias("attempts_left"))


def review_status(rows: DataFrame, offer_checks: DataFrame, ignored: DataFrame) -> DataFrame:
    """Status and message per input file. ``rows``: project_id, source_name, unusable, flags;
    ``offer_checks``: project_id, source_name, passed, not_applicable, actual; ``ignored``:
    project_id, name, doc_class."""
    text = F.array_join("flags", "; ")
    invoices = rows.select(
        "project_id", F.col("source_name").alias("file"), F.when(F.col("unusable") | (F.size("flags") > 0), "hinweis").otherwise("ok").alias("status"),
        F.when(F.col("unusable") & (text == ""), "nicht verwertbar").otherwise(text).alias("message"))
    total = F.concat(format_de(F.col("actual")), F.lit(" €"))
    offers = offer_checks.select(
        "project_id", F.col("source_name").alias("file"), F.when(F.col("passed"), "ok").otherwise("hinweis").alias("status"),
        F.when(F.col("not_applicable"), F.concat(F.lit("Schätzung — Σ "), total, F.lit(" (manuell prüfen)")))
        .when(F.col("passed"), F.concat(F.lit("Kreuzsumme OK — Σ "), total)).otherwise("⚠ Kreuzsumme weicht ab — im .xlsx rot markiert").alias("message"))
    sheet = F.col("name").rlike(r"(?i)\.(xlsx|ods)$")
    known = F.col("name").rlike(r"(?i)\.(pdf|png|jpg|jpeg)$")
    unused = ignored.select(
        "project_id", F.col("name").alias("file"), F.lit("hinweis").alias("status"),
        F.when(sheet, "Tabellen werden nicht mehr gelesen — die geprüfte Kostenaufstellung bitte als PDF hochladen (ignoriert)")
        .when(~known, "kein PDF/Bild — ignoriert").otherwise("nicht Rechnung/Angebot — ignoriert").alias("message"))
    return invoices.unionByName(offers).unionByName(unused)


def run_summary(rows: DataFrame, comparison: DataFrame | None = None) -> DataFrame:
    """Counts and sums per project of a finished run, with the comparison totals if there are any."""
    zero = F.lit(0).cast("decimal(28,2)")
    df = rows.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("invoices"), F.count_if(F.size("flags") > 0).alias("flagged"), F.count_if(~F.col("position_passed")).alias("failed_cross_sums"),
        F.count_if(F.col("dup_verdict") == "duplicate").alias("duplicates"), *[F.coalesce(F.sum(f"{c}_amount"), zero).alias(f"sum_{c}") for c in ("ik", "nk", "ek")])
    if comparison is None:
        return df
    totals = comparison.where(F.col("kind") == "sum").groupBy("project_id").agg(*[F.sum(c).alias(c) for c in ("missing", "drifted", "extra")])
    return df.join(totals, "project_id", "left")
