"""Readers, sinks and streams over small files."""

import json
import random
import time

from pyspark.sql import functions as F

from costproof.operators import events
from costproof.sources import documents, readers, sinks
from costproof.streaming import audit


def test_scan_documents(spark, tmp_path):
    for rel in ("a/Rechnung.pdf", "a/b/scan.PNG", "a/.hidden.pdf", "a/~lock.pdf", "a/notes.txt", "a/_b.pdf", "a/c.PdF", "_alt/e.JPg"):
        path = tmp_path / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    deep = {(r.parent_name, r["name"]) for r in documents.scan_documents(spark, str(tmp_path)).collect()}
    assert deep == {("a", "Rechnung.pdf"), ("b", "scan.PNG"), ("a", "_b.pdf"), ("a", "c.PdF"), ("_alt", "e.JPg")}
    flat = {r["name"] for r in documents.scan_documents(spark, str(tmp_path / "a"), recursive=False).collect()}
    assert flat == {"Rechnung.pdf", "_b.pdf", "c.PdF"}


def test_read_extractions(spark, tmp_path):
    good = dict(offer_id=1, project_id=1, vendor_name="V", offer_number="A-1", offer_date="2026-01-10",
                positions=[dict(pos="1", description="x" * 90, line_total_net=5), dict(pos="2", description="Option", optional=True)])
    open_line = dict(good, offer_id=2, positions=[dict(pos="1", description="fehlt")])
    nameless = dict(good, offer_id=3, vendor_name=None)
    lines = [json.dumps(r) for r in (good, open_line, nameless)] + ["{not json"]
    (tmp_path / "o.jsonl").write_text("\n".join(lines))
    offers, positions, rejected = readers.read_extractions(spark, str(tmp_path / "o.jsonl"), "offer")
    assert [r.offer_id for r in offers.collect()] == [1]
    assert sorted((r.pos_seq, len(r.description), len(r.short_name) <= 80) for r in positions.collect()) == [(1, 90, True), (2, 6, True)]
    assert sorted(r.reason for r in rejected.collect()) == ["binding position without total", "missing: vendor_name", "unreadable record"]


def test_read_projects_fills_missing(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text(json.dumps(dict(project_id=1, client_name="K", bewilligungszeitraum_start="2023-03-23")))
    ids = spark.createDataFrame([(1,), (2,)], "project_id bigint")
    rows = {r.project_id: r.client_name for r in readers.read_projects(spark, str(tmp_path / "p.jsonl"), ids).collect()}
    assert rows == {1: "K", 2: None}


EVENTS = [
    dict(ts="2026-01-01T10:00:00", job="j1", procedure="vne", event="created", message="Titel"),
    dict(ts="2026-01-01T10:00:01", job="j1", procedure="vne", event="file", file="a.pdf", status="läuft"),
    dict(ts="2026-01-01T10:00:02", job="j1", procedure="vne", event="file", file="a.pdf", status="ok", message="fertig"),
    dict(ts="2026-01-01T10:00:03", job="j1", procedure="vne", event="output", file="out.xlsx", bytes=12),
    dict(ts="2026-01-01T10:00:04", job="j1", procedure="vne", event="finished", status="fertig"),
    dict(ts="2026-01-01T10:00:05", job="j1", procedure="vne", event="feedback", verified=True, message="gut"),
    dict(ts="2026-01-01T11:00:00", job="j2", procedure="beg", event="created", message="Zwei"),
]


def test_job_state_batch_and_stream(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "audit.jsonl").write_text("\n".join(json.dumps(e) for e in EVENTS))
    log = readers.read_audit_log(spark, str(tmp_path / "log"))
    assert log.where("event = 'output'").first().payload == {"bytes": "12"}
    batch = {r.job: (r.title, r.status, r.verified, r.error_class) for r in events.job_state(log).collect()}
    assert batch == {"j1": ("Titel", "fertig", True, None), "j2": ("Zwei", "fehler", False, "server-restart")}
    stream = audit.stream_job_state(spark, str(tmp_path / "log"))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("job_state_test").trigger(availableNow=True).start()
    query.awaitTermination()
    live = {r.job: (r.title, r.status, r.verified, r.error_class) for r in spark.table("job_state_test").collect()}
    assert live == batch


def _serial_lockouts(rows):
    hits, until, out = {}, {}, []
    for address, ts, ok in sorted(rows, key=lambda r: (r[0], r[1])):
        if ts < until.get(address, float("-inf")):
            continue
        if ok:
            hits[address], until[address] = [], float("-inf")
            continue
        recent = [h for h in hits.get(address, []) if ts - h < 300] + [ts]
        if len(recent) >= 5:
            out.append((address, ts))
            hits[address], until[address] = [], ts + 900
        else:
            hits[address] = recent
    return sorted(out)


def test_lockouts_batch_and_stream(spark, tmp_path):
    rng = random.Random(3)
    rows = [("hot", float(i * 7 + rng.random()), rng.random() < 0.02) for i in range(600)]
    rows += [(f"a{rng.randrange(5)}", float(rng.randrange(20000)) + rng.random(), rng.random() < 0.1) for _ in range(300)]
    rows += [("edge", float(t), False) for t in (0, 75, 150, 225, 300)] + [("edge5", float(t), False) for t in (0, 75, 150, 225, 299)]
    rows = [(a, t + 1_700_000_000.0, ok) for a, t, ok in rows]
    df = spark.createDataFrame(rows, "address string, ts double, ok boolean")
    want = _serial_lockouts(rows)
    assert sorted((r.address, r.locked_at) for r in events.lockouts(df).collect()) == want
    assert ("edge5", 1_700_000_299.0) in want and not any(a == "edge" for a, _ in want)
    # Two batches that overlap within the delay, then one late enough to move the watermark past them all.
    ordered = sorted(rows, key=lambda r: r[1])
    swapped = [ordered[i] for k in range(0, len(ordered), 40) for i in sorted(range(k, min(k + 40, len(ordered))), key=lambda i: -i)]
    for n, part in enumerate((swapped[: len(rows) // 2 + 9], swapped[len(rows) // 2 + 9 :], [("late", 1_700_900_000.0, True)])):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "attempts"))
        time.sleep(1.1)  # files are taken by age
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "attempts"))
    query = audit.stream_lockouts(stream).writeStream.outputMode("append").format("memory").queryName("lockouts_test").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.address, r.locked_at) for r in spark.table("lockouts_test").collect()) == want


def test_attempts_left(spark):
    """The gate as it stands at a time: later events are unknown, a lock clears the count."""
    def left(rows, now, **kw):
        df = spark.createDataFrame([("x", float(t), ok) for t, ok in rows], "address string, ts double, ok boolean")
        return events.attempts_left(df, now, **kw).first().attempts_left

    four = [(0, False), (10, False), (20, False), (30, False)]
    assert left([*four, (5000, True)], 40.0) == 1
    assert left(four, 305.0) == 2 and left(four, 1000.0) == 5
    assert left([(0, False), (1, False)], 2.0, max_attempts=2) == 2
    assert left([*four, (35, True), (36, False)], 40.0) == 4


def test_sinks(spark, tmp_path):
    corrections = spark.createDataFrame([("position-field", "B", "1", "gesamt", "1.00", "2.00"), ("block-added", "C", None, None, None, None)],
                                        "scope string, block string, pos string, field string, original string, corrected string")
    sinks.write_corrections(corrections.coalesce(1), str(tmp_path / "c"))
    lines = [json.loads(line) for p in (tmp_path / "c").glob("part-*") for line in p.read_text().splitlines()]
    assert {"scope": "block-added", "block": "C"} in lines and len(lines) == 2
    renames = spark.createDataFrame([("a.pdf", "b.pdf", "")], "old_name string, new_name string, note string")
    sinks.write_rename_manifest(renames.coalesce(1), str(tmp_path / "r"))
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("*.csv"))
    assert text.splitlines() == ["alter Name;neuer Name;Hinweis", "a.pdf;b.pdf;"]
    sinks.write_result_tables({"rows": spark.range(10).select(F.col("id").alias("project_id"))}, str(tmp_path / "t"), buckets=4)
    assert sinks.read_result_table(spark, str(tmp_path / "t"), "rows").count() == 10
