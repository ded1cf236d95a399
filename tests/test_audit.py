"""Audit logs: order by file and line, in batch as in a stream, whichever tasks read the splits."""

import json

from costproof.operators import events
from costproof.sources import readers
from costproof.streaming import audit


def write_logs(folder):
    """Two files whose events share timestamps; the later line of the later file wins."""
    folder.mkdir()
    stamp = "2031-05-01T10:00:00"
    for f in range(2):
        lines = []
        for k in range(400):
            job = f"job{k % 7}"
            lines.append(json.dumps({"ts": stamp, "job": job, "event": "file", "file": f"f{k % 3}", "status": f"s{f}-{k}", "message": "x" * (k % 50)}))
            if k % 40 == 0:
                lines += ["", "no json", json.dumps({"ts": stamp, "job": job, "event": "feedback", "message": f"said {f}-{k}", "verified": k % 80 == 0})]
        (folder / f"log{f}.jsonl").write_text("\n".join(lines) + "\n")
    return folder


def test_order_of_equal_timestamps(spark, tmp_path):
    folder = write_logs(tmp_path / "log")
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # many splits of a file
    try:
        log = readers.read_audit_log(spark, str(folder))
        batch = sorted((r.log_file[-10:], r.line_no, r.job, r.status) for r in log.select("log_file", "line_no", "job", "status").collect())
        state = {(r.job, r.feedback) for r in events.job_state(log.where("job is not null")).collect()}
        files = {(r.job, r.file, r.status) for r in events.file_status(log).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    want, last, said = [], {}, {}
    for f in range(2):
        for n, line in enumerate((folder / f"log{f}.jsonl").read_text().split("\n"), 1):
            if not line.strip():
                continue
            e = json.loads(line) if line.startswith("{") else {}
            want.append((f"log{f}.jsonl", n, e.get("job"), e.get("status")))
            if e.get("event") == "file":
                last[e["job"], e["file"]] = e["status"]
            if e.get("event") == "feedback":
                said[e["job"]] = e["message"]
    assert batch == sorted(want, key=str) or sorted(batch, key=str) == sorted(want, key=str)
    assert files == {(*k, v) for k, v in last.items()} and dict(state) == {f"job{k}": said.get(f"job{k}", "") for k in range(7)}
    stream = readers.read_audit_log(spark, str(folder), streaming=True).writeStream.format("memory").queryName("audit_lines").trigger(availableNow=True).start()
    stream.awaitTermination(120)
    streamed = [(r.log_file[-10:], r.line_no, r.job, r.status) for r in spark.table("audit_lines").collect()]
    assert sorted(streamed, key=str) == sorted(want, key=str)
    query = audit.stream_job_state(spark, str(folder)).writeStream.outputMode("complete").format("memory").queryName("audit_state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.job, r.feedback) for r in spark.table("audit_state").where("job is not null").collect()} == state
