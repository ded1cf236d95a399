"""Training-order materialisation: fixed-stride shards in a keyed random order.

Documents' ids (each followed by an end id) are laid end to end in the order of the input's partitions; every ``width`` ids
are one sequence. A Feistel network over the smallest even number of bits that holds all sequence numbers permutes them; numbers
beyond the last sequence walk on along their cycle until they are inside. So each sequence has its own slot among 0 .. n - 1, and
the order is known from the key alone. Rows are sent to the shard of their slot; each task sorts its shard and writes one file of
records of the same size, so record i of shard k is at byte i * stride: a reader resumes anywhere by arithmetic.

Two passes read the input: the first counts ids per partition, the second lays them out. A digest of every partition shows if
its rows moved in between (as after a change of the cluster's size); then the second pass fails rather than write wrong shards.
Files are written under another name and renamed, so a task that is run again replaces its own file by an equal one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from costproof.llm.bytehash import mix
from costproof.llm.tables import shared_folder, written
from costproof.llm.tokens import encoder

ROUNDS = 6


def slots(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """The permutation's image of sequence numbers below n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    x = numbers.astype(np.uint64)
    walk = np.ones(len(x), bool)
    while walk.any():
        left, right = x[walk] >> np.uint64(half), x[walk] & low
        for r in range(ROUNDS):
            left, right = right, left ^ (mix(right, key * ROUNDS + r) & low)
        x[walk] = (left << np.uint64(half)) | right
        walk = x >= np.uint64(n)
    return x.astype(np.int64)


def _filesystem(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder) if ":" in folder.split("/")[0] else f"file://{folder}")


def _digest(was: int, doc: int | None, n: int) -> int:
    return zlib.crc32(f"{doc}:{n};".encode(), was)


def _counted(path: str):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, digest = encoder(path), 0, 0
        for batch in found:
            docs = batch.column("doc_id").to_pylist()
            for at in range(0, batch.num_rows, 1024):
                for doc, ids in zip(docs[at : at + 1024], own.ids([t or "" for t in batch.column("text").slice(at, 1024).to_pylist()])):
                    total += len(ids) + 1
                    digest = _digest(digest, doc, len(ids) + 1)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (TaskContext.get().partitionId(), total, digest)], ["part", "n", "digest"])

    return run


def _laid(path: str, end: int, width: int, total: int, key: int, parts: dict[int, tuple[int, int]]):
    count = -(-total // width)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, digest = encoder(path), 0
        at, expected = parts[TaskContext.get().partitionId()]
        for batch in found:
            docs = batch.column("doc_id").to_pylist()
            for b in range(0, batch.num_rows, 512):
                out = {k: [] for k in ("doc_id", "start", "sequence", "offset", "ids")}
                part = docs[b : b + 512]
                for doc, ids in zip(part, own.ids([t or "" for t in batch.column("text").slice(b, 512).to_pylist()])):
                    ids = np.append(ids, ids.dtype.type(end))
                    digest = _digest(digest, doc, len(ids))
                    cuts = [0, *range(width - at % width, len(ids), width), len(ids)]
                    for i, j in zip(cuts, cuts[1:]):
                        if j > i:
                            for k, v in zip(out, (doc, i, (at + i) // width, (at + i) % width, ids[i:j].tobytes())):
                                out[k].append(v)
                    at += len(ids)
                slot = slots(np.array(out["sequence"], np.int64), count, key)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(out[k], pa.int64()) for k in ("doc_id", "start", "sequence")), pa.array(slot), pa.array(out["offset"], pa.int64()), pa.array(out["ids"], pa.binary())],
                    ["doc_id", "start", "sequence_id", "slot", "offset", "ids"])
        if digest != expected:
            raise RuntimeError("the rows of a partition changed between the passes; run again")

    return run


def _stored(path: str, folder: str, width: int, per_shard: int, total: int):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(path).dtype
        step, count = dtype().itemsize, -(-total // width)
        shard, file, temp, record, held = None, None, "", -1, bytearray()
        fs, base = _filesystem(folder)

        def flush() -> None:
            if record >= 0:
                file.write(bytes(held) + bytes(width * step - len(held)))
                held.clear()

        def close() -> None:
            if shard is not None:
                flush()
                file.close()
                fs.move(temp, f"{base}/shard-{shard:08d}.bin")

        for batch in found:
            raws, at = batch.column("ids").to_pylist(), batch.column("slot").to_pylist()
            offsets = batch.column("offset").to_pylist()
            for slot, offset, raw in zip(at, offsets, raws, strict=True):
                if slot // per_shard != shard:
                    close()
                    shard, record = slot // per_shard, -1
                    temp = f"{base}/.shard-{shard:08d}-{TaskContext.get().taskAttemptId()}"
                    file = fs.open_output_stream(temp)
                if slot != record:
                    flush()
                    if slot != (record + 1 if record >= 0 else shard * per_shard):
                        raise RuntimeError(f"slot {slot} follows {record} in a shard")
                    record = slot
                if offset * step != len(held):
                    raise RuntimeError(f"sequence in slot {slot} has a gap")
                held += raw
            length = pa.array([len(r) // step for r in raws], pa.int64())
            crc = pa.array([zlib.crc32(np.frombuffer(r, dtype).astype("<u4").tobytes()) for r in raws], pa.int64())
            slot = np.array(at, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "start")), length, crc, *(batch.column(c) for c in ("sequence_id", "slot")), pa.array(slot // per_shard),
                 pa.array((slot % per_shard * width + offsets) * step if len(slot) else slot)],
                ["doc_id", "start", "length", "ids_crc32", "sequence_id", "slot", "shard", "byte_offset"])
        close()
        if shard is not None and record != min((shard + 1) * per_shard, count) - 1:
            raise RuntimeError(f"shard {shard} ends at slot {record}")

    return run


def write_shards(docs: DataFrame, path: str, folder: str | None = None, width: int = 1024, per_shard: int = 4096, key: int = 1, end: int = 0,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write shard-*.bin files into ``folder`` (default: a new one in the shared folder); one row per piece of a document in them.

    Columns: doc_id, start, length, ids_crc32 (of unsigned 32-bit ids), sequence_id, slot, shard, byte_offset. Ids are little-endian, two bytes each
    when the vocabulary allows, four otherwise; only the last sequence is padded, with zero bytes. A null text counts as
    empty and is its end id; rows that repeat are rows of their own; a null doc_id stays null. Empty input writes nothing.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    folder = folder or shared_folder(docs.sparkSession)
    fs, base = _filesystem(folder)
    fs.create_dir(base, recursive=True)
    sums = written(docs.mapInArrow(_counted(path), "part long, n long, digest long"))  # a row per partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = sums.withColumn("before", before).collect()
    total = sum(r["n"] for r in rows)
    laid = docs.mapInArrow(_laid(path, end, width, max(1, total), key, {r["part"]: (r["before"], r["digest"]) for r in rows}),
                           "doc_id long, start long, sequence_id long, slot long, offset long, ids binary")
    shards = max(1, -(-max(1, -(-total // width)) // per_shard))
    sent = laid.repartitionById(shards, F.floor(F.col("slot") / per_shard).cast("int")).sortWithinPartitions("slot", "offset")
    return written(sent.mapInArrow(_stored(path, folder, width, per_shard, total),
                                   "doc_id long, start long, length long, ids_crc32 long, sequence_id long, slot long, shard long, byte_offset long"))


def read_record(folder: str, slot: int, width: int = 1024, per_shard: int = 4096, step: int = 2) -> np.ndarray:
    """Ids of the sequence in a slot: one seek."""
    fs, base = _filesystem(folder)
    with fs.open_input_file(f"{base}/shard-{slot // per_shard:08d}.bin") as f:
        return np.frombuffer(f.read_at(width * step, slot % per_shard * width * step), np.uint16 if step == 2 else np.uint32)
