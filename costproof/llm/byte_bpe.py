"""Byte-level BPE encoding and decoding by a file of ranks.

A text splits at the pattern into pre-tokens. Each is looked up in two tiers. The first is a minimal perfect hash over the
vocabulary: levels of bit arrays, a key stands at the first level where no other key shares its bit, and the number of bits set before
it is its place in one table of ids. All distinct pre-tokens of a batch are looked up at once, and a hit counts only when the
stored bytes are equal, so hashes decide nothing by themselves. The second tier merges the bytes of a pre-token that is no token:
neighbours stand in a linked list, and a heap gives the pair of the lowest rank, leftmost first.

The table is built on the driver from the file and broadcast (its size is that of the file); workers keep what the second tier
encoded, up to a bound. Long texts go segment by segment, cut only where no pre-token can cross.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from costproof.llm.bytehash import mix

#: Characters of one batch of texts, and of a text beyond which it is cut; pre-tokens and their bytes that a worker keeps.
BATCH, KEPT, KEPT_BYTES = 1 << 21, 600_000, 32_000_000
_MASK = (1 << 64) - 1
_CUT = regex.compile(r"(?<=\S) (?=\S)")


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from lines of base64 token and rank; ranks count from 0 without gaps."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks are not 0, 1, 2 and so on")
    return [ranks[i] for i in range(len(ranks))]


def packed(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, where each key starts and, last, the end)."""
    starts = np.zeros(len(keys) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys)), out=starts[1:])
    return np.frombuffer(b"".join(keys), np.uint8), starts


def hashes(data: np.ndarray, starts: np.ndarray, longest: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each key; keys above ``longest`` bytes are hashed by their first ones."""
    length = np.diff(starts)
    out = mix(length.astype(np.uint64), seed)
    order = np.argsort(-length, kind="stable")
    falling = -length[order]
    for j in range(min(longest, int(length.max(initial=0)))):
        still = order[: np.searchsorted(falling, -j)]  # keys of more than j bytes
        out[still] = mix(out[still] ^ data[starts[still] + j], seed + j)
    return out


class PerfectHash:
    """Keys -> 0 ... number of keys - 1, each a different number; other byte strings -> -1."""

    def __init__(self, keys: list[bytes]):
        self.data, self.starts = packed(keys)
        self.longest = max(map(len, keys), default=0)
        for self.seed in range(64):  # equal hashes of two keys would never part
            found = hashes(self.data, self.starts, self.longest, self.seed * 1000)
            if len(np.unique(found)) == len(keys):
                break
        else:
            raise ValueError("a key is repeated")
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        left, rank = np.arange(len(keys)), np.full(len(keys), -1)
        done = 0
        while len(left):
            size = max(64, -(-len(left) * 3 // 2 // 64) * 64)
            at = (mix(found[left], len(self.levels) + 1) % np.uint64(size)).astype(np.int64)
            single = np.bincount(at, minlength=size) == 1
            words = np.packbits(single, bitorder="little").view(np.uint64)
            before = done + np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))[:-1]
            self.levels.append((size, words, before))
            placed = single[at]
            rank[left[placed]] = done + np.cumsum(single)[at[placed]] - 1
            done += int(single.sum())
            left = left[~placed]
        self.key_at = np.argsort(rank)  # place -> key

    def find(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Numbers of many byte strings at once, as their places in ``keys``."""
        out = np.full(len(starts) - 1, -1, np.int64)
        length = np.diff(starts)
        open_ = np.flatnonzero((length <= self.longest) & (length > 0))
        found = hashes(data, starts, self.longest, self.seed * 1000)
        for level, (size, words, before) in enumerate(self.levels):
            at = (mix(found[open_], level + 1) % np.uint64(size)).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            is_set = (word >> bit) & np.uint64(1) == 1
            lower = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[is_set]] = self.key_at[(before[at >> 6] + np.bitwise_count(lower))[is_set]]
            open_ = open_[~is_set]
        maybe = np.flatnonzero(out >= 0)
        key = out[maybe]
        same = np.diff(self.starts)[key] == length[maybe]
        out[maybe[~same]] = -1
        maybe, key = maybe[same], key[same]
        n = length[maybe]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        equal = data[np.repeat(starts[maybe], n) + inside] == self.data[np.repeat(self.starts[key], n) + inside]
        wrong = np.concatenate(([0], np.cumsum(~equal)))
        ends = np.cumsum(n)
        out[maybe[wrong[ends] != wrong[ends - n]]] = -1
        return out


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token by merging: a heap of pairs over a linked list of parts, the lowest rank first, the leftmost of equal ones."""
    n = len(piece)
    ends, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at a place
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i] if ends[i] else n
        if j >= n or not ends[i] or ends[j] != end:
            continue  # one of both parts is merged already
        ends[i], ends[j] = end, 0
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (rank := ranks.get(piece[i : ends[k]])) is not None:
                heapq.heappush(heap, (rank, i, ends[k]))
        h = before[i]
        if h >= 0 and (rank := ranks.get(piece[h:end])) is not None:
            heapq.heappush(heap, (rank, h, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = after[i]
    return out


class Codec:
    """Encodes and decodes by a table of tokens and a split pattern."""

    def __init__(self, tokens: list[bytes], pattern: str):
        if not all(bytes([b]) in set(tokens) for b in range(256)):
            raise ValueError("a single byte is no token")
        self.tokens, self.split = tokens, regex.compile(pattern)
        self.table = PerfectHash(tokens)
        self.ranks = {token: i for i, token in enumerate(tokens)}
        self.fresh()

    def fresh(self) -> None:
        self.kept: dict[bytes, bytes] = {}
        self.kept_bytes = 0

    def __getstate__(self) -> tuple:
        return self.tokens, self.split.pattern, self.table

    def __setstate__(self, state: tuple) -> None:
        self.tokens, pattern, self.table = state
        self.split = regex.compile(pattern)
        self.ranks = {token: i for i, token in enumerate(self.tokens)}
        self.fresh()

    def _second_tier(self, piece: bytes) -> bytes:
        """Ids of a pre-token that is no token, four bytes each."""
        ids = self.kept.get(piece)
        if ids is None:
            ids = array("i", merged(piece, self.ranks)).tobytes()
            if len(self.kept) >= KEPT or self.kept_bytes > KEPT_BYTES:
                self.fresh()
            if len(piece) <= 256:
                self.kept[piece] = ids
                self.kept_bytes += len(piece)
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts."""
        pieces: list[str] = []
        upto = [0]
        for text in texts:
            pieces += self.split.findall(text)
            upto.append(len(pieces))
        if not pieces:
            return [np.zeros(0, np.int32)] * len(texts)
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        del pieces
        distinct = coded.dictionary
        _, offsets, values = distinct.buffers()
        starts = np.frombuffer(offsets, np.int64)[: len(distinct) + 1]
        data = np.frombuffer(values, np.uint8)
        token = self.table.find(data, starts)
        n, misses = np.ones(len(token), np.int64), np.flatnonzero(token < 0)
        raw = memoryview(values)
        more = [self._second_tier(bytes(raw[a:b])) for a, b in zip(starts[misses].tolist(), starts[misses + 1].tolist(), strict=True)]
        n[misses] = np.fromiter(map(len, more), np.int64, len(more)) // 4
        pool = np.concatenate((token.astype(np.int32), np.frombuffer(b"".join(more), np.int32)))  # a hit's place is its own
        at = np.arange(len(token))
        at[misses] = len(token) + np.cumsum(n[misses]) - n[misses]
        codes = coded.indices.to_numpy()
        n, at = n[codes], at[codes]
        ends = np.cumsum(n)
        ids = pool[np.repeat(at - (ends - n), n) + np.arange(ends[-1])]
        cuts = np.concatenate(([0], ends))[upto].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def segments(text: str, size: int = BATCH) -> Iterator[str]:
    """Parts of a text of about ``size`` characters, cut before a single blank between visible characters; more where there is none."""
    start = 0
    while len(text) - start > size:
        found = _CUT.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


def batches(texts: list[str], limit: int = BATCH) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` characters together, or one longer text."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def encoded(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, part, ids, decoded): ids and decoded bytes of every text, in parts of about ``BATCH`` characters numbered from 0.

    A null text counts as empty: one part without ids. Only texts above ``BATCH`` characters have more than one part, unless they hold
    no single blank between visible characters. Strings that look like special tokens are ordinary text. Rows that repeat are rows of
    their own, a null doc_id stays null, further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(codec(path, pattern))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, parts in _segmented(rows):
            ids = shared.value.encode([p for _, p in parts])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array([k for k, _ in parts], pa.int32()), pa.array([i.tolist() for i in ids], pa.list_(pa.int32())),
                 pa.array([shared.value.decode(i) for i in ids], pa.binary())], ["doc_id", "part", "ids", "decoded"])

    return _given(docs, doc_id, text).mapInArrow(run, "doc_id long, part int, ids array<int>, decoded binary")


def _given(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def _segmented(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[tuple[int, str]]]]:
    """Batches of (doc_ids, [(number of the part, part)]); the parts of a text follow each other."""
    for batch in rows:
        names, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
        for a, b in batches(texts):
            if b - a == 1:
                for k, part in enumerate(segments(texts[a])):
                    yield [names[a]], [(k, part)]
            else:
                yield names[a:b], [(0, t) for t in texts[a:b]]


def round_trip(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256 (of the decimal ids, a blank between them), decoded_sha256.

    The parts of ``encoded`` are digested as they come, so no ids leave their task. Rules for odd rows are those of ``encoded``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(codec(path, pattern))

    def digests(rows: Iterator[pa.RecordBatch]) -> Iterator[list]:
        codec_, shown = shared.value, [str(i) for i in range(len(shared.value.tokens))]
        n = of_ids = of_bytes = None
        for names, parts in _segmented(rows):
            for name, (k, _), ids in zip(names, parts, codec_.encode([p for _, p in parts]), strict=True):
                if k == 0:
                    if n is not None:
                        yield [last, n, of_ids.hexdigest(), of_bytes.hexdigest()]
                    last, n, of_ids, of_bytes = name, 0, hashlib.sha256(), hashlib.sha256()
                decimal = " ".join(map(shown.__getitem__, ids.tolist()))
                of_ids.update((" " + decimal if n and decimal else decimal).encode())
                of_bytes.update(codec_.decode(ids))
                n += len(ids)
        if n is not None:
            yield [last, n, of_ids.hexdigest(), of_bytes.hexdigest()]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        for row in digests(rows):
            held.append(row)
            if len(held) == 4096:
                yield _table(held)
                held = []
        if held:
            yield _table(held)

    return _given(docs, doc_id, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _table(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)],
                                      ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
