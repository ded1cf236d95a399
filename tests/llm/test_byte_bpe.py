"""Byte-level BPE against the library: the perfect hash, the heap, cuts, odd rows."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from costproof.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, part int, ids string, decoded long, n_tokens string"


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.codec(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(codec.ranks), special_tokens={})


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    out = [None, "", " ", "  \n\t x  y \n", "it's IT'S 'tis 's", "<|endoftext|> <|fim|>", "日本語 のテキスト 😀 👩‍👩‍👧 é é", "\x00\x1c a\x85b\xa0c ", "a" * 3000, "ab" * 1500, "x y " * 4000, "9" * 700]
    out += ["".join(r.choice("abcE'’s \n1é٣\t") for _ in range(r.randint(0, 80))) for _ in range(400)]
    out += ["".join(chr(r.choice((r.randrange(0x20, 0x500), r.randrange(0x3000, 0xD7FF), r.randrange(0x10000, 0x1FFFF)))) for _ in range(300)) for _ in range(20)]
    words = ["abba", "baab"]  # texts whose polynomial hashes modulo 2^64 agree
    for _ in range(9):
        words = [words[0] + words[1], words[1] + words[0]]
    return [*out, f"q {words[0]}", f"q {words[1]}"]


def test_perfect_hash(codec):
    table = codec.table
    data, starts = byte_bpe.packed(codec.tokens)
    assert (table.find(data, starts) == np.arange(len(codec.tokens))).all()
    assert sorted(table.key_at.tolist()) == list(range(len(codec.tokens)))
    others = [t + b"\xff\xfe" for t in codec.tokens[:5000]] + [b"", b"zzzzqqqq" * 40] + [t[:-1] + bytes([t[-1] ^ 1]) for t in codec.tokens[5000:9000]]
    found = table.find(*byte_bpe.packed(others))
    assert all(codec.ranks.get(o, -1) == f for o, f in zip(others, found.tolist(), strict=True))
    for n in (1, 2, 300):
        small = byte_bpe.PerfectHash([b"%d" % i for i in range(n)])
        assert small.find(*byte_bpe.packed([b"%d" % i for i in range(n + 5)])).tolist() == [*range(n), *[-1] * 5]
    with pytest.raises(ValueError):
        byte_bpe.PerfectHash([b"a", b"a"])


def test_heap(codec, library):
    r = random.Random(5)
    for piece in [b"a", b"aaaaaaa", "Größenordnung".encode(), *[bytes(r.choice(b"abcest\xc3\xa9") for _ in range(r.randint(1, 60))) for _ in range(800)]]:
        assert byte_bpe.merged(piece, codec.ranks) == library._core_bpe.encode_single_piece(piece) or piece in codec.ranks


def test_ids(codec, library, texts):
    plain = [t or "" for t in texts]
    want = [library.encode_ordinary(t) for t in plain]
    assert [i.tolist() for i in codec.encode(plain)] == want
    for t, ids in zip(plain, want, strict=True):
        for size in (1, 9, 200):
            parts = list(byte_bpe.segments(t, size))
            assert "".join(parts) == t and [i for p in codec.encode(parts) for i in p.tolist()] == ids
        assert codec.decode(np.array(ids, np.int64)) == t.encode()


def test_round_trip(spark, library, texts, monkeypatch):
    rows = [*enumerate(texts), (None, "no id"), (3, texts[3])]
    docs = spark.createDataFrame([(i, t, 1, "x", 2, "y") for i, t in rows], SCHEMA)
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    for size in (1 << 21, 400):  # one part for each text, and several
        monkeypatch.setattr(byte_bpe, "BATCH", size)
        got = byte_bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    parts = byte_bpe.encoded(docs, PATH, public_tokenizers.PATTERN).where("doc_id is not null and doc_id <> 3").orderBy("doc_id", "part").collect()
    joined = {}
    for p in parts:
        joined.setdefault(p.doc_id, [b"", []])
        joined[p.doc_id] = [joined[p.doc_id][0] + bytes(p.decoded), joined[p.doc_id][1] + p.ids]
    assert all(joined[i] == [(t or "").encode(), library.encode_ordinary(t or "")] for i, t in rows[:-2] if i != 3)
    assert byte_bpe.round_trip(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
