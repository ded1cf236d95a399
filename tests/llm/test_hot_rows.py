"""Repeated rows, texts built to collide, unclosed markup, and pipelines beside each other."""

import threading
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from costproof.llm import bytehash, factorisation, language, minhash, mixing, packing, tokens
from tests.llm import plain
from tests.llm.test_documents import covered, frame, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


def twins(letters):
    """Two words of ``letters`` letters whose polynomial hashes modulo 2^64 agree."""
    x, y = "a", "b"
    while len(x) < letters:
        x, y = x + y, y + x
    return x, y


@pytest.mark.parametrize("letters", [1024, 4096])
def test_colliding_words(spark, letters):
    x, y = twins(letters)
    library = Tokenizer.from_file(PATH)
    texts = {i: t for i, t in enumerate([f"q {x}", f"q {y}", f"{x} q", f"{y} q", f"q {x} q {y}", f"one two three four {x} six", f"one two three four {y} six"])}
    want = {i: [*library.encode(t).ids, 0] for i, t in texts.items()}
    encoder = tokens.Encoder(PATH)
    for _ in range(2):
        assert [i.tolist() for i in encoder.ids(list(texts.values()))] == [v[:-1] for v in want.values()]
    docs = frame(spark, [(i, t, "en", "a") for i, t in texts.items()])
    covered(packing.pack(docs, PATH).collect(), set(texts), want)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()} == plain.near_duplicates(texts)


def test_lookup_compares_bytes(monkeypatch):
    """Every longer pre-token gets the same hash: ids are still those of the library."""
    whole = bytehash.hashed
    monkeypatch.setattr(bytehash, "hashed", lambda buffer, starts, ends: np.where(ends - starts > bytehash.EXACT, np.uint64(12345), whole(buffer, starts, ends)))
    library, encoder = Tokenizer.from_file(PATH), tokens.Encoder(PATH)
    texts = ["somewhat longer words andsomewhat longerer words", "longerer words somewhat", "somewhere", "some"]
    for _ in range(2):
        assert [i.tolist() for i in encoder.ids(texts)] == [library.encode(t).ids for t in texts]


def test_short_words_have_hashes_of_their_own():
    words = [bytes([a, b, c]) for a in range(97, 123) for b in range(97, 123) for c in range(97, 123)] + [b"%08d" % k for k in range(20_000)]
    found, first = bytehash.words(words)
    assert len(first) == len(words) + 1 and len(np.unique(found)) == len(words)


def test_lookup_of_repeated_texts():
    library, encoder = Tokenizer.from_file(PATH), tokens.Encoder(PATH)
    texts = ["some words and some more", "words some", "one", "some"]
    for _ in range(2):
        assert [i.tolist() for i in encoder.ids(texts)] == [library.encode(t).ids for t in texts]


def test_similarity_below_the_bands(spark):
    with pytest.raises(ValueError):
        minhash.near_duplicates(frame(spark, []), 70)


def test_classifier_reads_a_bounded_sample(spark, monkeypatch):
    good, bad = [(i, prose(i, 30), "en", "a") for i in range(40)], [(i, prose(i, 30).upper(), "en", "a") for i in range(40, 60)]
    docs = frame(spark, [*good, *bad, *[(7, prose(7, 40 + k % 5), "en", "a") for k in range(3000)]])
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(factorisation, "fit", lambda rows, y: seen.append(len(rows)) or {"b": 0.0})
    factorisation.train(docs, labels, 30)
    monkeypatch.setattr(factorisation, "TRAIN_BYTES", 1000)
    factorisation.train(docs, labels, 30)
    assert seen[0] == 30 and 0 < seen[1] < 10


def test_mix_of_one_id(spark):
    def run(ids):
        rows = [(i, prose(1, 20 + k % 3), "en", "ab"[k % 2]) for k, i in enumerate(ids)]
        start = time.time()
        return [tuple(r) for r in mixing.mix(frame(spark, rows).repartition(4)).collect()], time.time() - start

    one, seconds = run([5] * 16_000)
    _, apart = run(range(16_000))
    again, _ = run([5] * 16_000)
    assert len(one) == 16_000 and seconds < 3 * apart + 10 and Counter(one) == Counter(again)
    taken, target = Counter(), {}
    for r in one:
        taken[r[3]] += r[4]
        target[r[3]] = r[3]
    assert all(abs(taken[t] - t) <= 0.02 * t + 30 for t in target)


def test_unclosed_markup():
    assert language.visible("a<b>c</b><script>x > y</script >d<!-- <b> -->e<style>s</style>f <x") == "a c d e f <x"
    assert language.visible("<script>one <b>two") == "one two" and language.visible("1 < 2 <!-- open") == "1 < 2 <!-- open"
    start = time.time()
    assert language.visible("<script> <!-- <b" * 60_000 + ">") == "" and time.time() - start < 5


def small_tables(spark, folder):
    texts = {i: prose(i, 60) for i in range(40)} | {100 + i: prose(i, 60) for i in range(5)}
    spark.createDataFrame([(i, t, "en", "ab"[i % 2], len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipelines_beside_each_other(spark, tmp_path):
    small_tables(spark, tmp_path)
    first = corpus_pipeline.run(spark, str(tmp_path))
    second = corpus_pipeline.run(spark, str(tmp_path))
    want = sorted(map(tuple, second.collect()))
    assert sorted(map(tuple, first.collect())) == want
    found = {}
    threads = [threading.Thread(target=lambda k=k: found.__setitem__(k, sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())))) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert found == {0: want, 1: want}


def test_pipeline_of_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, key long, row string"
    rows = [(None, None, None, None, None, None, None), (None, prose(1, 50), None, None, 3, 1, "x"), (3, prose(2, 50), "en", None, 9, 1, "x"), (3, prose(2, 50), "en", None, 9, 1, "x"), (3, prose(3, 50), "en", "a", 9, 1, "x"), (4, "", "en", "a", 0, 1, "x")]
    for name, some in (("odd", rows), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        assert (corpus_pipeline.run(spark, str(tmp_path / name)).count() > 0) == bool(some)
