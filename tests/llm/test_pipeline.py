"""The registry and the pipeline's stages, each on what its predecessor kept."""

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import plain
from tests.llm.test_documents import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_registered():
    queries, oracles = entry.queries(), entry.oracle_sql()
    for n in range(1, 14):
        assert len([q for q in queries if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in queries and [x for x in oracles if x.startswith("op1_") or x.startswith("op5_")]


def test_stages(spark, tmp_path):
    texts = {i: prose(i, 60 + i % 40) for i in range(150)}
    texts |= {200 + i: texts[i] for i in range(20)}  # copies
    texts |= {300 + i: texts[i].replace(" ", "### ") for i in range(60)}  # to reject
    texts |= {400: prose(400, 50) + " password=hunter2hunter2 " + prose(401, 50), 401: None, 402: "too short"}
    docs = spark.createDataFrame([(i, t, "en", "ab"[i % 2], None if t is None else len(t)) for i, t in texts.items()], SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in texts if i < 400 and i % 5], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = docs
    results = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        results.append(kept.collect())
        assert name == corpus_pipeline.STAGES[-1][0] or kept.columns == docs.columns
    clean, single, masked, mixed, packed = results
    assert {r.doc_id for r in clean} == {i for i, t in texts.items() if i < 300 or i == 400}
    want = plain.near_duplicates({r.doc_id: r.text for r in clean})
    assert sorted(r.doc_id for r in single) == sorted(i for i, (_, c) in want.items() if i == c)
    assert {r.doc_id: r.text for r in masked} == {r.doc_id: r.text.replace("password=hunter2hunter2", "[SECRET]") for r in single}
    text = {r.doc_id: r.text for r in masked}
    assert {r.doc_id for r in mixed} <= set(text) and all(r.text == text[r.doc_id] for r in mixed)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*library.encode(t).ids, 0] for i, t in text.items()}
    assert sum(p.length for p in packed) == sum(len(ids[r.doc_id]) for r in mixed)
    whole = entry.queries()["pipeline"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, packed))
