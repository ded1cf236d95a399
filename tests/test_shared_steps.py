"""Steps that many queries share: read once, dealt out, and cheap per row."""

from __future__ import annotations

import unicodedata
from decimal import Decimal

from pyspark.sql import functions as F

from catalog import all_queries
from catalog.domain import TABLES, load
from costproof.functions.german import strip
from costproof.functions.text import loose
from costproof.operators import privacy, quality
from costproof.sources import readers

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_unions_of_one_table_are_read_once_and_equal_their_sql(spark):
    for name, source in (("evidence_fields", "invoices"), ("invoice_pages", "invoices"), ("letter_pages", "approval_letters")):
        got, table = load(spark, SF, name, source)
        want = spark.sql(TABLES[name], **{source: table})
        assert "Union" not in _plan(got)
        assert got.schema.simpleString() == want.schema.simpleString()
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty(), name


def test_evidence_reads_its_table_a_bounded_number_of_times(spark):
    for name in ("ground_evidence", "describe_evidence", "evidence_tally", "evidence_flags", "adjudicate_second_reading"):
        assert 0 < _plan(all_queries()[0][name](spark, SF)).count("Relation [l_orderkey") <= 8, name


def test_intake_forms_are_dealt_out(spark):
    assert "RepartitionByExpression" in _plan(all_queries()[0]["parse_intake_forms"](spark, SF))


def test_strip_and_loose_keep_their_rules(spark):
    white = [chr(c) for c in range(0x3100) if unicodedata.category(chr(c)) in ("Zs", "Zl", "Zp") or c in (*range(9, 14), 0x85)]
    texts = [f"{w}a{w}b{w}{w}" for w in white] + ["", " ", "\u200ba", "a\n", " \r\n", "Äö ß-É.x_1", "--"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    rows = df.select(strip(F.col("t")).alias("s"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("s2"), loose(F.col("t")).alias("l"),
                     F.trim(F.regexp_replace(F.lower("t"), r"[^a-z0-9äöüß]+", " ")).alias("l2")).collect()
    assert all(r.s == r.s2 and r.l == r.l2 for r in rows)


def test_texts_without_a_hit_are_not_scanned_again(spark):
    projects = spark.createDataFrame([(1, "Krause Metallbau GmbH", "Ringstr. 5, 54321 Musterau")], "project_id long, client_name string, client_address string")
    pages = spark.createDataFrame([(1, 1, 1, "nichts"), (1, 2, 1, "An Krause Metallbau GmbH, Ringstr. 5, 54321 Musterau"), (1, 3, 1, None)], "project_id long, doc_id long, page_no int, text string")
    df = privacy.mask_client(pages, projects)
    assert [tuple(r)[3:] for r in df.orderBy("doc_id").collect()] == [("nichts", 0, 0), ("An [KUNDE], [KUNDENADRESSE]", 1, 1), (None, None, None)]
    assert _plan(df).count("> 0) THEN regexp_replace") == 3


def test_unions_with_conditions_and_new_keys_are_read_once_and_equal_their_sql(spark):
    for name, source in (("payment_proofs", "invoices"), ("invoice_scans", "invoices"), ("scan_positions", "invoice_positions")):
        got, table = load(spark, SF, name, source)
        want = spark.sql(TABLES[name], **{source: table})
        assert "Union" not in _plan(got)
        assert got.schema.simpleString() == want.schema.simpleString()
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty(), name


def test_a_record_is_parsed_once(spark):
    for name in ("extracted_documents", "extracted_positions", "rejected_extractions"):
        assert _plan(all_queries()[0][name](spark, SF)).count("from_json") == 1, name
    lines = spark.createDataFrame([('{"invoice_id": 1, "vendor_name": "A"}',), ('{"invoice_id": 2',), (None,)], "value string")
    rows = readers.parse_extractions(lines, "invoice").select("invoice_id", "_corrupt").collect()
    assert sorted((tuple(r) for r in rows if r.invoice_id == 1 or r._corrupt), key=str) == [(1, None), (rows[1].invoice_id, '{"invoice_id": 2')] and len(rows) == 3


def test_names_are_taken_apart_after_dealing_out(spark):
    assert "RepartitionByExpression" in _plan(all_queries()[0]["fix_vendor_is_recipient"](spark, SF))


def test_sheets_are_compared_in_one_reading_of_each_side(spark):
    for name in ("diff_cost_tables", "correction_lines"):
        assert _plan(all_queries()[0][name](spark, SF)).count("Relation [l_orderkey") <= 4, name
    kind = "sheet_id long, block string, seq long, pos string, description string, gesamt decimal(18,2), investitionskosten decimal(18,2), nebenkosten decimal(18,2)"
    row = lambda sheet, block, seq, pos, text, total=1: (sheet, block, seq, pos, text, Decimal(total), None, None)
    old = [row(1, "A", 1, "1", "x"), row(1, "A", 2, "1", "x"), row(1, "A", 3, None, " Y "), row(1, "A", 4, None, None), row(1, None, 5, "1", "n"), row(2, "B", 1, "1", "x")]
    new = [row(1, "A", 1, "1", "first"), row(1, "A", 2, "1", "x", 2), row(1, "A", 3, " ", "y"), row(1, "A", 9, None, None), row(1, None, 5, "1", "n"), row(2, "C", 1, "1", "x")]
    got = quality.diff_cost_tables(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind))
    assert got.columns == ["sheet_id", "block", "scope", "pos", "field", "original", "corrected"]
    edit = (1, "A", "position-field", "1", "gesamt", "1.00", "2.00")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([
        edit, edit, (1, "A", "position-field", None, "description", " Y ", "y"),
        (1, "A", "position-removed", None, None, None, None), (1, "A", "position-added", None, None, None, None),
        (1, None, "block-removed", None, None, None, None), (1, None, "block-added", None, None, None, None),
        (2, "B", "block-removed", None, None, None, None), (2, "C", "block-added", None, None, None, None)], key=str)


def test_client_words_meet_page_words_without_joining_them(spark):
    assert _plan(all_queries()[0]["recipient_present"](spark, SF)).count("Relation [l_orderkey") == 1
    projects = spark.createDataFrame([(1, "Krause Kunststofftechnik GmbH", None), (2, None, None)], "project_id long, client_name string, client_address string")
    pages = spark.createDataFrame([(1, 1, "Krausa"), (1, 1, "Kunststofftechnyck"), (1, 2, "Krause Kunststoftechnic"), (1, 3, "Krause"), (1, 4, None), (2, 5, "x")],
                                  "project_id long, doc_id long, text string")
    rows = privacy.recipient_present(pages, projects).collect()
    assert {r.doc_id: (r.recipient_found, r.address_found) for r in rows} == {1: (True, None), 2: (True, None), 3: (False, None), 4: (False, None), 5: (False, None)}
