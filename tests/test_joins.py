"""What a join brings to the driver, and queries against their oracles on the smallest tables."""

from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from catalog.domain import GIVEN, load
from catalog.queries_matching import sixth
from costproof.operators import duplicates, layout, matching, positions, quality
from costproof.sources import einvoice

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="tables not present")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def norm(v):
        return str(v.normalize() + 0) if isinstance(v, Decimal) else (v if v is None else str(v))

    return Counter(tuple(norm(r[i]) for i in order) for r in data)


def against_oracle(spark, name, sf_dir=SF):
    con = duckdb.connect()
    for t in GIVEN:
        con.execute(f"create view {t} as select * from '{sf_dir if (Path(sf_dir) / f'{t}.parquet').exists() else SF}/{t}.parquet'")
    df = entry.queries()[name](spark, str(sf_dir))
    rel = con.execute(entry.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in rel.description], rel.fetchall())


def test_numbers_similar(spark):
    against_oracle(spark, "numbers_similar")


def test_blocks_stay_off_the_driver(spark):
    """Offer blocks are made by explode, so Spark takes them for as small as their customers, also where they are many."""
    blocks = load(spark, SF, "vendor_blocks")
    invoices = spark.sql("select id as project_id, 'Müller Elektro GmbH' as vendor_name, cast(1 as decimal(18,2)) as net_total from range(5)")
    frames = [invoices.join(blocks, "project_id"), matching.match_totals_to_blocks(invoices, blocks),
              matching.statement_fallback(matching.match_vendor(invoices, blocks), blocks)]
    for df in frames:
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("name", ["match_vendor", "vendor_overlap", "group_offer_blocks", "match_totals_to_blocks", "advance_chain_check"])
def test_against_oracle(spark, name):
    against_oracle(spark, name)


def test_sixth_decimal(spark):
    """Halves at the seventh decimal of scores."""
    values = [Decimal("0.105265500"), Decimal("0.125032500"), Decimal("0.064161500"), Decimal("0.255265500"), Decimal("0.350000000"), Decimal("0.000000500")]
    df = spark.createDataFrame([(v,) for v in values], "v decimal(12,9)").select("v", sixth(F.col("v")).alias("r"))
    con = duckdb.connect()
    assert {r.v: r.r for r in df.collect()} == {v: con.execute(f"select round(cast({v} as decimal(12,9))::double, 6)").fetchone()[0] for v in values}


@pytest.mark.parametrize("bound", [0, 30, positions.GROUP_PAIRS])
def test_pairs_in_group_and_by_word(spark, monkeypatch, bound):
    """Small and crowded groups are scored alike."""
    monkeypatch.setattr(positions, "GROUP_PAIRS", bound)
    against_oracle(spark, "score_positions")


def test_documents_are_parsed_once(spark):
    """A filter on parsed fields does not repeat the parser."""
    docs = spark.createDataFrame([(1, "<a/>"), (2, None)], "doc_id bigint, xml string")
    for df in einvoice.read_cii_invoices(docs):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_xml") == 1
    assert [r.doc_id for r in einvoice.read_cii_invoices(docs)[2].orderBy("doc_id").collect()] == [1, 2]


@pytest.mark.parametrize("name", ["cii_invoices", "cii_positions", "cii_rejected"])
def test_invoices_against_oracle(spark, name):
    against_oracle(spark, name)


def test_printed_lines_are_sorted_once(spark):
    """Texts are dealt before they are taken apart, and all carries use one order of their lines."""
    docs = spark.createDataFrame([(1, "SOLL: Müller Angebot 1 vom 01.02.1996\n1 Anlage  1,00 €  1,00 €  0,00 €")], "doc_id bigint, text string")
    for df in (layout.positions_from_layout_lines(docs), layout.blocks_from_layout_lines(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()  # one sort of lines, one of blocks or positions
        assert plan.count("Sort [doc_id") <= 2 and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["blocks_from_layout_lines", "positions_from_layout_lines"])
def test_printed_sheets_against_oracle(spark, name):
    against_oracle(spark, name)


def test_sheets_without_a_total(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"copy (select * replace (case when c_custkey % 5 = 0 then 0 else c_acctbal end as c_acctbal) from '{SF}/customer.parquet') to '{tmp_path}/customer.parquet' (format parquet)")
    against_oracle(spark, "blocks_from_layout_lines", tmp_path)


@pytest.mark.parametrize("bound", [0, 30, quality.DOCUMENT_PAIRS])
def test_items_in_document_and_by_word(spark, monkeypatch, bound):
    """Small and crowded documents are paired alike."""
    monkeypatch.setattr(quality, "DOCUMENT_PAIRS", bound)
    against_oracle(spark, "pair_line_items")


@pytest.mark.parametrize("rows_of_block", [0, 2, duplicates.BLOCK_ROWS])
def test_duplicates_in_block_and_by_key(spark, monkeypatch, rows_of_block):
    """Small and crowded blocks are judged alike."""
    monkeypatch.setattr(duplicates, "BLOCK_ROWS", rows_of_block)
    against_oracle(spark, "flag_duplicates")
