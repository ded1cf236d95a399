"""The registry, and a sample of registered queries against their oracles on the smallest tables."""

from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from catalog.domain import GIVEN

SF = "/root/testdata/sf0.001"
SAMPLE = ["invoice_position_check", "offer_cross_sum", "cost_table", "classify_documents", "recipient_check", "statement_fallback", "dedupe_invoices",
          "plan_renames", "funding_chain", "section_totals", "blocks_from_rows", "evidence_tally", "job_lists"]


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 120


@pytest.mark.skipif(not Path(SF).exists(), reason="tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_against_oracle(spark, name):
    con = duckdb.connect()
    for t in GIVEN:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")

    def rows(columns, data):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        def norm(v):
            return str(v.normalize() + 0) if isinstance(v, Decimal) else (v if v is None else str(v))
        return Counter(tuple(norm(r[i]) for i in order) for r in data)

    df = entry.queries()[name](spark, SF)
    rel = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, rel.fetchall())
