"""Position matching against plain loops: best of all lines by price and quantity, words inside words."""

import random
import time
from decimal import Decimal

from costproof import fixed_values as fx
from costproof.operators import positions

OFFER = "project_id bigint, group_seq bigint, line_seq bigint, pos string, artikelnummer string, description string, qty decimal(12,3), line_total_net decimal(18,2), optional boolean"
BILL = "project_id bigint, group_seq bigint, invoice_id bigint, pos_seq bigint, pos string, description string, qty decimal(12,3), line_total_net decimal(18,2)"


def price(offer, billed):
    if offer == 0 or billed is None:
        return Decimal(0)
    off = abs(billed - offer) / abs(offer)
    best = max(Decimal(0), 1 - 2 * off) if off <= Decimal("0.5") else Decimal(0)
    if 0 < billed < offer and any(abs(billed / offer - Decimal(f)) < Decimal("0.01") for f in fx.CLEAN_FRACTIONS):
        best = max(best, Decimal("0.6"))
    return best


def test_best_of_all_lines(spark):
    """No line shares a word with another: what is left is price and quantity over the whole group."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(9))
    amounts = ["0.00", "0.01", "100.00", "100.01", "200.00", "333.33", "-50.00", "-80.00", "1000.00", "15.55"]
    amount = lambda: Decimal(rng.choice(amounts)) if rng.random() < 0.4 else Decimal(rng.randrange(-20000, 90000)) / 100
    quantity = lambda: rng.choice([None, Decimal("1.000"), Decimal("2.500"), Decimal(rng.randrange(9))])
    offers = [(1, g, k, str(k), None, word(), quantity(), amount(), False) for g in range(3) for k in range((0, 7, 90)[g])]
    billed = [(1, g, k, 0, str(k), word(), quantity(), amount() if rng.random() < 0.95 else None) for g in range(3) for k in range(80)]
    got = {(r.group_seq, r.invoice_id): r for r in positions.propose_matches(spark.createDataFrame(offers, OFFER), spark.createDataFrame(billed, BILL)).collect()}
    assert len(got) == len(billed)
    for _, g, k, _, _, _, q, x in billed:
        scores = [price(o[7], x) * Decimal("0.25") + (Decimal("0.1") if q is not None and o[6] == q else 0) for o in offers if o[1] == g]
        r = got[g, k]
        assert (r.confidence, r.line_seq) == ("none", None) and abs(r.score - max(scores, default=Decimal(0))) < Decimal("0.00000001")
        assert (r.signals is None) == (not scores) and (not scores or abs(sum(r.signals, Decimal(0)) - r.score) < Decimal("0.00000001"))


def test_words_inside_words(spark):
    rng = random.Random(32)
    words = ["dach", "dachrinne", "rinne", "kupferdachrinne", "tür", "türzarge", "zarge", "a.+b", "xa.+by", "ab\ncd", "zab\ncdz", "aaaa", "aaaaaaa", *{"".join(rng.choice("ab") for _ in range(rng.randint(3, 9))) for _ in range(60)}]
    left, right = words[::2] + words[:13], words[1::2] + words[:13]
    df = lambda ws, c: spark.createDataFrame([([w],) for w in ws], f"{c} array<string>")
    got = sorted(map(tuple, positions._related_words(df(left, "o_tokens"), df(right, "i_tokens")).collect()))
    assert got == sorted({(a, b) for a in left for b in right if a == b or (len(a) >= 4 and len(b) >= 4 and (a in b or b in a))})
    long = ["".join(rng.choice("abcdefghij") for _ in range(10_000)) for _ in range(20)]
    start = time.time()
    found = positions._related_words(df(long, "o_tokens"), df([w[5000:5012] for w in long], "i_tokens")).collect()
    assert len(found) == 20 and time.time() - start < 60


def test_small_groups_need_no_runs_of_prices(spark, monkeypatch):
    """All pairs of a small group are compared where they meet; only crowded groups sort their prices."""
    def fail(*_):
        raise AssertionError("sorted")

    monkeypatch.setattr(positions, "_price_and_quantity", fail)
    offers = spark.sql("select 1L as project_id, 1L as group_seq, id as line_seq, '1' as pos, cast(null as string) as artikelnummer, 'Pumpe' as description, cast(1 as decimal(18,2)) as qty, cast(100 + id as decimal(18,2)) as line_total_net, false as optional from range(3)")
    billed = spark.sql("select 1L as project_id, 1L as group_seq, 7L as invoice_id, 1L as pos_seq, '1' as pos, 'Rohr' as description, cast(1 as decimal(18,2)) as qty, cast(101 as decimal(18,2)) as line_total_net")
    row = positions.propose_matches(offers, billed).first()
    assert row.confidence == "none" and float(row.score) == 0.35 and row.line_seq is None
