"""Position matching without pairs that are sorted or kept, against plain loops."""

import random
from decimal import ROUND_HALF_UP, Decimal

from costproof.operators import positions
from tests.test_positions import BILL, OFFER, price


def _tables(spark, wide=0):
    rng = random.Random(41)
    words = ["dach", "dachrinne", "rinne", "kupferdachrinne", "rohr", "abc", "abcd", "tor", "motor", "x12", "x1234", "brand", "pumpe", "pumpen", "wand", "leiter"]
    text = lambda: rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(1, 12))) + rng.choice(["", " T-77.1", " AB-1234"])])
    money = lambda: rng.choice([None, Decimal("0.00"), Decimal("100.00"), Decimal("33.33"), Decimal("-80.00"), Decimal(rng.randrange(1, 30000)) / 100, Decimal(f"{10**15}.01")])
    amount = lambda: rng.choice([None, Decimal("1.000"), Decimal(rng.randrange(4))])
    offers = [(g % 3, g, rng.choice([k, k + wide]), str(k), None, text(), amount(), money(), False) for g in range(8) for k in range(2 * g)]
    billed = [(g and g % 3, g, rng.choice([None, k]), 1, str(k), text(), amount(), money()) for g in [None, *range(9)] for k in range(25)]
    return spark.createDataFrame(offers, OFFER), spark.createDataFrame(billed, BILL)


def _found(a, b):
    return sum(any(t == u or (min(len(t), len(u)) >= 4 and (t in u or u in t)) for u in b) for t in a)


def _rounded(x, n):
    return x.quantize(Decimal(1).scaleb(-n), ROUND_HALF_UP)


def _signals(o, i):
    a, b = o.o_tokens, i.i_tokens
    words = Decimal(0)
    if a and b:
        words = (_rounded(Decimal(_found(a, b)) / len(a), 11) + _rounded(Decimal(_found(b, a)) / len(b), 11)) / 2
    near = _rounded(price(o.o_price, i.i_price), 12)
    return (Decimal("0.35") if set(o.o_articles or ()) & set(i.i_articles or ()) else Decimal(0), _rounded(words * Decimal("0.3"), 9), _rounded(near * Decimal("0.25"), 9),
            Decimal("0.1") if i.i_qty is not None and i.i_qty == o.o_qty else Decimal(0))


def test_one_number_against_all_pairs(spark):
    """Words inside words, many words, missing values, copies, and numbers of lines that leave no room in the number."""
    for wide in (0, 3 * 10**18):
        offers, billed = _tables(spark, wide)
        os, is_ = positions._offer_side(offers).collect(), positions._billed_side(billed).collect()
        want = []
        for i in is_:
            pairs = [(sum(s), -o.line_seq, s) for o in os if (o.project_id, o.group_seq) == (i.project_id, i.group_seq) for s in [_signals(o, i)]]
            score, neg, signals = max(pairs, default=(Decimal(0), None, None))
            want.append(repr((i.project_id, i.group_seq, i.invoice_id, -neg if score >= Decimal("0.4") else None, score.quantize(Decimal("1e-9")), signals and [s.quantize(Decimal("1e-9")) for s in signals])))
        got = positions.propose_matches(offers, billed).collect()
        assert sorted(want) == sorted(repr((r.project_id, r.group_seq, r.invoice_id, r.line_seq, r.score, r.signals and list(r.signals))) for r in got)
        assert any(r.confidence == "high" for r in got)


def test_pairs_are_not_sorted(spark):
    """The best pair of a line is found without sorting the pairs, and its two sides are shuffled once."""
    offers, billed = _tables(spark)
    best = positions._best_in_group(*map(positions._dealt, (positions._offer_side(offers), positions._billed_side(billed))))
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Sort [") == 2 and plan.count("Exchange") == 2


def test_lines_are_read_once(spark, tmp_path):
    """What match_lines returns comes from written lines, whatever made them is not run again."""
    offers, billed = _tables(spark)
    for name, df in (("offers", offers), ("billed", billed)):
        df.write.parquet(f"{tmp_path}/{name}")
    offers, billed = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("offers", "billed"))
    groups = spark.createDataFrame([], "project_id bigint, group_seq bigint, group_sonderpreis decimal(18,2)")
    plan = positions.match_lines(offers, billed, groups)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and "Relation [" not in plan
