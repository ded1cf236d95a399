"""Rules whose result depends on list order: cases with stated results, and properties that any result must have."""

import random
from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import Window, functions as F

from costproof import scale
from costproof.operators import duplicates, matching, payments, rounds

INVOICE = "project_id bigint, invoice_id bigint, seq bigint, vendor_name string, invoice_number string, invoice_date date, netto decimal(18,2)"
LINE = "invoice_id bigint, pos_seq bigint, line_total_net decimal(18,2)"


def test_duplicates(spark):
    """Each row: what it is and the verdict it must get; later rows meet only what was booked before them."""
    may = date(2031, 5, 1)
    rows = [
        # seq, vendor, number, date, netto, line totals, verdict, decided by
        (0, "Nordwind Bau GmbH", "4711001", may, "80.00", ["80.00"], "none", None),
        (1, "Nordwind Bau", "X4711001", may, "80.00", ["70.00"], "duplicate", 0),  # number and vendor
        (2, "Nordwind Bau", "4711999", may + timedelta(days=9), "80.00", [], "same-amount", 0),  # vendor alone
        (3, "Ganz Anders AG", "Z-1", may, "80.00", ["80.00"], "duplicate", 0),  # date and lines
        (4, "Ganz Anders AG", "Z-2", may + timedelta(days=30), "80.00", [], "none", None),  # 3 was no booking
        (5, "Ganz Anders AG", "Z-3", may + timedelta(days=60), "80.00", [], "same-amount", 4),
        (6, "Nordwind Bau", "4711001", may, "81.00", ["80.00"], "none", None),  # another amount
        (7, "Nordwind Bau", "4711001", may, "0.00", [], "none", None),
        (8, "Nordwind Bau", "4711001", may, "0.00", [], "none", None),  # nothing to double
    ]
    df = spark.createDataFrame([(1, 100 + r[0], r[0], r[1], r[2], r[3], Decimal(r[4])) for r in rows], INVOICE)
    lines = spark.createDataFrame([(100 + r[0], k, Decimal(x)) for r in rows for k, x in enumerate(r[5])], LINE)
    got = {r.seq: (r.dup_verdict, r.dup_of) for r in duplicates.flag_duplicates(df, lines).collect()}
    assert got == {r[0]: r[6:] for r in rows}


def test_duplicates_hold_together(spark):
    rng = random.Random(11)
    rows = [(p, p * 1000 + k, k, f"Firma {rng.choice(['Ulme', 'Esche', 'Linde'])}", f"{rng.randrange(40):05d}", date(2031, 1, 1 + rng.randrange(4)), Decimal(rng.choice(["10.00", "20.00"])))
            for p in range(4) for k in range(60)]
    found = duplicates.flag_duplicates(spark.createDataFrame(rows, INVOICE), spark.createDataFrame([], LINE)).collect()
    verdict = {(r.project_id, r.seq): (r.dup_verdict, r.dup_of) for r in found}
    amount = {(r[0], r[2]): r[6] for r in rows}
    assert len(verdict) == len(rows)
    for (p, k), (v, of) in verdict.items():
        if v != "none":  # decided by an earlier booked invoice of the same amount
            assert of < k and verdict[p, of][0] != "duplicate" and amount[p, of] == amount[p, k]


def test_first_fit_groups(spark):
    """A block joins the earliest founder it shares a word with, not a later one, and founders only found."""
    labels = ["Ulme Bau", "Esche Technik", "Ulme Technik", "Linde", "Technik Linde", "Linde Holz", "Holz"]
    want = [0, 1, 0, 3, 1, 3, 6]
    rows = [(p, k, x, "SOLL", False, None) for p in (1, 2) for k, x in enumerate(labels)]
    df = spark.createDataFrame(rows, "project_id bigint, block_seq bigint, label string, header string, statement boolean, sonderpreis decimal(18,2)")
    got = {(r.project_id, r.block_seq): r.group_seq for r in matching.group_offer_blocks(df).collect()}
    assert got == {(p, k): g for p in (1, 2) for k, g in enumerate(want)}


INV = ("project_id bigint, invoice_id bigint, seq bigint, vendor_name string, invoice_number string, invoice_date date, brutto decimal(18,2), netto decimal(18,2), "
       "skonto_pct decimal(5,2), cumulative_netto decimal(18,2), mwst_pct decimal(5,2)")
PROOF = "project_id bigint, proof_seq bigint, payee_name string, amount decimal(18,2), payment_date date, verwendungszweck string, source_path string"


def _invoice(k, vendor, number, day, gross, **more):
    return dict(project_id=1, invoice_id=k, seq=k, vendor_name=vendor, invoice_number=number, invoice_date=date(2031, 3, day), brutto=Decimal(gross), netto=Decimal(gross),
                skonto_pct=None, cumulative_netto=None, mwst_pct=None) | more


def _proof(k, payee, amount, text=None):
    return dict(project_id=1, proof_seq=k, payee_name=payee, amount=amount and Decimal(amount), payment_date=date(2031, 4, 1), verwendungszweck=text, source_path=f"p{k}")


def test_payments(spark):
    invoices = [
        _invoice(1, "Ulme Bau GmbH", "A-1001", 1, "100.00"), _invoice(2, "Ulme Bau", "A-1002", 2, "100.01"),  # two cents of tolerance, in order
        _invoice(3, "Ulme Bau", "A-1003", 3, "100.00"),  # nothing left
        _invoice(4, "Esche AG", "B-2001", 4, "200.00", skonto_pct=Decimal("3.00")),  # 194.00 after discount
        _invoice(5, "Linde", "C-3001", 5, "300.00"),  # named in the text only, other amount
        _invoice(6, "Holz KG", "D-4001", 6, "90.00", cumulative_netto=Decimal("150.00")),  # two payments reach the running total
        _invoice(7, "Holz KG", "D-4002", 7, "60.00"),  # its proofs went with the running total
    ]
    proofs = [_proof(1, "Ulme Bau", "100.00"), _proof(2, "Ulme", "100.01"), _proof(3, "Esche", "194.03"), _proof(4, None, "250.00", "Zahlung C/3001"), _proof(5, "Holz", "90.02"), _proof(6, "Holz", "60.01"),
              _proof(7, "Fremd", "300.00"), _proof(8, "Esche", None)]
    proofs[4]["amount"], proofs[5]["amount"] = Decimal("95.00"), Decimal("55.00")
    rows, uses = payments.reconcile_payments(spark.createDataFrame(invoices, INV), spark.createDataFrame(proofs, PROOF))
    assert {r.invoice_id: (r.status, r.bezahlt) for r in rows.collect()} == {
        1: ("paid", Decimal("100.00")), 2: ("paid", Decimal("100.01")), 3: ("no_proof", None), 4: ("paid_skonto", Decimal("194.03")), 5: ("amount_mismatch", Decimal("250.00")),
        6: ("paid", Decimal("150.00")), 7: ("no_proof", None)}
    assert sorted((u.invoice_id, u.proof_seq) for u in uses.collect()) == [(1, 1), (2, 2), (4, 3), (5, 4), (6, 5), (6, 6)]


def test_payments_hold_together(spark):
    """No proof serves twice, and no invoice is left open while an exact proof of its vendor is free."""
    rng = random.Random(5)
    invoices = [_invoice(k, rng.choice(["Ulme Bau", "Esche"]), f"R-{k:04d}", 1 + k % 28, rng.choice(["50.00", "70.00", "90.00"])) for k in range(40)]
    proofs = [_proof(k, rng.choice(["Ulme", "Esche AG"]), rng.choice(["50.00", "70.00", "90.00"])) for k in range(30)]
    rows, uses = payments.reconcile_payments(spark.createDataFrame(invoices, INV), spark.createDataFrame(proofs, PROOF))
    used = [u.proof_seq for u in uses.collect()]
    assert len(used) == len(set(used)) and len(used) > 20
    unpaid = {r.invoice_id for r in rows.where("status = 'no_proof'").collect()}
    free = {(p["payee_name"].split()[0], p["amount"]) for p in proofs if p["proof_seq"] not in used}
    assert not any((i["vendor_name"].split()[0], i["brutto"]) in free for i in invoices if i["invoice_id"] in unpaid)


def test_equal_instalments_settle_at_once(spark):
    """Many equal instalments of one vendor: the r-th invoice takes the r-th proof."""
    n = 300
    base = date(2025, 1, 1)
    invoices = [dict(project_id=1, invoice_id=k, seq=k, vendor_name="Müller Bau GmbH", invoice_number=f"RE-{k:05d}", invoice_date=base + timedelta(days=k),
                     brutto=Decimal("100.00"), netto=Decimal("100.00"), skonto_pct=None, cumulative_netto=None, mwst_pct=None) for k in range(n)]
    proofs = [dict(project_id=1, proof_seq=k, payee_name=("Mueller Bau" if k % 2 else "Müller Bau KG"), amount=Decimal("100.00"), payment_date=base,
                   verwendungszweck=f"RE-{n - 1 - k:05d}", source_path="x") for k in range(n)]
    rows, uses = payments.reconcile_payments(spark.createDataFrame(invoices, INV), spark.createDataFrame(proofs, PROOF))
    assert {(u.invoice_id, u.proof_seq) for u in uses.collect()} == {(k, k) for k in range(n)}
    assert rows.where("status = 'paid'").count() == n


def test_rank_by_index_matches_window(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.choice(["a", "b", None]), i * 7) for i in range(500)], "k string, i bigint")
    ranked = scale.rank_by_index(df, ["k"], "i", bits=5)
    plain = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("i")).cast("bigint"))
    assert sorted(map(tuple, ranked.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    by_order = scale.rank_within(df, ["k"], [F.col("i").desc()])
    back = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(F.col("i").desc())).cast("bigint"))
    assert sorted(map(tuple, by_order.collect()), key=str) == sorted(map(tuple, back.collect()), key=str)


def test_running_last(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i % 2, i, rng.random() < 0.05) for i in range(600)], "k int, i bigint, m boolean")
    got = scale.running_last(df, ["k"], "i", F.col("m"), "head", bits=4)
    want = df.withColumn("head", F.last(F.when(F.col("m"), F.col("i")), ignorenulls=True).over(Window.partitionBy("k").orderBy("i")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def _serial_payments(invoices, proofs):
    """{invoice_id: (kind, used proofs)} by the stated rule, one invoice after the other."""
    words = lambda name: {w for w in (name or "").lower().split() if w not in ("gmbh", "ag", "kg")}
    plain = lambda t: "".join(c for c in (t or "").lower() if c.isalnum())
    used, out = set(), {}
    for i in sorted(invoices, key=lambda i: (i["project_id"], i["invoice_date"], i["invoice_number"], i["seq"])):
        number = plain(i["invoice_number"])
        names = lambda p, n=number: len(n) >= 4 and n in plain(p["verwendungszweck"])
        left = [p for p in proofs if p["project_id"] == i["project_id"] and (p["project_id"], p["proof_seq"]) not in used and (words(p["payee_name"]) & words(i["vendor_name"]) or names(p))]
        less = i["skonto_pct"] is not None and i["brutto"] * (100 - i["skonto_pct"]) / 100
        exact = [p for p in left if p["amount"] is not None and abs(p["amount"] - i["brutto"]) <= Decimal("0.02")]
        reduced = [p for p in left if i["skonto_pct"] is not None and p["amount"] is not None and abs(p["amount"] - less) <= Decimal("0.05")]
        tied = [p for p in left if names(p)]
        takes, kind = (exact[:1] or reduced[:1]), "one"
        if not takes and i["cumulative_netto"] is not None and len(left) >= 2:
            takes, kind = left, "sum"
        takes = takes or tied[:1]
        used |= {(p["project_id"], p["proof_seq"]) for p in takes}
        out[i["invoice_id"]] = (kind if takes else "none", sorted(p["proof_seq"] for p in takes))
    return out


def test_payments_in_any_entanglement(spark):
    rng = random.Random(21)
    invoices, proofs = [], []
    for k in range(240):
        more = {"project_id": 1 + k % 3}
        if rng.random() < 0.2:
            more["skonto_pct"] = Decimal(rng.choice(["2.00", "3.00"]))
        if rng.random() < 0.08:
            more["cumulative_netto"] = Decimal("400.00")
        amount = rng.choice(["100.00", "100.01", "100.02", "100.03", "97.00", "97.04", "55.00"])
        invoices.append(_invoice(k, rng.choice(["Ulmenhof Birkner", "Eschenwald GmbH", "Lindenau Holzmann", "Holzmann KG", "Einsamer"]), f"RE-{rng.randrange(90):04d}", 1 + rng.randrange(28), amount, **more))
    for k in range(200):
        text = f"Rechnung RE/{rng.randrange(90):04d} und RE{rng.randrange(90):04d}" if rng.random() < 0.3 else None
        amount = rng.choice([None, "100.00", "100.01", "100.03", "97.00", "97.02", "98.01", "55.00", "12.00"])
        proofs.append(_proof(k, rng.choice(["Ulmenhof", "Birkner", "Eschenwald AG", "Lindenau", "Holzmann", None, "Fremdling"]), amount, text) | {"project_id": 1 + k % 3})
    rows, uses = payments.reconcile_payments(spark.createDataFrame(invoices, INV), spark.createDataFrame(proofs, PROOF))
    got = {r.invoice_id: ("none", []) for r in rows.collect()}
    for u in uses.collect():
        got[u.invoice_id] = (u.kind, sorted([*got[u.invoice_id][1], u.proof_seq]))
    want = _serial_payments(invoices, proofs)
    assert got == want and {k for k, _ in want.values()} == {"none", "one", "sum"}


def test_alternating_instalments_need_no_more_rounds(spark):
    """Amounts a cent apart in alternation: as many checkpoints for 200 as for 8."""
    def checkpoints(n):
        base = date(2025, 1, 1)
        invoices = [_invoice(k, "Ulme Bau", f"RE-{k:05d}", 1, ("100.00", "100.01")[k % 2]) | {"invoice_date": base + timedelta(days=k)} for k in range(n)]
        proofs = [_proof(k, "Ulme", ("100.01", "100.00")[k % 2]) for k in range(n)]
        made, plain = [0], payments.materialize

        def counted(df):
            made[0] += 1
            return plain(df)

        for module in (payments, rounds):
            module.materialize = counted
        try:
            _, uses = payments.reconcile_payments(spark.createDataFrame(invoices, INV), spark.createDataFrame(proofs, PROOF))
        finally:
            for module in (payments, rounds):
                module.materialize = plain
        assert {(u.invoice_id, u.proof_seq) for u in uses.collect()} == {(k, k) for k in range(n)}
        return made[0]

    assert checkpoints(8) == checkpoints(200)


def test_connected(spark):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(70)] + [(500, 500 + k) for k in range(1, 40)] + [(900, 900)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(90)]
    got = {r.node: r.root for r in rounds.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {n: n for e in edges for n in e}
    for _ in parent:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent
    assert rounds.connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_of_small_projects_are_labelled_in_one_pass(spark, monkeypatch):
    pairs = [(1, 1, 10, 1, True), (1, 2, 10, 2, True), (1, 3, 11, None, True), (1, 4, 12, 1, True), (1, 4, 13, 1, True), (1, 5, 13, 1, True), (2, 1, 10, 1, True), (2, 2, 11, 1, False), (2, 3, -5, 3, True), (2, 2, -5, 1, True)]
    df = spark.createDataFrame(pairs, "project_id long, cls long, q long, tier int, payee boolean").repartition(3).localCheckpoint()

    def found():
        rows = payments._components(df).collect()
        groups = {}
        for r in rows:
            groups.setdefault((r.component, r.alike), set()).add((r.project_id, r.cls, r.q, r.tier, r.payee))
        return sorted((sorted(map(str, v)), k[1]) for k, v in groups.items())

    jobs = []
    monkeypatch.setattr(payments, "connected", lambda edges, rounds=payments.connected: jobs.append(1) or rounds(edges))
    once = found()
    assert jobs == [] and [a for _, a in once].count(True) == 2 and len(once) == 5
    monkeypatch.setattr(payments, "PROJECT_PAIRS", 4)
    assert found() == once and jobs == [1]


def test_amounts_at_the_edges_of_a_step_still_meet(spark):
    kind = "project_id long, cls long, vendor string, target decimal(18,2), discounted decimal(18,4)"
    classes = spark.createDataFrame([(1, c, "v", Decimal(c) / 100, Decimal(c) / 100 - 3) for c in range(-20, 20)], kind)
    links = spark.createDataFrame([(1, "v", "p")], "project_id long, vendor string, payee string")
    proofs = spark.createDataFrame([(1, q, "p", Decimal(q) / 100) for q in range(-330, 30)], "project_id long, q long, payee string, amount decimal(18,2)")
    got = {(r.cls, r.q): r.tier for r in payments._class_edges(classes, links, proofs).collect()}
    assert got == {(c, q): 1 if abs(c - q) <= 2 else 2 for c in range(-20, 20) for q in range(-330, 30) if abs(c - q) <= 2 or abs(c - 300 - q) <= 5}
