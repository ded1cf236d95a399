"""Lockouts folded range by range against the gate itself, attempt after attempt."""

import random

from costproof.operators import events


def gate(rows, now=float("inf"), window=100.0, lock=60.0):
    """({(address, locked_at)}, {address: attempts left})"""
    locks, state = set(), {}
    for address, ts, ok in sorted(rows):
        hits, until = state.get(address, ([], float("-inf")))
        if ts > now:
            continue
        if ts < until:
            state[address] = hits, until
        elif ok:
            state[address] = [], float("-inf")
        else:
            hits = [h for h in hits if ts - h < window] + [ts]
            if len(hits) >= 5:
                locks.add((address, ts))
                hits, until = [], ts + lock
            state[address] = hits, until
    return locks, {a: max(0, 5 - len([h for h in hits if now - h < window])) for a, (hits, _) in state.items()}


def test_ranges_of_one_address(spark, monkeypatch):
    monkeypatch.setattr(events, "RANGE_BITS", 4)
    rng = random.Random(41)
    rows, at = [], {}
    for k in range(1500):
        a = "hot" if k % 3 else f"a{rng.randrange(12)}"
        at[a] = at.get(a, 0.0) + rng.choice([0.0, 1.0, 5.0, 9.0, 30.0, 250.0 if rng.random() < 0.1 else 2.0])
        rows.append((a, at[a], rng.random() < 0.05))
    rows += [("steady", 3.0 * k, False) for k in range(300)]  # locked again and again, no success in between
    df = spark.createDataFrame(rows, "address string, ts double, ok boolean")
    got = {(r.address, r.locked_at) for r in events.lockouts(df, window=100.0, lock=60.0).collect()}
    assert got == gate(rows)[0] and len(got) > 50
    for now in (40.0, 700.0, 5000.0):
        left = {r.address: r.attempts_left for r in events.attempts_left(df, now, window=100.0, lock=60.0).collect()}
        assert left == gate(rows, now)[1]
