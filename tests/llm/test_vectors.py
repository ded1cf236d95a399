"""Embedding near-duplicates against brute force: links, components, odd rows, recall."""

import numpy as np

from costproof.llm import quantised
from costproof.llm.components import components
from tests.llm import plain

SCHEMA = "vec_id long, embedding array<double>, label int, key string, list int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], g, "k", 1) for i, v, g in rows], SCHEMA)


def brute(rows, least=0.93):
    ok = {i: (np.array(v, float), g) for i, v, g in rows if v is not None and g is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(ok)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0])
             and ok[a][0] @ ok[b][0] / (np.linalg.norm(ok[a][0]) * np.linalg.norm(ok[b][0])) >= least]
    found = plain.component_ids([i for i, *_ in rows], links)
    return {i: (sum(i in x for x in links), found[i]) for i, *_ in rows}


def test_near_vectors(spark):
    r = np.random.default_rng(3)
    rows, at = [], 0
    for label in range(3):
        for _ in range(60):
            base = r.normal(size=24)
            for k in range(r.integers(1, 5)):
                rows.append((at, list(base + r.normal(size=24) * [0, 0.1, 0.3, 0.5][k]), label))
                at += 1
    hot = r.normal(size=24)
    rows += [(at + k, list(hot + r.normal(size=24) * 0.2), 1) for k in range(150)] + [(at + 150 + k, list(hot), 1) for k in range(40)]
    at += 200
    odd = [(at, None, 1), (at + 1, [0.0] * 24, 1), (at + 2, [None, *hot[1:]], 1), (at + 3, [float("nan"), *hot[1:]], 1), (at + 4, [float("inf"), *hot[1:]], 1),
           (at + 5, list(hot), None), (at + 6, [], 1), (at + 7, list(hot * 3), 1), (at + 8, list(hot), 2)]
    want = brute(rows + odd)
    got = {x.vec_id: x for x in quantised.near_vectors(frame(spark, rows + odd)).collect()}
    assert len(got) == len(rows + odd)
    links, true = sum(x.n_links for x in got.values()), sum(n for n, _ in want.values())
    assert 0.99 * true <= links <= true
    assert np.mean([(got[i].n_links, got[i].component_id) == want[i] for i in want]) > 0.99
    assert all(x.kept == (x.vec_id == x.component_id) for x in got.values())
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in range(at, at + 7))


def test_odd_tables(spark):
    assert quantised.near_vectors(frame(spark, [])).count() == 0
    rows = quantised.near_vectors(frame(spark, [(None, [1, 2], 1), (4, [1, 2], 1), (4, [1, 2], 1), (6, None, None), (7, [1, 2, 3], 1)])).collect()
    assert sorted((x.vec_id or -1, x.n_links, x.component_id, x.kept) for x in rows) == [(-1, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (6, 0, 6, True), (7, 0, 7, True)]


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 50)] + [(300, 301), (301, 300), (302, 302)]
    roots = {x.node: x.root for x in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert len({roots[k] for k in range(61)}) == 1 and len({roots[100 + k] for k in range(50)}) == 1
    assert roots[300] == roots[301] and 302 not in roots and len(set(roots.values())) == 3
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_two_lengths(spark, monkeypatch):
    r = np.random.default_rng(11)
    rows, at = [], 0
    for dims, groups in ((24, 60), (16, 40), (8, 5)):
        for _ in range(groups):
            base = r.normal(size=dims)
            for _ in range(3):
                rows.append((at, list(base + r.normal(size=dims) * 0.15), 1))
                at += 1
    want = brute(rows)
    assert all(any(want[i][0] for i, v, _ in rows if len(v) == d) for d in (24, 16, 8))
    for indexed in (quantised.LENGTHS, 1):  # lengths without an index of their own as well
        monkeypatch.setattr(quantised, "LENGTHS", indexed)
        got = {x.vec_id: (x.n_links, x.component_id) for x in quantised.near_vectors(frame(spark, rows)).collect()}
        assert got == want


def test_differences_along_centroids(spark):
    r = np.random.default_rng(12)
    rows = []
    for i in range(400):  # an arc: the planes between lists cross the only direction in which vectors differ
        t = r.uniform(-1.2, 1.2)
        v = r.normal(size=64) * 0.005
        v[:2] += np.cos(t), np.sin(t)
        rows.append((i, list(v), 1))
    got = {x.vec_id: (x.n_links, x.component_id) for x in quantised.near_vectors(frame(spark, rows)).collect()}
    assert got == brute(rows)
