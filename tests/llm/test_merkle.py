"""The manifest against a plain version: ties, nulls, repeated rows, one document, small fan-outs, no rows."""

import hashlib
import zlib

import pytest

from costproof.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, idx long, digest string, height int"


def frame(spark, rows):
    """Documents with columns that clash with the operator's own names."""
    return spark.createDataFrame([(*r, "t", 3, "d", 9) for r in rows], SCHEMA)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes, fanout):
    """(root, for each node its steps as (left, right)) of a list of digests."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for k, i in enumerate(at):
            run, slot = runs[i // fanout], i % fanout
            steps[k].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            at[k] = i // fanout
        nodes = [h(*run) for run in runs]
    return nodes[0], steps


def plain(rows, fanout=16):
    """Sorted result rows."""
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append(row)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    inner = {name: climb([leaf(r) for r in trees[name]], fanout) for name in names}
    root, outer = climb([inner[name][0] for name in names], fanout)
    out = []
    for name, above in zip(names, outer, strict=True):
        for row, steps in zip(trees[name], inner[name][1], strict=True):
            steps = [*steps, *above]
            text = row[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            back = leaf((*row[:4], text))
            for left, right in steps:
                back = h(left, back, right)
            out.append((row[0], leaf(row), inner[name][0], root, h(*[a + b for a, b in steps]), back, back == root))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    out = [(i, "hot", "en", i * 3, f"Text {i} É" * (i % 4)) for i in range(0, 600, 2)]
    out += [(i, "s%d" % (i % 19), None if i % 3 else "de", None if i % 7 == 0 else i, None if i % 11 == 0 else f"ÄB{i}") for i in range(1, 120)]
    out += [(4, None, None, None, None), (5, None, "x", 1, ""), (6, "", "x", 1, "A\n"), (None, "hot", "en", 1, "Nothing"), (10, "hot", "en", 30, "Other"), (10, "hot", "en", 30, "Other"),
            (7, "ü", "-", 1, "x" * 5000 + "Y"), (8, "-", "-", 1, "Q"), (9, "=", "-", 1, "Q")]
    return out


@pytest.mark.parametrize("fanout", [16, 2])
def test_manifest(spark, rows, fanout):
    got = merkle.manifest(frame(spark, rows), merkle.every_fifth_lowered(), fanout).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, fanout)
    assert 0 < sum(not r.verified for r in got) < len(got) / 3


def test_single_and_untampered(spark, rows):
    one = merkle.manifest(frame(spark, rows[:1])).collect()
    assert tuple(one[0]) == (rows[0][0], *[leaf(rows[0])] * 3, h(""), leaf(rows[0]), True)
    assert all(r.verified for r in merkle.manifest(frame(spark, rows[:40])).collect())
    assert merkle.manifest(frame(spark, []), merkle.every_fifth_lowered()).count() == 0
