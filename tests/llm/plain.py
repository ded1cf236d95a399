"""Plain versions of the rules, row by row, for small fixtures."""

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORD.findall((text or "").translate(UPPER))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def component_ids(ids, links):
    reach = {i: i for i in ids}

    def top(i):
        while reach[i] != i:
            i = reach[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        reach[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def near_duplicates(docs):
    """{doc_id: (n_shingles, component_id)} of {doc_id: text}."""
    sets = {i: shingle_set(t) for i, t in docs.items()}
    ids = sorted(docs)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    found = component_ids(ids, links)
    return {i: (len(sets[i]), found[i]) for i in ids}


def statistics(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


_KINDS = [
    (re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 6),
    (re.compile(r"AKIA[A-Z0-9]+"), 0, 20), (re.compile(r"[0-9a-f]+"), 0, 24)]


def secrets(text):
    """(counts of the three kinds, digest of their spans)."""
    spans = sorted((m.start(), k, m.end()) for k, (p, group, least) in enumerate(_KINDS) for m in p.finditer(text or "") if len(m[group]) >= least)
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
    return [sum(x[1] == k for x in spans) for k in range(3)], hashlib.sha256(joined.encode()).hexdigest()


def targets(sizes):
    """{source: (size, target)} of [(source, size)]."""
    total = defaultdict(int)
    for s, n in sizes:
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight, capped, whole = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, set(), sum(total.values())
    while True:
        left = sum(weight[s] for s in order if s not in capped) or 1
        share = (whole - sum(3 * total[s] for s in capped)) / left
        above = {s for s in order if s not in capped and share * weight[s] > 3 * total[s]}
        if not above:
            return {s: (total[s], 3.0 * total[s] if s in capped else share * weight[s]) for s in order}
        capped |= above


_CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_PART = "[A-Za-z0-9+/_=-]"
_WORDS = re.compile(f"(?<!{_PART}){_PART}{{3,15}}(?!{_PART})")
_LONG = re.compile(f"(?<!{_PART}){_PART}{{16,}}")


def base_spans(text):
    return sorted((m.start(), k, m.end()) for k, (p, group, least) in enumerate(_KINDS) for m in p.finditer(text or "") if len(m[group]) >= least)


def long_runs(text):
    """(start, end) of runs of 16 and more identifier characters that touch no hit of the patterns."""
    spans = base_spans(text)
    return [m.span() for m in _LONG.finditer(text or "") if not any(a < m.end() and m.start() < b for a, _, b in spans)]


def _log_chances(counts):
    n, alone = len(_CHARS), Counter()
    for (_, b), x in counts.items():
        alone[b] += x
    whole, rows = sum(alone.values()), defaultdict(float)
    for (a, _), x in counts.items():
        rows[a] += x

    def log(a, b):
        base = (0.9 * alone[b] / whole if whole else 0.9 / n) + 0.1 / n
        return math.log(0.9 * (counts.get((a, b), 0) + 20 * base) / (rows[a] + 20) + 0.1 * base)

    return log


def _count(tokens):
    out = Counter()
    for token, n in tokens:
        for pair in zip(["", *token], token, strict=False):
            out[pair] += n
    return out


def random_runs(texts):
    """For each text the long runs that the self-labelled character models call random."""
    digests = []
    for i in range(2048):
        raw = hashlib.sha256(str(i).encode()).digest()
        text = base64.b64encode(raw).decode()
        bare = re.sub("[+/=]", "", text)
        digests += [raw.hex(), text.replace("=", ""), bare, bare.lower(), bare.upper()]
    digests, common = _count((d, 1) for d in digests), _count((w, 1) for t in texts for w in set(_WORDS.findall(t or "")))
    value = lambda t, a, k, b: next(m for m in _KINDS[k][0].finditer(t) if m.start() == a)[_KINDS[k][1]]
    hits = Counter(x for t in texts for x in {value(t, *s) for s in base_spans(t)})
    runs = Counter(x for t in texts for x in {t[a:b] for a, b in long_runs(t)})
    random, ordinary = _log_chances(digests), _log_chances(common)
    for _ in range(4):
        score = lambda x, r=random, o=ordinary: sum(r(*p) - o(*p) for p in zip(["", *x], x, strict=False) if p[1] in _CHARS)
        found = _count((x, 1) for x in hits if score(x) >= 0)
        share = min(1.0, sum(digests.values()) / max(1.0, sum(found.values())))
        taken = {x for x in runs if len(set(x)) >= 8 and score(x) >= 10}
        random = _log_chances({k: digests.get(k, 0) + share * found.get(k, 0) for k in digests.keys() | found.keys()})
        ordinary = _log_chances(common + _count((x, n) for x, n in runs.items() if x not in taken))
    score = lambda x: sum(random(*p) - ordinary(*p) for p in zip(["", *x], x, strict=False) if p[1] in _CHARS)
    taken = {x for x in runs if len(set(x)) >= 8 and score(x) >= 10}
    return [[(a, b) for a, b in long_runs(t) if t[a:b] in taken] for t in texts]
