"""Op 2 on planted texts, and the alignment against a plain longest common subsequence."""

import math
import random
from collections import Counter

from llm_classes import DATA

from tessella.llm import licenses
from tessella.llm.contamination import words
from tessella.llm.queries import op2_license_scan
from tessella.llm.templates import TEMPLATES

ALL = dict(TEMPLATES)


def scan(documents, texts, **options):
    rows = licenses.scanned(documents(enumerate(texts)).selectExpr("*", "'x' as licenses"), **options).orderBy("doc_id").collect()
    return [(r.licenses, r.n_matches, r.coverage) for r in rows]


def test_planted(documents, make):
    texts = [f"{make(300)}\n{text}\n{make(300)}" for text in ALL.values()]
    got = scan(documents, texts)
    assert [g[0] for g in got] == [[name] for name in ALL]
    assert all(g[2] == 1 for g in got)


def test_twice_and_edited(documents, make):
    notice = ALL["GPL-3.0 notice"]
    mit = ALL["MIT"].split()
    edited = " ".join(w for k, w in enumerate(mit) if k % 17 != 3)
    got = scan(documents, [f"{notice} {make(40)} {notice}", f"{make(9)} {edited} {make(9)}", " ".join(mit[: len(mit) // 2])])
    assert got[0][:2] == (["GPL-3.0 notice"], 2)
    assert got[1][0] == ["MIT"] and 0.85 <= got[1][2] < 1
    assert got[2][1] == 0


def test_edges(documents, make):
    assert scan(documents, [None, "", "...", make(2000), "the the the"]) == [([], 0, 0.0)] * 5
    assert licenses.scanned(documents([])).count() == 0


def test_alignment_is_common_and_increasing():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randrange(12) for _ in range(r.randint(0, 25))] for _ in range(2))
        pairs = licenses.aligned(a, b)
        assert all(a[x] == b[y] for x, y in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for k, y in enumerate(b, 1):
                before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
        assert len(pairs) <= row[-1]
    assert licenses.aligned([1, 2, 3, 4], [1, 2, 3, 4]) == [(k, k) for k in range(4)]


def plain_pairs(a, b):
    """Patience alignment as it is defined, by recursion: places of ``a`` and ``b``."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0)] + [(x + 1, y + 1) for x, y in plain_pairs(a[1:], b[1:])]
    if a[-1] == b[-1]:
        return [*plain_pairs(a[:-1], b[:-1]), (len(a) - 1, len(b) - 1)]
    once = [(a.index(w), b.index(w)) for w in sorted(set(a)) if a.count(w) == 1 and b.count(w) == 1]
    once.sort()
    best = []  # the longest increasing one that ends in each, the first found of equals by the smallest tops
    tops, piles, back = [], [], []
    for k, (_, y) in enumerate(once):
        p = sum(t < y for t in tops)
        tops[p:p + 1], piles[p:p + 1] = [y], [k]
        back.append(piles[p - 1] if p else None)
    k = piles[-1] if piles else None
    while k is not None:
        best.insert(0, once[k])
        k = back[k]
    if not best:
        return []
    out, (x0, y0) = [], (-1, -1)
    for x, y in [*best, (len(a), len(b))]:
        out += [(x0 + 1 + p, y0 + 1 + q) for p, q in plain_pairs(a[x0 + 1:x], b[y0 + 1:y])]
        if x < len(a):
            out.append((x, y))
        x0, y0 = x, y
    return out


def brute(text):
    """Matches and largest coverage, by aligning every window that begins with a word of a template."""
    w, found, most = words((text or "").encode()), [], 0.0
    for name, template in TEMPLATES:
        own = words(template.encode())
        need, least, wide = math.ceil(0.85 * len(own) - 1e-9), math.ceil(0.5 * len(own) - 1e-9), int(1.5 * len(own)) + 1
        free = 0
        for b in range(len(w)):
            part = w[b : b + wide]
            if b < free or w[b] not in own or sum(x in own for x in part) < least or sum((Counter(part) & Counter(own)).values()) < least:
                continue
            pairs = plain_pairs(part, own)
            if pairs and pairs[0][0]:
                later = plain_pairs(w[b + pairs[0][0] : b + pairs[0][0] + wide], own)
                if len(later) >= len(pairs):
                    b, pairs = b + pairs[0][0], later
            if len(pairs) >= least:
                most = max(most, len(pairs) / len(own))
            if len(pairs) >= need:
                free = b + pairs[-1][0] + 1
                found.append((len(pairs), len(pairs) / len(own), name, b + pairs[0][0], free))
    taken = []
    for n, share, name, b, e in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[3])):
        if all(e <= x or y <= b for _, x, y, _ in taken):
            taken.append((name, b, e, share))
    return [f"{n}:{b}:{e}:{round(100 * c)}" for n, b, e, c in sorted(taken, key=lambda m: (m[1], m[0]))], most


def test_against_brute_force(documents, make):
    """Whole, cut, edited and shuffled templates among other words."""
    r, texts = random.Random(5), []
    for name, text in TEMPLATES:
        w = text.split()
        for part in (0.0, 0.1, 0.3, 0.6):
            v = [x for x in w if r.random() >= part * r.random()]
            for _ in range(int(part * 10)):
                v.insert(r.randrange(len(v) + 1), r.choice([make(1), r.choice(w)]))
            texts.append(f"{make(r.randint(0, 8))} {' '.join(v)} {make(5)} {' '.join(r.sample(w, len(w)))}")
    rows = licenses.scanned(documents(enumerate(texts))).orderBy("doc_id").collect()
    assert [(r.matches, r.coverage) for r in rows] == [brute(t) for t in texts]


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in op2_license_scan(spark, DATA).collect():
        matches, most = brute(texts[r.doc_id])
        assert (r.matches, r.n_matches, r.coverage) == (",".join(matches), len(matches), most)


def test_recall_of_edited_templates(documents, make):
    """Of templates with one word in 20 left out, replaced or put in, all are found; the short notices by a word in their whole."""
    r, texts, names = random.Random(9), [], []
    for name, text in TEMPLATES:
        for _ in range(5):
            w = text.split()
            for k in sorted(r.sample(range(len(w)), max(len(w) // 20, int(len(w) >= 7))), reverse=True):
                w[k : k + 1] = r.choice([[], [make(1)], [w[k], make(1)]])
            texts.append(f"{make(50)} {' '.join(w)} {make(50)}")
            names.append(name)
    got = scan(documents, texts)
    assert sum(n in g[0] for n, g in zip(names, got, strict=True)) >= 0.9 * len(names)


def test_nested_licenses_get_their_own_names(documents, make):
    """Licenses that hold most of another one, whole and with one word in 20 edited, each between other words."""
    r, texts, names = random.Random(11), [], []
    for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MIT", "ISC", "Apache-2.0"):
        for _, text in (t for t in TEMPLATES if t[0] == name):
            texts.append(f"{make(30)} {text} {make(30)}")
            names.append(name)
            for _ in range(4):
                w = text.split()
                for k in sorted(r.sample(range(len(w)), len(w) // 20), reverse=True):
                    w[k : k + 1] = r.choice([[], [make(1)], [w[k], make(1)]])
                texts.append(f"{make(30)} {' '.join(w)} {make(30)}")
                names.append(name)
    got = [g[0] for g in scan(documents, texts)]
    assert all(g == [n] for n, g in zip(names[::5], got[::5], strict=True))
    assert sum(g == [n] for n, g in zip(names, got, strict=True)) >= 0.9 * len(names)
