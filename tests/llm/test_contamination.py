"""Op 4 against a search for every window."""

import random
import re

import pytest
from llm_classes import DATA

from tessella.llm import contamination as c
from tessella.llm.queries import op4_benchmark_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for name, text in items:
        w = split(text)
        k = min(13, len(w))
        for b in range(len(w) - k + 1) if w else ():
            windows.setdefault(tuple(w[b : b + k]), set()).add("null" if name is None else str(name))
    out = []
    for text in docs:
        w, hit, found = split(text), set(), set()
        for k in set(map(len, windows)):
            for b in range(len(w) - k + 1):
                if names := windows.get(tuple(w[b : b + k])):
                    hit.update(range(b, b + k))
                    found |= names
        out.append((len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def check(spark, documents, docs, items, **options):
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = c.measure(documents(enumerate(docs)).selectExpr("*", "0 as n_hit"), bench, **options).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in rows] == brute(docs, items)
    assert all(sum(e - b for b, e in r.hits) == r.n_hit for r in rows)
    return rows


def test_planted(spark, documents, make):
    items = [(k, make(n)) for k, n in enumerate([40, 20, 13, 12, 3, 1, 60])] + [(3, make(15)), (None, make(14)), (50, None), (51, "..."), (52, "")]
    t = [i[1] for i in items]
    docs = [make(500), f"{make(100)} {t[0].upper()}! {make(50)}", f"{t[1]}\n{t[1]} {t[2]}", f"{make(30)} {t[3]}", f"{make(9)} {t[4]}", t[5], f"{make(2000)} {' '.join(t[6].split()[10:23])} {make(2000)}", " ".join(t[0].split()[:12]), t[8], None, "", "?!", f"{t[0]} {t[1]}", t[7]]
    rows = check(spark, documents, docs, items)
    assert rows[1].longest_match == 40 and rows[7].longest_match <= 1


def test_blocks_give_the_same(spark, documents, make):
    items = [(k, make(25)) for k in range(12)]
    docs = [make(50)] + [f"{make(20)} {i[1]} {items[(k + 5) % 12][1]}" for k, i in enumerate(items)]
    check(spark, documents, docs, items, block_bytes=300)


def test_repeats(spark, documents, make):
    text = make(30)
    items = [(1, text), (1, text), (2, text), (3, " ".join(text.split()[5:25]))]
    check(spark, documents, [f"{text} {text}", " ".join(["word"] * 200)], [*items, (4, "word word word")])


def test_empty(spark, documents, make):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert c.measure(documents([(1, make(20))]), bench).first().n_hit == 0
    assert c.measure(documents([]), bench).count() == 0
    assert c.decontaminate(documents([(1, make(20))]), bench).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_query(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    b = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    got = op4_benchmark_decontamination(spark, DATA).orderBy("doc_id").collect()
    want = brute([r.text for r in d], [(r.item_id, r.text) for r in b])
    assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got] == [(w, h, len(n), c.digest(n), x) for w, h, n, x in want]


def longest(docs, items):
    """For each text the words and the place of the longest verbatim match, of equal ones the first."""
    out = []
    for text in docs:
        w, best = split(text), None
        for _, other in items:
            v = split(other)
            for p in range(len(w)):
                for q in range(len(v)):
                    k = 0
                    while p + k < len(w) and q + k < len(v) and w[p + k] == v[q + k]:
                        k += 1
                    if k and (best is None or (-k, p) < (-best[0], best[1])):
                        best = (k, p)
        out.append(best)
    return out


@pytest.mark.parametrize("block_bytes", [c.BLOCK_BYTES, 150])
def test_longest_matches_of_any_length(spark, documents, block_bytes):
    """Matches of one word and of more words than a window, with their places; also where words repeat."""
    r = random.Random(4)
    items, docs = [], []
    for many in (2, 6, 40):
        own = [f"w{k}" for k in range(many)]
        items += [(len(items) + k, " ".join(r.choice(own) for _ in range(r.randint(1, 30)))) for k in range(5)]
        docs += [" ".join(r.choice([*own, "other"]) for _ in range(r.randint(0, 60))) for _ in range(8)]
    docs += [items[0][1], " ".join(items[3][1].split()[-12:]), "none", None]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = c.measure(documents(enumerate(docs)), bench, block_bytes=block_bytes).orderBy("doc_id").collect()
    assert [r.longest and (r.longest["words"], r.longest["at"]) for r in rows] == longest(docs, items)
    texts = {str(k): split(t) for k, t in items}
    for row in rows:
        if m := row.longest:
            assert texts[m["item"]][m["item_at"] :][: m["words"]] == split(row.text)[m["at"] :][: m["words"]]


def test_repeated_words_take_time_in_proportion():
    """One word over and over, in an item and in a document: nothing is worked out for each pair of places."""
    items = c.Items([("a", b"word " * 20_000)])
    (found,) = c.scan([b"word " * 100_000], items)
    assert found[1:] == ([(0, 100_000)], ["a"], 20_000, (20_000, 0, "a", 0))
