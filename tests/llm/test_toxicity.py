"""Op 10 by held-out accuracy."""

import zlib

import numpy as np
from llm_classes import DATA

from tessella.llm import toxicity as t
from tessella.llm.queries import op10_toxicity


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def corpus(make, n=900):
    """Every eighth text holds some bad words; a third of the texts has a label."""
    bad, docs, labels, truth = ["vilest", "rotter", "swinehunde"], [], [], {}
    for i in range(n):
        w = make(60 + i % 90).split()
        truth[i] = int(i % 8 == 0)
        if truth[i]:
            for k in range(3 + i % 3):
                w.insert((k * 17 + i) % len(w), bad[(i + k) % 3] + ("" if k % 2 else "ish"))
        docs.append((i, " ".join(w)))
        if i % 3 != 2:
            labels.append((i, 0, truth[i]))
    return docs, labels, truth


def test_held_out(spark, documents, make):
    docs, labels, truth = corpus(make)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = documents(docs)
    rows = t.scored(df, t.fit(df, lab)).collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    right = [r.predicted == truth[r.doc_id] for r in rows if r.held_out]
    assert np.mean(right) > 0.98
    # Labels of the held-out fold and labels as such are no inputs.
    flipped = spark.createDataFrame([(i, q, 1 - y if held(i) else y) for i, q, y in labels], lab.schema)
    again = t.scored(df.withColumn("lang", df.source), t.fit(df, flipped)).collect()
    assert {r.doc_id: round(r.score, 9) for r in again} == {r.doc_id: round(r.score, 9) for r in rows}


def test_odd_rows(spark, documents, make):
    docs, labels, _ = corpus(make, 300)
    lab = spark.createDataFrame([*labels, (0, 0, 1), (None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    odd = [*docs, (None, make(5)), (1, make(5)), (9000, None), (9001, ""), (9002, "\n"), (9003, make(30_000))]
    out = t.scored(documents(odd).selectExpr("*", "1 as score"), t.fit(documents(odd), lab))
    got = {r.doc_id: r for r in out.collect()}
    assert got[9000].score == got[9001].score == got[9002].score and got[9000].predicted == 0
    assert got[None].held_out is False and out.count() == len(odd)


def test_without_labels(spark, documents, make):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = documents([(1, make(5)), (2, None)])
    assert [r.score for r in t.scored(df, t.fit(df, lab)).collect()] == [0.0, 0.0]
    assert t.scored(documents([]), t.fit(documents([]), lab)).count() == 0
    assert t.clean(df, lab).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_risk_is_kept_from_going_below_zero():
    rng = np.random.default_rng(1)
    p, u = rng.normal(2, 1, (100, 3)), np.concatenate([rng.normal(2, 1, (60, 3)), rng.normal(-2, 1, (240, 3))])
    w, b = t.nnpu(p, u, 0.2)
    assert np.mean(p @ w + b > 0) > 0.9 and np.mean(u[60:] @ w + b > 0) < 0.1


def plain_features(word):
    w = word.strip(".,;:!?\"'()[]{}|*#%&$<>«»“”-_=+/\\")
    return [w[:k] for k in range(3, min(8, len(w)) + 1)] + [w + " "] if len(w) >= 3 else []


def plain_values(text):
    """The value of each feature of a text."""
    words, count = text.lower().split(), {}
    words = [w for k, w in enumerate(words) if not k or w != words[k - 1]]
    for w in words:
        for f in plain_features(w):
            count[f] = count.get(f, 0) + 1
    return {f: min(3.0, 100.0 * c / (len(words) + 100.0)) for f, c in count.items()}


def test_query(spark):
    """Scores from a model that is trained again here from plain loops over all texts."""
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r.toxic is not None}
    texts = {}
    for i, text in docs:
        if not held(i) and text:
            ids, marks = texts.setdefault(text, ([], []))
            ids.append(i)
            marks += [labels[i]] if i in labels else []
    unique = sorted((min(ids), text, max(marks, default=None)) for text, (ids, marks) in texts.items())
    known = [y == 1 for _, _, y in unique if y is not None]
    prior = min(max(sum(known) / len(known), 1e-3), 0.9)
    p, values = np.array([y == 1 for _, _, y in unique]), [plain_values(text) for _, text, _ in unique]
    # A feature counts in texts by its words, repeated in a row or not.
    seen = {}
    for (_, text, _), positive in zip(unique, p, strict=True):
        if positive:
            for f in {f for w in set(text.lower().split()) for f in plain_features(w)}:
                seen[f] = seen.get(f, 0) + 1
    names = sorted((f for f, n in seen.items() if n >= max(2, p.sum() // 100)), key=lambda f: (-seen[f], f))[: t.CANDIDATES]
    x = np.array([[v.get(f, 0.0) for f in names] for v in values])
    apart = (x[p].mean(0) - x.mean(0)) / np.sqrt(x[p].var(0) / p.sum() + x.var(0) / len(x) + 1e-9)
    keep = [k for k in np.argsort(-apart, kind="stable")[: t.FEATURES] if apart[k] > 1.0]
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    model = t.fit(df, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert set(model.weights) == {names[k] for k in keep}
    keep = [names.index(f) for f in model.weights]
    w, b = t.nnpu(x[p][:, keep], x[:, keep], prior)
    assert np.allclose(w, list(model.weights.values()), atol=1e-6) and abs(b - model.bias) < 1e-6
    rows = {r.doc_id: r for r in op10_toxicity(spark, DATA).collect()}
    assert len(rows) == 200
    for i, text in docs:
        v = plain_values(text)
        margin = b + sum(a * v.get(names[k], 0.0) for a, k in zip(w, keep, strict=True))
        score = 1 / (1 + np.exp(-(margin - model.shift + np.log(0.7 / 0.3))))
        assert abs(rows[i].score - score) < 1e-6 and rows[i].held_out == held(i) and rows[i].predicted == (rows[i].score >= 0.7)


def test_prior_may_be_given(spark, documents, make):
    docs, labels, truth = corpus(make, 450)
    lab = spark.createDataFrame([x for x in labels if x[2]], "doc_id long, quality int, toxic int")
    df = documents(docs)
    rows = t.scored(df, t.fit(df, lab, prior=1 / 8)).collect()
    assert np.mean([r.predicted == truth[r.doc_id] for r in rows if r.held_out]) > 0.95
