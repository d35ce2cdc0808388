"""What Python holds at a time is bounded, whatever the rows of a batch, and results are those of plain loops."""

import random
import tracemalloc

import pyarrow as pa
from conftest import DATA

from tessella.functions import lexical, wordpiece
from tessella.operators import postings, search
from tessella.plans import catalogue
from tessella.plans.model import passages


def peak(run) -> float:
    """MB that Python and its Arrow buffers hold at most."""
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    buffers = 0
    for _ in run:
        buffers = max(buffers, pa.total_allocated_bytes() - before)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return (most + buffers) / 1e6


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lexemes_of_a_few_texts_are_held():
    text = " ".join(f"w{k % 7000}" for k in range(20_000))
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array([text, None] * 30)], names=["id", "text"])
    assert peak(postings.gathered(lexical.lexemes)([batch])) < 40
    rows = [r for b in postings.gathered(lexical.lexemes)([batch.slice(0, 3)]) for r in b.to_pylist()]
    want = {}
    for w, p in lexical.lexemes(text):
        want.setdefault(w, []).append(p)
    assert [(r["id"], r["lexeme"], r["places"]) for r in rows] == [(i, w, p) for i in (0, 2) for w, p in want.items()]


def test_postings_are_made_where_texts_are(spark):
    shown = plan(catalogue.queries()["inverted_table"](spark, DATA))
    assert "MapInArrow" in shown and "Exchange" not in shown and "ArrowEvalPython" not in shown
    assert "Exchange" not in plan(search.postings(passages(spark, DATA)))


def test_postings_of_repeated_keys(spark, monkeypatch):
    rows = [("N1", 1, "alpha beta alpha"), ("N1", 1, "beta gamma"), ("N1", 2, "alpha"), (None, 3, "delta"), (None, 3, "delta x delta"), (None, None, "beta"), (None, None, "the beta"), ("N2", None, ""), ("N2", 1, None), ("N3", 1, "beta")]
    p = spark.createDataFrame(rows, "nbk_id string, passage_id int, text string")
    want = {}
    for n, i, t in rows:
        for w, at in lexical.lexemes(f"  {t or ''}"):
            want.setdefault((w, i, n), []).append(at)
    want = {k: sorted(v) for k, v in want.items()}
    for most in (100, 1):
        monkeypatch.setattr(search, "FEW", most)
        got = search.postings(p).collect()
        assert len(got) == len(want) and {(r.lexeme, r.passage_id, r.nbk_id): r.places for r in got} == want


SIGNS = "abcdeRSÉéñçÀ中文字 \t-.,'ßµ́̈‍0123ﬁ日本ΩЖж\x0b\x1c\x00\u2028\u3000\xa0\x85İſK"


def by_loop(found, size, overlap):
    """Windows of the list of all tokens."""
    firsts = ([0] if 0 < len(found) <= size else range(0, max(0, len(found) - overlap), size - overlap))
    return [(k, len(found[k : k + size]), found[k][1], found[k : k + size][-1][2]) for k in firsts]


def test_windows_of_a_vocabulary():
    r = random.Random(5)
    pieces = list(dict.fromkeys([*catalogue.LETTERS, *"-.,'中文é", "##é", "re", "##ss", "ss", "fi", "##ca", "k", "ω", "##ω", "ж", "##ж"]))
    vocabulary = wordpiece.Vocabulary(pieces)
    texts = ["", " ", "x" * 300, "é" * 300 + " z", "é" * 101 + "\u0301", "İ" * 60 + "x", "ab-" * 200, "中" * 200, "a" * 100 + " " + "a" * 101]
    texts += ["".join(r.choice(SIGNS) for _ in range(r.randint(0, 90))) for _ in range(1500)]
    texts += ["".join(r.choice(SIGNS.replace(" ", "").replace("\t", "")) for _ in range(r.randint(90, 300))) for _ in range(100)]
    for text in texts:
        found = vocabulary.encode(text)
        for size, overlap in ((7, 2), (5, 0), (510, 50)):
            assert vocabulary.windows(text, size, overlap) == by_loop(found, size, overlap), text


def test_tokens_of_a_few_texts_are_held(spark):
    sent = {}

    class Rows:
        """Takes the function that Python workers would run."""

        columns, schema, sparkSession = ["id", "text"], spark.createDataFrame([], "id long, text string").schema, spark

        def mapInArrow(self, run, kinds):
            sent["run"] = run
            return spark.createDataFrame([], kinds)

    wordpiece.windows(Rows(), catalogue.LETTERS, size=510, overlap=50)
    text = "The risk-reducing surgery of carriers " * 1500
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array([text] * 60)], names=["id", "text"])
    assert peak(sent["run"]([batch])) < 20
    # A text of one word, of which no part is known.
    assert peak(sent["run"]([pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["é" * 500_000])], names=["id", "text"])])) < 20
    out = [w for b in sent["run"]([batch]) for w in b.column(2).to_pylist()]
    found = by_loop(wordpiece.Vocabulary(catalogue.LETTERS).encode(text), 510, 50)
    want = [{"chunk": k, "first": f, "n_tokens": n, "begin": b, "end": e, "window": text[b:e]} for k, (f, n, b, e) in enumerate(found)]
    assert out == [want] * 60


def test_buckets_pass_no_table_through_the_driver(spark):
    assert "Broadcast" not in plan(catalogue.queries()["bench_buckets"](spark, DATA))


def test_ranks_of_a_few_documents_are_held():
    r, q = random.Random(6), lexical.parse('"alpha beta" or gamma -delta')
    docs = [None, [], *([(r.choice(["alpha", "beta", "gamma", "delta"]), p) for p in range(r.randint(0, 40))] for _ in range(300))]
    kind = pa.list_(pa.struct([("lexeme", pa.string()), ("place", pa.int32())]))
    rows = pa.array([None if d is None else [{"lexeme": w, "place": p} for w, p in d] for d in docs], kind)
    want = [lexical.rank(q, d) if d is not None else (0.0, 0.0, 0.0, 0) for d in docs]
    for some, first in ((rows, 0), (rows.slice(7), 7)):
        assert [tuple(x.values()) for x in lexical.ranks(q, some).to_pylist()] == want[first:]
    long = pa.array([[{"lexeme": "alpha" if p % 2 else "gamma", "place": p} for p in range(20_000)]], kind)
    many = pa.concat_arrays([long] * 60)
    tracemalloc.start()
    out = lexical.ranks(q, many).to_pylist()
    assert tracemalloc.get_traced_memory()[1] / 1e6 < 40 and len(out) == 60
    tracemalloc.stop()


def test_pieces_of_one_word_need_no_pattern():
    r = random.Random(7)
    pieces = ["".join(r.choice("abyYZ.,;:!?()\"'-_/&<1é") for _ in range(r.randint(1, 7))) for _ in range(20_000)] + ["The", "(the)", "That's", "'tis", "a.b", "x@y.org", "I", "Ⅳ", "running,"]
    assert [lexical._piece(p) for p in pieces] == [lexical._lexemes(p) for p in pieces]


def test_indexed_ranks_go_through_no_frames(spark):
    shown = plan(catalogue.queries()["indexed_ranks"](spark, DATA))
    assert "lexeme_column" not in shown and "MapInArrow" in shown
