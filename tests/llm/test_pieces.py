"""Op 3 against the library."""

import hashlib

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_classes import DATA

from tessella.llm import pieces
from tessella.llm.queries import PIECE_MODEL, op3_sentencepiece

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
with open(PIECE_MODEL, "rb") as f:
    CODEC = pieces.Codec(f.read())

texts = st.lists(st.sampled_from(["the", "ing", " ", "  ", "\n", "▁", "<s>", "<0x0A>", "é", "你", "\U0001f600", "\t", "\x00", "aaaa", "!!", "123", "ñ", "\r\n"]) | st.characters(exclude_categories=["Cs"]), max_size=30).map("".join)


@settings(max_examples=400, deadline=None)
@given(texts)
def test_encodes_and_decodes_as_the_library(text):
    ids = LIBRARY.encode(text)
    assert CODEC.run(text) == (len(ids), ",".join(map(str, ids)), LIBRARY.decode(ids))
    assert CODEC.model.encode(text) == ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 600) | st.integers(0, 31999), max_size=12))
def test_decodes_any_ids(ids):
    assert CODEC.model.decode(ids) == LIBRARY.decode(ids)


def test_long_parts():
    for text in ("ab" * 30_000, " " * 20_000 + "x", "\n" * 5000, "étion" * 4000):
        assert CODEC.run(text)[1] == ",".join(map(str, LIBRARY.encode(text)))


def test_rows(documents, make):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, make(5000)), (5, " lead and trail ")]
    out = pieces.tokenized(documents(rows).withColumnRenamed("lang", "n_tokens"), PIECE_MODEL, ids=True, decoded=True).collect()
    for (_, text), r in zip(rows, out, strict=True):
        ids = LIBRARY.encode(text or "")
        assert (r.n_tokens, list(r.ids), r.decoded) == (len(ids), ids, LIBRARY.decode(ids))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert pieces.tokenized(documents([]), PIECE_MODEL).count() == 0


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in op3_sentencepiece(spark, DATA).collect():
        ids = LIBRARY.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
