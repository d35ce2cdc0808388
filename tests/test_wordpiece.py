"""WordPiece tokens and spans against the tokenizers library, with vocabularies made here."""

import random
import string

import pytest
from conftest import DATA

from tessella.functions import wordpiece
from tessella.plans import catalogue

PIECES = ["[PAD]", "[UNK]", *string.printable.strip(), *[f"##{c}" for c in string.ascii_lowercase + string.digits], "the", "risk", "##ing", "re", "##duc", "resume", "##s", "中", "文", "e", "##ae", "strasse", "##ss", "ß", "##ß", "σ", "##σ", "##ς", "i", "##i"]
TEXTS = [
    "", " ", "The Risk-reducing   surgery", "naïve RÉSUMÉ Ångström", "中文字 mixed中文text", "tab\tnew\nline\r\nend", "zero​width­soft", "á combining és", "x" * 101 + " ok", "x" * 100, "µ ½ ﬁ Straße İstanbul ΣΊΣΥΦΟΣ",
    "don't $5.00 (a+b)=c `q` ^~|<>", "　full width， punctuation。", "emoji \U0001f600 and \U0001f1e9\U0001f1ea", "\x00nul\x07bell�", "한국어 텍스트", " nbsp thin", "«quoted» – dash — em…", "word sep para", "ก็ไทย हिन्दी",
]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer(tokenizers.models.WordPiece({p: k for k, p in enumerate(dict.fromkeys(PIECES))}, unk_token="[UNK]", max_input_chars_per_word=100))
    t.normalizer = tokenizers.normalizers.BertNormalizer(clean_text=True, handle_chinese_chars=True, strip_accents=True, lowercase=True)
    t.pre_tokenizer = tokenizers.pre_tokenizers.BertPreTokenizer()
    return t


def expected(library, text):
    e = library.encode(text, add_special_tokens=False)
    return list(zip(e.ids, *zip(*e.offsets, strict=True), strict=True)) if e.ids else []


@pytest.mark.parametrize("text", TEXTS)
def test_as_the_library_has_it(library, text):
    assert wordpiece.Vocabulary(dict.fromkeys(PIECES)).encode(text) == expected(library, text)


def test_random_texts(library):
    r, vocabulary = random.Random(1), wordpiece.Vocabulary(dict.fromkeys(PIECES))
    signs = "abcdeRSÉéñçÀ中文字 \t-.,'ßµ́̈‍0123ﬁ日本ΩЖж"
    for _ in range(3000):
        text = "".join(r.choice(signs) for _ in range(r.randint(0, 30)))
        assert vocabulary.encode(text) == expected(library, text), text


def test_windows_are_cut_from_the_source(spark, tmp_path):
    (tmp_path / "v.txt").write_text("\n".join(dict.fromkeys(PIECES)) + "\n")
    pieces = wordpiece.read_vocabulary(spark, str(tmp_path / "v.txt"))
    texts = [(1, "The  RÉSUMÉ,\n" * 30), (2, None), (3, ""), (4, "short"), (5, "中文" * 40)]
    df = spark.createDataFrame(texts, "id int, text string")
    got = wordpiece.windows(df, pieces, size=25, overlap=5).collect()
    vocabulary = wordpiece.Vocabulary(pieces)
    for i, text in texts:
        found, mine = vocabulary.encode(text or ""), sorted((r for r in got if r.id == i), key=lambda r: r.chunk)
        assert [r.window for r in mine] == [text[r.begin : r.end] for r in mine]
        assert [r.first for r in mine] == ([0] if 0 < len(found) <= 25 else list(range(0, max(0, len(found) - 5), 20)))
        for r in mine:
            part = found[r.first : r.first + 25]
            assert (r.n_tokens, r.begin, r.end) == (len(part), part[0][1], part[-1][2])
    with pytest.raises(ValueError):
        (tmp_path / "empty").mkdir()
        wordpiece.read_vocabulary(spark, str(tmp_path / "empty"))


def test_registered_query(spark):
    got = {(r.doc_id, r.chunk): r for r in catalogue.queries()["wordpiece_windows"](spark, DATA).collect()}
    vocabulary, n = wordpiece.Vocabulary(catalogue.LETTERS), 0
    for d in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        found = vocabulary.encode(d.text or "")
        for k, first in enumerate([0] if 0 < len(found) <= 510 else range(0, max(0, len(found) - 50), 460)):
            part, r = found[first : first + 510], got[d.doc_id, k]
            assert (r.first, r.n_tokens, r.begin, r.end) == (first, len(part), part[0][1], part[-1][2])
            n += 1
    assert n == len(got)
