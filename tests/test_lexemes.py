"""The English text configuration: published stems, stop words, compounds and addresses, phrases with gaps."""

import pytest

from tessella.functions import constants as C
from tessella.functions import lexical

#: Words and stems of the published sample vocabulary and of the rules' own examples.
STEMS = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consists consist
consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol
consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir
conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave
knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight
knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock
knopp knopp knot knot knots knot generously generous generate generat generic generic dying die lying lie skies sky skis ski news news inning inning university universiti communism communism
hopping hop hoping hope shed shed happy happi cry cri by by say say ties tie cries cri gas gas gaps gap kiwis kiwi luxuriated luxuri relational relat conditional condit rational ration vileness vile
hopefulness hope formality formal sensitivity sensit sensibility sensibl analogy analog triplicate triplic electricity electr goodness good revival reviv allowance allow inference infer airliner airlin
replacement replac adjustment adjust adoption adopt homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll
""".split()


@pytest.mark.parametrize("word, stem", list(zip(STEMS[::2], STEMS[1::2], strict=True)))
def test_stems(word, stem):
    assert lexical.stem(word) == stem == lexical.stem(word.upper())


def test_stop_words_take_places_only():
    assert len(C.ENGLISH_STOP_WORDS) == len(set(C.ENGLISH_STOP_WORDS)) == 127
    assert lexical.lexemes("That thing with this, from there don't") == [("thing", 2)]
    q = lexical.parse("that with from")
    assert q.terms == ["that", "with", "from"] and q.any_of == [] and not q.phrase and lexical.wanted(q) == set()
    assert lexical.rank(q, lexical.lexemes("that with from")) == (0.0, 0.0, 0.0, 0)


@pytest.mark.parametrize(
    "text, found",
    [
        ("risk-reducing surgery", [("risk-reduc", 1), ("risk", 2), ("reduc", 3), ("surgeri", 4)]),
        ("the up-to-date list", [("up-to-d", 2), ("date", 5), ("list", 6)]),
        ("covid-19 10-20", [("covid-19", 1), ("covid", 2), ("19", 3), ("10", 4), ("-20", 5)]),
        ("at http://www.Example.com/a/b?x=1 too", [("www.example.com/a/b?x=1", 2), ("www.example.com", 3), ("/a/b?x=1", 4)]),
        ("see example.org.", [("see", 1), ("example.org", 2)]),
        ("mail First.Last@site.org", [("mail", 1), ("first.last@site.org", 2)]),
        ("1.5 -12 3e8 1.2.3 5266dupC", [("1.5", 1), ("-12", 2), ("3e8", 3), ("1.2.3", 4), ("5266dupc", 5)]),
        ("<b>bold</b> &amp; <!-- no --> and/or", [("bold", 1), ("and/or", 2)]),
        ("naïve 中文 ÉTÉ", [("naïve", 1), ("中文", 2), ("été", 3)]),
        ("", []),
        (None, []),
    ],
)
def test_places(text, found):
    assert lexical.lexemes(text) == found


def test_phrases_keep_their_gaps():
    q = lexical.parse('"surgery of the carriers"')
    assert q.phrase == ["surgeri", "carrier"] and q.phrase.steps == [0, 3] and q.required[0].steps == [0, 3]
    rank = lambda t: lexical.rank(q, lexical.lexemes(t))
    assert rank("surgery for all carriers")[0] == pytest.approx(0.1 / 3) and rank("surgery carriers")[0] == 0 and rank("surgery on carriers")[1] == 0
    assert rank("surgery surgery of many carriers")[0] == pytest.approx(0.1 / 3)


def test_compounds_match_as_wholes():
    q = lexical.parse("risk-reducing")
    assert q.required == [["risk-reduc", "risk", "reduc"]] and q.any_of == ["risk", "reduc"]
    assert lexical.rank(q, lexical.lexemes("risk-reducing surgery"))[1] > 0 == lexical.rank(q, lexical.lexemes("reducing the risk"))[1]


def test_repeats_take_linear_time():
    import time

    q = lexical.parse('"alpha beta"')
    began = time.perf_counter()
    assert lexical.rank(q, [("alpha", 2 * k) for k in range(200_000)] + [("beta", 2 * k + 1) for k in range(200_000)])[0] == pytest.approx(20_000)
    assert time.perf_counter() - began < 10


def test_pieces_of_text_are_cut_as_the_whole_is():
    import random

    r = random.Random(1)
    signs = ["a", "b", "surgery", "surgeries", "dying", "Surgical", "éa", ",", "(", "!", ":", "-", ".", "/", "@", "www.x.org", "1", "2", "&amp;", ";", " ", "\n", "\u3000", "_", "'", "\u00e9", "://", "http", "<b>", "<", ">", "e8", "+"]
    for _ in range(3000):
        text = "".join(r.choice(signs) for _ in range(r.randint(0, 14)))
        whole = [(word if not spoken else lexical.stem(word), at) for at, (word, spoken, _) in enumerate(lexical.tokens(text), 1) if not spoken or word not in C.ENGLISH_STOP_WORDS]
        assert lexical.lexemes(text) == whole, text
        assert lexical.lexemes_among(text, {"a", "surgeri", "1"}) == [x for x in whole if x[0] in ("a", "surgeri", "1")]
        assert lexical.lexemes_among(text, {"die", "surgic", "/", "www.x.org"}) == [x for x in whole if x[0] in ("die", "surgic", "/", "www.x.org")]
