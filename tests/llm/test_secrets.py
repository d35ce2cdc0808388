"""Op 8: base patterns against a plain reading of the contract, the field on lines it wasn't trained on."""

import hashlib
import itertools
import random
import re
import string

import pytest
from llm_classes import DATA

from tessella.llm import secrets as s
from tessella.llm.queries import op8_secret_scan

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return ",".join(f"{s.KINDS[k]}:{b}:{e}" for b, k, e in sorted(out))


def test_rows(documents, make):
    texts = [None, "", make(3000), "é PassWord : 'abcdefgh1", "token=short", "to\u212aen=abcdefghij", "AKIA" + "A" * 12, "AKIAAKIA" + "B" * 7, "f" * 32 + "g" + "0" * 31, "secret==abcdefgh token=secret=password", 'api_key = "' + "ab12" * 10 + '"']
    rows = s.scanned(documents(enumerate(texts)).selectExpr("*", "1 as spans")).orderBy("doc_id").collect()
    assert [r.base for r in rows] == [base(t) for t in texts]
    assert s.scanned(documents([])).count() == 0
    for r in rows:
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))


@pytest.mark.parametrize("text", ["the key is ghp_{} in it", "Authorization: Bearer {}xYz0 and so on", "see xoxb-12345678901-{} there"])
def test_added(documents, make, text):
    value = "aB3dE6gH9jK2mN5pQ8rS1tU4"
    t = f"{make(60)}\n{text.format(value)}\n{make(60)}"
    spans = s.scanned(documents([(1, t)])).first().spans
    assert any(t[int(b) : int(e)].find(value) >= 0 for _, b, e in (x.split(":") for x in spans.split(",") if x))


def test_prose_and_addresses_are_left(documents, make):
    text = f"{make(200)} bosbt.42@mail8.example.com {make(20)} https://an.example.org/en/12345?page=2 2024-05-06 {make(20)} 1234567890123 +49-123-4567890 {'thesor' * 9} ====================="
    assert s.scanned(documents([(1, text)])).first().spans == ""


def test_field_on_other_lines():
    field, hit, wrong, missed = s.trained(), 0, 0, 0
    for line in s.made_lines(99):
        tags = field.tags([t for t, _ in line], ["settings0", "words1"])
        for (t, want), got in zip(line, tags, strict=True):
            hit += want != s.O and got != s.O
            wrong += want == s.O and got != s.O
            missed += want != s.O and got == s.O
    assert hit / (hit + wrong) > 0.97 and hit / (hit + missed) > 0.97


def test_viterbi_is_the_best_of_all_tags():
    f = s.trained()
    tokens = ["token", "=", "aB3dE6gH9jK2", "mN5pQ8rS1tU4", "word"]

    def score(tags):
        total = 0.0
        for k, (t, tag) in enumerate(zip(tokens, tags, strict=True)):
            e = f.emission(t, [*s.around(tokens[max(0, k - 2) : k], tokens[k + 1] if k + 1 < len(tokens) else None), "words1"])
            total += e[tag] + (f.start[tag] if k == 0 else f.steps[tags[k - 1]][tag])
        return total

    best = max(itertools.product(range(3), repeat=len(tokens)), key=score)
    assert list(best) == f.tags(tokens, ["words1"])


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in op8_secret_scan(spark, DATA).collect():
        b = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(b.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(b.count(f"{k}:") for k in ("assign", "access", "hex"))


def test_letters_only_and_short_secrets_by_their_context(make):
    """Lines that no generator of the field has made: letters only, or eight characters, after words the base patterns don't know."""
    r = random.Random(11)
    scanner, hit, wrong, n = s.Scanner(s.trained()), 0, 0, 0
    leads = ["export PGPASS_pwd = '{}'", "passphrase: {} # rotate", "auth: {}", "credentials = \"{}\"", "Authorization: Bearer {}", "private_key: {}", "db pwd={} host=local"]
    for k in range(280):
        letters = string.ascii_letters if k % 2 else string.ascii_lowercase
        value = "".join(r.choice(letters + (string.digits if k % 3 == 0 else "")) for _ in range(r.randint(8, 20)))
        line = leads[k % len(leads)]
        text = f"{make(30)}\n{line.format(value)}\n{make(30)}"
        hit += any(value in text[b:e] for b, _, e in scanner.added(text))
        plain = f"{make(30)} {line.format(make(1))} {make(30)}"
        wrong += bool(scanner.added(plain))
        n += 1
    assert hit >= 0.9 * n and wrong <= 0.1 * n, (hit, wrong, n)


def test_stretches_are_decoded_as_whole_texts_are(make):
    """Leaving out words that can be no part of a secret changes nothing against decoding every token of the text."""
    field = s.trained()
    scanner = s.Scanner(field)
    for value in ("ghp_aB3dE6gH9jK2mN5pQ8rS1tU4", "qwrtzkplmvx", "f" * 40, "nothing"):
        text = f"{make(40)} pwd = {value} {make(10)}\nkey: '{value}' {make(30)} {value}."
        tokens = [(m.start(), m[0]) for m in s.TOKEN.finditer(text)]
        want, inside = [], False
        for (b, t), tag in zip(tokens, field.tags([t for _, t in tokens], s.file_features(text.split())), strict=True):
            if tag == s.B:
                want.append((b, "crf", b + len(t)))
            elif tag == s.I and inside:
                want[-1] = (want[-1][0], "crf", b + len(t))
            inside = tag != s.O
        assert scanner.added(text) == want


def test_signatures_decide_the_shape(spark):
    """Words of one signature have the same features."""
    seen = {}
    for row in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        for token in s.TOKEN.findall(row.text or ""):
            if (sign := s.signature(token)) is not None:
                assert seen.setdefault(sign, sorted(s.shape(token))) == sorted(s.shape(token)), token
    assert len(seen) > 100
