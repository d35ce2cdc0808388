"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

The field tags tokens as begin, inside or outside of a secret from a token's own shape, its neighbouring
words and features of the whole file; the tags are decoded by Viterbi. It is trained here, in numpy, on
lines made by a seeded generator, so that it is the same at every size of input.

Any token can be tagged; what decides is the field. A secret adds to the score of its text only if one of
its tokens gains more by being inside than all steps between tags can cost. So words are first weighed by
the field's own scores, remembered by word: those whose gain, with what neighbours of their kind can add
at most, stays below that are no part of a secret by themselves, and only stretches around the others are
decoded, with ``MARGIN`` words on either side.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from functools import cache
from operator import add
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import KEY, extended, held, slices, without

KINDS = ["assign", "access", "hex", "crf"]
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
OWN = ["n_assign", "n_access", "n_hex", "base", "spans"]
SLICE = 4 << 20
MEMO = 300_000

B, I, O = 0, 1, 2  # noqa: E741
TOKEN = re.compile(r"[\w./+\-~%@]+(?:={1,2}(?![\w=]))?|[:=]|[^\s\w]")
CHUNK = re.compile(r"\S+")
KEYWORDS = {"password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "accesskey", "auth", "authorization", "bearer", "credential", "credentials", "private_key", "client_secret", "aws_secret_access_key", "key", "passphrase", "pass"}
#: Pairs of letters that are frequent in words of European languages.
COMMON = set("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ei ie un ge la el qu au ca ta os do ad ci ón sc ke lo us ai ui eu".split())
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk_live_", "sk_test_", "sk-", "pk_live_", "xoxb-", "xoxp-", "AIza", "eyJ", "npm_", "hf_", "SG.")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping for each kind."""
    out = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "key" in low:
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return out + [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]


def strong(token: str) -> bool:
    """Long, or with digits: a feature, and no more than that."""
    n = len(token)
    return n >= 20 or n >= 8 and any("0" <= c <= "9" for c in token)


def bucket(x: float, edges: tuple) -> int:
    return sum(x >= e for e in edges)


def shape(token: str) -> list[str]:
    """A token's own features."""
    n = len(token)
    lower, upper, digit = (sum(map(f, token)) for f in (str.islower, str.isupper, str.isdigit))
    mark = n - lower - upper - digit
    turns = sum((a.isdigit() != b.isdigit()) or (a.isupper() and b.islower() and k) for k, (a, b) in enumerate(zip(token, token[1:], strict=False)))
    out = [f"len{bucket(n, (2, 4, 6, 8, 12, 16, 20, 32, 40, 64))}", f"mix{(lower > 0) * 4 + (upper > 0) * 2 + (digit > 0)}", f"marks{bucket(mark / n, (0.01, 0.1, 0.2))}", f"digits{bucket(digit / n, (0.01, 0.15, 0.3, 0.5, 0.99))}", f"turns{bucket(turns / n, (0.05, 0.15, 0.3))}", f"variety{bucket(len(set(token)) / n, (0.3, 0.5, 0.75))}"]
    if strong(token):
        out.append("strong")
    if lower + upper == n and n >= 6:
        vowels = sum(c in "aeiouyáéíóúäöüèêàçñAEIOUY" for c in token)
        hard = max((len(x) for x in re.findall(r"[^aeiouyáéíóúäöüèêàAEIOUY]+", token)), default=0)
        rare = sum(c in "qxzjkwvyQXZJKWVY" for c in token)
        pairs = sum(token[k : k + 2].lower() in COMMON for k in range(n - 1)) / (n - 1)
        out += [f"pairs{bucket(pairs, (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6))}", f"vowels{bucket(vowels / n, (0.1, 0.2, 0.3, 0.5, 0.6))}", f"hard{bucket(hard, (3, 4, 5, 6, 8))}", f"rare{bucket(rare / n, (0.01, 0.1, 0.2, 0.3))}"]
        if any(a.islower() and b.isupper() for a, b in zip(token, token[1:], strict=False)):
            out.append("humped")
    if token.lower().strip("-_.") in KEYWORDS:
        out.append("keyword")
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", token):
        out.append("hexlike")
    if re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", token):
        out.append("base64like")
    for name, sign in (("at", "@"), ("slash", "/"), ("dot", "."), ("dash", "-"), ("percent", "%")):
        if sign in token:
            out.append(name)
    if any(ord(c) > 127 for c in token):
        out.append("beyond")
    if re.fullmatch(r"[\d.,/:\-+%]+", token):
        out.append("number")
    if re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", token):
        out.append("uuid")
    if token.startswith(PREFIXES):
        out.append("prefix")
    if re.search(r"\.[a-z]{2,5}$", token):
        out.append("suffix")
    return out


_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]?[a-zß-öø-ÿ]+)(\.?)")
_HARD = re.compile(r"[^aeiouyáéíóúäöüèêàAEIOUY]+")
_NO_VOWELS, _NO_RARE = str.maketrans("", "", "aeiouyáéíóúäöüèêàçñAEIOUY"), str.maketrans("", "", "qxzjkwvyQXZJKWVY")
_LENGTHS = (2, 4, 6, 8, 12, 16, 20, 32, 40, 64)


def signature(token: str) -> tuple | None:
    """For plain words, with a capital and a full stop or without: what their features depend on, so that words alike in it
    have the same ``shape``. None for all other tokens."""
    m = _WORD.fullmatch(token)
    if m is None or len(token) < 2 or m[1].lower() in KEYWORDS or token.startswith(PREFIXES):
        return None
    n = len(token)
    case, varied, plain = token[0].isupper(), bisect_right((0.3, 0.5, 0.75), len(set(token)) / n), token.isascii()
    if m[2]:
        return bisect_right(_LENGTHS, n), case, varied, plain, bisect_right((0.01, 0.1, 0.2), 1 / n)
    hexlike = not case and not token.strip("abcdef")
    if n < 6:
        return bisect_right(_LENGTHS, n), case, varied, plain, hexlike, None
    low = token.lower()
    pairs = sum(map(COMMON.__contains__, map(add, low, low[1:]))) / (n - 1)
    return (
        bisect_right(_LENGTHS, n), case, varied, plain, hexlike, bisect_right((0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6), pairs), bisect_right((0.1, 0.2, 0.3, 0.5, 0.6), (n - len(token.translate(_NO_VOWELS))) / n),
        bisect_right((3, 4, 5, 6, 8), max(map(len, _HARD.findall(token)), default=0)), bisect_right((0.01, 0.1, 0.2, 0.3), (n - len(token.translate(_NO_RARE))) / n),
    )


def around(before: list[str], after: str | None) -> list[str]:
    """Features of up to two tokens before and one after."""
    out = []
    near = [t.lower().strip("-_.") for t in before[-2:]]
    if near and near[-1] in KEYWORDS:
        out.append("after-keyword")
    if len(near) == 2 and near[0] in KEYWORDS and near[1] in (":", "="):
        out.append("assigned")
    if before and before[-1] in (":", "="):
        out.append("after-sign")
    if before and before[-1] in "\"'`":
        out.append("after-quote")
    if before and strong(before[-1]):
        out.append("after-strong")
    if after is not None and after in "\"'`":
        out.append("before-quote")
    if after is None:
        out.append("last")
    return out


def file_features(chunks: list[str]) -> list[str]:
    """Features of a whole file: how much of it looks like settings, and its length."""
    n = max(1, len(chunks))
    whole = " ".join(chunks) + " "
    # Words with a sign in them, or a colon behind; most files hold neither.
    signs = sum("=" in c or c.endswith(":") for c in chunks) if "=" in whole or ": " in whole else 0
    return [f"settings{bucket(signs / n, (0.002, 0.02, 0.1))}", f"words{bucket(n, (10, 100, 1000))}"]


def made_lines(seed: int = 7, each: int = 20) -> list[list[tuple[str, int]]]:
    """Lines of tokens with their tags, of every kind of secret and of what resembles one."""
    r = random.Random(seed)
    low, alnum, upper, hexa = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef"
    syllables = "th er on an re ti es nd st en at ion ed ing le de la ment eau que ción ado sch ung keit lich be ver é ü ñ or ha ou tz pf wh ly ch ß ö cks ght lt ck mp rst str".split()

    def some(of: str, n: int) -> str:
        return "".join(r.choice(of) for _ in range(n))

    def word() -> str:
        return "".join(r.choice(syllables) for _ in range(r.randint(1, 5)))

    def prose(n: int) -> list[tuple[str, int]]:
        shaped = lambda w: w.capitalize() if (x := r.random()) < 0.2 else w.upper() if x < 0.23 else w
        return [(shaped(word()) if r.random() < 0.9 else r.choice(".,:|"), O) for _ in range(n)]

    def marked(text: str, tag: int) -> list[tuple[str, int]]:
        tokens = TOKEN.findall(text)
        return [(t, tag if k == 0 or tag == O else I) for k, t in enumerate(tokens)]

    secrets = [
        lambda: r.choice(PREFIXES[3:9]) + some(alnum, r.randint(20, 40)),
        lambda: "AKIA" + some(upper, 16),
        lambda: some(hexa, r.choice([16, 20, 32, 40, 64])),
        lambda: some(alnum + "+/", r.choice([24, 32, 40, 44])) + r.choice(["", "=", "=="]),
        lambda: "eyJ" + some(alnum, 20) + "." + some(alnum, 40) + "." + some(alnum, 30),
        lambda: some(alnum, r.randint(12, 30)),
        lambda: "xoxb-" + some("0123456789", 11) + "-" + some(alnum, 24),
        lambda: some(low, r.randint(8, 20)),
        lambda: some(low + low.upper(), r.randint(8, 24)),
        lambda: some(alnum, r.randint(8, 12)),
    ]
    secrets += secrets[7:9] * 2  # letters only: the hardest to tell from words
    alone = [secrets[0], secrets[1], secrets[4], secrets[6], lambda: some(hexa, r.choice([40, 64])), lambda: some(alnum + "+/", r.choice([40, 44, 64]))]
    other = [
        lambda: f"{some(low, 6)}.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com",
        lambda: f"https://{word()}.example.org/{r.choice(['en', 'fr'])}/{r.randint(1, 99999)}",
        lambda: f"20{r.randint(10, 29)}-0{r.randint(1, 9)}-{r.randint(10, 28)}",
        lambda: f"+{r.randint(1, 99)}-{r.randint(100, 999)}-{r.randint(1000000, 9999999)}",
        lambda: f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}",
        lambda: f"/usr/lib/python3.{r.randint(1, 13)}/{word()}/{word()}{r.randint(0, 9)}.py",
        lambda: f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}-rc{r.randint(1, 5)}",
        lambda: "-".join([some(hexa, 8), some(hexa, 4), some(hexa, 4), some(hexa, 4), some(hexa, 12)]),
        lambda: str(r.randint(10_000_000, 10**15)),
        lambda: "".join(r.choice(syllables) for _ in range(r.randint(9, 16))),
        lambda: r.choice("=-_.*#") * r.randint(20, 60),
        lambda: word().capitalize() + word().capitalize() + word().capitalize() + str(r.randint(1, 2030)),
        lambda: f"{r.randint(1, 30)}/{r.randint(1, 12)}/{r.randint(1990, 2030)}",
        lambda: f"{word()}_{word()}_{word()}_{r.randint(1, 999)}",
        lambda: f"www.{word()}{word()}.example.net/{word()}/{r.randint(1, 999)}.html",
    ]
    lines: list[list[tuple[str, int]]] = []
    keys = sorted(KEYWORDS)
    for make in secrets:
        for _ in range(each):
            key, sign, quote = r.choice(keys), r.choice([":", "="]), r.choice(["", '"', "'"])
            lines.append([*prose(r.randint(0, 5)), (key if r.random() < 0.7 else key.upper(), O), (sign, O), *([(quote, O)] if quote else []), *marked(make(), B), *([(quote, O)] if quote else []), *prose(r.randint(0, 4))])
            lead = [("Authorization", O), (":", O)] if r.random() < 0.5 else prose(2)
            lines.append([*lead, (r.choice(["Bearer", "bearer", "token", "key"]), O), *marked(make(), B), *prose(r.randint(0, 5))])
    for _ in range(12 * each):  # what stands after such words in prose
        key, sign = r.choice(keys), r.choice([":", "=", "is", "of", ","])
        lines.append([*prose(r.randint(0, 5)), (key, O), (sign, O), *prose(r.randint(1, 8))])
    for make in alone:
        for _ in range(each):
            lines.append([*prose(r.randint(0, 6)), *marked(make(), B), *prose(r.randint(0, 6))])
    for _ in range(each):
        rows = [some(alnum + "+/", 64) for _ in range(r.randint(2, 5))]
        lines.append([("KEY", O), ("-----", O), *[(t, B if k == 0 else I) for k, t in enumerate(rows)], ("-----END", O)])
    for make in other:
        for _ in range(2 * each):
            lead = [(r.choice([*keys, word(), word()]), O), (r.choice([":", "of", "is"]), O)] if r.random() < 0.2 else []
            lines.append([*prose(r.randint(0, 5)), *lead, *marked(make(), O), *prose(r.randint(0, 5))])
    for _ in range(12 * each):
        lines.append(prose(r.randint(3, 14)))
    return lines


class Field:
    """Weights of features (three each) and of transitions between tags."""

    def __init__(self, weights: dict[str, tuple[float, float, float]], steps: list[list[float]], start: list[float]):
        self.weights, self.steps, self.start = weights, steps, start
        self.own: dict[str, list[float]] = {}
        #: Own scores by signature: as many as there are combinations of its buckets at most.
        self.alike: dict[tuple, list[float]] = {}
        #: The most that the steps to a token inside, and from it, can be better than those outside.
        self.slack = max(0.0, *(max(steps[a][y] for a in range(3)) + max(steps[y]) for y in (B, I))) - 2 * min(0.0, steps[O][O]) + max(0.0, *(x - start[O] for x in start))

    def emission(self, token: str, context: list[str]) -> list[float]:
        if (own := self.own.get(token)) is None:
            sign = signature(token)
            if sign is None or (own := self.alike.get(sign)) is None:
                own = [sum(self.weights.get(f, (0, 0, 0))[k] for f in shape(token)) for k in range(3)]
                if sign is not None:
                    self.alike[sign] = own
            if sign is None and len(token) <= KEY:
                if len(self.own) > MEMO:
                    self.own.clear()
                self.own[token] = own
        if not context:
            return own
        return [own[k] + sum(self.weights.get(f, (0, 0, 0))[k] for f in context) for k in range(3)]

    def tags(self, tokens: list[str], file: list[str], lead: bool = True) -> list[int]:
        """The best tags (Viterbi) of a stretch of tokens; without ``lead`` it follows one that is outside."""
        back, best = [], None
        for k, t in enumerate(tokens):
            e = self.emission(t, [*around(tokens[max(0, k - 2) : k], tokens[k + 1] if k + 1 < len(tokens) else None), *file])
            if best is None:
                best = [s + x for s, x in zip(self.start if lead else self.steps[O], e, strict=True)]
                continue
            came = [max(range(3), key=lambda a, b=b, best=best: best[a] + self.steps[a][b]) for b in range(3)]
            back.append(came)
            best = [best[came[b]] + self.steps[came[b]][b] + e[b] for b in range(3)]
        tag = max(range(3), key=lambda b: best[b])
        out = [tag]
        for came in reversed(back):
            out.append(tag := came[tag])
        return out[::-1]


@cache
def trained(seed: int = 7, rounds: int = 80) -> Field:
    """A field fitted to the made lines by penalised likelihood, with Adam on all lines at once."""
    lines = made_lines(seed)
    names: dict[str, int] = {}
    n, longest = len(lines), max(map(len, lines))
    which, rows = [], []
    tags, there = np.full((n, longest), O), np.zeros((n, longest), bool)
    r = random.Random(seed)
    for a, line in enumerate(lines):
        tokens = [t for t, _ in line]
        # A line stands for a file of some length; how much of it are settings follows the line.
        signs = sum(t == "=" for t in tokens)
        file = [f"settings{r.choice([0, 1, 2, 3] if signs else [0, 0, 1])}", f"words{r.randint(0, 3)}"]
        for k, (t, tag) in enumerate(line):
            there[a, k], tags[a, k] = True, tag
            for f in {*shape(t), *around(tokens[max(0, k - 2) : k], tokens[k + 1] if k + 1 < len(tokens) else None), *file}:
                rows.append(a * longest + k)
                which.append(names.setdefault(f, len(names)))
    x = np.zeros((n * longest, len(names)), np.float32)
    x[rows, which] = 1
    used = np.flatnonzero(x.any(1))
    x = x[used]
    w, step, start = np.zeros((len(names), 3)), np.zeros((3, 3)), np.zeros(3)
    params = [w, step, start]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    hot = np.eye(3)[tags] * there[:, :, None]
    for turn in range(1, rounds + 1):
        e = np.zeros((n * longest, 3))
        e[used] = x @ w
        e = e.reshape(n, longest, 3)
        left = np.zeros((n, longest, 3))
        right = np.zeros((n, longest, 3))
        left[:, 0] = e[:, 0] + start
        for k in range(1, longest):
            reach = np.logaddexp.reduce(left[:, k - 1, :, None] + step, axis=1) + e[:, k]
            left[:, k] = np.where(there[:, k, None], reach, left[:, k - 1])
        for k in range(longest - 2, -1, -1):
            reach = np.logaddexp.reduce(step + (e[:, k + 1] + right[:, k + 1])[:, None, :], axis=2)
            right[:, k] = np.where(there[:, k + 1, None], reach, 0.0)
        whole = np.logaddexp.reduce(left[:, -1], axis=1)
        single = np.exp(left + right - whole[:, None, None]) * there[:, :, None]
        g_e = (single - hot) / n
        pair = np.exp(left[:, :-1, :, None] + step + (e + right)[:, 1:, None, :] - whole[:, None, None, None]) * there[:, 1:, None, None]
        g = [x.T @ g_e.reshape(-1, 3)[used] + 1e-4 * w, (pair.sum((0, 1)) - np.einsum("nka,nkb->ab", hot[:, :-1], hot[:, 1:])) / n + 1e-4 * step, g_e[:, 0].sum(0) + 1e-4 * start]
        for p, gp, a, b in zip(params, g, m, v, strict=True):
            a += 0.1 * (gp - a)
            b += 0.001 * (gp * gp - b)
            p -= 0.1 * (a / (1 - 0.9**turn)) / (np.sqrt(b / (1 - 0.999**turn)) + 1e-8)
    step[O, I] = start[I] = -1e4  # inside follows begin or inside
    return Field({f: tuple(map(float, w[i])) for f, i in names.items()}, step.tolist(), start.tolist())


#: Words on either side of a possible part of a secret that are decoded with it.
MARGIN = 3
#: What draws a secret out of a token beside it.
_DRAWS = {":", "=", '"', "'", "`"}
_DRAWN = 1e6
#: A plain word, its full stop, another sign.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]?[a-zß-öø-ÿ]+)(?:(\.?)|([,;!?]))")


class Scanner:
    def __init__(self, field: Field):
        self.field = field
        most = lambda names: sum(max(0.0, max(w[:2]) - w[2]) for f in names if (w := field.weights.get(f)))
        #: The most that neighbours can add: those that draw, and any.
        self.drawn, self.any = most(["after-keyword", "assigned", "after-sign", "after-quote", "after-strong", "before-quote", "last"]), most(["last"])

        alone = {p: self.most(p) for p in ",;!?"}

        class Known(dict):
            """By word: the most that one of its tokens gains, and ``_DRAWN`` more if it draws a secret out of the next."""

            def __missing__(memo, chunk: str) -> float:
                found = None
                if len(chunk) < 20 and (m := _PLAIN.fullmatch(chunk)):  # a word with a sign or without, which draws nothing
                    e = field.alike.get(signature(m[1] + (m[2] or "")))
                    if e is not None:
                        found = max(e[B] - e[O], e[I] - e[O], alone.get(m[3], -1e9))
                if found is None:
                    tokens = TOKEN.findall(chunk)
                    found = max(map(self.most, tokens), default=-1e9)
                    if any(t in _DRAWS or strong(t) or t.lower().strip("-_.") in KEYWORDS for t in tokens):
                        # Tokens within a word are neighbours too.
                        found += _DRAWN + (self.drawn if len(tokens) > 1 else 0.0)
                if len(chunk) <= KEY:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[chunk] = found
                return found

        self.known = Known()

    def most(self, token: str) -> float:
        """What a token gains by being inside, by its own score."""
        e = self.field.emission(token, [])
        return max(e[B], e[I]) - e[O]

    def possible(self, chunks: list[str], file: list[str]) -> np.ndarray:
        """The words that may hold a token of a secret, given the best of neighbours."""
        gain = np.fromiter(map(self.known.__getitem__, chunks), float, len(chunks))
        draws = gain > _DRAWN / 2
        gain[draws] -= _DRAWN
        near = draws.copy()
        near[1:] |= draws[:-1]
        near[2:] |= draws[:-2]
        near[:-1] |= draws[1:]
        added = self.field.slack + sum(max(w[:2]) - w[2] for f in file if (w := self.field.weights.get(f)))
        return np.flatnonzero(gain + np.where(near, self.drawn, self.any) + added >= 0)

    def added(self, text: str) -> list[tuple[int, str, int]]:
        """(start, "crf", end) of the field's secrets."""
        chunks = text.split()
        if not chunks:
            return []
        file = file_features(chunks)
        seeds = self.possible(chunks, file)
        if not len(seeds):
            return []
        cuts = np.flatnonzero(np.diff(seeds) > 2 * MARGIN) + 1
        at = [(m.start(), m.end()) for m in CHUNK.finditer(text)]
        out: list[tuple[int, str, int]] = []
        for part in np.split(seeds, cuts):
            first, last = max(0, int(part[0]) - MARGIN), min(len(at) - 1, int(part[-1]) + MARGIN)
            begin, end = at[first][0], at[last][1]
            tokens = [(m.start() + begin, m[0]) for m in TOKEN.finditer(text[begin:end])]
            # A token past the stretch says no more than that there is one.
            tags = self.field.tags([t for _, t in tokens] + ([] if last == len(at) - 1 else ["."]), file, lead=first == 0)[: len(tokens)]
            inside = False
            for (s, t), tag in zip(tokens, tags, strict=True):
                if tag == B:
                    out.append((s, "crf", s + len(t)))
                elif tag == I and inside:
                    out[-1] = (out[-1][0], "crf", s + len(t))
                inside = tag != O
        return out


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{b}:{e}" for b, kind, e in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]))))


def scanned(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Each row with n_assign, n_access, n_hex, base and spans (``kind:start:end`` joined by commas).

    Spans are in code points, end exclusive, ordered by start and then by kind; ``base`` holds those of the
    fixed patterns, ``spans`` also the field's that overlap none of them. Whole texts are scanned; null and
    empty texts have no spans. Columns that clash with the results are replaced.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(trained())
    keep = without(docs, OWN)
    schema = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(c, T.LongType()) for c in OWN[:3]], *[T.StructField(c, T.StringType()) for c in OWN[3:]]])

    def run(batches, name=uuid4().hex):
        own = held(name, lambda: Scanner(sent.value))
        for batch, texts in slices(batches, text, SLICE):
            rows = []
            for t in texts:
                t = t.decode() if t else ""
                base = base_spans(t)
                more = [s for s in own.added(t) if all(s[2] <= b or e <= s[0] for b, _, e in base)]
                rows.append((*[sum(k == kind for _, k, _ in base) for kind in KINDS[:3]], joined(base), joined([*base, *more])))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield extended(batch, keep, {c: pa.array([r[i] for r in rows], kinds[i]) for i, c in enumerate(OWN)})

    return docs.select(*keep).mapInArrow(run, schema)


def digested(out: DataFrame) -> DataFrame:
    return out.withColumn("base_sha256", F.sha2("base", 256)).drop("base")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
