"""Personal data: fixed patterns, and a linear-chain conditional random field for secrets.

The field labels the tokens of a line as O (nothing), K (a word that announces a
secret), P (what joins it to the value) or V (the secret value) by features of word
shape, and is trained on a small labelled table. Lines that hold no announcing word,
no digit and no long run of characters need no decoding; the others are decoded by
Viterbi in numpy, many lines at a time. Adjacent values are one span, up to white space,
a quote, a bracket, & or a mark that ends a clause.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache, partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The kind that the field adds.
ADDED = "secret"
LABELS = "OKPV"
#: Lines of the labelled table, and its seed.
TRAINING_LINES, TRAINING_SEED = 1000, 7
#: Tokens decoded together, at most about; a longer line is decoded in parts of LINE_TOKENS,
#: each with so many tokens before it as context.
BATCH_TOKENS, LINE_TOKENS, CONTEXT_TOKENS = 1 << 16, 4096, 32

_EMAIL_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: What a token must hold to be a value.
_VALUE = re.compile(r"\w")
#: What a line without an announcing word must hold to be decoded.
_SHAPE = re.compile(r"[0-9]|[^\s\"'`]{16}")


def _digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def _luhn(digits: list[int]) -> bool:
    doubled = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(doubled) + sum(digits[-1::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the fixed patterns, leftmost and non-overlapping in each kind, in order.

    A match that fails its test (parts at most 255; 12 to 19 digits and Luhn's sum;
    9 to 15 digits) is dropped and its text not tried again.
    """
    out = []
    if "@" in text:
        for run in _EMAIL_RUN.finditer(text):  # an address lies within such a run
            start, at = run.start(), text.find("@", run.start(), run.end())
            while at >= 0:  # all that precedes it, back to the last @ or address, is the local part
                found = _DOMAIN.match(text, at + 1, run.end()) if at > start else None
                if found:
                    out.append((start, 0, found.end()))
                start = found.end() if found else at + 1
                at = text.find("@", start, run.end())
    if _DIGIT.search(text):
        for run in _DOTTED.finditer(text):  # four parts at a time, as the pattern takes them
            at, parts = run.start(), run[0].split(".")
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = at + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                    out.append((at, 1, end))
                at = end + 1
        for m in _CARD.finditer(text):
            if 12 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- the field's features

#: What stands between quotes without a space; words joined by marks; single marks.
_TOKEN = re.compile(r"(?<=[\"'`])[^\s\"'`]++(?=[\"'`])|[+/]?\w+(?:[-+/.~@!#$%^*?]+\w+)*|[^\w\s]")
#: What belongs to a value after its last token.
_REST = re.compile(r"[^\s\"'`,;.:()\[\]{}<>&]*")
#: Words that may announce a secret, in lower case; the field learns what they are worth.
ANNOUNCING = frozenset(("password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "auth", "credential", "access_key", "secret_key", "access_token"))
#: Each of them holds one of these.
_STEMS = ("key", "token", "secret", "pass", "pwd", "auth", "credential")
_CLASSES = ("word", "announcing", "=", ":", "quote", "mark", "digits", "mixed", "none")
#: Starts of common access keys.
PREFIXES = ("AKIA", "ASIA", "ghp_", "xoxb", "AIza", "sk-", "eyJ")
_STARTS = re.compile("|".join(PREFIXES))
_PARTED = re.compile(r"[-._]")
_MARK = re.compile(r"[^\w]")
_HUMPS = re.compile(r"[a-zß-ÿ][A-Z]")
_HEX = re.compile(r"[0-9a-f]+\Z|[0-9A-F]+\Z")
_RUNS = re.compile(r"[0-9]+|[^0-9]+")
FEATURES = 1 << 10


def _class(token: str) -> int:
    """Class of a token as its neighbours see it."""
    if token.lower() in ANNOUNCING or _PARTED.split(token.lower())[-1] in ANNOUNCING:
        return 1
    if token in ("=", ":"):
        return 2 + (token == ":")
    if token in "\"'`":
        return 4
    if not _VALUE.search(token):
        return 5
    return (6 if token.lower() == token.upper() else 7) if _DIGIT.search(token) else 0


def _announces(line: str) -> bool:
    low = line.lower()
    return any(w in low for w in _STEMS)


def _length(n: int) -> int:
    return next((i for i, most in enumerate((1, 3, 7, 11, 15, 20, 32, 48, 80)) if n <= most), 9)


def _own_features(token: str) -> list[int]:
    """Features of a token's own shape, as indices below FEATURES."""
    upper, lower, digit = token != token.lower(), token != token.upper(), bool(_DIGIT.search(token))
    kinds = upper + 2 * lower + 4 * digit
    length = _length(len(token))
    runs = min(5, len(list(islice(_RUNS.finditer(token), 6))))
    hexed, start, found = bool(_HEX.match(token)), _STARTS.match(token), set(_MARK.findall(token))
    marks = ("." in found) + 2 * ("@" in found) + 4 * ("/" in found) + 8 * bool(found - set("./@"))
    return [_class(token), 16 + kinds, 32 + length, 64 + kinds * 16 + length, 256 + kinds * 8 + runs, 384 + hexed * 16 + length, 448 + hexed * 128 + length * 8 + runs, 900 + (PREFIXES.index(start[0]) + 1 if start else 0), 920 + marks, 940 + min(3, len(list(islice(_HUMPS.finditer(token), 3)))) * 10 + length]


#: Offsets of the neighbours whose class counts, each with a range of features of its own.
_NEIGHBOURS = {-1: 800, -2: 816, -3: 832, 1: 848}
_NONE = _CLASSES.index("none")


def labelled_table(lines: int = TRAINING_LINES, seed: int = TRAINING_SEED) -> list[tuple[list[str], str]]:
    """The labelled table: tokens of a line, one label each. Invented lines; about half hold a secret."""
    r = random.Random(seed)
    low, hexa, mixed = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))

    def digital(chars, n):
        text = some(chars, n)
        return text if _DIGIT.search(text) else text[:-1] + "7"

    def word():
        w = some("abcdefghijklmnopqrstuvwxyzéèäüñ", r.randint(1, 11))
        return r.choice((w, w, w, w.capitalize(), w.upper() if r.random() < 0.2 else w)) + r.choice(("", "", "", "", ",", "."))

    def prose():
        return [(word(), "O") for _ in range(r.randint(0, 9))]

    def harmless():
        n = lambda a, b: str(r.randint(a, b))
        return r.choice((
            ".".join(n(1, 255) for _ in range(4)), f"+1 ({n(200, 999)}) 555-{n(1000, 9999)}", n(10**15, 10**16 - 1), f"{n(1, 31)}.{n(1, 12)}.{n(1900, 2030)}",
            f"version {n(1, 20)}.{n(0, 9)}", f"{n(1, 999)}", f"{n(1, 99)}th", f"{some('ABC', 1)}{n(1, 999)}", f"{some(hexa[10:], 3)}.{n(10, 99)}@mail{n(0, 9)}.example.com",
            f"http://www.example.com/{n(1, 999)}.html?page={n(1, 9)}", f"{n(1, 9)},{n(100, 999)},{n(100, 999)}", f"size = {n(1, 9999)}", f"page: {n(1, 500)}", f"the key {n(1, 9)}",
            f"token {n(1, 99)}", f"id={n(1, 99999)}", f"{n(10, 99)}%", f"{n(1, 12)}:{n(10, 59)}", f"ISBN {n(10**9, 10**10 - 1)}", f"x{n(1, 9)} = \"{n(1, 99)}\"", some(mixed[26:], 4) + some("abc", 4), some(mixed[:26], r.randint(12, 24)),
            f"{some(low, 5)}-{some(low, 6)}", f"{some(low, 4)}/{some(low, 5)}-{some(low, 3)}.txt", some(low, r.randint(12, 30)), f"{n(1990, 2030)}-{n(10, 12)}-{n(10, 28)}", f"a {some(low, 4)} token {some(low, 5)}", f"the key word {some(low, 6)}",
            f"password {some(low, 5)}", f"{some(low, 5)}: {some(low, 6)}", f"{some(low, 4)} = \"{some(low, 8)}\"", f"{some(low, 3).capitalize()}{some(low, 5).capitalize()}",
        ))

    def secret():
        kind, every = r.randrange(5), r.choice((mixed + low + "0189", mixed + low + "0189", mixed[:26] + low))
        part = lambda a, b: some(every, r.randint(a, b))
        if kind == 0:
            return [(r.choice((
                "AKIA" + some(mixed, 16), "AKIA" + some(mixed, 16), "ASIA" + some(mixed, 16), "ghp_" + part(30, 36), f"xoxb-{r.randint(10**9, 10**12)}-{part(16, 24)}", "sk-" + part(20, 48),
                "AIza" + part(30, 35), f"eyJ{part(14, 30)}.eyJ{part(14, 60)}.{part(20, 43)}",
            )), "V")]
        name = r.choice(sorted(ANNOUNCING))
        name = r.choice((name, name, name.upper(), name.capitalize()))
        value = digital(hexa, r.choice((16, 18, 24, 32, 40, 64))) if kind == 1 or r.random() < 0.6 else digital(hexa + "ghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", r.randint(10, 44))
        if kind > 2:
            words = [some(low, r.randint(3, 8)) for _ in range(r.randint(1, 4))]
            value = r.choice((
                "".join(words), words[0] + "".join(w.capitalize() for w in words[1:]), "-".join(words), "-".join(w.capitalize() for w in words) + some("0123456789", 1), r.choice(".+/_!#$%").join(words),
                some(every, 10) + "/" + some(every, 12) + "+" + some(every, 9), some(mixed[:26], 14),
            ))
        quote = r.choice(("", '"', '"', "'"))
        join = r.choice(("=", "=", ":"))
        marks = [(join, "P")] + [(quote, "P")] * bool(quote)
        return [(name, "K"), *marks, (value, "V")] + [(quote, "O")] * bool(quote)

    table = []
    for i in range(lines):
        parts = prose()
        for _ in range(r.randint(1, 2)):
            parts += (secret() if i % 2 else [(harmless(), "O")]) + prose()
        tokens, labels = [], ""
        for text, label in parts:
            own = [text] if label == "V" else _TOKEN.findall(text)
            tokens += own
            labels += label * len(own)
        if tokens:
            table.append((tokens, labels))
    return table


class Field:
    """A linear-chain conditional random field: weights (feature, label), steps (label, label) and firsts (label)."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray, firsts: np.ndarray):
        self.weights, self.steps, self.firsts = weights, steps, firsts

    @staticmethod
    def features(tokens: list[str], known: dict[str, tuple[list[int], int]]) -> np.ndarray:
        """Indices of each token's features, a row each."""
        for t in tokens:
            if t not in known:
                known[t] = _own_features(t), _class(t)
        own = np.array([known[t][0] for t in tokens])
        classes = np.array([_NONE] * 3 + [known[t][1] for t in tokens] + [_NONE])
        n = len(tokens)
        return np.hstack([own, *[(first + classes[3 + at : 3 + at + n])[:, None] for at, first in _NEIGHBOURS.items()]])

    def emissions(self, features: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Scores (token, label); V is barred where value is false."""
        out = self.weights[features].sum(1)
        out[~value, LABELS.index("V")] = -1e9
        return out

    def viterbi(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of each line, from its scores (token, label); all lines go together, step by step."""
        order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
        lengths = np.array([len(scores[i]) for i in order])
        best = self.firsts + np.array([scores[i][0] for i in order])
        back = []
        for t in range(1, lengths[0]):
            n = int(np.searchsorted(-lengths, -t, side="left"))  # lines that go on
            ways = best[:n, :, None] + self.steps
            back.append(ways.argmax(1))
            best[:n] = ways.max(1) + np.array([scores[i][t] for i in order[:n]])
        out: list[np.ndarray] = [np.zeros(0, int)] * len(scores)
        for row, i in enumerate(order):
            labels = [int(best[row].argmax())]
            for t in range(len(scores[i]) - 2, -1, -1):
                labels.append(int(back[t][row, labels[-1]]))
            out[i] = np.array(labels[::-1])
        return out


def train(table: list[tuple[list[str], str]], rounds: int = 100, rate: float = 0.15, decay: float = 2e-4) -> Field:
    """Maximum likelihood by Adam over the whole table; forward-backward runs on all lines at once."""
    L, n, longest = len(LABELS), len(table), max(len(t) for t, _ in table)
    known: dict = {}
    feats = [Field.features(t, known) for t, _ in table]
    x = np.zeros((n, longest, feats[0].shape[1]), int)
    y = np.zeros((n, longest), int)
    mask = np.zeros((n, longest), bool)
    barred = np.zeros((n, longest), bool)
    for i, (tokens, labels) in enumerate(table):
        k = len(tokens)
        x[i, :k], mask[i, :k] = feats[i], True
        y[i, :k] = [LABELS.index(c) for c in labels]
        barred[i, :k] = [not _VALUE.search(t) for t in tokens]
    last = mask.sum(1) - 1
    params = [np.zeros((FEATURES, L)), np.zeros((L, L)), np.zeros(L)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    gold = np.eye(L)[y] * mask[..., None]
    lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
    for step in range(1, rounds + 1):
        w, steps, firsts = params
        e = w[x].sum(2)
        e[barred, LABELS.index("V")] = -1e9
        alpha, beta = np.zeros((n, longest, L)), np.zeros((n, longest, L))
        alpha[:, 0] = firsts + e[:, 0]
        for t in range(1, longest):
            alpha[:, t] = np.where(mask[:, t, None], lse(alpha[:, t - 1, :, None] + steps, 1) + e[:, t], alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(mask[:, t + 1, None], lse(steps + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        z = lse(alpha[np.arange(n), last], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + steps + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        grad = np.zeros_like(w)
        np.add.at(grad, x[mask], (gold - p)[mask][:, None, :])
        grads = [grad, np.einsum("itk,itl->kl", gold[:, :-1], gold[:, 1:]) - pair.sum((0, 1)), (gold - p)[:, 0].sum(0)]
        for i, g in enumerate(grads):
            g = g / n - decay * params[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] + rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Field(*params)


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_table())


def secret_spans(texts: list[str], field: Field) -> list[list[tuple[int, int]]]:
    """(start, end) of the values that the field labels V in each text; lines are decoded together."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    known: dict = {}
    waiting: list[tuple[int, list[tuple[int, int]], np.ndarray, int]] = []

    def decode():
        for (i, spans, _, seen), labels in zip(waiting, field.viterbi([s for _, _, s, _ in waiting]) if waiting else []):
            last = out[i][-1][1] if out[i] else -1
            for k in np.flatnonzero(labels == LABELS.index("V")):
                if k < seen:  # context
                    continue
                start, end = spans[k]
                end = _REST.match(texts[i], end).end()
                if start <= last:
                    start, end = out[i].pop()[0], max(end, last)
                out[i].append((start, end))
                last = end
        waiting.clear()

    n = 0
    for i, text in enumerate(texts):
        at = 0
        for line in text.split("\n"):
            if _SHAPE.search(line) or _announces(line):
                found, before = _TOKEN.finditer(line), []
                while part := list(islice(found, LINE_TOKENS)):
                    part = before + part
                    tokens = [m[0] for m in part]
                    scores = field.emissions(field.features(tokens, known), np.array([bool(_VALUE.search(t)) for t in tokens]))
                    waiting.append((i, [(at + m.start(), at + m.end()) for m in part], scores, len(before)))
                    before, n = part[-CONTEXT_TOKENS:], n + len(part)
                    if n >= BATCH_TOKENS:
                        decode()
                        n = 0
                    if len(known) > 100_000:
                        known.clear()
            at += len(line) + 1
    decode()
    return [sorted(x) for x in out]


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_secret long, n_spans long, base_sha256 string, spans string"


def _told(spans: list[tuple[int, int, int]]) -> str:
    names = (*KINDS, ADDED)
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)


def _find(batches, field: Field):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        texts = [x or "" for x in batch.column("text").to_pylist()]
        rows = []
        for text, secrets in zip(texts, secret_spans(texts, field)):
            base = base_spans(text)
            every = sorted(base + [(a, len(KINDS), b) for a, b in secrets])
            counts = [sum(k == kind for _, kind, _ in every) for k in range(len(KINDS) + 1)]
            rows.append((*counts, len(every), hashlib.sha256(_told(base).encode()).hexdigest(), _told(every)))
        columns = list(zip(*rows)) if rows else [()] * 8
        arrays = [pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(c, pa.string()) for c in columns[6:]]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=names)


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """A row of SCHEMA for each row of docs(doc_id, text).

    spans: kind:start:end in code points, end exclusive, by start, then kind; the
    fixed patterns' always, and the field's as kind secret. base_sha256 covers the
    fixed patterns' alone; n_spans counts all. Null text: empty, without spans. Null and repeated doc_ids
    are rows like others. A long text is searched whole, a line of over LINE_TOKENS tokens in parts that overlap.
    An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_find, field=field or default_field()), SCHEMA)


def op6_pii_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
