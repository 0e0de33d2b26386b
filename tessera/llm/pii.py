"""Personal data by base rules and a semi-Markov conditional random field.

The field segments each digit- or @-bearing run of text: every candidate segment (at most ``MOST_TOKENS`` tokens) is scored
as a whole, for each type, from features of the span, and a dynamic programme chooses boundaries and types jointly. Its
weights are fitted by maximum likelihood (forward-backward) on examples written by a fixed seeded grammar.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._arrow import annotate, field

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS = 16

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SHORT = re.compile(r"[0-9]{1,3}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octet(part: str) -> bool:
    """Digits worth at most 255, however many zeros come first."""
    value = part.lstrip("0")
    return len(value) < 3 or len(value) == 3 and value <= "255"


def base_matches(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start: per kind leftmost and non-overlapping, failing matches dropped."""
    out: list[tuple[str, int, int]] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# --- the field -------------------------------------------------------------------------------------------------------

_RUN = re.compile(r"[0-9@]\S*(?:[ ][+(]?[0-9]\S*)*")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s|.", re.S)
_WORD_BEFORE = re.compile(r"([A-Za-z]+)[^A-Za-z0-9]{0,3}\Z")
#: Words that announce a type.
_HINTS = {"mail": "email", "email": "email", "contact": "email", "ip": "ip", "host": "ip", "server": "ip", "address": "ip", "card": "card", "visa": "card", "tel": "phone", "phone": "phone", "call": "phone", "mobile": "phone", "fax": "phone"}


def runs(text: str) -> list[tuple[int, int]]:
    """The stretches that can hold an entity: words with a digit or @, with digit words that follow after one space."""
    out, done = [], 0
    for m in _RUN.finditer(text):
        start = m.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        if start >= 2 and text[start - 1] == " " and text[start - 2 : start - 1] == ")":  # an area code before it
            k = text.rfind("(", max(done, start - 8), start)
            start = k if k >= 0 else start
        out.append((start, m.end()))
        done = m.end()
    return out


def _features(text: str, a: int, b: int, hint: str | None) -> list[str]:
    """Of a whole candidate span, whatever its type."""
    s = text[a:b]
    digits = _digits(s)
    seps = "".join(sorted({c for c in s if not c.isalnum()}))
    alpha = any(c.isalpha() for c in s)
    parts = s.split(".")
    out = ["bias", f"digits={min(len(digits), 20)}", f"seps={seps[:6]}", f"alpha={alpha}", f"plus={s[0] == '+'}", f"at={s.count('@')}"]
    out.append(f"edge={a > 0 and (text[a - 1].isalnum() or text[a - 1] in '+@._%-')},{b < len(text) and (text[b].isalnum() or text[b] in '@_%')}")
    out.append("next=" + ("d" if re.match(r"[ .-]?[0-9]", text[b : b + 2]) else "o"))
    if not alpha and 13 <= len(digits) <= 19:
        out.append(f"luhn={luhn(digits)}")
    if len(parts) == 4 and not alpha:
        out.append(f"quad={all(_SHORT.fullmatch(p) and int(p) < 256 for p in parts)}")
    if s.count("@") == 1:
        name, host = s.split("@")
        out.append(f"mail={bool(name) and bool(re.fullmatch(r'[A-Za-z0-9-]+([.][A-Za-z0-9-]+)*[.][A-Za-z]{2,}', host))}")
    if not alpha and "@" not in s:
        out.append("groups=" + "-".join(str(len(g)) for g in re.findall(r"[0-9]+", s)[:6]))
    if hint:
        out.append(f"hint={hint}")
    return out


def _segments(text: str, a: int, b: int) -> tuple[list[int], list[tuple[int, int, list[str]]]]:
    """Token bounds of the run, and its candidate segments (first token, token after the last, features)."""
    bounds = [a + m.start() for m in _TOKEN.finditer(text[a:b])] + [b]
    word = _WORD_BEFORE.search(text[max(0, a - 24) : a])
    hint = _HINTS.get(word[1].lower()) if word else None
    out = []
    for i in range(len(bounds) - 1):
        first = text[bounds[i]]
        if not (first.isalnum() or first in "+("):
            continue
        for j in range(i + 1, min(i + MOST_TOKENS, len(bounds) - 1) + 1):
            s = text[bounds[i] : bounds[j]]
            if s[-1].isalnum() and (len(_digits(s)) >= 4 or "@" in s):
                out.append((i, j, _features(text, bounds[i], bounds[j], hint)))
    return bounds, out


class SemiMarkov:
    """Weights by (type, feature); outside tokens score the weight of ('O', 'token')."""

    def __init__(self, weights: dict[tuple[str, str], float]):
        self.weights = weights

    def scores(self, segments) -> list[tuple[int, int, str, float, list[str]]]:
        w = self.weights
        return [(i, j, k, sum(w.get((k, f), 0.0) for f in fs), fs) for i, j, fs in segments for k in KINDS]

    def decode(self, text: str, a: int, b: int) -> list[tuple[str, int, int]]:
        bounds, segments = _segments(text, a, b)
        if not segments:
            return []
        n, outside = len(bounds) - 1, self.weights.get(("O", "token"), 0.0)
        ending: dict[int, list] = {}
        for x in self.scores(segments):
            if x[3] > outside * (x[1] - x[0]):
                ending.setdefault(x[1], []).append(x)
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for t in range(1, n + 1):
            best[t] = best[t - 1] + outside
            for x in ending.get(t, ()):
                if best[x[0]] + x[3] > best[t]:
                    best[t], back[t] = best[x[0]] + x[3], x
        out, t = [], n
        while t:
            if back[t]:
                out.append((back[t][2], bounds[back[t][0]], bounds[t]))
                t = back[t][0]
            else:
                t -= 1
        return out[::-1]

    def step(self, text: str, run: tuple[int, int], gold: set[tuple[str, int, int]], rate: float, decay: float) -> None:
        """One gradient step on the log-likelihood of a run's gold segmentation."""
        bounds, segments = _segments(text, *run)
        scored = self.scores(segments)
        n, outside = len(bounds) - 1, self.weights.get(("O", "token"), 0.0)
        ending: dict[int, list] = {}
        starting: dict[int, list] = {}
        for x in scored:
            ending.setdefault(x[1], []).append(x)
            starting.setdefault(x[0], []).append(x)
        fore, aft = [0.0] * (n + 1), [0.0] * (n + 1)
        for t in range(1, n + 1):
            fore[t] = _lse([fore[t - 1] + outside, *(fore[x[0]] + x[3] for x in ending.get(t, ()))])
        for t in range(n - 1, -1, -1):
            aft[t] = _lse([aft[t + 1] + outside, *(aft[x[1]] + x[3] for x in starting.get(t, ()))])
        w, covered = self.weights, 0.0
        for i, j, k, s, fs in scored:
            p = math.exp(min(0.0, fore[i] + s + aft[j] - fore[n]))
            g = ((k, bounds[i], bounds[j]) in gold) - p
            covered += g * (j - i)
            if abs(g) > 1e-6:
                for f in fs:
                    w[k, f] = w.get((k, f), 0.0) * decay + rate * g
        w["O", "token"] = outside - rate * 0.1 * covered


def _lse(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


def _examples(seed: int, n: int) -> list[tuple[str, set[tuple[str, int, int]]]]:
    """Lines of filler with entities (gold spans) and look-alikes: dates, versions, prices, hashes, other long numbers."""
    r = random.Random(seed)
    word = lambda lo=2, hi=9: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(lo, hi)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card(valid: bool) -> str:
        body = r.choice("3456") + num(r.choice([14, 14, 14, 15, 17]))
        check = next(c for c in "0123456789" if luhn(body + c))
        full = body + (check if valid else str((int(check) + r.randint(1, 9)) % 10))
        cut = r.choice(["", "", " ", "-"])
        return cut.join(full[k : k + 4] for k in range(0, len(full), 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return r.choice([f"+{r.randint(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"{a}.{b}.{c}", f"+{num(11)}"])

    email = lambda: f"{word()}{r.choice(['', '.' + word(), num(2), '_' + word()])}@{word()}.{r.choice(['com', 'org', 'net', 'example.com', 'co.uk'])}"
    ip = lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))
    decoys = [lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{r.randint(10, 28)}.{r.randint(10, 12)}.{r.randint(1900, 2030)}", lambda: f"v{r.randint(1, 30)}.{r.randint(0, 99)}.{r.randint(0, 9999)}", lambda: num(r.choice([4, 5, 6, 8, 9, 10, 12])), lambda: f"{num(3)},{num(3)}.{num(2)}", lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40]))), lambda: card(False), lambda: f"{r.randint(256, 999)}.{r.randint(256, 999)}.{num(3)}.{num(2)}", lambda: f"@{word()}", lambda: f"{word()}@{word()}", lambda: f"#{num(6)}-{num(2)}"]
    out = []
    for _ in range(n):
        text, gold = f"{word()} {word()} ", set()
        for _ in range(r.randint(1, 2)):
            if r.random() < 0.5:
                kind = r.choice(KINDS)
                if r.random() < 0.15:
                    text += r.choice([h for h, k in _HINTS.items() if k == kind]) + r.choice([" ", ": "])
                s = {"email": email, "ip": ip, "card": lambda: card(True), "phone": phone}[kind]()
                gold.add((kind, len(text), len(text) + len(s)))
            else:
                s = r.choice(decoys)()
            text += s + r.choice([" ", " ", ". ", ", "]) + word() + " "
        out.append((text, gold))
    return out


@lru_cache(maxsize=4)
def train(seed: int = 11, n: int = 700, epochs: int = 5) -> SemiMarkov:
    model = SemiMarkov({("O", "token"): 0.0})
    examples = _examples(seed, n)
    for e in range(epochs):
        for text, gold in examples:
            for run in runs(text):
                model.step(text, run, gold, 0.3 / (1 + e), 1 - 1e-4)
    return model


class Taken:
    """Base spans of all kinds, overlapping ones as one, for the question whether a stretch touches or lies in one."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted((a, b) for _, a, b in spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touches(self, a: int, b: int) -> bool:
        k = bisect_right(self.ends, a)
        return k < len(self.starts) and self.starts[k] < b

    def covers(self, a: int, b: int) -> bool:
        k = bisect_right(self.ends, a)
        return k < len(self.starts) and self.starts[k] <= a and b <= self.ends[k]


def find_spans(text: str, model: SemiMarkov) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base): every base match, and the field's segments that overlap none."""
    base = base_matches(text)
    out = [(*x, True) for x in base]
    taken = Taken(base)
    for run in runs(text):
        if taken.covers(*run) or len(_digits(text[run[0] : run[1]])) < 4 and "@" not in text[run[0] : run[1]]:
            continue
        out += [(k, a, b, False) for k, a, b in model.decode(text, *run) if not taken.touches(a, b)]
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


def _annotator(model: SemiMarkov) -> Callable[[], Callable[[pa.Array], list]]:
    def make():
        def run(texts: pa.Array) -> list:
            return [[[{"kind": k, "start": a, "end": b, "base": s} for k, a, b, s in find_spans(t or "", model)] for t in texts.to_pylist()]]

        return run

    return make


def find_pii(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``pii``, an array of (kind, start, end, base) in code points, end exclusive, by kind then start.

    A null text counts as empty and has none; repeated rows are each reported.
    """
    return annotate(docs, text, _annotator(train()), [field("pii", "array<struct<kind:string,start:long,end:long,base:boolean>>")], keep)


def mask(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with each span as its kind in square brackets; of overlapping spans the one that starts first (then the longest) counts."""
    pieces, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            pieces += [text[at:a], f"[{kind.upper()}]"]
            at = b
        elif b > at:
            at = b
    return "".join(pieces) + text[at:]


def mask_pii(docs: DataFrame, *, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with all its columns and rows, personal data in ``text`` masked and ``length`` (where it is a column) made right.

    A null text stays null (its length too), an empty one empty; repeated rows are each masked, and alike; an empty table stays empty.
    """
    model, counted = train(), length in docs.columns

    def make():
        def run(texts: pa.Array) -> list:
            out = [None if t is None else mask(t, s) if (s := find_spans(t, model)) else t for t in texts.to_pylist()]
            return [out, [None if t is None else len(t) for t in out]] if counted else [out]

        return run

    fields = [field(text, "string"), *([field(length, "long")] if counted else [])]
    return annotate(docs, text, make, fields, docs.columns).select(*[F.col(f"`{c}`") for c in docs.columns])


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("pii", lambda s: (s["kind"] == k) & s["base"])).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(_joined(F.filter("pii", lambda s: s["base"])), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"))
