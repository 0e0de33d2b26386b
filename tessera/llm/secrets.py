"""Secret scan with a recursive decoding worklist.

Every text is a first layer. Encoded segments of a layer (escapes, base64, compressed bytes) are decoded into new layers,
escapes within escapes in one step, each with a map back to the code points of the original text, until no new layer appears. A layer
already seen at the same place is not opened again, so cycles end. Each layer is scanned by the same rules.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._arrow import annotate, field

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

_ESCAPED = re.compile(r"%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}")
_BEGINS = re.compile(r"[%\\]")
_HEX_DIGITS = frozenset("0123456789abcdefABCDEF")
#: Escapes as (kind, characters, how they begin).
_FORMS = (("percent", 3, "%"), ("escape", 4, "\\x"), ("escape", 6, "\\u"))
_WIDEST = 6
_MANY = 4096
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_BETWEEN = re.compile(r"[+/_-]")
_LEAST = 16
_CHUNK = 1 << 16
_DEEPEST = 100
_LARGE = 1 << 20
_BREAKS = b"\n\r\t\0,;<>()[]{}|&?!*#$@^`~"
_NEEDS_DECODING = re.compile(r"%[0-9A-Fa-f]{2}|\\[ux][0-9A-Fa-f]{2}|[A-Za-z0-9+/_-]{16}")


def base_matches(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base rules: per kind leftmost and non-overlapping, failing matches dropped."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


@dataclass
class Layer:
    """A decoded text; ``starts[i]``/``ends[i]`` is what character i covers of the original, or ``at`` what each of them does; all None
    where the layer is the original."""

    text: str
    starts: list[int] | None
    ends: list[int] | None
    chain: tuple[str, ...]
    at: tuple[int, int] | None = None
    forced: tuple[bool, bool] = (False, False)

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.at:
            return self.at
        return (a, b) if self.starts is None else (self.starts[a], self.ends[b - 1])

    def place(self) -> tuple[bytes, int, int]:
        """What a cycle comes back to: the text (its digest) and what it covers of the original."""
        return (hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *self.span(0, len(self.text)))


def _packed(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or (len(data) > 2 and data[0] == 0x78 and (data[0] * 256 + data[1]) % 31 == 0)


def _inflated(pieces: Iterator[bytes], most: int) -> Iterator[bytes]:
    """What zlib or gzip members in a row hold, at most ``most`` bytes at a time; of a broken one, what comes before the fault."""
    unpack, left = None, b""
    for chunk in (piece[k : k + _CHUNK] for piece in pieces for k in range(0, len(piece), _CHUNK)):
        left += chunk
        while left:
            if unpack is None:
                if len(left) < 3:
                    break
                if not _packed(left):
                    return
                unpack = zlib.decompressobj(47)
            try:
                out = unpack.decompress(left, most)
                left = unpack.unconsumed_tail
                while out:
                    yield out
                    # all is read, but output may still be held back
                    out = b"" if unpack.eof or left else unpack.decompress(b"", most)
            except zlib.error:
                return
            if unpack.eof:
                unpack, left = None, unpack.unused_data


def _opened(data: bytes, most: int) -> tuple[int, Iterator[bytes]]:
    """How often the bytes are compressed, and what is inside. A stream that holds itself ends at once, one that holds ever
    new streams after ``_DEEPEST``."""

    def at(depth: int) -> Iterator[bytes]:
        return reduce(lambda pieces, _: _inflated(pieces, most), range(depth), iter([data]))

    depth, head, heads = 0, data, set()
    while _packed(head) and head not in heads and depth < _DEEPEST:
        heads.add(head)
        head = next(at(depth + 1), b"")
        if not head:
            break
        depth += 1
    return depth, at(depth)


def _texts(pieces: Iterator[bytes], most: int) -> Iterator[tuple[str, bool, bool]]:
    """The bytes as texts of up to ``most`` bytes, cut behind characters that no rule and no encoding contains. Where a text has
    none, its last quarter is in the next one too; for each text, whether its start and its end are such forced cuts."""
    held, forced = bytearray(), False
    for piece in pieces:
        held += piece
        while len(held) > most:
            cut = max(held.rfind(c, 0, most) for c in _BREAKS) + 1
            yield held[: cut or most].decode("utf-8", "replace"), forced, not cut
            del held[: cut or most - most // 4]
            forced = not cut
    if held:
        yield held.decode("utf-8", "replace"), forced, False


def _base64_bytes(segment: str) -> bytes | None:
    body = segment.rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _text_bytes(data: bytes) -> int:
    """How many of the first bytes are UTF-8."""
    try:
        data.decode("utf-8")
    except UnicodeDecodeError as e:
        return e.start
    return len(data)


def _segments(run: str) -> Iterator[tuple[int, int]]:
    """Where base64 may lie in a run of its letters: the whole, each piece between two of ``+/_-`` (paths, options), and, as
    base64 may hold these itself, from each of them as far as the bytes are text, or to the end if they are compressed."""
    yield 0, len(run)
    body = len(run.rstrip("="))
    cuts = [m.start() for m in _BETWEEN.finditer(run)]
    if not cuts:
        return
    tried = {(0, len(run))}
    starts, ends = [0, *(c + 1 for c in cuts)], [*cuts, len(run)]
    for a, b in zip(starts, ends, strict=True):
        if b - a >= _LEAST:
            tried.add((a, b))
            yield a, b
    within: dict[int, int] = {}
    for a in starts:
        head = _base64_bytes(run[a : a + _LEAST]) if body - a >= _LEAST else None
        # what starts a whole number of letters groups into a segment is a part of it
        if head is None or a < within.get(a % 4, 0):
            continue
        last = len(run) if (body - a) % 4 != 1 else body - 1
        if _packed(head):
            b = last
        elif _text_bytes(head) < len(head) - 3:
            continue
        else:
            data = _base64_bytes(run[a:last]) or b""
            n = _text_bytes(data)
            k = bisect_right(ends, a + -(-n * 4 // 3)) - 1
            while k > 0 and (ends[k] - a) % 4 == 1:
                k -= 1
            b = within[a % 4] = last if n == len(data) else ends[k]
        if b - a >= _LEAST and (a, b) not in tried:
            tried.add((a, b))
            yield a, b


class _Island:
    """Characters around escapes, each with its span. What completes an escape is replaced at once by the character it stands for,
    which may complete another: so nested escapes take one pass, however deep."""

    def __init__(self):
        self.items: list[tuple[str | int, int, int]] = []
        self.heads: list[int] = []  # where escapes may begin
        self.kinds: set[str] = set()

    def open(self, ahead: str) -> bool:
        """Whether the character ahead belongs here: it may go on with an escape, or begins one next to another (bytes of one character
        and surrogates lie side by side). A long row of plain escapes may be parted."""
        if self.heads and len(self.items) - self.heads[-1] < _WIDEST:
            return True
        return ahead in "%\\" and (len(self.items) < _MANY or not isinstance(c := self.items[-1][0], str) or "\ud800" <= c <= "\udfff")

    def push(self, c: str | int, a: int, b: int) -> None:
        while True:
            if c == "%" or c == "\\":
                self.heads.append(len(self.items))
            self.items.append((c, a, b))
            if c not in _HEX_DIGITS or not self.heads or not (found := self._complete(self.heads[-1])):
                return
            kind, c = found
            self.kinds.add(kind)
            at = self.heads.pop()
            a = self.items[at][1]
            del self.items[at:]

    def _complete(self, at: int) -> tuple[str, str | int] | None:
        width, first = len(self.items) - at, self.items[at][0]
        for kind, size, head in _FORMS:
            if width == size and first == head[0] and (len(head) == 1 or self.items[at + 1][0] == head[1]):
                digits = [c for c, _, _ in self.items[at + len(head) :]]
                if all(c in _HEX_DIGITS for c in digits):
                    value = int("".join(digits), 16)
                    return kind, value if kind == "percent" and value > 127 else chr(value)
        return None

    def take(self) -> Iterator[tuple[str, int, int]]:
        """All characters so far: escaped bytes as UTF-8, surrogates in pairs, U+FFFD for what is neither."""
        items, self.items, self.heads = self.items, [], []
        k = 0
        while k < len(items):
            c, a, b = items[k]
            to = k + 1
            if isinstance(c, int):
                while to < len(items) and isinstance(items[to][0], int):
                    to += 1
                c, b = bytes(x[0] for x in items[k:to]).decode("utf-8", "replace"), items[to - 1][2]
            elif "\ud800" <= c <= "\udfff":
                if c < "\udc00" and to < len(items) and isinstance(items[to][0], str) and "\udc00" <= items[to][0] <= "\udfff":
                    c, b = c + items[to][0], items[to][2]
                    to += 1
                c = c.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
            yield from ((x, a, b) for x in c)
            k = to


def _unescaped(layer: Layer) -> Layer | None:
    """The text with percent, backslash-u and backslash-x escapes resolved until none is left; None if there are none."""
    text = layer.text
    if not _ESCAPED.search(text):
        return None
    pieces: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    island, at = _Island(), 0
    while at < len(text):
        m = _BEGINS.search(text, at)
        to = m.start() if m else len(text)
        pieces.append(text[at:to])
        if not layer.at:
            starts += range(at, to) if layer.starts is None else layer.starts[at:to]
            ends += range(at + 1, to + 1) if layer.ends is None else layer.ends[at:to]
        at = to
        while at < len(text) and (at == to or island.open(text[at])):
            island.push(text[at], *layer.span(at, at + 1))
            at += 1
        done = list(island.take())
        pieces.append("".join(c for c, _, _ in done))
        if not layer.at:
            starts += [a for _, a, _ in done]
            ends += [b for _, _, b in done]
    chain = (*layer.chain, "+".join(sorted(island.kinds)))
    return Layer("".join(pieces), None, None, chain, layer.at, layer.forced) if layer.at else Layer("".join(pieces), starts, ends, chain)


def _unwrapped(layer: Layer, most: int) -> Iterator[Layer]:
    """The layers one step below: the text with all escapes resolved, and each base64 segment that holds text."""
    if below := _unescaped(layer):
        yield below
    for m, (a, b) in ((m, s) for m in _BASE64.finditer(layer.text) for s in _segments(m[0])):
        data = _base64_bytes(m[0][a:b])
        if not data:
            continue
        depth, pieces = _opened(data, most)
        if not depth and _text_bytes(data) < len(data):
            continue
        at = layer.span(m.start() + a, m.start() + b)
        for text, *forced in _texts(pieces, most) if depth else [(data.decode("utf-8"), False, False)]:
            yield Layer(text, None, None, (*layer.chain, "base64" + "+inflate" * depth), at, tuple(forced))


def scan(text: str, most: int = 1 << 26) -> list[tuple[str, int, int, str]]:
    """All (kind, start, end, layer chain): base matches have an empty chain; a match of a decoded layer maps to the
    original characters it came from and is left out where a base match of its kind lies in the same place."""
    found = [(k, a, b, "") for k, a, b in base_matches(text)]
    if not _NEEDS_DECODING.search(text):
        return found
    # those of a kind never overlap, so the last one that starts before an end is the only one to look at
    have = {kind: sorted((a, b) for k, a, b, _ in found if k == kind) for kind in KINDS}
    first = Layer(text, None, None, ())
    seen, work = {first.place()}, deque([first])

    def visit(layer: Layer) -> None:
        for below in _unwrapped(layer, most):
            if (place := below.place()) in seen:
                continue
            seen.add(place)
            for kind, a, b in base_matches(below.text):
                # at a forced cut a match may go on; the next text has all of it
                if (below.forced[0] and not a) or (below.forced[1] and b == len(below.text)):
                    continue
                start, end = below.span(a, b)
                at = bisect_left(have[kind], (end,))
                if not at or have[kind][at - 1][1] <= start:
                    have[kind].insert(at, (start, end))
                    found.append((kind, start, end, ">".join(below.chain)))
            # large pieces of a layer don't wait for each other, so that one at a time is held
            if below.at and len(below.text) > _LARGE:
                visit(below)
            else:
                work.append(below)

    while work:
        visit(work.popleft())
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _make(most: int):
    def make():
        def run(texts: pa.Array) -> list:
            return [[[{"kind": k, "start": a, "end": b, "layer": c} for k, a, b, c in scan(t or "", most)] for t in texts.to_pylist()]]

        return run

    return make


def find_secrets(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), most_bytes: int = 1 << 26) -> DataFrame:
    """``keep`` columns and ``secrets``, an array of (kind, start, end, layer) in code points of the original, end exclusive.

    A null text counts as empty and has none. Repeated rows are each reported. Spans from decoded layers carry their chain of
    encodings. Bytes count as text if they are UTF-8; compressed ones (in any depth) are text with odd bytes replaced. A compressed
    layer of over ``most_bytes`` is scanned in pieces; where nothing in a piece ends a run, a match of over a quarter of a piece
    is left out and an encoded segment of over a quarter may be cut in two. Bytes compressed over a hundred times in a row are left
    packed there.
    """
    return annotate(docs, text, _make(most_bytes), [field("secrets", "array<struct<kind:string,start:long,end:long,layer:string>>")], keep)


def span_list(spans, base_only: bool):
    own = F.filter(spans, lambda s: s["layer"] == "") if base_only else spans
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("secrets", lambda s: (s["kind"] == k) & (s["layer"] == ""))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(span_list(F.col("secrets"), True), 256).alias("base_sha256"), span_list(F.col("secrets"), False).alias("spans"))
