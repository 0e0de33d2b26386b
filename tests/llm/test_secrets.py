import base64
import gzip
import random
import re
import time
import urllib.parse
import zlib

from tessera.llm.secrets import KINDS, Layer, _unescaped, base_matches, find_secrets, scan

SECRET = "password = hunter22secret"


def plain(t):
    out = [("assign", *m.span()) for m in re.finditer(r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def test_base_rules_equal_plain_patterns():
    r = random.Random(4)
    parts = ["token", "=", ": ", "AKIA", "ABCD1234", "0123456789abcdef", '"', "x", " ", "API_key", "'", "%41", "\\u0041", "ſecret", "toKen"]
    for _ in range(4000):
        t = "".join(r.choice(parts) for _ in range(r.randint(1, 30)))
        assert base_matches(t) == plain(t), t


def test_layers_are_unwrapped_and_mapped():
    b64 = lambda b: base64.b64encode(b).decode()
    forms = [urllib.parse.quote(SECRET), "".join(f"\\u{ord(c):04x}" for c in SECRET), b64(SECRET.encode()), b64(zlib.compress(SECRET.encode())), b64(b64(zlib.compress(urllib.parse.quote(SECRET).encode())).encode())]
    for form in forms:
        found = [x for x in scan(f"abc {form} def") if x[0] == "assign"]
        assert len(found) == 1 and 4 <= found[0][1] < found[0][2] <= 4 + len(form) and found[0][3]


def test_loops_and_bombs_end():
    assert scan("%2525252541" * 50) == []
    bomb = base64.b64encode(zlib.compress(b"a" * (1 << 22))).decode()
    assert scan(bomb, most=1 << 20) == []


def test_nested_escapes_take_time_in_proportion():
    for form in ("%" + "25" * 500_000 + "41", "\\x5c" + "x5c" * 300_000 + "x41", "\\u005c" + "u005c" * 200_000 + "u0041"):
        began = time.time()
        below = _unescaped(Layer("a " + form + " b", None, None, ()))
        assert below.text == "a A b" and below.span(2, 3) == (2, 2 + len(form)) and time.time() - began < 15
    assert _unescaped(Layer("100% of \\d and %zz", None, None, ())) is None


def plain_unescape(text):
    """One escape after another, the first that is complete, until none is left."""
    while True:
        m = min((m for m in (re.search(p, text) for p in (r"%[0-7][0-9A-Fa-f]", r"\\u00[0-7][0-9A-Fa-f]", r"\\x[0-7][0-9A-Fa-f]")) if m), key=lambda m: m.end(), default=None)
        if not m:
            return text
        text = text[: m.start()] + chr(int(m[0].lstrip("%\\ux"), 16)) + text[m.end() :]


def test_escapes_equal_a_plain_rewriting():
    r = random.Random(12)
    for _ in range(4000):
        t = "".join(r.choice(["%", "25", "41", "5c", "\\", "x", "u", "00", "a", " ", "3", "%35", "\\x41", "\\u0025"]) for _ in range(r.randint(1, 20)))
        below = _unescaped(Layer(t, None, None, ()))
        if below and not below.text.isascii():
            continue
        assert (below.text if below else t) == plain_unescape(t), t
        if below:
            assert all(a < b for a, b in zip(below.starts, below.ends)) and all(b <= a for b, a in zip(below.ends, below.starts[1:])), t
    assert _unescaped(Layer("%E4%B8%AD \\ud83d\\ude00 %ff", None, None, ())).text == "中 😀 \ufffd"


def unwrapped_plainly(form):
    """All texts a form holds, by a plain recursion without worklist, spans or cycles."""
    out = [form]
    loose = urllib.parse.unquote(re.sub(r"\\u([0-9a-f]{4})", lambda m: chr(int(m[1], 16)), form))
    if loose != form:
        out += unwrapped_plainly(loose)
    try:
        data = base64.b64decode(form, validate=True)
        while data[:2] == b"\x1f\x8b" or data[:1] == b"x":
            data = zlib.decompress(data, 47)
        out += unwrapped_plainly(data.decode())
    except (ValueError, zlib.error):
        pass
    return out


def test_random_nestings_equal_a_plain_recursion():
    r = random.Random(7)
    b64 = lambda b: base64.b64encode(b).decode()
    wraps = [lambda t: urllib.parse.quote(t, safe=""), lambda t: "".join(f"\\u{ord(c):04x}" for c in t), lambda t: b64(t.encode()), lambda t: b64(zlib.compress(t.encode())), lambda t: b64(gzip.compress(zlib.compress(t.encode()), mtime=0))]
    secrets = [SECRET, "see AKIA" + "Q7" * 10, "0123456789abcdef" * 2]
    for _ in range(200):
        forms = []
        for _ in range(r.randint(1, 3)):
            form = r.choice(secrets)
            for _ in range(r.randint(1, 4)):
                form = r.choice(wraps)(form)
            forms.append(form)
        text = " , ".join(forms)
        found, at = scan(text), 0
        for form in forms:
            kinds = {k for t in unwrapped_plainly(form) for k, _, _ in base_matches(t)}
            assert kinds and kinds == {k for k, a, b, _ in found if at <= a and b <= at + len(form)}, form
            at += len(form) + 3


def test_equal_segments_at_other_places_are_reported_too():
    for data in (SECRET.encode(), zlib.compress(SECRET.encode())):
        form = base64.b64encode(data).decode()
        text = f"one {form} two {form} three {form}"
        assert [x[1:3] for x in scan(text)] == [m.span() for m in re.finditer(re.escape(form), text)]


def test_segments_in_assignments_queries_and_paths():
    slashed = base64.b64encode("é?~?~?> ".encode() + SECRET.encode()).decode()
    assert re.search("[+/]", slashed)
    for form in (base64.b64encode(SECRET.encode()).decode(), slashed, base64.b64encode(zlib.compress(SECRET.encode())).decode(), base64.urlsafe_b64encode("~?~?é ".encode() + SECRET.encode()).decode()):
        for before, after in (("data=", ""), ("https://a.example/?d=", "&y=1"), ("KEY=", "\n"), ("https://a.b/", ""), ("x/some-path/of_it/", " "), ("https://a.b/", "/get-it"), ("a=", "=b")):
            found = [x for x in scan(before + form + after) if x[0] == "assign" and x[3]]
            assert found, (before, form, after)
            assert found[0][1] < len(before + form) and len(before) < found[0][2]


def test_long_runs_of_letters_end():
    r = random.Random(6)
    run = "".join(r.choice("ABCDEFGHIJabcdefghij0123456789+/_-") for _ in range(200_000))
    assert scan(run) == []
    assert scan("enp6" * 20_000 + "/" + "Yf8v" * 20_000) == []


def test_layers_are_opened_to_the_end():
    b64 = lambda b: base64.b64encode(b).decode()
    packed = gzip.compress(SECRET.encode())
    for data in (gzip.compress(packed), zlib.compress(packed), gzip.compress(zlib.compress(packed)), gzip.compress(b"first ") + packed):
        assert [x[:3] for x in scan(b64(data))] == [("assign", 0, len(b64(data)))]
    for odd in ("\u00a0", "\u200d", "\f", "\x1b[0m"):
        assert [x[0] for x in scan(b64(f"le {odd} {SECRET}".encode()))] == ["assign"], odd
    assert [x[0] for x in scan(b64(("x^2 " + SECRET).encode()))] == ["assign"]


def test_large_layers_are_scanned_in_pieces():
    r = random.Random(9)
    for k in range(40):
        noise = lambda n: "".join(r.choice("ghijklmnop, \n") for _ in range(n))  # noqa: B023, E731
        inner = base64.b64encode(SECRET.encode()).decode() if k % 2 else SECRET
        data = (noise(3000 + 37 * k) + "\n" + inner + "\n" + noise(5000)).encode()
        form = base64.b64encode(zlib.compress(data)).decode()
        assert [x[:3] for x in scan(form, most=1 << 10)] == [("assign", 0, len(form))]
    solid = zlib.compress(b"z" * 5000 + b" AKIA" + b"Q7" * 10 + b"." + b"z" * 5000)
    assert [x[0] for x in scan(base64.b64encode(solid).decode(), most=1 << 10)] == ["access"]


def test_odd_rows_and_empty_tables(odd_docs, no_docs):
    assert find_secrets(odd_docs).count() == 9 and find_secrets(no_docs).count() == 0
