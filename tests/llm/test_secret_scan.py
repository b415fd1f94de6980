import base64
import bz2
import gzip
import hashlib
import lzma
import re
import urllib.parse
import zlib

import duckdb
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstack.llm.secret_scan import KINDS, PIECE, redacted, scan, secret_report, secrets

NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def plainly(text):
    """Base finds by reading character by character."""
    out, low = [], "".join(c.lower() if c.isascii() else c for c in text)

    def while_in(at, those):
        while at < len(text) and text[at] in those:
            at += 1
        return at

    def assigned(at):
        for name in NAMES:
            if low.startswith(name, at):
                p = at + len(name)
                p += text[p : p + 1] in ("'", '"') and p < len(text)
                p = while_in(p, " ")
                if text[p : p + 1] not in (":", "=") or p >= len(text):
                    return None
                p = while_in(p + 1, " ")
                p += text[p : p + 1] in ("'", '"') and p < len(text)
                stop = while_in(p, VALUE)
                return (stop, stop - p) if stop > p else None
        return None

    def runs(name, match, least):
        at = 0
        while at < len(text):
            found = match(at)
            if found is None:
                at += 1
                continue
            if found[1] >= least:
                out.append((at, [k for k, *_ in KINDS].index(name), found[0], name))
            at = found[0]

    capital = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    runs("assign", assigned, 6)
    runs("access", lambda at: (s, s - at) if text.startswith("AKIA", at) and (s := while_in(at + 4, capital)) > at + 4 else None, 20)
    runs("hex", lambda at: (s, s - at) if (s := while_in(at, set("0123456789abcdef"))) > at else None, 24)
    return [(k, a, b) for a, _, b, k in sorted(out)]


def base(text):
    return [(KINDS[f.kind][0], f.start, f.stop) for f in scan(text) if not f.how]


PARTS = ["password", "Token", "api_key", "APIKEY", "'", '"', " ", ":", "=", "abc", "AKIA", "ABCDEFGHIJKLMNOPQ", "0123456789abcdef01234567", "deadbeef", "é", "Key", "ſecret", "\n", "%3D", "_", "."]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_base_finds(text):
    assert base(text) == plainly(text)


SECRET = 'password = "hunter2-Xyzzy"'


def utf8(f):
    return lambda s: f(s.encode())


def b64(raw):
    return base64.b64encode(raw).decode()


WRAPS = {
    "url": lambda s: "".join(f"%{ord(c):02X}" for c in s),
    "partly url": lambda s: urllib.parse.quote(s),
    "unicode": lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    "braces": lambda s: "".join(f"\\u{{{ord(c):x}}}" for c in s),
    "long unicode": lambda s: "".join(f"\\U{ord(c):08x}" for c in s),
    "bytes": lambda s: "".join(f"\\x{ord(c):02x}" for c in s),
    "json in json": lambda s: "".join(f"\\\\u{ord(c):04x}" for c in s),
    "base64": utf8(b64),
    "url-safe": utf8(lambda r: base64.urlsafe_b64encode(r).decode()),
    "utf16": lambda s: b64(s.encode("utf-16le")),
    "gzip": utf8(lambda r: b64(gzip.compress(r))),
    "zlib": utf8(lambda r: b64(zlib.compress(r))),
    "bz2": utf8(lambda r: b64(bz2.compress(r))),
    "xz": utf8(lambda r: b64(lzma.compress(r))),
    "zstd": utf8(lambda r: b64(zstandard.compress(r))),
}


@pytest.mark.parametrize("outer", [None, *WRAPS])
@pytest.mark.parametrize("inner", WRAPS)
def test_two_layers(inner, outer):
    wrapped = WRAPS[inner](SECRET)
    wrapped = WRAPS[outer](wrapped) if outer else wrapped
    for before, after in (("said: ", ", ok"), ("é😀 (", ")"), ("path/x", "\n")):
        text = before + wrapped + after
        found = [f for f in scan(text) if f.how and KINDS[f.kind][0] == "assign"]
        assert found, text
        assert all(len(before) <= f.start < f.stop <= len(before) + len(wrapped) for f in found)
        assert base(text) == plainly(text)


def test_spans_are_exact_without_compression():
    text = "a, " + WRAPS["url"](SECRET[:-1]) + ", b"
    assert [(f.start, f.stop, f.how) for f in scan(text)] == [(3, len(text) - 3, "url")]
    value = "token: abcdefgh"
    text = b64(b"..." + value.encode() + b"   ")
    (f,) = scan(text)
    assert (f.start, f.stop, f.how) == (4, 24, "base64") and base64.b64decode(text[f.start : f.stop]) == value.encode()
    lines = base64.encodebytes(b"x" * 50 + b" " + SECRET.encode() + b" " + b"y" * 60).decode()
    assert any(base64.b64decode(re.sub(r"\s", "", lines)).find(b"password") * 4 // 3 <= f.start for f in scan(lines) if KINDS[f.kind][0] == "assign")


def test_cycles_bombs_and_broken_streams():
    assert [f.how for f in scan("%25" * 500 + "20token%3Dabcdef")] == ["url"]
    assert scan("\\u005cu005cu005cu005cu0074oken") == []
    bomb = b64(zlib.compress(b"\0" * (3 * PIECE) + SECRET.encode() + b"\0" * PIECE))
    assert [(f.start, f.how) for f in scan(bomb)] == [(0, "base64>compressed")]
    torn = b64(gzip.compress(SECRET.encode() + bytes(range(256)) * 40)[:-30])
    assert any(f.how.endswith("compressed") for f in scan(torn))
    again = SECRET
    for _ in range(12):
        again = b64(zlib.compress(again.encode()))
    assert any(f.how.count("compressed") == 12 for f in scan(again))


def test_clean_texts_have_no_finds():
    clean = "The quick brown fox, 100% sure; internationalization\\of\\unusual\\words https://example.org/a%20b?q=c%2Bd and dGhpcyBpcyBub3RoaW5nIHNwZWNpYWw=."
    assert scan(clean) == []


ROWS = [(1, SECRET), (1, SECRET), (2, None), (3, ""), (None, "token=abcdefg"), (4, "x " + WRAPS["gzip"](SECRET)), (5, "AKIA" + "%41" * 16), (6, "\x00é token='abcdef12' " + "0a" * 12), (7, "plain")]


def test_report(docs):
    got = secret_report(docs(*ROWS))
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"}
    want = []
    for i, t in ROWS:
        own = plainly(t or "")
        spans = ",".join(f"{KINDS[f.kind][0]}:{f.start}:{f.stop}" for f in scan(t or ""))
        want.append((i, *(sum(k == kind for k, *_ in own) for kind, *_ in KINDS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in own).encode()).hexdigest(), spans))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert secret_report(docs()).count() == 0


def test_redacted(docs):
    got = {r.doc_id: r[1] for r in secrets(docs(*ROWS)).select("doc_id", redacted("#")).collect()}
    assert got[1] == '#"' and got[2] == "" and got[None] == "#" and got[7] == "plain" and got[5] == "#"
    assert got[6] == "\x00é #' #" and got[4].startswith("x #")


def test_odd_and_long(docs, odd):
    rows = [*odd, (70, "lorem ipsum, " * 400_000 + SECRET), (71, "f" * 2_000_000)]
    got = {r.doc_id: r for r in secret_report(docs(*rows)).collect()}
    assert len(rows) == 10 and got[70].n_assign == 1 and got[71].spans == "hex:0:2000000"
    assert got[7].spans == got[1].spans == ""


def test_whole_table(spark):
    """Counts on the test table against DuckDB's own expressions."""
    path = "/root/testdata/sf0.01/documents.parquet"
    got = {(r.doc_id, r.n_hex, r.n_access) for r in secret_report(spark.read.parquet(path)).collect()}
    count = lambda pattern: f"len(regexp_extract_all(coalesce(text, ''), '{pattern}'))"
    want = duckdb.sql(f"SELECT doc_id, {count('[0-9a-f]{24,}')}, {count('AKIA[A-Z0-9]{16,}')} FROM '{path}'").fetchall()
    assert got == set(want) and sum(r[1] for r in want) > 0
