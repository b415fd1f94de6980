"""Secrets in texts and in what texts have wrapped: a recursive decoding worklist.

Three kinds are looked for: assignments to names such as ``password`` or ``token``, access key ids,
and long hexadecimal runs.  They are found in the text itself first (base finds, leftmost and without
overlap for each kind).  Then a worklist of layers is unwrapped until nothing is left:

* *url*: %XX escapes, *unicode*: \\uXXXX, \\u{X}, \\UXXXXXXXX and \\xXX escapes.  Matches of every kind
  and escapes are made of a small alphabet, so a stretch of it is a layer of its own, and a long
  text costs no more than its stretches with escapes.  Escapes nested in themselves
  (%252525..., \\u005cu005c...) are undone in one step.
* *base64*: runs of 16 letters or more of either alphabet, also over lines of equal width, decoded
  at all four alignments, as a run may have grown together with what stands before it.  A layer of
  bytes that is UTF-16 is read without its zero bytes, too.
* *compressed*: gzip, zlib, bz2, xz and zstd streams in decoded bytes, however much of them is sound.
  Output comes in pieces of ``PIECE`` bytes that overlap by ``OVERLAP``, so a bomb takes time and not memory.

Bytes are read as one character each, which is enough since all patterns are ASCII.  Each layer
carries, for each of its characters, the span of the original text that it came from, so finds in a
layer are spans of the text; what is compressed maps to the whole run it stands in.  A layer is
scanned and unwrapped in its turn unless the same content came from the same span before (a
cycle: a stream may decompress to itself).

Finds are added to the base ones, never taken for them.  Rows are independent: no shuffle; a task
holds one slice of texts and one worklist.

Edge cases: a null text counts as empty and has no finds; null ids and repeated rows are rows like
others; within a compressed layer of more than ``PIECE`` bytes a find longer than ``OVERLAP`` may be missed
where pieces meet; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, whole_text
from .tokens import slices

PIECE, OVERLAP = 8 << 20, 64 << 10
#: kind, pattern, group whose length counts, least length; in the order that breaks ties
KINDS = [
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]
#: what a text must hold to have base finds, or layers, in the syntax of Arrow's expressions; each may hold too often
_GATES = [r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", r"AKIA[A-Z0-9]{16}", r"[0-9a-f]{24}"]
_WRAPPED = r"%[0-9A-Fa-f]{2}|\\+(?:[uU][0-9A-Fa-f]{4}|u\{|x[0-9A-Fa-f]{2})|[A-Za-z0-9+/_-]{16}"
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")  # as its kind, without stopping at each short run
_URL = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
_UNICODE = re.compile(r"\\+(?:u(?:005[cC]u)*(?:([0-9A-Fa-f]{4})|\{0*([0-9A-Fa-f]{1,6})\})|U00([0-9A-Fa-f]{6})|x([0-9A-Fa-f]{2}))")
_STRETCH = re.compile(r"[A-Za-z0-9+/_.=\"' :%\\{}-]+")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
_LINES = re.compile(r"(?:[A-Za-z0-9+/_-]{60,76}\r?\n)+[A-Za-z0-9+/_-]{1,76}")
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
_STANDARD = str.maketrans("-_", "+/")


class Find(NamedTuple):
    start: int
    kind: int
    stop: int
    how: str  # the layers it was under, outermost first; empty: in the text itself


class Layer(NamedTuple):
    """text[i] came from the original's lo[i] .. hi[i]."""

    text: str
    lo: np.ndarray
    hi: np.ndarray
    how: str


def matches(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, stop) of what stands in the text as it is."""
    for k, (_, pattern, group, least) in enumerate(KINDS):
        for m in (_LONG_HEX if k == 2 else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                yield k, m.start(), m.end()


def _replaced(layer: Layer, pattern: re.Pattern, value, how: str) -> Iterator[Layer]:
    """Each stretch with its escapes undone. Value: the characters that a match stands for, or None."""
    if not pattern.search(layer.text):
        return
    for stretch in _STRETCH.finditer(layer.text):
        text, lo, hi, at, base = [], [], [], stretch.start(), stretch.start()
        own = stretch.group()
        for m in pattern.finditer(own):
            if (new := value(m)) is None:
                continue
            a, b = base + m.start(), base + m.end()
            text += [layer.text[at:a], new]
            lo += [layer.lo[at:a], np.full(len(new), layer.lo[a])]
            hi += [layer.hi[at:a], np.full(len(new), layer.hi[b - 1])]
            at = b
        if text:
            end = stretch.end()
            yield Layer("".join(text) + layer.text[at:end], np.concatenate([*lo, layer.lo[at:end]]), np.concatenate([*hi, layer.hi[at:end]]), _under(layer, how))


def _under(layer: Layer, how: str) -> str:
    return f"{layer.how}>{how}" if layer.how else how


def _code_point(m: re.Match) -> str | None:
    code = int(next(filter(None, m.groups())), 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _bytes_of(layer: Layer) -> Iterator[Layer]:
    """What base64 runs hold."""
    runs = [(m.group(), m.start(), None) for m in _RUN.finditer(layer.text)]
    for m in _LINES.finditer(layer.text):
        places = np.array([i for i, c in enumerate(m.group()) if c not in "\r\n"])
        runs.append((re.sub(r"[\r\n]", "", m.group()), m.start(), places))
    for run, start, places in runs:
        run = run.translate(_STANDARD)
        for skip in range(4):
            part = run[skip:]
            part = part[: len(part) - (len(part) % 4 == 1)]
            if len(part) < 8:
                continue
            raw = binascii.a2b_base64(part + "=" * (-len(part) % 4))
            i = np.arange(len(raw))
            first, last = skip + i * 4 // 3, skip + np.minimum((i * 8 + 7) // 6, len(part) - 1)
            if places is not None:
                first, last = places[first], places[last]
            yield Layer(raw.decode("latin-1"), layer.lo[start + first], layer.hi[start + last], _under(layer, "base64"))


def _narrow(layer: Layer) -> Iterator[Layer]:
    """UTF-16 text without its zero bytes."""
    if 0 < len(layer.text) <= 3 * layer.text.count("\0") and layer.text.strip("\0"):
        keep = np.flatnonzero(np.frombuffer(layer.text.encode("latin-1", "replace"), np.uint8))
        yield Layer(layer.text.replace("\0", ""), layer.lo[keep], layer.hi[keep], _under(layer, "utf16"))


def _pieces(raw: memoryview) -> Iterator[bytes]:
    """Output of the stream that raw begins with, at most ``PIECE`` bytes at a time; an error where it stops being sound."""
    head = bytes(raw[:4])
    if head == b"\x28\xb5\x2f\xfd":
        reader = zstandard.ZstdDecompressor().stream_reader(raw)
        while out := reader.read(PIECE):
            yield out
        return
    opened = bz2.BZ2Decompressor() if head.startswith(b"BZh") else lzma.LZMADecompressor() if head.startswith(b"\xfd7z") else zlib.decompressobj(31 if head.startswith(b"\x1f\x8b") else 15)
    for at in range(0, len(raw), 1 << 10):  # what is sound before an error is not lost with a larger step
        todo = raw[at : at + (1 << 10)]
        while not opened.eof:
            out = opened.decompress(todo, PIECE)
            todo = getattr(opened, "unconsumed_tail", b"")
            yield out
            if not todo and (len(out) < PIECE or getattr(opened, "needs_input", True)):
                break
    if hasattr(opened, "flush"):
        yield opened.flush()


def unpacked(raw: memoryview) -> Iterator[bytes]:
    """Output in pieces of ``PIECE`` bytes or a little more, as far as it is sound; each begins with the end of the one before."""
    held = bytearray()
    try:
        for out in _pieces(raw):
            held += out
            if len(held) >= PIECE:
                yield bytes(held)
                del held[:-OVERLAP]
    except (zlib.error, lzma.LZMAError, zstandard.ZstdError, OSError, EOFError, ValueError):
        pass
    if held:
        yield bytes(held)


def _decompressed(layer: Layer) -> Iterator[Layer]:
    try:
        raw = layer.text.encode("latin-1")
    except UnicodeEncodeError:
        return
    for s in (m.start() for m in _MAGIC.finditer(raw)):
        for piece in unpacked(memoryview(raw)[s:]):
            lo, hi = np.broadcast_to(layer.lo[s], len(piece)), np.broadcast_to(layer.hi[-1], len(piece))
            yield Layer(piece.decode("latin-1"), lo, hi, _under(layer, "compressed"))


def unwrapped(layer: Layer, with_bytes: bool) -> Iterator[Layer]:
    yield from _replaced(layer, _URL, lambda m: chr(int(m[1], 16)), "url")
    yield from _replaced(layer, _UNICODE, _code_point, "unicode")
    yield from _bytes_of(layer)
    if with_bytes:
        yield from _narrow(layer)
        yield from _decompressed(layer)


def scan(text: str, wrapped: bool = True) -> list[Find]:
    """All finds, by start, kind and stop; of equal spans the one under the fewest layers."""
    found = {(k, a, b): "" for k, a, b in matches(text)}
    if wrapped:
        places = np.arange(len(text) + 1, dtype=np.int32)
        # a stack of layers being unwrapped: one layer of each depth is held, however many there are
        todo, seen = [unwrapped(Layer(text, places[:-1], places[1:], ""), False)], set()
        while todo:
            inner = next(todo[-1], None)
            if inner is None:
                todo.pop()
                continue
            if not inner.text:
                continue
            key = (hashlib.blake2b(inner.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), int(inner.lo[0]), int(inner.hi[-1]))
            if key in seen:
                continue
            seen.add(key)
            for k, a, b in matches(inner.text):
                span = (k, int(inner.lo[a]), int(inner.hi[b - 1]))
                if span not in found or inner.how.count(">") < found[span].count(">"):
                    found[span] = inner.how
            todo.append(unwrapped(inner, True))
    return sorted(Find(a, k, b, how) for (k, a, b), how in found.items())


FOUND = "array<struct<kind:string,start:int,stop:int,how:string>>"


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and found: kind, span in code points, and the layers it was under (empty: base find)."""
    inside = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("how", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").cast(pa.large_string())
                plain, wrapped = pc.match_substring_regex(texts, "|".join(_GATES)), pc.match_substring_regex(texts, _WRAPPED)
                found: list[list[dict]] = [[]] * part.num_rows
                for i in np.flatnonzero(pc.or_(plain, wrapped).to_numpy(zero_copy_only=False)).tolist():
                    found[i] = [{"kind": KINDS[f.kind][0], "start": f.start, "stop": f.stop, "how": f.how} for f in scan(texts[i].as_py(), wrapped[i].as_py())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, inside)], ["doc_id", "text", "found"])

    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    return map_arrow(rows, run, f"doc_id {rows.schema[0].dataType.simpleString()}, text string, found {FOUND}")


def redacted(mask: str = "[secret]") -> Column:
    """The text of rows of ``secrets`` with each stretch that finds cover replaced by the mask."""
    seed = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(so_far: Column, f: Column) -> Column:
        fresh = f["start"] >= so_far["at"]
        piece = F.concat(F.col("text").substr(so_far["at"] + 1, f["start"] - so_far["at"]), F.lit(mask))
        out = F.when(fresh, F.concat(so_far["out"], F.array(piece))).otherwise(so_far["out"])
        return F.struct(F.greatest(so_far["at"], f["stop"]).alias("at"), out.alias("out"))

    done = F.aggregate("found", seed, step)
    return F.concat(F.array_join(done["out"], ""), F.col("text").substr(done["at"] + 1, F.length("text")))


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base finds, and all spans, of each document."""
    found = secrets(docs).select("doc_id", "found")
    base = F.filter("found", lambda f: f["how"] == "")
    joined = lambda x: F.array_join(F.transform(x, lambda f: F.concat_ws(":", f["kind"], f["start"], f["stop"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k, *_ in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
